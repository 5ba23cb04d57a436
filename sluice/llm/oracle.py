"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from .mixing import SCHEDULES, WEIGHTS

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _positions() -> str:
    cases = []
    for turn, phases in enumerate(SCHEDULES):
        before, total, n = 0.0, sum(phases), len(phases)
        for i, m in enumerate(phases):
            start, stop = f"target * {before / total!r}::DOUBLE", f"target * {(before + m) / total!r}::DOUBLE"
            cases.append(f"WHEN turn = {turn} AND off < {stop} THEN {i / n!r}::DOUBLE + (off - {start}) / ({stop} - {start}) / {float(n)!r}::DOUBLE")
            before += m
    return "CASE " + " ".join(cases) + " END"


_MIX = f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
ranked AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS turn FROM sized GROUP BY source),
weighed AS (SELECT *, {list(WEIGHTS)!r}[turn + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked),
sorted AS (SELECT *, cap / weight AS ratio FROM weighed),
shared AS (SELECT *, (SELECT sum(source_size) FROM ranked)::DOUBLE * 1.5 - (sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap) AS remaining,
  sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM sorted),
levelled AS (SELECT *, CASE WHEN ratio > remaining / open THEN remaining / open END AS level FROM shared),
firsts AS (SELECT *, first_value(level IGNORE NULLS) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS fair FROM levelled),
targets AS (SELECT source, source_size, turn, CASE WHEN fair IS NULL THEN cap ELSE fair * weight END AS target FROM firsts),
placed AS (SELECT doc_id, size, source_size, target, turn, sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS off
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taking AS (SELECT *, (greatest(0, least(size, floor(target)::BIGINT - off)) + greatest(0, least(size, floor(target)::BIGINT - source_size - off)))::BIGINT AS taken FROM placed)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round({_positions()}, 9) END AS position FROM taking
"""

_LINES = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (SELECT doc_id, i, lines[i] AS line, {_LOWER.format(f"trim(lines[i], {_SPACE})")} AS key FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM cut)),
frequent AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.doc_id, k.i, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""

_EXACT = f"""
WITH normal AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM normal WINDOW w AS (PARTITION BY t)
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to FROM g
"""

ORACLE_SQL = {"op4_line_dedup": _LINES, "op5_mixing": _MIX, "op6_warc": _WARC, "op7_exact_dedup": _EXACT}
