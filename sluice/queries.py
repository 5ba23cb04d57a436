"""Queries over whole test tables, one for each operator, and their SQL.

Two line sources serve them: ``event_lines`` renders the events as log lines,
``document_lines`` cuts the documents at line ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Level, Mode, preset
from .functions import text as T
from .operators import lines as L, patterns, sampling, templates, temporal
from .plans import modes
from .sources.sinks import as_jsonl
from .streaming.lines import template_windows

_SETTINGS = preset(Level.STANDARD)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(" user "), F.col("user_id").cast("string"), F.lit(" "), "event_type", F.lit(" props "), "props")
    return e.select(F.col("event_id").alias("line_no"), line.alias("line"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return rows.select((F.col("doc_id") * 100000 + F.col("i")).alias("line_no"), "line")


EVENTS = """lines AS (SELECT event_id AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END
 || ' user ' || user_id || ' ' || event_type || ' props ' || props AS line FROM events)"""
DOCUMENTS = """lines AS (SELECT line_no, line FROM (SELECT doc_id * 100000 + i - 1 AS line_no, regexp_replace(regexp_replace(parts[i], '^\\s+', ''), '\\s+$', '') AS line
 FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))) WHERE line <> '')"""
PARSED = EVENTS + """, parsed AS (SELECT line_no, line, try_strptime(nullif(regexp_extract(line, '\\d{4}-\\d{2}-\\d{2}[T\\s]\\d{2}:\\d{2}:\\d{2}'), ''), '%Y-%m-%d %H:%M:%S') AS ts,
 upper(nullif(regexp_extract(line, '(?i)\\b(DEBUG|INFO|WARN|ERROR|CRITICAL)\\b', 1), '')) AS level FROM lines)"""
MINED = EVENTS + """, m AS (SELECT line_no, line, regexp_replace(line, '[0-9]+', '<NUM>', 'g') AS template FROM (SELECT min(line_no) AS line_no, line FROM lines GROUP BY line)),
 mined AS (SELECT *, min(line_no) OVER (PARTITION BY template) AS cluster FROM m)"""
COUNTED = MINED + """, counted AS (SELECT cluster, min_by(template, line_no) AS template, count(*) AS count FROM mined GROUP BY cluster)"""
RANKED = COUNTED + """, scored AS (SELECT *, count * CASE WHEN upper(template) LIKE '%CRITICAL%' OR upper(template) LIKE '%FATAL%' THEN 200 WHEN upper(template) LIKE '%ERROR%' OR upper(template) LIKE '%FAIL%' THEN 100
 WHEN upper(template) LIKE '%WARN%' THEN 50 ELSE 1 END * (1 + len(regexp_extract_all(template, '<\\*>')) * 0.5::DOUBLE) * (1 + len(regexp_extract_all(template, '\\S+')) * 0.1::DOUBLE) AS priority
 FROM counted WHERE count >= 2), ranked AS (SELECT *, row_number() OVER (ORDER BY priority DESC, cluster) AS rank FROM scored QUALIFY rank <= 500)"""
EXAMPLES = RANKED + """, ex AS (SELECT line, rank, row_number() OVER (PARTITION BY cluster ORDER BY line_no) AS n FROM mined JOIN ranked USING (cluster) QUALIFY n <= 2),
 shown AS (SELECT row_number() OVER (ORDER BY rank, n) - 1 AS pos, line, rank FROM ex)"""


def normalize_lines(spark, sf_dir):
    return L.normalise(document_lines(spark, sf_dir))


def exact_dedup_keep_first(spark, sf_dir):
    return L.exact_dedup(normalize_lines(spark, sf_dir))


def dedup_stats(spark, sf_dir):
    return L.dedup_stats(normalize_lines(spark, sf_dir))


def line_levels(spark, sf_dir):
    return temporal.parse_lines(event_lines(spark, sf_dir)).select("line_no", "level")


def line_timestamps(spark, sf_dir):
    return temporal.parse_lines(event_lines(spark, sf_dir)).select("line_no", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"))


def temporal_windows(spark, sf_dir):
    timed = temporal.windows(temporal.parse_lines(event_lines(spark, sf_dir)))
    return timed.groupBy("window_key").agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_line_no"))


def temporal_mode(spark, sf_dir):
    return temporal.select_temporal(temporal.parse_lines(event_lines(spark, sf_dir)), 60, _SETTINGS.max_patterns)


def hourly_distribution(spark, sf_dir):
    return temporal.hourly(temporal.parse_lines(event_lines(spark, sf_dir)))


def level_distribution(spark, sf_dir):
    return temporal.levels(temporal.parse_lines(event_lines(spark, sf_dir)))


def typed_masking(spark, sf_dir):
    return event_lines(spark, sf_dir).select("line_no", T.mask_types(F.col("line")).alias("masked"))


def shape_masking(spark, sf_dir):
    """Lines with a value of each typed shape."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("h", F.md5(F.col("event_id").cast("string")))
    part = lambda *widths: [F.substring("h", 1 + sum(widths[:i]), w) for i, w in enumerate(widths)]
    n = F.col("event_id")
    ip = F.concat_ws(".", F.lit("10"), *((n * k % 256).cast("string") for k in (1, 7, 13)))
    uuid, mac, ipv6 = F.concat_ws("-", *part(8, 4, 4, 4, 12)), F.concat_ws(":", *part(2, 2, 2, 2, 2, 2)), F.concat_ws(":", *part(4, 4, 4, 4, 4, 4, 4, 4))
    line = F.concat_ws(" ", F.lit("peer"), ip, F.lit("session"), uuid, F.lit("card"), mac, F.lit("addr"), ipv6, F.lit("at"), F.concat(F.lit("0x"), "h"), F.lit("seq"), n.cast("string"))
    return e.select(n.alias("line_no"), T.mask_types(line).alias("masked"))


def _times(spark, sf_dir, line, year=None):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("line_no"), line.alias("line"))
    return temporal.parse_lines(e, year).select("line_no", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"))


def common_log_times(spark, sf_dir):
    return _times(spark, sf_dir, F.concat(F.lit("10.0.0.1 - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET / HTTP/1.0" 200')))


def syslog_times(spark, sf_dir):
    """Times without a year, some with two spaces before the day or behind it."""
    day, gap = F.lpad(F.dayofmonth("ts").cast("string"), 2, " "), F.when(F.col("event_id") % 3 == 0, "  ").otherwise(" ")
    return _times(spark, sf_dir, F.concat(F.date_format("ts", "MMM"), F.lit(" "), day, gap, F.date_format("ts", "HH:mm:ss"), F.lit(" host daemon[1]: ready")), 2024)


def window_templates(spark, sf_dir):
    """Templates mined in each hour apart."""
    return temporal.window_templates(temporal.parse_lines(event_lines(spark, sf_dir)), 60, _SETTINGS.drain_similarity)


def _mined(spark, sf_dir):
    return templates.mask_miner(L.exact_dedup(event_lines(spark, sf_dir)))


def template_counts(spark, sf_dir):
    return patterns.count_patterns(_mined(spark, sf_dir))


def occurrence_filter(spark, sf_dir):
    return patterns.count_patterns(_mined(spark, sf_dir), 1000)


def priority_topk(spark, sf_dir):
    ranked = patterns.rank_patterns(patterns.count_patterns(_mined(spark, sf_dir), 2), _SETTINGS.max_patterns)
    return ranked.withColumn("priority", F.round("priority", 6)).withColumn("rank", F.col("rank").cast("long"))


def pattern_examples(spark, sf_dir):
    mined = _mined(spark, sf_dir)
    ranked = patterns.rank_patterns(patterns.count_patterns(mined, 2), _SETTINGS.max_patterns)
    return patterns.examples(mined, ranked, _SETTINGS.examples_per_pattern).withColumn("rank", F.col("rank").cast("long"))


def pattern_mode(spark, sf_dir):
    return modes.pattern_mode(event_lines(spark, sf_dir), _SETTINGS, miner="mask")


def severity_scores(spark, sf_dir):
    return event_lines(spark, sf_dir).groupBy(T.severity(F.col("line")).alias("severity")).agg(F.count(F.lit(1)).alias("lines"))


def word_counts(spark, sf_dir):
    return normalize_lines(spark, sf_dir).select("line_no", F.size(T.words(F.col("line"))).cast("long").alias("words"), F.octet_length("line").cast("long").alias("bytes"))


def hash_sample(spark, sf_dir):
    return sampling.sample_fraction(event_lines(spark, sf_dir), 0.1, 7)


def reservoir_bottom_k(spark, sf_dir):
    return sampling.sample_lines(event_lines(spark, sf_dir), 100)


def batch_size_estimate(spark, sf_dir):
    average = F.avg(F.octet_length("line"))
    return event_lines(spark, sf_dir).agg(F.round(average, 6).alias("avg_bytes"), sampling.row_budget(average, 100 * 2**20).alias("batch_rows"))


def reduction_stats(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    total, kept = lines.agg(F.count(F.lit(1)).alias("input_lines")), pattern_mode(spark, sf_dir).agg(F.count(F.lit(1)).alias("output_lines"))
    both = total.join(kept)  # one row each
    return both.withColumn("reduction_percent", F.round(F.when(F.col("input_lines") > 0, (1 - F.col("output_lines") / F.greatest("input_lines", F.lit(1))) * 100).otherwise(0.0), 6))


def jsonl_encode(spark, sf_dir):
    return as_jsonl(normalize_lines(spark, sf_dir).withColumnRenamed("line_no", "pos"))


def union_distinct(spark, sf_dir):
    """The union of two results in order, each line once, at its first place."""
    a = pattern_mode(spark, sf_dir).select(F.lit(0).alias("part"), "pos", "line")
    b = temporal_mode(spark, sf_dir).select(F.lit(1).alias("part"), "pos", "line")
    first = a.unionByName(b).groupBy("line").agg(F.min(F.struct("part", "pos")).alias("p"))
    return first.select((F.row_number().over(Window.orderBy("p")) - 1).cast("long").alias("pos"), "line")


def first_column_lines(spark, sf_dir):
    """Database rows as lines: the first column, blanks and nulls skipped."""
    return L.normalise(L.from_table(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text", "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("n")), "n"))


def template_window_counts(spark, sf_dir):
    """The streaming aggregate, over the same lines as a batch."""
    parsed = temporal.parse_lines(event_lines(spark, sf_dir))
    return template_windows(parsed).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start_text"), "template", "lines")


def drain_patterns(spark, sf_dir):
    mined = templates.drain_miner(L.exact_dedup(event_lines(spark, sf_dir)), _SETTINGS.drain_similarity)
    return patterns.rank_patterns(patterns.count_patterns(mined, 2), _SETTINGS.max_patterns)


def near_dedup(spark, sf_dir):
    return L.near_dedup(exact_dedup_keep_first(spark, sf_dir), 0.8)


def anomaly_mode(spark, sf_dir):
    return modes.anomaly_mode(normalize_lines(spark, sf_dir), _SETTINGS)


def hybrid_mode(spark, sf_dir):
    return modes.hybrid_mode(event_lines(spark, sf_dir), _SETTINGS)


def reduce_to_target(spark, sf_dir):
    from .engine import Reducer
    from .plans.target import collect_target

    target = _SETTINGS.max_patterns * _SETTINGS.examples_per_pattern
    lines, _ = collect_target(event_lines(spark, sf_dir), Reducer(spark, Level.STANDARD, Mode.PATTERN), target_rows=target, seed=1)
    return spark.createDataFrame(list(enumerate(lines)), "pos long, line string")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_lines, exact_dedup_keep_first, dedup_stats, line_levels, line_timestamps, temporal_windows, temporal_mode, hourly_distribution, level_distribution,
        typed_masking, shape_masking, common_log_times, syslog_times, window_templates, template_counts, occurrence_filter, priority_topk, pattern_examples, pattern_mode, severity_scores, word_counts, hash_sample, reservoir_bottom_k,
        batch_size_estimate, reduction_stats, jsonl_encode, union_distinct, first_column_lines, template_window_counts, drain_patterns, near_dedup, anomaly_mode, hybrid_mode, reduce_to_target,
    )
}

_TEMPORAL = PARSED + """, timed AS (SELECT *, floor(epoch(ts) / 3600)::BIGINT AS window_key FROM parsed WHERE ts IS NOT NULL), placed AS (SELECT *, min(line_no) OVER (PARTITION BY window_key) AS begun FROM timed),
 chosen AS (SELECT 0 AS part, begun, line_no, line, window_key FROM placed QUALIFY row_number() OVER (ORDER BY begun, line_no) <= 500),
 temporal AS (SELECT row_number() OVER (ORDER BY part, begun, line_no) - 1 AS pos, line, window_key FROM (SELECT * FROM chosen UNION ALL
 (SELECT 1, 0, line_no, line, NULL FROM parsed WHERE ts IS NULL ORDER BY line_no LIMIT 100)))"""

ORACLE_SQL = {
    "normalize_lines": f"WITH {DOCUMENTS} SELECT line_no, line FROM lines",
    "exact_dedup_keep_first": f"WITH {DOCUMENTS} SELECT min(line_no) AS line_no, line FROM lines GROUP BY line",
    "dedup_stats": f'WITH {DOCUMENTS} SELECT count(*) AS total, count(DISTINCT line) AS "unique", count(*) - count(DISTINCT line) AS duplicates FROM lines',
    "line_levels": f"WITH {PARSED} SELECT line_no, level FROM parsed",
    "line_timestamps": f"WITH {PARSED} SELECT line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM parsed",
    "temporal_windows": f"WITH {PARSED} SELECT floor(epoch(ts) / 3600)::BIGINT AS window_key, count(*) AS lines, min(line_no) AS first_line_no FROM parsed WHERE ts IS NOT NULL GROUP BY 1",
    "temporal_mode": f"WITH {_TEMPORAL} SELECT pos, line, window_key FROM temporal",
    "hourly_distribution": f"WITH {PARSED} SELECT hour(ts)::INTEGER AS hour, count(*) AS lines FROM parsed WHERE ts IS NOT NULL GROUP BY 1",
    "level_distribution": f"WITH {PARSED} SELECT level, count(*) AS lines FROM parsed WHERE ts IS NOT NULL AND level IS NOT NULL GROUP BY 1",
    "typed_masking": f"WITH {EVENTS} SELECT line_no, regexp_replace(regexp_replace(line, '-([0-9])', '-\\1', 'g'), '[0-9]+', '<NUM>', 'g') AS masked FROM lines",
    "shape_masking": "SELECT event_id AS line_no, 'peer <IP> session <UUID> card <MAC> addr <IPV6> at <HEX> seq <NUM>' AS masked FROM events",
    "common_log_times": "SELECT event_id AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM events",
    "syslog_times": "SELECT event_id AS line_no, '2024' || strftime(ts, '-%m-%d %H:%M:%S') AS ts_text FROM events",
    "template_counts": f"WITH {COUNTED} SELECT cluster, template, count FROM counted",
    "occurrence_filter": f"WITH {COUNTED} SELECT cluster, template, count FROM counted WHERE count >= 1000",
    "priority_topk": f"WITH {RANKED} SELECT cluster, template, count, round(priority, 6) AS priority, rank FROM ranked",
    "pattern_examples": f"WITH {EXAMPLES} SELECT pos, line, rank FROM shown",
    "pattern_mode": f"WITH {EXAMPLES} SELECT pos, line FROM shown",
    "severity_scores": f"WITH {EVENTS} SELECT CASE WHEN upper(line) LIKE '%CRITICAL%' OR upper(line) LIKE '%FATAL%' THEN 200 WHEN upper(line) LIKE '%ERROR%' OR upper(line) LIKE '%FAIL%' THEN 100 WHEN upper(line) LIKE '%WARN%' THEN 50 ELSE 1 END AS severity, count(*) AS lines FROM lines GROUP BY 1",
    "word_counts": f"WITH {DOCUMENTS} SELECT line_no, len(regexp_extract_all(line, '\\S+'))::BIGINT AS words, strlen(line)::BIGINT AS bytes FROM lines",
    "hash_sample": f"WITH {EVENTS} SELECT line_no, line FROM lines WHERE ('0x' || substr(md5('7:' || line_no || ':' || line), 1, 8))::BIGINT < {round(0.1 * 2**32)}",
    "reservoir_bottom_k": f"WITH {EVENTS} SELECT line_no, line FROM lines ORDER BY md5('0:' || line_no || ':' || line), line_no LIMIT 100",
    "batch_size_estimate": f"WITH {EVENTS}, a AS (SELECT avg(strlen(line)) AS x FROM lines), r AS (SELECT x, floor({100 * 2**20} / greatest(1.0, x * 3))::BIGINT AS n FROM a) SELECT round(x, 6) AS avg_bytes, greatest(1000, least(1000000, n - n % 1000))::BIGINT AS batch_rows FROM r",
    "reduction_stats": f"WITH {EXAMPLES}, c AS (SELECT (SELECT count(*) FROM lines) AS input_lines, (SELECT count(*) FROM shown) AS output_lines) SELECT input_lines, output_lines, round(CASE WHEN input_lines > 0 THEN (1 - output_lines / greatest(input_lines, 1)) * 100 ELSE 0 END, 6) AS reduction_percent FROM c",
    "jsonl_encode": f"WITH {DOCUMENTS} SELECT line_no AS pos, to_json({{'line': line}})::VARCHAR AS value FROM lines",
    "first_column_lines": "SELECT line_no, line FROM (SELECT conv_id * 1000 + turn AS line_no, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS line FROM conversations) WHERE line <> ''",
    "template_window_counts": f"WITH {PARSED} SELECT strftime(time_bucket(INTERVAL 60 minutes, ts), '%Y-%m-%d %H:%M:%S') AS start_text, regexp_replace(line, '[0-9]+', '<NUM>', 'g') AS template, count(*) AS lines FROM parsed WHERE ts IS NOT NULL GROUP BY ALL",
    "union_distinct": f"WITH {EXAMPLES}, {_TEMPORAL.split('AS line FROM events), ', 1)[1]}, u AS (SELECT 0 AS part, pos, line FROM shown UNION ALL SELECT 1, pos, line FROM temporal), f AS (SELECT line, min((part, pos)) AS p FROM u GROUP BY line) SELECT row_number() OVER (ORDER BY p) - 1 AS pos, line FROM f",
}
