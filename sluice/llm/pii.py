"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame operations only.

Base spans are e-mail addresses, IP addresses, payment cards and phone
numbers.  They are the protected entities.  Terms in an entity's surroundings
may reveal it as well.  The corpus tells how strongly: with N documents, n(e)
of them holding entity e, n(t) holding term t and n(e, t) holding t near e,

    PMI(e; t) = log2(n(e, t) * N / (n(e) * n(t)))     what t tells about e
    IC(e)     = log2(N / n(e))                        all there is to tell

A term with PMI >= IC / alpha and n(e, t) >= support exceeds the disclosure
threshold; it becomes a span of kind ``term`` wherever it stands near e.  A
term that tells everything (PMI = IC) is removed, the others are generalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_names, scratch, stored, text_or_empty

#: Kinds in the order in which equal starts are listed; ``term`` is the method's own.
KINDS = ("email", "ip", "card", "phone", "term")

# The contract's patterns.  Quantifiers are possessive and runs are entered at
# their start only, which changes no match but keeps long runs linear; \G lets
# a match start right after the one before it.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to have any match of the kind.
MARKS = {"email": "@", "phone": "+"}
TERM = r"[\p{L}\p{N}_]{3,}+"
_BLOCK = 128
#: Code points of a term that its generalisation looks at.
TERM_SHOWN = 16


def once(value: Column, use) -> Column:
    """``use`` of a value that is bound to a variable, so that it is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_spans(pieces: Column, found: Column) -> Column:
    """The (start, end, value) of each match, from the pieces between the matches and the matches.

    Sums run inside blocks and over the blocks, so that a text with very many
    matches costs n * (block + n / block) steps instead of n * n.
    """
    both = F.named_struct(F.lit("pieces"), pieces, F.lit("found"), found)
    lens = lambda s: F.transform(s["found"], lambda m, i: F.char_length(F.get(s["pieces"], i)) + F.char_length(m))
    return once(both, lambda s: once(lens(s), lambda n: _running(s["pieces"], s["found"], n)))


def _running(pieces: Column, found: Column, lens: Column) -> Column:
    item = F.named_struct(F.lit("start"), F.lit(0), F.lit("end"), F.lit(0), F.lit("value"), F.lit(""))
    none = F.slice(F.array(item), 2, 1)
    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / F.lit(_BLOCK)).cast("int"))
    add = lambda s, x: s + x
    sums = F.transform(blocks, lambda b: F.aggregate(F.slice(lens, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), add))

    def block(b: Column, sums: Column) -> Column:
        base = F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), add)
        items = F.sequence(b * _BLOCK, F.least(b * _BLOCK + _BLOCK, F.size(found)) - 1)

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.char_length(F.get(pieces, i))
            end = start + F.char_length(F.get(found, i))
            one = F.named_struct(F.lit("start"), start, F.lit("end"), end, F.lit("value"), F.get(found, i))
            return F.named_struct(F.lit("at"), end, F.lit("out"), F.concat(acc["out"], F.array(one)))

        return F.aggregate(items, F.named_struct(F.lit("at"), base, F.lit("out"), none), step, lambda acc: acc["out"])

    spans = once(sums, lambda known: F.flatten(F.transform(blocks, lambda b: block(b, known))))
    return F.when(F.size(found) > 0, spans).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":  # a part above 255 has three digits or more behind its leading zeros
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)))
    n = F.char_length(_digits(value))
    if kind == "card":
        return (n >= 14) & (n <= 19) & F.when((n >= 14) & (n <= 19), _luhn(value)).otherwise(False)
    return (n >= 10) & (n <= 15)


def _keep(kind: str):
    return lambda s: _valid(kind, s["value"])


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one column ``_<kind>`` for each base kind: its valid spans, (start, end, value), in order."""
    kinds = list(PATTERNS)
    for kind in kinds:
        rx, text = PATTERNS[kind], text_or_empty(text_col)
        may = F.contains(text, F.lit(MARKS[kind])) if kind in MARKS else text.rlike("[0-9]")
        docs = docs.withColumn(f"_pieces_{kind}", F.when(may, F.split(text, rx, -1)))
    for kind in kinds:
        hit = F.size(f"_pieces_{kind}") > 1
        docs = docs.withColumn(f"_found_{kind}", F.when(hit, F.regexp_extract_all(text_or_empty(text_col), F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for kind in kinds:
        spans = running_spans(F.col(f"_pieces_{kind}"), F.col(f"_found_{kind}"))
        docs = docs.withColumn(f"_{kind}", F.filter(spans, _keep(kind)))
    return docs.drop(*[f"_{x}_{k}" for x in ("pieces", "found") for k in kinds])


def _named(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.named_struct(F.lit("start"), s["start"], F.lit("kind"), F.lit(kind), F.lit("end"), s["end"]))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _entity(kind: str, span: Column) -> Column:
    """128 bits of what a span names."""
    return F.md5(F.concat(F.lit(f"{kind}:"), ascii_lower(span["value"])))


def _entities(kind: str) -> Column:
    return F.transform(F.col(f"_{kind}"), lambda s: _entity(kind, s))


#: Code points of the pieces of a text from which surroundings are taken, so that none is sought from the text's start.
_CHUNK = 4096


def _contexts(text: Column, reach: int) -> Column:
    """The surroundings of each entity on both sides: (entity, from, text), with words cut at the outer ends left out."""
    some = F.lit(False)
    for kind in PATTERNS:
        some |= F.size(f"_{kind}") > 0
    return F.when(some, once(_chunks(text), lambda c: _around(c, reach))).otherwise(F.slice(_around(F.array(F.lit("")), reach), 1, 0))


def _chunks(text: Column) -> Column:
    last = F.floor(F.greatest(F.lit(0), F.char_length(text) - 1) / F.lit(_CHUNK)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * _CHUNK + 1, F.lit(_CHUNK)))


def _part(chunks: Column, start: Column, size: Column) -> Column:
    """``size`` code points, _CHUNK at most, from ``start`` on."""
    at = F.floor(start / F.lit(_CHUNK)).cast("int")
    near = F.concat(F.coalesce(F.get(chunks, at), F.lit("")), F.coalesce(F.get(chunks, at + 1), F.lit("")))
    return F.substring(near, start - at * _CHUNK + 1, size)


def _between(text: Column, chunks: Column, start: Column, stop: Column) -> Column:
    return F.when(stop - start <= _CHUNK, _part(chunks, start, stop - start)).otherwise(F.substring(text, start + 1, stop - start))


def _around(chunks: Column, reach: int) -> Column:
    def around(kind: str):
        def sides(s: Column) -> Column:
            entity = _entity(kind, s)
            start = F.greatest(F.lit(0), s["start"] - reach)
            before, after = _part(chunks, start, s["start"] - start), _part(chunks, s["end"], F.lit(reach))
            torn = F.when(start > 0, F.regexp_extract(before, r"^[\p{L}\p{N}_]*", 0)).otherwise("")
            ragged = F.char_length(after) == reach
            return F.array(
                F.named_struct(F.lit("entity"), entity, F.lit("from"), start + F.char_length(torn), F.lit("text"), F.substring(before, F.char_length(torn) + 1, F.lit(reach))),
                F.named_struct(F.lit("entity"), entity, F.lit("from"), s["end"], F.lit("text"), F.when(ragged, F.regexp_replace(after, r"[\p{L}\p{N}_]*$", "")).otherwise(after)),
            )

        return sides

    def of(kind: str) -> Column:
        return once(F.col(f"_{kind}"), lambda spans: F.flatten(F.transform(spans, around(kind))))

    return F.concat(*map(of, PATTERNS))


def row_key(id_: Column, text: Column) -> Column:
    """128 bits of an id and a text."""
    return F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), F.md5(text)))


def _by_block(spans: Column, out: Column, step) -> Column:
    """What ``step`` makes of each block of spans in order, from ``at``, the greatest end before the block, and ``out``."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / F.lit(_BLOCK)).cast("int"))
    of = lambda j: F.slice(spans, j * _BLOCK + 1, F.lit(_BLOCK))
    ends = F.transform(blocks, lambda j: F.array_max(F.transform(of(j), lambda s: s["end"])))

    def block(j: Column, ends: Column) -> Column:
        at = F.coalesce(F.array_max(F.slice(ends, F.lit(1), j)), F.lit(0))
        return F.aggregate(of(j), F.struct(at.alias("at"), out.alias("out")), step, lambda acc: acc["out"])

    return once(ends, lambda known: F.transform(blocks, lambda j: block(j, known)))


def _masked(text: Column, base: Column) -> Column:
    """The text with all that base spans, (start, kind, end) in order, cover blanked, code point by code point."""

    def whole(chunks: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            start = F.greatest(acc["at"], s["start"])
            parts = F.concat(acc["out"], _between(text, chunks, acc["at"], start), F.repeat(F.lit(" "), s["end"] - start))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("out"))

        last = F.array_max(F.transform(base, lambda s: s["end"]))
        return F.concat(F.array_join(_by_block(base, F.lit(""), step), ""), F.substring(text, last + 1, F.char_length(text)))

    return F.when(F.size(base) > 0, once(_chunks(text), whole)).otherwise(text)


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _word_places(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with one row for each word of a text: s (start, end, value)."""
    others = [c for c in rows.columns if c != text_col]
    rows = rows.withColumn("pieces", F.split(text_col, TERM, -1)).withColumn("found", F.regexp_extract_all(text_col, F.lit(TERM), F.lit(0)))
    return rows.select(*others, F.explode(running_spans(F.col("pieces"), F.col("found"))).alias("s"))


def _held_together(of: str) -> list[Column]:
    """128 bits of the set of the rows of a group, for which each row must come once."""
    return [F.bit_xor(F.xxhash64(F.col("row"), F.lit(f"{of}{i}"))).alias(f"s{i}") for i in (1, 2)]


def _terms_nearby(kept: DataFrame, holders: DataFrame, word_counts, total: int, reach: int, alpha: float, support: int) -> DataFrame | None:
    """row, terms: of the words within ``reach`` code points of an entity."""
    live = kept.join(_entity_rows(kept).join(holders, "entity").select("row").distinct(), "row")
    near = live.select("row", F.explode(_contexts(F.col("shown"), reach)).alias("n")).select("row", F.col("n.entity").alias("entity"), F.col("n.from").alias("from"), F.col("n.text").alias("t"))
    near = _word_places(near.join(holders.select("entity"), "entity"), "t")
    # a word that belongs to an entity itself is no term
    near = near.select("row", "entity", F.lower("s.value").alias("term"), (F.col("from") + F.col("s.start")).alias("start"), (F.col("from") + F.col("s.end")).alias("end")).distinct()
    near = stored(near, "pii-near")
    together = stored(near.select("row", "entity", "term").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= support), "pii-pairs")
    if together.isEmpty():
        return None
    counts = word_counts(together.select("term").distinct())
    judged = together.join(holders, "entity").join(counts, "term")
    strong = judged.where(_discloses(F.col("n_et"), F.col("n_e"), F.col("n_t"), total, alpha)).select("entity", "term", (F.col("n_et") >= F.col("n_t")).alias("full"))
    places = near.join(strong, ["entity", "term"]).groupBy("row", "start", "end").agg(F.max("full").alias("full"))
    return places.groupBy("row").agg(F.collect_list(F.struct("start", "end", "full")).alias("terms"))


def _terms_anywhere(kept: DataFrame, holders: DataFrame, word_counts, total: int, alpha: float, support: int) -> DataFrame | None:
    """row, terms: of all words of the texts that hold an entity.

    Entities that the same rows hold, and terms that the same of these rows and
    equally many others hold, are judged as one: copies of a text with many
    entities and words cost one pair.  n(t) <= n(e) ** (1 / alpha) * N ** (1 - 1 / alpha)
    follows from the threshold, as n(e, t) <= n(e); no other pair is formed.
    """
    held = stored(_entity_rows(kept).join(holders, "entity"), "pii-held")
    words = kept.join(held.select("row").distinct(), "row").select("row", F.explode(_words(F.col("shown"))).alias("term"))
    words = stored(words, "pii-words")
    bound = F.log2(F.lit(float(total)) / F.col("n_t")) + 1e-9
    least = held.agg(F.min(F.log2(F.lit(float(total)) / F.col("n_e")))).first()[0]
    counts = stored(word_counts(words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("term")).where(bound >= least / alpha), "pii-counts")
    words = words.join(counts, "term")
    same = words.groupBy("term").agg(*_held_together("t"), F.first("n_t").alias("n_t"))
    of_term = stored(same.select("term", F.struct("s1", "s2", "n_t").alias("tc")), "pii-term-classes")
    tc = stored(words.join(of_term, "term").select("row", "tc").distinct(), "pii-row-terms")
    same = held.groupBy("entity").agg(*_held_together("e"), F.first("n_e").alias("n_e"))
    ec = stored(held.join(same.select("entity", F.struct("s1", "s2", "n_e").alias("ec")), "entity").select("row", "ec").distinct(), "pii-row-entities")
    pairs = ec.join(tc, "row").where(F.log2(F.lit(float(total)) / F.col("tc.n_t")) + 1e-9 >= F.log2(F.lit(float(total)) / F.col("ec.n_e")) / alpha)
    n_et = pairs.groupBy("ec", "tc").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= support)
    strong = n_et.where(_discloses(F.col("n_et"), F.col("ec.n_e"), F.col("tc.n_t"), total, alpha))
    strong = stored(strong.select("ec", "tc", (F.col("n_et") >= F.col("tc.n_t")).alias("full")), "pii-strong")
    if strong.isEmpty():
        return None
    told = pairs.join(strong, ["ec", "tc"]).groupBy("row", "tc").agg(F.max("full").alias("full"))
    told = stored(told.join(of_term, "tc").select("row", "term", "full"), "pii-told")
    places = _word_places(kept.join(told.select("row").distinct(), "row").select("row", "shown"), "shown")
    places = places.select("row", F.lower("s.value").alias("term"), "s.start", "s.end").join(told, ["row", "term"])
    return places.groupBy("row").agg(F.collect_list(F.struct("start", "end", "full")).alias("terms"))


def _discloses(n_et: Column, n_e: Column, n_t: Column, total: int, alpha: float) -> Column:
    return F.log2(n_et * F.lit(float(total)) / (n_e * n_t)) >= F.log2(F.lit(float(total)) / n_e) / alpha


def _entity_rows(kept: DataFrame) -> DataFrame:
    """The distinct (row, entity)."""
    return kept.where(F.col("shown").isNotNull()).select("row", F.explode(F.array_distinct(F.concat(*map(_entities, PATTERNS)))).alias("entity"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = 64, alpha: float = 1.25, support: int = 3) -> DataFrame:
    """id, _text_key, n_email, n_ip, n_card, n_phone, base, spans (``kind:start:end``), terms, of every row.

    Offsets are code points, ends exclusive.  Null texts are empty; rows of one
    id with different texts are kept apart; repeated rows get equal spans.
    ``terms`` holds (start, end, full) of the method's own spans; full says
    that the term discloses its entity completely.  Corpus statistics count
    documents, over all rows.  A term stands near an entity within ``reach``
    code points of it or, if that is None, anywhere in a text that holds the
    entity, outside all base spans.
    """
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    source = source.withColumn("key", row_key(F.col("id"), F.col("text")))
    base = F.concat(*[_named(F.col(f"_{k}"), i) for i, k in enumerate(PATTERNS)])
    some = F.size("b") > 0
    shown = F.col("text") if reach is not None else _masked(F.col("text"), F.col("b"))
    spans = base_spans(source).withColumn("b", F.array_sort(base)).withColumn("shown", F.when(some, shown))
    # words that a mask has cut out of longer ones
    torn = F.array_except(_words(F.col("shown")), _words(F.col("text"))) if reach is None else F.array().cast("array<string>")
    none = F.array().cast("array<struct<start:int,end:int,full:boolean>>")
    with scratch(docs.sparkSession) as keep:
        kept = stored(spans.select(F.monotonically_increasing_id().alias("row"), "id", "key", *[f"_{k}" for k in PATTERNS], "b", "shown", F.when(some, torn).alias("torn")), "pii")
        kept = keep(kept)
        total = kept.count()
        # n(e, t) is at most n(e)
        holders = _entity_rows(kept).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
        holders = stored(holders.where((F.col("n_e") >= support) & (F.col("n_e") < total)), "pii-holders")

        def word_counts(wanted: DataFrame) -> DataFrame:
            # each task counts its own words before any move; those that are not wanted go after that
            words = source.select(F.explode(_words(F.col("text"))).alias("term")).union(kept.select(F.explode("torn").alias("term")))
            return words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(wanted, "term")

        terms = None
        if not holders.isEmpty():
            how = (kept, holders, word_counts, total)
            terms = _terms_anywhere(*how, alpha, support) if reach is None else _terms_nearby(*how, reach, alpha, support)
        if terms is not None:
            terms = keep(stored(terms, "pii-terms"))

    out = kept.select("row", "id", "key", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS], "b")
    if terms is None:
        out = out.withColumn("terms", none)
    else:
        # a term inside a base span adds nothing
        clear = lambda s: ~F.exists("b", lambda x: (s["start"] < x["end"]) & (x["start"] < s["end"]))
        out = out.join(terms, "row", "left").withColumn("terms", F.coalesce("terms", none))
        out = out if reach is None else out.withColumn("terms", F.filter("terms", clear))
    own = _named(F.col("terms"), len(KINDS) - 1)
    return out.select(
        F.col("id").alias(id_col), F.col("key").alias("_text_key"), *[f"n_{k}" for k in PATTERNS],
        _listed(F.col("b")).alias("base"), _listed(F.concat("b", own)).alias("spans"), "terms",
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with personal data replaced: entities by ``<KIND>``, terms that tell everything removed, others generalised.

    A term is generalised to what it looks like: ``<NUMBER>`` with digits, ``<NAME>`` with a capital first, else ``<WORD>``.
    Where spans overlap, the first (and of those that start together the first
    kind) is replaced and the rest of the other spans goes with it.  Texts without spans stay as they are, null or not.
    """
    columns = docs.columns
    key = row_key(F.col(id_col), text_or_empty(text_col))
    own, spans, terms = free_names(docs, 3)
    found = find_pii(docs, id_col, text_col, **how).where("spans <> ''").dropDuplicates(["_text_key"])
    found = found.select(F.col("_text_key").alias(own), F.col("spans").alias(spans), F.col("terms").alias(terms))
    text = text_or_empty(text_col)

    def parsed(span: Column) -> Column:
        part = F.split(span, ":")
        return F.named_struct(F.lit("kind"), F.get(part, F.lit(0)), F.lit("start"), F.get(part, F.lit(1)).cast("int"), F.lit("end"), F.get(part, F.lit(2)).cast("int"))

    def step(acc: Column, span: Column) -> Column:
        free = span["start"] >= acc["at"]
        return F.named_struct(F.lit("at"), F.greatest(acc["at"], span["end"]), F.lit("out"), F.when(free, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]))

    def label(span: Column, chunks: Column) -> Column:
        word = F.substring(_part(chunks, span["start"], span["end"] - span["start"]), F.lit(1), F.lit(TERM_SHOWN))
        looks = F.when(word.rlike("[0-9]"), "<NUMBER>").when(word.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<WORD>")
        full = F.exists(terms, lambda t: (t["start"] == span["start"]) & t["full"])
        return F.when(span["kind"] != "term", F.concat(F.lit("<"), F.upper(span["kind"]), F.lit(">"))).when(full, "").otherwise(looks)

    def written(kept: Column, chunks: Column) -> Column:
        end = lambda i: F.coalesce(F.get(kept, i)["end"], F.lit(0))
        parts = F.transform(kept, lambda s, i: F.concat(_between(text, chunks, end(i - 1), s["start"]), label(s, chunks)))
        return F.concat(F.array_join(parts, ""), F.substring(text, end(F.size(kept) - 1) + 1, F.char_length(text)))

    nothing = F.slice(F.array(parsed(F.lit("x:0:0"))), 2, 1)
    chosen = once(F.transform(F.split(spans, ","), parsed), lambda all_: F.flatten(_by_block(all_, nothing, step)))
    done = once(chosen, lambda kept: once(_chunks(text), lambda chunks: written(kept, chunks)))
    joined = docs.join(found, key == F.col(own), "left")
    return joined.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(done)).select(*columns)
