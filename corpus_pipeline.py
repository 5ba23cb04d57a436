"""A corpus pipeline: junk, repeated lines and near copies go, the rest is mixed and tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet to the shared folder and read again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``.  An empty table goes
through as one.  Rows of a null id, and rows that repeat one, are rows as any
other; what a stage makes of rows equal in all columns it says itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.bpe import token_digests
from sluice.llm.common import broadcast_if_small, free_names, fresh_path, remove_path, stored, table
from sluice.llm.line_dedup import line_dedup
from sluice.llm.mixing import mixed_documents
from sluice.llm.near_dedup import near_dedup
from sluice.llm.quality import fit_quality, keep_good
from sluice.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half go, rows that repeat an id by their own texts; a null text is scored as an empty one."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of many documents stay in one of them; n_chars follows the text.  No row goes; rows of one id count as one document."""
    cleaned = line_dedup(docs)
    changed = F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", changed).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least id; documents without words stay all.

    Rows are told apart by id and text, so null and repeated ids keep what differs; rows equal in both come once.
    """
    found = near_dedup(docs).where("n_shingles > 0")
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    rows = found.groupBy("component_key", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    rows = stored(rows, "near-rows")
    kept = rows.groupBy("component_key").agg(stays.alias("s")).select("component_key", "s.doc_id", "s.text_hash")
    same = lambda a, b: (a["doc_id"].eqNullSafe(b["doc_id"])) & (a["text_hash"] == b["text_hash"])
    gone = stored(rows.join(kept, (rows["component_key"] == kept["component_key"]) & same(rows, kept), "left_anti").select("doc_id", "text_hash"), "near-gone")
    again = stored(rows.where("times > 1").select("doc_id", "text_hash"), "near-again")
    (name,) = free_names(docs, 1)
    hashed = docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))
    there = lambda rows: (hashed["doc_id"].eqNullSafe(rows["doc_id"])) & (hashed[name] == rows["text_hash"])
    hashed = hashed.join(broadcast_if_small(gone), there(gone), "left_anti")
    if not again.isEmpty():
        repeated = hashed.join(broadcast_if_small(again), there(again), "left_semi").dropDuplicates(["doc_id", name])
        hashed = hashed.join(broadcast_if_small(again), there(again), "left_anti").unionByName(repeated)
    return hashed.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; null and empty texts, of which nothing can be taken, go."""
    return mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document of the mix, one row for each copy."""
    return token_digests(docs, *vocabulary())


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("tokens", tokenise),
]

#: A classifier, a sketch and a tokeniser are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; what a stage wrote goes when the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
