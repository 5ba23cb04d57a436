"""Sources: text files, tables and queries, JDBC databases, Kafka topics.  Each gives normalised lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from ..operators.lines import from_table, normalise
from ..operators.sampling import share
from .dialects import DIALECTS, random_batch, sampled_query, sampled_table


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, compressed ones too; bytes that are no UTF-8 go."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"File not found: {path}")
    text = spark.read.text(path)
    bad = ~F.is_valid_utf8("value")
    value = F.when(bad, F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit(""))).otherwise(F.col("value"))
    return normalise(from_table(text.select(value.alias("value"))))


def size_bytes(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file or folder, through its own file system."""
    if not _exists(spark, path):
        return None
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target) is not None


def read_query(spark: SparkSession, query: str, params: dict | None = None, order_by: str | None = None) -> DataFrame:
    """The first column of a Spark SQL query with bound parameters."""
    return normalise(from_table(spark.sql(query, args=params or {}), order_by))


def dialect_name(url: str) -> str:
    """The database that a URL speaks of, without a client library's name."""
    scheme = url.removeprefix("jdbc:").partition(":")[0].partition("+")[0].lower()
    return {"postgres": "postgresql", "sqlite3": "sqlite"}.get(scheme, scheme)


def jdbc_target(url: str) -> dict[str, str]:
    """``url``, ``user`` and ``password`` of a JDBC connection to what a database URL names.

    User and password stand before the host in a database URL; most JDBC drivers
    take them apart from theirs.  A file's path follows ``sqlite:`` directly.
    """
    if url.startswith("jdbc:"):
        return {"url": url}
    name, parts = dialect_name(url), urlsplit(url)
    if name == "sqlite":
        return {"url": f"jdbc:sqlite:{(parts.netloc + parts.path).removeprefix('/') or ':memory:'}"}
    place = parts.netloc.rpartition("@")[2] + parts.path + (f"?{parts.query}" if parts.query else "")
    login = {k: unquote(v) for k, v in (("user", parts.username), ("password", parts.password)) if v is not None}
    return {"url": f"jdbc:{name}://{place}"} | login


def jdbc_options(url: str, query: str, *, params: dict | None = None, sample: float | None = None, sample_seed: int | None = None, fetchsize: int = 1000) -> dict[str, str]:
    """Options of a JDBC read; the query is sampled inside the database.  JDBC reads bind no parameters, so they are refused."""
    if params:
        raise ValueError("a JDBC read binds no parameters: register the table with Spark and use read_query, or write the values into the query")
    name = dialect_name(url)
    prepare = None
    if sample is not None:
        prepare, query = sampled_query(name, query, sample, sample_seed)
    options = jdbc_target(url) | {"query": query, "fetchsize": str(fetchsize)}
    if name in DIALECTS:
        options["driver"] = DIALECTS[name].driver
    return options | ({"sessionInitStatement": prepare} if prepare else {})


def read_jdbc(spark: SparkSession, url: str, query: str, **how) -> DataFrame:
    return normalise(from_table(spark.read.format("jdbc").options(**jdbc_options(url, query, **how)).load()))


def read_jdbc_table(spark: SparkSession, url: str, table: str, column: str, *, fraction: float, seed: int | None = None, method: str = "system", where: str | None = None) -> DataFrame:
    """A sample of a table's column, by the database's own table sampling."""
    return read_jdbc(spark, url, sampled_table(dialect_name(url), table, column, fraction, seed, method, where))


def read_jdbc_batch(spark: SparkSession, url: str, query: str, n: int) -> DataFrame:
    """A fresh random batch of the full query."""
    return read_jdbc(spark, url, random_batch(dialect_name(url), query, n))


def _outer_words(query: str) -> Iterator[str]:
    """The bare words of a query, in capitals, that stand in no quotes and no parentheses."""
    depth, word, quote = 0, "", ""
    for mark in query + " ":
        if quote:
            quote = "" if mark == quote else quote
            continue
        if word and not (mark.isalnum() or mark == "_"):
            yield word.upper()
            word = ""
        if mark in "'\"`":
            quote = mark
        elif mark in "()":
            depth += 1 if mark == "(" else -1
        elif not depth and (mark.isalnum() or mark == "_"):
            word += mark


def clickhouse_query(query: str, sample: float | None = None, parameters: dict | None = None, settings: dict | None = None) -> str:
    """The query with its parameters' values, a sample of its table, and its own settings.

    SAMPLE belongs to a table, so a query whose table is followed by more of the
    query cannot be sampled from outside.
    """
    for name, value in (parameters or {}).items():
        text = str(value).replace("\\", "\\\\").replace("'", "\\'")
        before, mark, after = query.partition("{" + name + ":")
        if not mark:
            raise ValueError(f"the query has no parameter {name!r}")
        kind, _, after = after.partition("}")
        query = f"{before}CAST('{text}' AS {kind}){after}"
    if sample is not None:
        words = list(_outer_words(query))
        later = words[words.index("FROM") + 1 :] if "FROM" in words else []
        if stop := next((w for w in later if w in ("WHERE", "PREWHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "JOIN", "UNION", "SETTINGS")), None):
            raise ValueError(f"a sample is taken of a table, and this query goes on behind its table with {stop}; write SAMPLE into the query")
        query = f"{query} SAMPLE {share(sample)!r}"
    return query + (" SETTINGS " + ", ".join(f"{k} = {v!r}" for k, v in settings.items()) if settings else "")


def read_clickhouse(spark: SparkSession, url: str, query: str, sample: float | None = None, parameters: dict | None = None, settings: dict | None = None) -> DataFrame:
    return read_jdbc(spark, url, clickhouse_query(query, sample, parameters, settings))


def kafka_client(config: str | dict, verify_ssl: bool = True) -> dict[str, str]:
    """A client's own settings as Spark's options; a bare string names the servers."""
    named = {"bootstrap.servers": config} if isinstance(config, str) else config
    unchecked = {} if verify_ssl else {"ssl.endpoint.identification.algorithm": ""}
    return {f"kafka.{key}": str(value) for key, value in {**named, **unchecked}.items()}


def mask_credentials(config: dict) -> dict:
    """``config`` for logs: whatever names a user or a secret is hidden, unless it is empty."""
    secret = lambda key: key.rpartition(".")[2] in ("username", "password", "secret", "token", "key", "config") and key.startswith(("sasl.", "ssl."))
    return {key: "***" if value and secret(key) else value for key, value in config.items()}


def kafka_options(config: str | dict, topics: str | list[str], group_id: str | None = None, verify_ssl: bool = True, *, poll_timeout: float | None = None, assignment_timeout: float | None = None) -> dict[str, str]:
    """Options of a read of all that topics hold now; nothing is committed.

    ``poll_timeout`` bounds the wait of a task for records; ``assignment_timeout``
    the wait of the driver for the topics' partitions and offsets, both in seconds.
    """
    options = kafka_client(config, verify_ssl)
    options |= {"subscribe": topics if isinstance(topics, str) else ",".join(topics), "startingOffsets": "earliest", "endingOffsets": "latest"}
    if poll_timeout is not None:
        options["kafkaConsumer.pollTimeoutMs"] = str(int(poll_timeout * 1000))
    if assignment_timeout is not None:
        wait = str(int(assignment_timeout * 1000))
        options |= {"kafka.default.api.timeout.ms": wait, "kafka.request.timeout.ms": wait, "fetchOffset.numRetries": "1"}
    return options | ({"kafka.group.id": group_id} if group_id else {})


def read_kafka(spark: SparkSession, config: str | dict, group_id: str, topics: str | list[str], *, verify_ssl: bool = True, max_messages: int | None = None, encoding: str = "utf-8", poll_timeout: float | None = None, assignment_timeout: float | None = 30.0) -> DataFrame:
    """The topics' messages in the order of topic, partition and offset.

    The offsets are fetched at once, so that servers that do not answer and topics
    that do not exist are told here, as a ``SourceError``, within ``assignment_timeout``.
    """
    options = kafka_options(config, topics, group_id, verify_ssl, poll_timeout=poll_timeout, assignment_timeout=assignment_timeout)
    try:
        rows = spark.read.format("kafka").options(**options).load()
        rows.rdd.getNumPartitions()
    except Exception as error:
        raise SourceError(f"Kafka topics {options['subscribe']}", error) from error
    rows = rows.where("value IS NOT NULL").orderBy("topic", "partition", "offset")
    rows = rows.limit(max_messages) if max_messages else rows
    text = F.make_valid_utf8(F.col("value").cast("string")) if encoding.lower().replace("_", "-") in ("utf-8", "utf8") else F.decode("value", encoding)
    return normalise(from_table(rows.select(text.alias("value"))))


def open_dsn(spark: SparkSession, dsn: str, *, query: str | None = None, topic: str | None = None, group: str | None = None, sample: float | None = None, sample_seed: int | None = None) -> DataFrame:
    """The source that a DSN's scheme names: Kafka, ClickHouse, or any other database."""
    scheme = dsn.partition("://")[0].lower()
    if scheme == "kafka":
        if sample is not None or not (topic and group):
            raise ValueError("a Kafka source is read whole, from a topic and by a group")
        return read_kafka(spark, dsn.partition("://")[2], group, topic)
    if not query:
        raise ValueError("a database source needs a query")
    if scheme == "clickhouse":
        return read_clickhouse(spark, dsn, query, sample)
    return read_jdbc(spark, dsn, query, sample=sample, sample_seed=sample_seed)


def batches_of(spark: SparkSession, dsn: str, query: str) -> Callable[[int], DataFrame]:
    """A function that draws so many random rows of a query inside the database that a DSN names."""
    return lambda rows: read_jdbc_batch(spark, dsn, query, rows)
