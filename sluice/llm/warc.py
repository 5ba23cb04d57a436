"""A deterministic, sharded WARC writer and its reader.

Pages are range-sorted by id into shards of about equally many pages; the ranges
come from a sample of the ids by their hashes, so they depend on the ids alone.
Each shard is written in order by one task that rolls to a new file once the
compressed size passes a limit; every record is a gzip member of its own.  Headers are made
anew: lengths, payload and block digests, record ids from the content.  Of equal
payloads one record is the response and the others are revisits of it.

A file is written under a temporary name and renamed when complete; when all
tasks are done the driver writes a manifest that lists the files of the one
attempt that counts.  Readers go by the manifest only, so leftovers of lost or
repeated tasks are never seen.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, ship, tidy

#: Compressed bytes after which a shard goes on in a new file, and bytes of payload that a shard is made for.
ROLL_BYTES, SHARD_BYTES = 1 << 30, 1 << 30
#: Sampled ids for each shard.
SAMPLES = 64
#: Bytes that the reader takes at a time.
READ_BYTES = 1 << 16
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 1000
#: WARC-Date of every record, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "manifest.json"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{n}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers: bool, n: int = 0) -> bytes:
    """One record: a response with its payload, or a revisit without it."""
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""]
    http = b"\r\n".join(head)
    block = http if refers else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", _uri(page_id, n)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(" " if c in "\r\n" else c for c in url or "")),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _uri(refers_to, 0)), ("X-Refers-To-Page", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return text.encode("utf-8", "replace") + block + b"\r\n\r\n"


def members(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of the gzip members of a file that comes in parts; one member is held at a time."""
    inflate, held = zlib.decompressobj(wbits=31), []
    for data in parts:
        while data:
            held.append(inflate.decompress(data))
            data = inflate.unused_data
            if inflate.eof:
                yield b"".join(held)
                inflate, held = zlib.decompressobj(wbits=31), []
            else:
                break
    if any(held):
        raise ValueError("the archive ends inside a record")


def parse_records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, HTTP head, payload) of each record of an archive that comes in parts, digests checked."""
    for raw in members(parts):
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record: {version[:40]}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        block = rest[: int(fields["Content-Length"])]
        if _sha1(block) != fields["WARC-Block-Digest"]:
            raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not match")
        http, _, payload = block.partition(b"\r\n\r\n")
        if fields["WARC-Type"] == "response" and _sha1(payload) != fields["WARC-Payload-Digest"]:
            raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not match")
        yield fields, http, payload


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, digest, first) of the payloads that are written as revisits of page ``first``.

    Records with equal payloads of at least LEAST_REVISIT bytes refer to the
    one with the largest id; rows that repeat that id are responses as well.
    Null payloads are empty, null ids lose against any other.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), payload.alias("payload")).where(F.length("payload") >= LEAST_REVISIT).select("id", F.sha2("payload", 256).alias("digest"))
    copies = rows.groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = cut(copies.where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    return rows.join(copies, "digest").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "digest", "first").distinct()


def shard_bounds(pages: DataFrame, id_col: str, html_col: str, shards: int | None, shard_bytes: int) -> list[int]:
    """The least id of each shard but the first; the same for the same pages and number of shards.

    The driver gets about SAMPLES ids a shard, those of the least hashes.
    """
    ids = pages.select(F.col(id_col).cast("long").alias("id"), F.octet_length(html_col).cast("long").alias("size"))
    total = ids.agg(F.count("id").alias("n"), F.sum("size").alias("size")).first()
    least = min(partitions(pages.sparkSession), -(-total["n"] // 1000))  # work for all cores, if there is some for each
    shards = shards or max(1, least, -(-(total["size"] or 0) // shard_bytes))
    if shards == 1 or not total["n"]:
        return []
    share = min(1.0, SAMPLES * shards / total["n"])
    taken = F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = sorted(r["id"] for r in ids.where(taken & F.col("id").isNotNull()).select("id").collect())
    return sorted({sample[len(sample) * i // shards] for i in range(1, shards)}) if sample else []


def write_warc(pages: DataFrame, path: str, shards: int | None = None, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = 6, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[dict]:
    """Write ``pages`` under ``path`` and return the manifest's files.

    The same pages and number of ``shards`` give the same archives, however Spark
    deals the work out.  ``shards`` defaults to one for each ``shard_bytes`` of payload,
    and as many as there are shuffle partitions if these have 1000 pages each.  Ids are
    whole numbers, as sparse as they like.  Pages of a null id come first; pages of one
    id are in one shard and stand in the order of url and payload.  An empty table gives
    an empty manifest.
    """
    spark = pages.sparkSession
    ship(spark)
    bounds = shard_bounds(pages, id_col, html_col, shards, shard_bytes)
    shards = len(bounds) + 1
    edges = spark.sparkContext.broadcast(bounds)  # a number for each shard

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), dtype=np.int32)
        out[known] = np.searchsorted(np.array(edges.value, dtype=np.int64), ids[known].to_numpy().astype(np.int64), side="right")
        return pd.Series(out)

    number = F.col(id_col).cast("long")
    records = pages.select(number.alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    records = records.withColumns({"digest": F.lit(None).cast("string"), "first": F.lit(None).cast("long")})
    # the payloads move once; what is to be a revisit travels beside them and sorts before its page
    marks = revisits(pages, id_col, html_col).select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first")
    rows = records.unionByName(marks)
    # ids beyond 2 ** 53 must not pass through floating point on their way: nulls are told apart before
    rows = rows.withColumn("shard", F.when(F.col("id").isNull(), F.lit(0)).otherwise(shard_of(F.coalesce("id", F.lit(0)))) if bounds else F.lit(0))
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), F.col("digest").asc_nulls_last(), "url", "payload")
    attempt = uuid.uuid4().hex

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        task = uuid.uuid4().hex
        done: list[tuple] = []
        out, at, roll, written, records, digest, temp = None, None, 0, 0, 0, None, ""
        page, times = object(), 0
        refers: dict[str, int] = {}

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                final = f"part-{at:06d}-{roll:05d}-{task}.warc.gz"
                store.move(temp, f"{root}/{final}")
                done.append((at, roll, final, written, records, digest.hexdigest()))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if row["id"] != page:
                    page, times, refers = row["id"], 0, {}
                if row["digest"] is not None:
                    refers[row["digest"]] = row["first"]
                    continue
                if out is None or row["shard"] != at or written >= roll_bytes:
                    close()
                    roll = roll + 1 if row["shard"] == at else 0
                    at, written, records, digest = row["shard"], 0, 0, hashlib.sha256()
                    temp = f"{root}/_temporary-{attempt}-{task}-{at}-{roll}"
                    out = store.open_output_stream(temp)
                first = refers.get(hashlib.sha256(row["payload"]).hexdigest()) if refers else None
                record = make_record(page, row["url"], row["payload"], first, first is not None, times)
                times += 1
                member = gzip.compress(record, compresslevel=level, mtime=0)
                out.write(member)
                digest.update(member)
                written += len(member)
                records += 1
        close()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], type=k) for i, k in enumerate(kinds)], names=["shard", "roll", "file", "bytes", "records", "sha256"])

    # one row a file: the only attempt of each task that Spark accepted; sorted here, as a sort in Spark would run the writers twice
    written = rows.mapInArrow(run, "shard int, roll int, file string, bytes long, records long, sha256 string").collect()
    files = sorted((r.asDict() for r in written), key=lambda f: (f["shard"], f["roll"]))
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/_{MANIFEST}-{attempt}") as out:
        out.write(json.dumps({"version": 1, "files": files}, indent=1).encode())
    store.move(f"{root}/_{MANIFEST}-{attempt}", f"{root}/{MANIFEST}")
    return files


def read_warc(spark, path: str) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest (lower-case hex SHA-1), record_type, refers_to of every record that the manifest lists."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/{MANIFEST}") as file:
        files = json.loads(file.read())["files"]
    if not files:
        return spark.createDataFrame([], schema)
    ship(spark)
    listed = spark.createDataFrame([(f["file"], f["sha256"]) for f in files], "file string, sha256 string").repartition(len(files), "file")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, sha256 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = hashlib.sha256()
                rows = []
                for fields, http, payload in parse_records(parts(own, f"{base}/{file}", digest)):
                    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                    sha1 = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                    number = lambda k, f=fields: int(f[k]) if f.get(k) else None
                    response = fields["WARC-Type"] == "response"
                    rows.append((number("X-Page-ID"), fields["WARC-Target-URI"], payload if response else None, size, sha1, fields["WARC-Type"], number("X-Refers-To-Page")))
                    if len(rows) >= 200:
                        yield pack(rows)
                        rows = []
                if digest.hexdigest() != sha256:
                    raise ValueError(f"{file} is not what the manifest lists")
                if rows:
                    yield pack(rows)

    def parts(own: fs.FileSystem, file: str, digest) -> Iterator[bytes]:
        with own.open_input_stream(file, compression=None, buffer_size=1 << 20) as f:
            while data := f.read(READ_BYTES):
                digest.update(data)
                yield data

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=names)

    return listed.mapInArrow(run, schema)
