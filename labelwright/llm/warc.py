"""Deterministic sharded WARC archives.

Records go to shards by range of their key, cut by payload bytes (``SHARD_BYTES`` each), and are sorted within a shard.
The cuts come from a sample that the keys' hashes choose, so that the same rows give the same bytes whatever the cluster.
A key, or null keys, of more than a shard's bytes have several shards, by digest.  A shard rolls to a new file once the compressed size passes
``ROLL_BYTES``.  Each record is a gzip member of its own; headers and digests are made anew from the payload.  A file is
written under a temporary name that is the attempt's own and renamed when it is whole; then its line goes to the
manifest, which Spark commits.  Readers go by the manifest alone, so what a lost executor left behind is never read, and
a repeated attempt renames the same bytes to the same name.

Payloads of at least ``REVISIT_BYTES`` bytes that equal another's are stored once, with the record of the largest key;
the others are revisit records that name it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm.common import fresh_path

#: Payload bytes of a shard, shards at most (beyond, they grow), and keys of the sample that the cuts come from, about.
SHARD_BYTES, SHARDS, SAMPLE = 64 << 20, 10_000, 100_000
ROLL_BYTES = 32 << 20
REVISIT_BYTES = 1000
VERSION = b"WARC/1.1"
#: Records carry this date unless a caller gives another: a run's clock would change the bytes.
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "shard long, part int, name string, n_records long, n_bytes long, sha256 string"
RECORD = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def decisions(records: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(key, digest, refers_to): of each record; refers_to is null for a response.

    ``records``: (key, payload binary).  Only digests and lengths are shuffled.  Of records with one payload and one key,
    all have the same line here, and the writer makes the first of them the response.
    """
    small = records.select("key", F.sha1("payload").alias("digest"), F.length("payload").alias("n"))
    last = small.where(F.col("n") >= least).groupBy("digest").agg(F.max("key").alias("top"), F.count("*").alias("copies")).where("copies > 1")
    named = small.join(last, "digest", "left")
    return named.select("key", "digest", "top").distinct()


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record_id(key: int | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{key}:{digest}')}>"


def _header(url: str | None) -> str:
    """A value that fits a header line."""
    return re.sub(r"[\r\n]+\s*", " ", url or "")


def record(key: int | None, url: str | None, data: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, not yet compressed."""
    digest = hashlib.sha1(data).hexdigest()
    kind = "response" if refers_to is None else "revisit"
    lines = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key, digest, kind)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_header(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Record-Key: {'' if key is None else key}", f"X-Payload-Length: {len(data)}", f"X-Url: {'null' if url is None else 'given'}",
    ]
    body = b""
    if refers_to is None:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(data) + data
        lines.append("Content-Type: application/http; msgtype=response")
    else:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest, 'response')}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Key: {refers_to}"]
    lines += [f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}", f"Content-Length: {len(body)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class _Roller:
    """The files of one shard."""

    def __init__(self, out: str, shard: int, roll: int):
        self.system, self.root = _file_system(out)
        self.shard, self.roll, self.part, self.file = shard, roll, 0, None

    def add(self, data: bytes) -> Iterator[tuple]:
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = press.compress(data) + press.flush()
        if self.file is None:
            self.name = f"shard-{self.shard:012d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary-{uuid.uuid4().hex}-{self.name}"
            self.file, self.records, self.bytes, self.sum = self.system.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        self.file.write(member)
        self.sum.update(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)
        if self.bytes >= self.roll:
            yield self.close()

    def close(self) -> tuple:
        self.file.close()
        self.file = None
        self.system.move(self.temporary, f"{self.root}/{self.name}")
        line = self.shard, self.part, self.name, self.records, self.bytes, self.sum.hexdigest()
        self.part += 1
        return line


def cuts(records: DataFrame, size: int = SHARD_BYTES) -> tuple[np.ndarray, int]:
    """(keys at which shards begin, ascending, a key of several shards more than once; shards of null keys)."""
    small = records.select("key", F.length("payload").alias("n"))
    known = F.col("key").isNotNull()
    said = small.agg(F.count_if(known).alias("rows"), F.sum(F.when(known, F.col("n"))).alias("bytes"), F.sum(F.when(~known, F.col("n"))).alias("null_bytes")).first()
    each = max(size, -(-(said.bytes or 0) // SHARDS))
    every = max(said.rows // SAMPLE, 1)
    # a key's bytes are added up before they come to the driver, so that a key of many rows is one row of the sample
    some = small.where(known & (F.pmod(F.xxhash64("key"), F.lit(every)) == 0)).groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").collect()
    keys, total = np.array([r.key for r in some], np.int64), np.cumsum([0] + [r.n * every for r in some])
    places = np.arange(each, total[-1], each)
    return keys[np.searchsorted(total, places, "right") - 1] if len(keys) else keys, max(1, -(-(said.null_bytes or 0) // size))


def shard_of(at: np.ndarray, nulls: int, key: Column, digest: Column) -> Column:
    """The shard of a record, below zero for null keys; among several shards of a key the digest decides."""

    @F.pandas_udf("long")
    def found(k: pd.Series, h: pd.Series) -> pd.Series:
        lo, hi = (np.searchsorted(at, k.to_numpy(), side) for side in ("left", "right"))
        several = np.where(hi - lo > 1, hi - lo, 1)
        return pd.Series(np.where(hi - lo > 1, lo + 1 + h.to_numpy() % several, hi))

    h = F.pmod(F.xxhash64(digest), F.lit(1 << 40))
    return F.when(key.isNull(), -1 - F.pmod(h, F.lit(nulls))).otherwise(found(F.coalesce(key, F.lit(0)), h))


def write(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", html: str = "html", roll: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Writes an archive of ``pages`` to the folder ``out`` (any file system that pyarrow opens, shared by all executors); returns its manifest.

    A null html is an empty payload; null keys have shards of their own and refer to nothing; a null url is an empty
    header.  Rows with equal keys keep their places by url and payload.  An empty table gives an empty manifest.
    """
    system, root = _file_system(out)
    system.create_dir(root, recursive=True)
    records = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), payload(F.col(html)).alias("payload"))
    at, nulls = cuts(records)
    parts = len(at) + 1 + nulls
    shard = shard_of(at, nulls, F.col("key"), F.col("digest"))
    # decisions travel with the records in one shuffle by shard, and stand before them
    first = decisions(records.select("key", "payload")).where("top IS NOT NULL").select(shard.alias("shard"), "key", F.lit(0).alias("kind"), F.col("digest").alias("url"), F.lit(None).cast("binary").alias("payload"), "top")
    rows = first.unionByName(records.withColumn("digest", F.sha1("payload")).select(shard.alias("shard"), "key", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("top")))
    rows = rows.repartitionById(parts, (F.col("shard") + nulls).cast("int")).sortWithinPartitions("shard", "key", "kind", "url", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, at, known, given = None, None, {}, set()  # decisions of one key at a time
        lines: list[tuple] = []
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("shard", "key", "kind", "url", "payload", "top")]
            for i in range(batch.num_rows):
                s, k, kind, u, data, top = (c[i].as_py() for c in cols)
                if roller is None or s != roller.shard:
                    if roller is not None and roller.file is not None:
                        lines.append(roller.close())
                    roller = _Roller(out, s, roll)
                if kind == 0:
                    if k != at:
                        at, known, given = k, {}, set()
                    known[k, u] = top
                    continue
                data = data or b""
                digest = hashlib.sha1(data).hexdigest()
                top = known.get((k, digest))
                again = top == k and (k, digest) in given
                if top == k:
                    given.add((k, digest))
                lines += roller.add(record(k, u, data, top if top is not None and (top != k or again) else None, date))
        if roller is not None and roller.file is not None:
            lines.append(roller.close())
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in lines], t) for j, t in enumerate(kinds)], names=["shard", "part", "name", "n_records", "n_bytes", "sha256"])

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{out}/_manifest")
    return pages.sparkSession.read.parquet(f"{out}/_manifest")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file of gzip members, one record in memory at a time."""
    press, held, data = zlib.decompressobj(31), b"", b""
    while True:
        if not held:
            held = stream.read(1 << 20)
            if not held:
                break
        data += press.decompress(held)
        held = press.unused_data
        if press.eof:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            yield headers, rest[: int(headers["Content-Length"])]
            press, data = zlib.decompressobj(31), b""


def read(spark: SparkSession, out: str, payloads: bool = False) -> DataFrame:
    """Rows of ``RECORD`` of every file that the manifest names; payload is null for revisits, or unless asked for.

    A response's digest and length are those of the bytes read, and must be those that its headers say.
    """
    manifest = spark.read.parquet(f"{out}/_manifest").select("name", "n_records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(out)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            for name, expected in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("name", "n_records"))):
                rows: list[tuple] = []
                seen = size = 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for h, block in parse(stream):
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        n, kind, body = int(h["X-Payload-Length"]), h["WARC-Type"], None
                        if kind == "response":
                            body = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha1(body).hexdigest() != digest or len(body) != n:
                                raise ValueError(f"{name}: a payload is not what its headers say")
                        key, refers = h["X-Record-Key"], h.get("X-Refers-To-Key")
                        rows.append((int(key) if key else None, h["WARC-Target-URI"] if h["X-Url"] == "given" else None, n, digest, kind, int(refers) if refers else None, body if payloads else None))
                        seen, size = seen + 1, size + n * payloads
                        if len(rows) >= 5000 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)
                            rows, size = [], 0
                if seen != expected:
                    raise ValueError(f"{name}: {seen} records, not {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)

    # a task for each file, up to SHARDS; files are of about one size
    return manifest.repartitionByRange(max(1, min(manifest.count(), SHARDS)), "name").mapInArrow(run, RECORD)


def op2_warc(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from an archive written to the shared folder.

    A null html is an empty payload; rows of one page_id are records of their own.  A very long payload is one record of a shard
    that it may fill alone.  No pages: no archive and no rows.  Further columns, whatever their names, are not looked at.
    """
    out = fresh_path(pages.sparkSession, "warc")
    write(pages, out)
    return read(pages.sparkSession, out).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
     t AS (SELECT page_id, n, digest, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM t
"""
