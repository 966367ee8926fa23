"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id and payload digest into shards.  Their number
follows from the payloads' bytes and their bounds from a sample drawn by content,
so the same rows give the same files whatever the partitioning and settings.  A
task writes whole shards and rolls to a next file once the compressed size passes
a limit.  Files get temporary names with the task attempt in them and are renamed
when closed; tasks list them in the parts of a manifest, a folder that is renamed
last.  Readers open only files of the manifest and check each one's digest and
every record's block and payload digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

#: Payload bytes of a shard and compressed bytes of a file; both grow where there would be more than MOST_SHARDS.
SHARD_BYTES, FILE_BYTES = 8 << 20, 4 << 20
MOST_SHARDS = 100_000
PER_SHARD = 50  # rows sampled for each shard
DATE = "1970-01-01T00:00:00Z"
GROUP_FROM = 0  # payloads of at least so many bytes are revisited


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(where: str) -> str:
    """``file:/x`` as written by Hadoop to ``file:///x``."""
    return "file:///" + where[5:].lstrip("/") if where.startswith("file:") else where


def _base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_text(value) -> str:
    """A header value on one line."""
    return "".join(" " if c in "\r\n" else c for c in ("" if value is None else str(value)))


HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {}\r\n\r\n"


def record_id(page_id, digest: str, copy: int) -> str:
    """Name of the ``copy``-th record of a page and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{copy}')}>"


def _record(page_id, url, payload: bytes, refers, copy: int) -> bytes:
    """One record; all headers are made anew from page_id, url and payload."""
    digest = _base32(payload)
    kind = "response" if refers is None else "revisit"
    block = HTTP.format(len(payload)).encode() + (payload if refers is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, copy)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_header_text(url)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_base32(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers, digest, 0)}", f"X-Refers-To-Page-ID: {refers}"]
    head += [f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}", "Content-Type: application/http;msgtype=response"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    """A gzip member without time or name, so equal records give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + zlib.crc32(raw).to_bytes(4, "little") + (len(raw) & 0xFFFFFFFF).to_bytes(4, "little")


class _Writer:
    """Rolls the files of one shard."""

    def __init__(self, root: str, shard: int, attempt: str, limit: int):
        self.fs, self.root = _fs(root)
        self.shard, self.attempt, self.limit = shard, attempt, limit
        self.part, self.out, self.done = 0, None, []

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.temp = f"{self.root}/_temporary-{self.shard:06d}-{self.part:05d}-{self.attempt}"
            self.out, self.hash, self.size, self.rows = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0
        piece = _member(raw)
        self.out.write(piece)
        self.hash.update(piece)
        self.size += len(piece)
        self.rows += 1
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"part-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.fs.move(self.temp, f"{self.root}/{name}")
            self.done.append((self.shard, name, self.size, self.rows, self.hash.hexdigest()))
            self.part, self.out = self.part + 1, None


MANIFEST = "shard long, name string, bytes long, records long, sha256 string"


def _write_batches(root: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        attempt = f"{ctx.taskAttemptId() if ctx else 0}-{uuid.uuid4().hex[:8]}"
        names = [x.split()[0] for x in MANIFEST.split(", ")]

        def closed(writer: _Writer) -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*writer.done)], names)

        writer, last, copy, known = None, None, 0, None
        for whole in batches:
            for at in range(0, whole.num_rows, 64):  # payloads become Python strings a few at a time
                for shard, page_id, key, kind, url, html, first in zip(*(c.to_pylist() for c in whole.slice(at, 64).columns)):
                    if not kind:  # says which page has this payload first; its pages follow
                        known = (page_id, key, first)
                        continue
                    first = known[2] if known is not None and known[:2] == (page_id, key) else None
                    if writer is None or writer.shard != shard:
                        if writer:
                            yield closed(writer)
                        writer, last = _Writer(root, shard, attempt, limit), None
                    copy = copy + 1 if (page_id, key) == last else 0  # repeated rows follow each other
                    last = (page_id, key)
                    refers = None if first is None or page_id is None or first == page_id and not copy else first
                    writer.add(_record(page_id, url, (html or "").encode(), refers, copy))
        if writer:
            yield closed(writer)

    return run


_LEAST = -(1 << 63)


def _bounds(rows: DataFrame, n: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper (page_id, key prefix) of all shards but the last, at quantiles of a sample of distinct pairs drawn by hash."""
    share = min(1.0, PER_SHARD * shards / max(1, n))
    drawn = rows.select("page", "prefix").where(F.pmod(F.xxhash64("page", "prefix"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
    got = drawn.toPandas().sort_values(["page", "prefix"]).to_numpy(np.int64) if shards > 1 else np.zeros((0, 2), np.int64)
    got = np.unique(got[(np.arange(1, shards) * len(got)) // shards], axis=0) if len(got) else got
    return got[:, 0], got[:, 1]


def shard_numbers(page: np.ndarray, prefix: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the sorted bounds are not above (page, prefix)."""
    low, high = np.searchsorted(cuts[0], page, "left"), np.searchsorted(cuts[0], page, "right")
    while (open_ := low < high).any():
        mid = (low + high) // 2
        below = open_ & (cuts[1][np.minimum(mid, len(cuts[1]) - 1)] <= prefix)
        low, high = np.where(below, mid + 1, low), np.where(open_ & ~below, mid, high)
    return low


def write(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> dict:
    """Write all rows below ``root`` and commit the manifest; returns counts.

    Of rows with equal payloads the one with the smallest page_id is a response,
    the others revisit it.  Rows that repeat a page_id and payload revisit their
    first, and follow each other in one file.  Rows without a page_id are
    responses and come first.  A null html is an empty payload.  An empty table
    gives a manifest without files.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("b")).first()
    fs, base = _fs(root)
    fs.create_dir(base, recursive=True)
    listed, temp = f"{root}/manifest", f"{root}/_manifest-{uuid.uuid4().hex}"
    if size["n"]:
        shard_bytes, grown = max(shard_bytes, -(-size["b"] // MOST_SHARDS)), shard_bytes
        file_bytes = file_bytes * shard_bytes // grown
        shards = max(1, min(size["n"], -(-size["b"] // shard_bytes)))
        key = F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)
        keyed = rows.withColumn("key", key).withColumn("page", F.coalesce("page_id", F.lit(_LEAST))).withColumn("prefix", F.conv(F.substring("key", 1, 15), 16, 10).cast("long"))
        cuts = spark.sparkContext.broadcast(_bounds(keyed, size["n"], shards))

        @F.pandas_udf("int")
        def shard_of(page: pd.Series, prefix: pd.Series) -> pd.Series:
            return pd.Series(shard_numbers(page.to_numpy(np.int64), prefix.to_numpy(np.int64), cuts.value).astype(np.int32))

        first = keyed.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
        least = F.octet_length(F.coalesce("html", F.lit(""))) >= GROUP_FROM
        found = keyed.where(F.col("page_id").isNotNull() & least).select("page_id", "page", "prefix", "key").distinct().join(first, "key")
        # told rows sort before their pages, so payloads are shuffled once
        told = found.select(shard_of("page", "prefix").alias("shard"), "page_id", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "first")
        full = keyed.select(shard_of("page", "prefix").alias("shard"), "page_id", "key", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("first"))
        dealt = told.union(full).repartition(shards, "shard").sortWithinPartitions("shard", "page_id", "key", "kind", "url")
        dealt.mapInArrow(_write_batches(root, file_bytes), MANIFEST).write.json(temp)
    else:
        spark.createDataFrame([], MANIFEST).write.json(temp)
    got = spark.read.schema(MANIFEST).json(temp).agg(F.count("*"), F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if got[1] != size["n"]:
        raise RuntimeError(f"{got[1]} of {size['n']} records were written")
    for info in fs.get_file_info(pafs.FileSelector(base)):  # left by attempts that were lost
        if info.base_name.startswith("_temporary-"):
            fs.delete_file(info.path)
    fs.move(_fs(temp)[1], _fs(listed)[1])
    return {"files": got[0], "records": got[1], "bytes": got[2]}


def _members(f, seen, step: int = 1 << 20) -> Iterator[bytes]:
    """Each gzip member of a stream, whose bytes also go to the hash ``seen``."""
    z, out = zlib.decompressobj(31), []
    while piece := f.read(step):
        seen.update(piece)
        while piece:
            out.append(z.decompress(piece))
            piece = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("a gzip member is cut short")


def records(f, seen=None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream of gzip members, one in memory at a time."""
    for text in _members(f, seen or hashlib.sha256()):
        end = text.index(b"\r\n\r\n")
        lines = text[:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = text[end + 4 : end + 4 + int(head["Content-Length"])]
        if _base32(block) != head["WARC-Block-Digest"].removeprefix("sha1:"):
            raise ValueError(f"block digest of {head['WARC-Record-ID']} differs")
        yield head, block


FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _read_batches(root: str, full: bool):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in FIELDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(root)
        for batch in batches:
            for name, sha in zip(*(c.to_pylist() for c in batch.columns)):
                seen, rows = hashlib.sha256(), []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for h, block in records(f, seen):
                        whole = h["WARC-Type"] == "response"
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if whole and _base32(payload) != digest:
                            raise ValueError(f"payload digest of {h['WARC-Record-ID']} differs")
                        page, refers = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), int(h["X-Payload-Length"]), digest, h["WARC-Type"], refers and int(refers), h["WARC-Target-URI"], payload if full and whole else None))
                        if full and len(rows) == 64:
                            yield out(rows)
                            rows = []
                if seen.hexdigest() != sha:
                    raise ValueError(f"{name} differs from the manifest")
                if rows:
                    yield out(rows)

    return run


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The committed files below ``root``: shard, name, bytes, records, sha256."""
    return spark.read.schema(MANIFEST).json(f"{root}/manifest")


def read(spark: SparkSession, root: str, full: bool = False) -> DataFrame:
    """Rows of the archives that the manifest below ``root`` lists.

    With ``full`` the column payload has the payload of responses.
    """
    listed = manifest(spark, root)
    n = listed.count()
    return listed.select("name", "sha256").repartition(max(1, n), "name").mapInArrow(_read_batches(root, full), FIELDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{_uri(shared_dir(spark))}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return read(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op9_warc": op9_warc}
SQL = {
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS lowest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = lowest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = lowest THEN NULL ELSE lowest END AS refers_to
FROM h""",
}
