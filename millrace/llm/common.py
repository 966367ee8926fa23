"""Helpers shared by the text operators: Arrow access, vectorised hashing, storage.

Texts are handled as UTF-8 byte buffers taken straight from Arrow columns.  A
chunk is a run of whole documents; only a single document longer than the
chunk size makes a chunk larger than asked for, so memory is bounded by the
chunk size or the longest document.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20

_P1 = np.uint64(11400714785074694791)
_P2 = np.uint64(14029467366897019727)
_P3 = np.uint64(1609587929392839161)
_P4 = np.uint64(9650029242287828579)
_P5 = np.uint64(2870177450012600261)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only in local mode may it be a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if where:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(where)
        return where.rstrip("/")
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared checkpoint folder and read it back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that later steps no longer read, and let go of old shuffles."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for name in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished steps go once the driver has collected their handles."""
    gc.collect()
    spark._jvm.System.gc()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null strings count as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    off = np.frombuffer(offsets, kind, count=n + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes, or one longer document."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word ``[^\\x20\\x09-\\x0D]+`` of whole texts."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    begins = off[:-1][off[:-1] < off[1:]]
    first[begins] = ink[begins]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    last[begins[1:] - 1] = ink[begins[1:] - 1]
    s = np.flatnonzero(first)
    e = np.flatnonzero(last) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def pieces(raw: memoryview, limit: int = CHUNK_BYTES, cut: bytes | None = None) -> Iterator[bytes]:
    """A text in pieces that end where a word does, so that long texts need not be split as a whole; bytes are replaced by those of ``cut`` if given.

    Only a word longer than ``limit`` makes a longer piece.
    """
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + limit)
        while end < n:
            ahead = bytes(raw[end : end + limit])
            blank = np.flatnonzero(SPACE[np.frombuffer(ahead.translate(cut) if cut else ahead, np.uint8)])
            if len(blank):
                end += int(blank[0])
                break
            end = min(n, end + limit)
        piece = bytes(raw[at:end])
        yield piece.translate(cut) if cut else piece
        at = end


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of one buffer, worked per distinct length."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    w8 = np.ndarray((len(buf) - 7,), np.dtype("<u8"), buf.data, strides=(1,))
    w4 = np.ndarray((len(buf) - 3,), np.dtype("<u4"), buf.data, strides=(1,))
    top = int(length.max())
    key = length.astype(np.uint16) if top < 65536 else length
    order = np.argsort(key, kind="stable")
    sizes, at = np.unique(length[order], return_index=True)
    at = np.append(at, len(order))
    sd = np.array([seed], np.uint64)
    for k, size in enumerate(sizes.tolist()):
        rows = order[at[k] : at[k + 1]]
        p = start[rows]
        done = 0
        if size >= 32:
            v1, v2, v3, v4 = sd + _P1 + _P2, sd + _P2, sd + np.uint64(0), sd - _P1
            while done + 32 <= size:
                v1 = _round(v1, w8[p + done])
                v2 = _round(v2, w8[p + (done + 8)])
                v3 = _round(v3, w8[p + (done + 16)])
                v4 = _round(v4, w8[p + (done + 24)])
                done += 32
            h = _rotl(v1, 1) + _rotl(v2, 7) + _rotl(v3, 12) + _rotl(v4, 18)
            for v in (v1, v2, v3, v4):
                h = (h ^ _round(np.zeros(1, np.uint64), v)) * _P1 + _P4
        else:
            h = np.repeat(sd + _P5, len(rows))
        h = h + np.uint64(size)
        while done + 8 <= size:
            h = _rotl(h ^ _round(np.zeros(1, np.uint64), w8[p + done]), 27) * _P1 + _P4
            done += 8
        if done + 4 <= size:
            h = _rotl(h ^ (w4[p + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
            done += 4
        while done < size:
            h = _rotl(h ^ (buf[p + done].astype(np.uint64) * _P5), 11) * _P1
            done += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[rows] = h ^ (h >> np.uint64(32))
    return out


def equal_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``a`` equal those from ``b``, eight at a time."""
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    w8 = np.ndarray((len(buf) - 7,), np.dtype("<u8"), buf.data, strides=(1,))
    same = np.ones(len(a), bool)
    rows, done = np.flatnonzero(length > 0), 0
    while len(rows):
        rest = np.minimum(8, length[rows] - done).astype(np.uint64)
        mask = ~np.uint64(0) >> (np.uint64(64) - rest * np.uint64(8))
        same[rows] &= ((w8[a[rows] + done] ^ w8[b[rows] + done]) & mask) == 0
        done += 8
        rows = rows[length[rows] > done]
    return same


def distinct_ranges(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the different byte strings among ranges, and which of them each range is; hashes find them, bytes decide."""
    _, first, which = np.unique(xxh64(data, start, length), return_index=True, return_inverse=True)
    like = first[which]
    if (length == length[like]).all() and equal_ranges(data, start, start[like], length).all():
        return first, which
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(data[s : s + n].tobytes(), len(known)) for s, n in zip(start.tolist(), length.tolist())], np.int64)
    return np.unique(which, return_index=True)[1], which


def shingle_hashes(data: np.ndarray, off: np.ndarray, shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of a chunk that have words, XXH64 of their word shingles one text after the other, and how many each has.

    A-Z is lower-cased, words are joined by single spaces, and a text of fewer
    words than a shingle gives its whole sequence.
    """
    texts = [data[off[i] : off[i + 1]].tobytes().lower().split() for i in range(len(off) - 1)]
    n_words = np.array([len(t) for t in texts], np.int64)
    rows = np.flatnonzero(n_words)
    if not len(rows):
        return rows, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = np.frombuffer(b" ".join([b" ".join(texts[i]) for i in rows]), np.uint8)
    gap = np.flatnonzero(flat == 32)
    start = np.concatenate([[0], gap + 1])
    end = np.concatenate([gap, [len(flat)]])
    n = n_words[rows]
    base = np.cumsum(n) - n
    n_sh = np.maximum(1, n - shingle + 1)
    head = np.cumsum(n_sh) - n_sh
    first = np.arange(int(n_sh.sum())) + np.repeat(base - head, n_sh)
    last = np.minimum(first + shingle - 1, np.repeat(base + n - 1, n_sh))
    return rows, xxh64(flat, start[first], end[last] - start[first], seed), n_sh


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` for all pairs."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    head = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - head, length)


def per_doc(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values, zero for empty runs."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


def filter_rows(docs: DataFrame, column: str, make: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """Rows of ``docs`` that a test of one column keeps, with all columns as they are.

    ``make`` is called once a task and gives a function from the Arrow column to
    a boolean array.
    """
    at = [f.name for f in docs.schema.fields].index(column)
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for batch in batches:
            yield batch.filter(pa.array(np.asarray(test(batch.column(at)), bool)))

    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)
