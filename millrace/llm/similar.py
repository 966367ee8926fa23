"""Links between texts whose sets of word shingles are alike, for the near-duplicate stage.

A 64-bit fingerprint tells texts of similarity 0.8 apart by about ten bits, more
than a bit index can search without comparing all with all.  This search adds
those links:

1. A text gives 80 min-wise values of its shingles, read as 16 bands of five,
   and the 512 smallest shingle hashes.  Texts with equal sets of shingles are one.
2. Texts that agree on a band share a bucket.  Each member is compared with the
   bucket's pivot, the first in one of four orders of ids, by the share of common
   hashes among the 512 smallest of both.  That is exact where both have fewer
   different shingles; else it decides only beyond MARGIN (over five standard
   deviations) and leaves the pair open.
3. Components of the links found are told.  A bucket with one component needs
   nothing more, nor one whose only pair is decided.  Of the others every pair of
   texts in different components is judged by the exact share over both whole
   sets, taken from the texts: members are dealt to blocks by hash, and each pair
   of blocks is one piece of work, bounded in rows and bytes.

So all pairs that share a band are linked exactly if they are alike, or lie in
one component.  Two texts of similarity 0.8 share a band with probability 0.998,
of 0.9 with 0.9999998.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ranges, shingle_hashes, utf8
from .components import connected_components

BANDS, ROWS, LOW = 16, 5, 512
WIDTH = BANDS * ROWS
_MULTIPLY = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)

HEAD = 4 * WIDTH
ROWS_AT_ONCE = 512
MARGIN = 0.1  # of a sampled share; its standard deviation is 0.018 at 0.8
BLOCK, BLOCK_BYTES = 1024, 4 << 20  # members and bytes of a block
RARE = 32  # shingles of at most so many texts are counted pair by pair
TOLD = "u long, v long, told int, keys array<long>"


def set_sketches(data: np.ndarray, off: np.ndarray, shingle: int) -> tuple[list[bytes], np.ndarray]:
    """Per text of a chunk its min-wise values, then its smallest hashes (32-bit integers), worked in blocks of 4,096 shingles; and a hash of the whole set."""
    rows, h, n = shingle_hashes(data, off, shingle)
    none = np.full(WIDTH, 0xFFFFFFFF, "<u4").tobytes()
    out = [none] * (len(off) - 1)
    whole = np.zeros(len(off) - 1, np.int64)
    end = np.cumsum(n)
    for i, a, b in zip(rows.tolist(), (end - n).tolist(), end.tolist()):
        mine = np.unique(h[a:b])
        low = np.full(WIDTH, np.iinfo(np.uint64).max)
        for k in range(0, len(mine), 4096):
            np.minimum(low, (_MULTIPLY[:, None] * mine[k : k + 4096]).min(axis=1), out=low)
        out[i] = (np.concatenate([low, mine[:LOW]]) >> np.uint64(32)).astype("<u4").tobytes()
        whole[i] = int.from_bytes(hashlib.blake2b(mine.tobytes(), digest_size=8).digest(), "little", signed=True)
    return out, whole


def sketches(data: np.ndarray, off: np.ndarray, shingle: int) -> list[bytes]:
    """The sketches alone."""
    return set_sketches(data, off, shingle)[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity by the smallest hashes of two sets; two empty sets are alike."""
    both = np.union1d(a, b)
    if len(a) >= LOW or len(b) >= LOW:
        both = both[:LOW]
    if not len(both):
        return 1.0
    return float((np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)).sum()) / len(both)


def _mix(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    x = (key ^ value.astype(np.uint64)) * _PRIME
    return x ^ (x >> np.uint64(29))


def _bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            n = batch.num_rows
            wide = np.frombuffer(b"".join([x.as_buffer().slice(0, HEAD) for x in batch.column(1)]), "<u4").reshape(n, BANDS, ROWS)
            key = np.zeros((n, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for r in range(ROWS):
                key = _mix(key, wide[:, :, r])
            sid, size = (pa.array(np.repeat(batch.column(k).to_numpy(), BANDS)) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), sid, size], ["key", "sid", "size"])


def _compare_batches(similarity: float):
    """Pairs with a pivot: told is 1 for alike, 0 for open.

    A sample of hashes decides beyond MARGIN only, whole sets of 32-bit hashes
    beyond what two hashes that fell together would change.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                rows = []
                for p, sid, keys, mine, other in zip(*[batch.column(k) for k in range(5)]):
                    a, b = (np.frombuffer(x.as_buffer(), "<u4")[WIDTH:] for x in (mine, other))
                    share = likeness(a, b)
                    near = max(2 / max(1, len(a), len(b)), MARGIN if max(len(a), len(b)) >= LOW else 0)
                    if share >= min(1.0, similarity + near):
                        rows.append((p.as_py(), sid.as_py(), 1, None))
                    elif share >= similarity - near:
                        rows.append((p.as_py(), sid.as_py(), 0, keys.as_py()))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["u", "v", "told", "keys"])

    return run


def _common(text: np.ndarray, h: np.ndarray, m: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``left`` x ``right``, from (text, hash) members of ``m`` sets, each once."""
    order = np.argsort(h, kind="stable")
    text = text[order]
    _, at, df = np.unique(h[order], return_index=True, return_counts=True)
    row, col = np.full(m, -1), np.full(m, -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    wide = len(right)
    flat = np.zeros(len(left) * wide, np.int64)
    for d in range(2, min(RARE, int(df.max(initial=0))) + 1):
        every = at[df == d]
        for k in range(0, len(every), 4096):
            held = text[every[k : k + 4096, None] + np.arange(d)]
            x, y = row[held], col[held]
            for i in range(d):
                cell = (x[:, i, None] * wide + y)[(x[:, i, None] >= 0) & (y >= 0)]
                np.add.at(flat, cell, 1)
    out = flat.reshape(len(left), wide).astype(np.float32)
    often = np.flatnonzero(df > RARE)
    for k in range(0, len(often), 1024):
        some = often[k : k + 1024]
        x = np.zeros((m, len(some)), np.float32)
        n = df[some]
        x[text[ranges(at[some], n)], np.repeat(np.arange(len(some)), n)] = 1
        out += x[left] @ x[right].T
    return out


def block_links(texts: pa.Array, label: np.ndarray, block: np.ndarray, shingle: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of rows that link all labels with an alike pair: of two blocks one row each, of one block any two."""
    m = len(texts)
    if len(np.unique(label)) < 2:
        return []
    rows, h, n = shingle_hashes(*utf8(texts), shingle)
    end = np.cumsum(n)
    sets = [np.unique(h[b - k : b]) for b, k in zip(end.tolist(), n.tolist())]
    size = np.zeros(m)
    size[rows] = [len(x) for x in sets]
    two = len(np.unique(block)) > 1
    left = np.flatnonzero(block == block.min()) if two else np.arange(m)
    right = np.flatnonzero(block != block.min()) if two else np.arange(m)
    both = _common(np.repeat(rows, size[rows].astype(np.int64)), np.concatenate(sets) if sets else h, m, left, right)
    union = size[left][:, None] + size[right][None, :] - both
    alike = (both >= similarity * union - 1e-6) & (label[left][:, None] != label[right][None, :])
    if not two:
        alike &= left[:, None] < right[None, :]
    x, y = (left[alike.nonzero()[0]], right[alike.nonzero()[1]])
    root: dict[int, int] = {}

    def top(k: int) -> int:
        while root.get(k, k) != k:
            root[k] = root.get(root[k], root[k])
            k = root[k]
        return k

    out = []
    for i, j in zip(x.tolist(), y.tolist()):
        a, b = top(int(label[i])), top(int(label[j]))
        if a != b:
            root[a] = b
            out.append((i, j))
    return out


def _block_batches(shingle: int, similarity: float):
    """Rows key, i, j, block, sid, label, text, sorted by key, i and j, to links."""

    def links(group: pa.Table) -> pa.RecordBatch:
        sid = group.column("sid").to_numpy()
        found = block_links(group.column("text").combine_chunks(), group.column("label").to_numpy(), group.column("block").to_numpy(), shingle, similarity)
        return pa.RecordBatch.from_arrays([pa.array([int(sid[x[k]]) for x in found], pa.int64()) for k in range(2)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(k).to_numpy() for k in range(3)])
            edge = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edge, edge[1:]):
                name = tuple(names[:, a].tolist())
                if held and name != last:
                    yield links(pa.Table.from_batches(held))
                    held = []
                last = name
                held.append(batch.slice(a, b - a))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def similar_links(sketches: DataFrame, texts: Callable[[DataFrame], DataFrame], shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(sid, sketch, size) rows, sid a hash of the set of shingles and size the text's bytes, to links (u, v) that join ids of alike texts.

    ``texts`` gives (sid, text) for distinct ids (column sid).  Repeated rows
    count once; an empty table gives an empty result.
    """
    members = sketches.mapInArrow(_bucket_batches, "key long, sid long, size long")
    first = F.struct(F.xxhash64("sid", F.expr("key & 3")).alias("h"), "sid")
    pivots = members.groupBy("key").agg(F.min(first).alias("x"), F.min("sid").alias("a"), F.max("sid").alias("z"))
    pivots = pivots.where("a < z").select("key", F.col("x.sid").alias("p"))
    shared = cut(members.join(pivots, "key").groupBy("key", "sid").agg(F.max("size").alias("size"), F.first("p").alias("p")))
    pairs = shared.where("sid <> p").groupBy("p", "sid").agg(F.collect_set("key").alias("keys"))
    # one column and one grouping on both sides, so that a single exchange serves both joins
    one = sketches.groupBy("sid").agg(F.first("sketch").alias("sketch"))
    pairs = pairs.join(one, "sid").join(one.toDF("p", "sketch_p"), "p")
    told = cut(pairs.select("p", "sid", "keys", "sketch", "sketch_p").mapInArrow(_compare_batches(similarity), TOLD))
    found = told.where("told = 1").select("u", "v")
    # buckets with pairs that are neither judged nor in one component
    part = connected_components(found).toDF("sid", "label")
    shared = shared.join(part, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    still = told.where("told = 0").select(F.explode("keys").alias("key")).distinct().withColumn("still", F.lit(True))
    todo = shared.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("label").alias("a"), F.max("label").alias("z"), F.expr("bit_xor(xxhash64(sid))").alias("x"))
    todo = todo.where("a <> z").join(still, "key", "left").where("n > 2 or still")
    # buckets of the same texts are one
    todo = todo.groupBy("n", "x").agg(F.min("key").alias("key"), F.max("size").alias("size"))
    todo = todo.select("key", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = shared.join(todo, "key").select("key", "sid", "label", "blocks", F.pmod(F.xxhash64("sid", "key"), F.col("blocks")).cast("int").alias("block"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = cut(dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "label"))
    if dealt.isEmpty():
        return found
    work = dealt.join(texts(dealt.select("sid").distinct()), "sid").select("key", "i", "j", "block", "sid", "label", "text")
    work = work.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return found.union(cut(work.mapInArrow(_block_batches(shingle, similarity), "u long, v long")))
