"""Removal of long repeated strings with per-shard suffix arrays.

A 200-byte string is told by its anchor: the least hash among its 32-byte grams.
Equal strings have equal anchors, so only stretches whose anchor occurs at two
places or more can hold a repeat; the others are left out by exact counts.

1. Each text is cut into stretches: maximal runs of string starts that share an
   anchor.  Anchors are counted over all texts.
2. Stretches with a shared anchor are compared by a hash of their bytes.  Those
   with an equal one are repeats as a whole, and only one text of each stretch
   that shares its anchor with a different one is needed from here on, so
   thousands of copies cost as much as two.
3. A shard is a few MB of such stretches, brought together by anchor.  Its suffix array is built by
   Larsson-Sadakane refinement in numpy and its common prefixes by Kasai's
   recurrence, run in lockstep over lanes of the text.  Starts with 200 common
   bytes are repeats.
4. An anchor with many different stretches is spread over shards.  Each hands on
   a sorted run of its distinct strings, cut at fixed bounds, and strings that
   several shards have are found by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_staged, free_shuffles, stage_table, utf8, xxh64

LENGTH, GRAM = 200, 32
LONGEST_RUN = 512
SHARD_BYTES = 2 << 20
#: Stretches of one anchor in one shard; above it the anchor is spread.
PER_SHARD = 512
#: Entries of spread strings aimed at in one part of the merge.
PER_PART = 500_000
LANES = 4096


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while width < GRAM:
        h = (h[:-width] ^ (h[:-width] >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + h[width:] * np.uint64(0xA0761D6478BD642F)
        width *= 2
    return h ^ (h >> np.uint64(32))


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if width > have else h


def stretches(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start of each run of one text, and 2 where the anchor occurs again in the text."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4
    g, width = gram_hashes(data), length - GRAM + 1
    m = window_minima(g, width)
    lo = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    hi = np.append(lo[1:], len(m)) - 1
    edge = np.full(width - 1, np.iinfo(np.uint64).max)  # a gram is an anchor if it is the least of some window
    chosen = g[~window_minima(np.concatenate([edge, ~m, edge]), width) == g]
    value, n = np.unique(chosen, return_counts=True)
    times = np.minimum(2, n[np.searchsorted(value, m[lo])])
    parts = (hi - lo) // LONGEST_RUN + 1
    if (parts > 1).any():
        k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        last, times = np.repeat(hi, parts), np.repeat(times, parts)
        lo = np.repeat(lo, parts) + k * LONGEST_RUN
        hi = np.minimum(lo + LONGEST_RUN - 1, last)
    return m[lo].view(np.int64), lo, hi, times


_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def range_hashes(data: np.ndarray, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range, from running sums of a polynomial modulo 2^64.

    Ranges are shorter than the 2048 bytes from which such a sum is weak.
    """
    n = len(data)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, n), dtype=np.uint64)])
    h = (sums[end] - sums[lo]) * _powers(_BACK, n + 1)[lo]
    h = (h ^ (h >> np.uint64(32)) ^ (end - lo).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order (Larsson-Sadakane).

    Ranks start from eight bytes; each round sorts only groups that are not yet
    of one suffix by the rank ``h`` further on, and doubles ``h``.
    """
    n = len(data)
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((n,), np.dtype(">u8"), buf.data, strides=(1,)).astype(np.uint64)
    sa = np.argsort(word, kind="stable")
    v = word[sa]
    head = np.concatenate([[True], v[1:] != v[:-1]])
    rank = np.zeros(n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1  # 0 is the end of the text
    h = 8
    while True:
        single = head & np.append(head[1:], True)
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        at = sa[open_]
        far = rank[np.minimum(at + h, n)]
        key = rank[at] * (n + 1) + far
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[open_] = at
        first = np.concatenate([[True], key[1:] != key[:-1]])
        head[open_] = first
        rank[at] = open_[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))] + 1
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Common prefix (``depth`` at most) of each suffix with the one before it in ``sa``.

    Kasai: the prefix at i + 1 is at least that at i less one.  The text is cut
    into lanes that take one step each at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    buf = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    w8 = np.ndarray((n + depth + 8,), np.dtype("<u8"), buf.data, strides=(1,))
    lanes = max(1, min(LANES, n // 64))
    step = -(-n // lanes)
    begin = np.arange(lanes) * step
    h = np.zeros(lanes, np.int64)
    plcp = np.zeros(n, np.int64)
    for t in range(step):
        i = begin + t
        live = np.flatnonzero(i < np.minimum(n, begin + step))
        i = i[live]
        j = before[i]
        k = np.maximum(h[live] - 1, 0)
        k[j < 0] = 0
        limit = np.minimum(depth, n - np.maximum(i, j))
        go = np.flatnonzero((j >= 0) & (k < limit))
        while len(go):
            x = w8[i[go] + k[go]] ^ w8[j[go] + k[go]]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            k[go] += same
            go = go[(same == 8) & (k[go] < limit[go])]
        k = np.minimum(k, limit)
        k[j < 0] = 0
        h[live] = k
        plcp[i] = k
    return plcp[sa]


def repeated(data: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of valid starts: whether another one has the same string, and its class."""
    sa = suffix_array(data)
    group = np.cumsum(common_prefixes(data, sa, length) < length)
    cls = np.zeros(len(data), np.int64)
    cls[sa] = group
    n = np.bincount(cls[valid], minlength=int(group[-1]) + 1)
    return n[cls[valid]] > 1, cls[valid]


STRETCHES = "kid long, kh long, anchor long, d long, lo int, hi int, times int"


def _stretch_batches(length: int):
    names = [x.split()[0] for x in STRETCHES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kid, kh = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, off = utf8(batch.column(2))
            out, size = [], 0
            for i in range(len(kid)):
                raw = data[off[i] : off[i + 1]]
                a, lo, hi, times = stretches(raw, length)
                out.append((np.full(len(a), kid[i]), np.full(len(a), kh[i]), a, range_hashes(raw, lo, hi + length), lo, hi, times))
                size += len(a)
                if size > 200_000 or i == len(kid) - 1:
                    cols = [np.concatenate(x) for x in zip(*out)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, (np.int64,) * 4 + (np.int32,) * 3)], names)
                    out, size = [], 0

    return run


CONTEXTS = "anchor long, d long, n long, of long, ctx binary"


def _context_batches(length: int):
    names = [x.split()[0] for x in CONTEXTS.split(", ")]
    kinds = (pa.int64(),) * 4 + (pa.binary(),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(0))
            rows, size = [], 0
            for i in range(batch.num_rows):
                raw = data[off[i] : off[i + 1]].tobytes()
                for x in batch.column(1)[i].as_py():
                    rows.append((x["anchor"], x["d"], x["n"], x["of"], raw[x["lo"] : x["hi"] + length]))
                    size += len(rows[-1][-1])
                if rows and (size > 4 << 20 or i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0

    return run


def _shard(rows: list[tuple], length: int):
    """Work one shard; rows of (anchor, salt, parts, d, n, ctx).

    Gives per stretch its repeated starts as runs, and, for spread anchors, an
    entry (two hashes, anchor, d, start, salt) for each distinct string.
    """
    size = np.array([len(r[5]) for r in rows], np.int64)
    base = np.cumsum(size) - size
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    n = size - length + 1
    which = np.repeat(np.arange(len(rows)), n)
    valid = np.arange(int(n.sum())) + np.repeat(base - (np.cumsum(n) - n), n)
    dup, cls = repeated(data, valid, length)
    once = (np.array([r[4] for r in rows]) == 1)[which]  # the others are repeats as a whole
    mark = dup & once
    edge = np.concatenate([[True], (mark[1:] != mark[:-1]) | (which[1:] != which[:-1])])
    lo = np.flatnonzero(edge)
    hi = np.append(lo[1:], len(mark)) - 1
    runs: dict[int, tuple[list[int], list[int]]] = {}
    for a, b in zip(lo[mark[lo]].tolist(), hi[mark[lo]].tolist()):
        w = int(which[a])
        x = runs.setdefault(w, ([], []))
        x[0].append(int(valid[a] - base[w]))
        x[1].append(int(valid[b] - base[w]))
    found = [(rows[w][0], rows[w][3], a, b) for w, (a, b) in runs.items()]
    entries = None
    wide = np.array([r[2] > 1 for r in rows])
    if wide.any():
        at = np.flatnonzero(wide[which])
        _, first, times = np.unique(cls[at], return_index=True, return_counts=True)
        at = at[first]
        long = np.full(len(at), length, np.int64)
        one, two = xxh64(data, valid[at], long, 1), xxh64(data, valid[at], long, 2)
        order = np.lexsort((two, one))
        at, mine = at[order], which[at[order]]
        anchor, d = np.array([r[0] for r in rows], np.int64)[mine], np.array([r[3] for r in rows], np.int64)[mine]
        entries = (one[order], two[order], anchor, d, (valid[at] - base[mine]).astype(np.int32), times[order] == 1)
    return found, entries


SHARDED = "kind int, anchor long, d long, a array<int>, b array<int>, part int, w1 array<long>, w2 array<long>, anchors array<long>, ds array<long>, starts array<int>, lone array<boolean>"


def _shard_batches(length: int, bits: int):
    """Runs of repeated starts (kind 0), and sorted entries cut by their first ``bits`` (kind 1)."""
    names = [x.split()[0] for x in SHARDED.split(", ")]
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = (pa.int32(), pa.int64(), pa.int64(), ints, ints, pa.int32(), longs, longs, longs, longs, ints, pa.list_(pa.bool_()))

    def out(rows):
        found, e = _shard(rows, length)
        table = [(0, x, d, a, b, *[None] * 7) for x, d, a, b in found]
        if e is not None:
            part = (e[0] >> np.uint64(64 - bits)).astype(np.int64)
            at = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
            cols = (e[0].view(np.int64), e[1].view(np.int64), *e[2:])
            table += [(1, None, None, None, None, int(part[i]), *(c[i:j] for c in cols)) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*table), kinds)], names) if table else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_BYTES and (r[0], r[1]) != last:
                    if (got := out(rows)) is not None:
                        yield got
                    rows, size = [], 0
                rows.append(r)
                size += len(r[5])
                last = (r[0], r[1])
        if rows and (got := out(rows)) is not None:
            yield got

    return run


def _merge(runs: list[list[np.ndarray]]):
    """Strings of several runs that are alone in their own: (anchor, d, start) of each."""
    w1, w2, anchor, d, start, lone = (np.concatenate(c) for c in zip(*runs))
    every = np.sort(w1)
    maybe = np.flatnonzero(np.searchsorted(every, w1, side="right") - np.searchsorted(every, w1, side="left") > 1)
    maybe = maybe[np.lexsort((w2[maybe], w1[maybe]))]
    same = (w1[maybe][1:] == w1[maybe][:-1]) & (w2[maybe][1:] == w2[maybe][:-1])
    hit = np.zeros(len(maybe), bool)
    hit[1:] |= same
    hit[:-1] |= same
    hit = maybe[hit & lone[maybe].astype(bool)]
    return pa.RecordBatch.from_arrays([pa.array(anchor[hit]), pa.array(d[hit]), pa.array(start[hit].astype(np.int32))], ["anchor", "d", "start"])


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by part; each part is merged once it is complete."""
    runs, last = [], None
    for batch in batches:
        parts = batch.column(0).to_pylist()
        for i, part in enumerate(parts):
            if part != last and runs:
                yield _merge(runs)
                runs = []
            last = part
            runs.append([batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in range(1, 7)])
    if runs:
        yield _merge(runs)


def _finish_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            rows = []
            for i, spans in enumerate(batch.column(2)):
                mine = data[off[i] : off[i + 1]]
                cover = np.zeros(len(mine) + 1, np.int32)
                for x in spans.as_py() or ():
                    for a, b in zip(x["a"], x["b"]):
                        cover[x["lo"] + a] += 1
                        cover[x["lo"] + b + length] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                n_spans = int(gone[0] + (gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                rows.append((len(mine), int(gone.sum()), n_spans, hashlib.sha256(mine[~gone].tobytes()).hexdigest()))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeats(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(kid, kh, spans): per text key its stretches with repeated starts.

    The key is the doc_id (the least long for null) and a hash of the text; a
    span has the place of a stretch and runs of starts relative to it.  Rows that
    repeat others have the same spans, which partial aggregation makes one.
    """
    rows = rows.where(F.octet_length("text") >= length).select("kid", "kh", "text")
    every = stage_table(rows.mapInArrow(_stretch_batches(length), STRETCHES), "stretches")
    shared = every.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor")
    mine = stage_table(every.join(shared, "anchor"), "shared-stretches")
    drop_staged(every)
    kinds = cut(mine.groupBy("anchor", "d").agg(F.count("*").alias("n"), F.max("times").alias("times"), F.min(F.struct("kid", "kh", "lo", "hi")).alias("rep")))
    crowd = kinds.groupBy("anchor").agg(F.count("*").alias("of"))
    need = kinds.join(crowd, "anchor").where("of > 1 OR times > 1").select("anchor", "d", "n", "of", "rep.*")
    lists = need.groupBy("kid", "kh").agg(F.collect_list(F.struct("anchor", "d", "n", "of", "lo", "hi")).alias("need"))
    contexts = stage_table(rows.join(lists, ["kid", "kh"]).select("text", "need").mapInArrow(_context_batches(length), CONTEXTS), "contexts")
    free_shuffles(rows.sparkSession)
    parts = F.ceil(F.col("of") / PER_SHARD).cast("int")
    sharded = contexts.select("anchor", F.pmod(F.col("d"), parts.cast("long")).cast("int").alias("salt"), parts.alias("parts"), "d", "n", "ctx")
    spread = contexts.where(F.col("of") > PER_SHARD).count()
    bits = min(24, max(6, int(np.ceil(np.log2(max(1, spread * 100 / PER_PART))))))
    sharded = cut(sharded.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_shard_batches(length, bits), SHARDED))
    drop_staged(contexts)
    inside = sharded.where("kind = 0").select("anchor", "d", "a", "b")
    entries = sharded.where("kind = 1").select("part", "w1", "w2", "anchors", "ds", "starts", "lone")
    across = entries.repartition("part").sortWithinPartitions("part").mapInArrow(_merge_batches, "anchor long, d long, start int")
    across = across.groupBy("anchor", "d").agg(F.collect_set("start").alias("a")).select("anchor", "d", "a", F.col("a").alias("b"))
    whole = kinds.where("n > 1").select("anchor", "d", F.array(F.lit(0)).alias("a"), F.array(F.col("rep.hi") - F.col("rep.lo")).alias("b"))
    runs = whole.union(inside).union(across)
    placed = mine.select("anchor", "d", "kid", "kh", "lo").join(runs, ["anchor", "d"])
    return placed.groupBy("kid", "kh").agg(F.collect_set(F.struct("lo", "a", "b")).alias("spans"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that starts twice or more.

    Texts are UTF-8 bytes; strings do not cross documents; all are judged on the
    input.  Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs)
    and kept_sha256.  Null texts are empty.  Repeated rows repeat each other, so
    both lose all strings of the length; null ids are kept; other columns are
    ignored; an empty table gives an empty result.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("kid", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("kh", F.xxhash64("text"))
    found = repeats(keyed, length)
    rows = keyed.join(found, ["kid", "kh"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_finish_batches(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
SQL: dict[str, str] = {}
