"""SimHash near-duplicates through a Gray-order hierarchical index.

1. Fingerprints are computed per document from hashed word shingles.
2. Distinct fingerprints are dealt to buckets that share four of six bit
   blocks: two codes that differ in at most two bits agree on four blocks at
   least, so each link meets in some bucket.  A bucket holds at most 2^22
   distinct codes (32 MB) whatever the corpus, as 42 or more bits are fixed.
3. In each task the codes are sorted by Gray rank.  Upper nodes keep the bits
   that all codes below share; a search adds up differences on bits that are
   new at each level and drops a node once the sum passes the radius.  Nodes
   that already lie in the query's component are dropped too, so a dense
   cluster costs about as much as a sparse one, and a task returns a spanning
   forest instead of all pairs.
4. Components of the forests are found by distributed star rounds.

The stage ``keep_one`` adds links between texts that share 0.8 or more of their
five-word shingles (``similar.py``), which lie beyond two bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, shingle_hashes, utf8
from .components import connected_components
from .similar import set_sketches, similar_links

ONES = np.uint64(0x0101010101010101)
BLOCKS = (11, 11, 11, 11, 10, 10)
KEEP = 4
CHOICES = list(combinations(range(len(BLOCKS)), KEEP))
TOGETHER = 1 << 16  # codes of small buckets that are indexed at once


def fingerprints(data: np.ndarray, off: np.ndarray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text of a chunk (unsigned)."""
    rows, h, n_sh = shingle_hashes(data, off, shingle, seed)
    out = np.zeros(len(off) - 1, np.uint64)
    if not len(rows):
        return out
    head = np.cumsum(n_sh) - n_sh
    per = (n_sh + 254) // 255
    cell = np.cumsum(per) - per
    blocks = (np.arange(int(per.sum())) - np.repeat(cell, per)) * 255 + np.repeat(head, per)
    code = np.zeros(len(rows), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & ONES, blocks).astype("<u8").view(np.uint8).reshape(-1, 8)
        count = np.add.reduceat(lanes.astype(np.int64), cell, axis=0)
        on = 2 * count > n_sh[:, None]
        for lane in range(8):
            code |= on[:, lane].astype(np.uint64) << np.uint64(8 * lane + k)
    out[rows] = code
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected binary Gray order."""
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Levels of masked patterns over codes sorted by Gray rank."""

    def __init__(self, codes: np.ndarray, fanout: int = 16):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        self.fanout = fanout
        one, zero = self.codes, ~self.codes
        self.levels = [(one, zero)]
        while len(one) > fanout:
            at = np.arange(0, len(one), fanout)
            one, zero = np.bitwise_and.reduceat(one, at), np.bitwise_and.reduceat(zero, at)
            self.levels.append((one, zero))

    def uniform(self, comp: np.ndarray) -> list[np.ndarray]:
        """Per level the component of each node, -1 where it holds several."""
        low = high = comp
        out = [comp]
        for one, _ in self.levels[1:]:
            at = np.arange(0, len(low), self.fanout)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
        return out

    def search(self, codes: np.ndarray, radius: int, key: int = 0, comp: np.ndarray | None = None, own: np.ndarray | None = None):
        """Pairs (query, leaf) within ``radius`` that agree on the bits of ``key``.

        ``comp`` holds components of leaves and ``own`` those of the queries:
        nodes wholly inside a query's component are left out.
        """
        key = np.uint64(key)
        label = self.uniform(comp) if comp is not None else None
        top = len(self.levels) - 1
        width = len(self.levels[top][0])
        q = np.repeat(np.arange(len(codes)), width)
        node = np.tile(np.arange(width), len(codes))
        acc = np.zeros(len(q), np.uint8)
        seen = np.zeros(len(q), np.uint64)
        for k in range(top, -1, -1):
            one, zero = self.levels[k]
            fixed = one[node] | zero[node]
            diff = (codes[q] ^ one[node]) & fixed
            acc = acc + np.bitwise_count(diff & ~seen)
            keep = (acc <= radius) & ((diff & key) == 0)
            if label is not None:
                keep &= label[k][node] != own[q]
            q, node, acc, seen = q[keep], node[keep], acc[keep], fixed[keep]
            if k:
                below = len(self.levels[k - 1][0])
                n = np.minimum(self.fanout, below - node * self.fanout)
                head = np.cumsum(n) - n
                child = np.arange(int(n.sum())) + np.repeat(node * self.fanout - head, n)
                q, acc, seen, node = np.repeat(q, n), np.repeat(acc, n), np.repeat(seen, n), child
        return q, node


def forest(codes: np.ndarray, radius: int, key: int = 0, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (positions in ``codes``) of the links among distinct codes."""
    index = GrayIndex(codes)
    n = len(codes)
    comp = np.arange(n)
    block = max(block, n // 64)
    left, right = [], []
    at = 0
    step = 64
    while at < n:
        rows = np.arange(at, min(n, at + step))
        q, leaf = index.search(index.codes[rows], radius, key, comp, comp[rows])
        q = rows[q]
        if len(q):
            pair = np.stack([np.minimum(comp[q], comp[leaf]), np.maximum(comp[q], comp[leaf])])
            _, pick = np.unique(pair[0] * n + pair[1], return_index=True)
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    root[x] = root.get(root[x], root[x])
                    x = root[x]
                return x

            for i in pick.tolist():
                a, b = find(int(pair[0][i])), find(int(pair[1][i]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    left.append(q[i])
                    right.append(leaf[i])
            to = np.arange(n)
            for x in list(root):
                to[x] = find(x)
            comp = to[comp]
        at += step
        step = min(block, step * 2)
    pick = lambda x: index.order[np.array(x, np.int64)]
    return pick(left), pick(right)


def _moved(codes: np.ndarray, chosen: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """Codes with the chosen blocks in front, and the mask of those blocks."""
    low = np.cumsum((0, *BLOCKS))
    out, at, fixed = np.zeros(len(codes), np.uint64), 64, 0
    for b in (*chosen, *(x for x in range(len(BLOCKS)) if x not in chosen)):
        at -= BLOCKS[b]
        part = (codes >> np.uint64(low[b])) & np.uint64((1 << BLOCKS[b]) - 1)
        out |= part << np.uint64(at)
        if b in chosen:
            fixed |= ((1 << BLOCKS[b]) - 1) << at
    return out, fixed


def _block_masks() -> list[int]:
    low = np.cumsum((0, *BLOCKS)).tolist()
    masks = [sum(((1 << BLOCKS[b]) - 1) << low[b] for b in c) for c in CHOICES]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _fingerprint_batches(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            parts = [fingerprints(data[off[i] : off[j]], off[i : j + 1] - off[i], shingle, seed) for i, j in chunks(off)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


def _sketch_batches(shingle: int, wide: int):
    """doc_id, _row, fp, the sketch, a hash of the set of shingles and the size, a chunk of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in chunks(off):
                part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                fp = pa.array(fingerprints(part, at, shingle).view(np.int64))
                sketch, sid = set_sketches(part, at, wide)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], fp, pa.array(sketch, pa.binary()), pa.array(sid), pa.array(np.diff(at))], ["doc_id", "_row", "fp", "sketch", "sid", "size"])

    return run


def _forest_batches(radius: int):
    def bucket(c: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        mine = np.unique(np.concatenate(parts).view(np.uint64))
        moved, fixed = _moved(mine, CHOICES[c])
        a, b = forest(moved, radius, fixed)
        return pa.RecordBatch.from_arrays([pa.array(mine[a].view(np.int64)), pa.array(mine[b].view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows c, k, fp sorted by c and k: one bucket is held at a time, small ones are worked together."""
        held, last, size = [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c, k, codes = (x.to_numpy() for x in batch.columns)
            edge = [0, *(np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1).tolist(), len(c)]
            for a, b in zip(edge, edge[1:]):
                name = (int(c[a]), int(k[a]))
                if held and name != last and (size >= TOGETHER or name[0] != last[0]):
                    yield bucket(last[0], held)
                    held, size = [], 0
                last = name
                held.append(codes[a:b])
                size += b - a
        if held:
            yield bucket(last[0], held)

    return run


def simhash(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprint_batches(shingle, seed), "doc_id long, fp long")


def links(codes: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct fingerprints (column fp) to links (u, v) that span each component."""
    if not 0 <= radius <= len(BLOCKS) - KEEP:
        raise ValueError(f"radius must be 0 to {len(BLOCKS) - KEEP}")
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(_block_masks())])
    dealt = codes.select("fp", F.explode(cells).alias("cell")).select(F.col("cell.c").alias("c"), "fp", F.col("cell.k").alias("k"))
    return dealt.select("c", "k", "fp").repartition("c", "k").sortWithinPartitions("c", "k").mapInArrow(_forest_batches(radius), "u long, v long")


def _groups(fps: DataFrame, radius: int, more: DataFrame | None = None) -> DataFrame:
    """(fp, rep, label): each distinct fingerprint, its least doc_id, and its component; ``more`` adds links (u, v)."""
    codes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = links(codes.select("fp"), radius)
    label = connected_components(found if more is None else found.union(more)).withColumnRenamed("node", "fp")
    return codes.join(label, "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """Fingerprint and group of each document.

    ``docs`` needs doc_id and text; other columns are ignored.  Returns doc_id,
    fingerprint (16 hex digits) and component_id, the smallest doc_id reachable.
    Null and empty texts have fingerprint zero and are linked like any other.
    Rows with a null doc_id are kept with a null id and take part in links;
    component_id is null only where all ids of a group are null.  Repeated rows
    stay; an empty table gives an empty result.
    """
    fps = cut(simhash(docs, shingle, seed))
    named = _groups(fps, radius)
    low = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    groups = named.select("fp", "label").join(low, "label").select("fp", "component_id")
    return fps.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _alike(rows: DataFrame, texts: DataFrame, wide: int, similarity: float) -> DataFrame:
    """Links (u, v) between fingerprints of texts with alike sets of shingles.

    Rows with equal sets (column sid) are named by their least fingerprint;
    ``texts`` has the text of each _row.
    """
    node = rows.groupBy("sid").agg(F.min("fp").alias("fp"))
    same = rows.select("sid", F.col("fp").alias("u")).distinct().join(node, "sid").where("u <> fp").select("u", F.col("fp").alias("v"))

    def whole(ids: DataFrame) -> DataFrame:
        some = ids.join(rows.groupBy("sid").agg(F.min("_row").alias("_row")), "sid")
        return some.join(texts, "_row").groupBy("sid").agg(F.first("text").alias("text"))

    found = similar_links(rows.select("sid", "sketch", "size"), whole, wide, similarity)
    found = found.join(node.toDF("u", "fu"), "u").join(node.toDF("v", "fv"), "v").select(F.col("fu").alias("u"), F.col("fv").alias("v"))
    return same.union(found.where("u <> v"))


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2, wide: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates, with all columns of ``docs``.

    Texts are linked by their fingerprints (``shingle``, ``radius``), and where
    their sets of shingles of ``wide`` words have at least ``similarity`` in
    common (Jaccard, measured as ``similar.py`` says).  The row with the group's
    smallest doc_id stays; of rows that repeat this id, and of groups without
    any id, the one with the smallest hash of the row.  Null and empty texts are
    one group.  An empty table gives an empty result.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    safe = docs.toDF(*names)
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    # columns with a map can't be compared: their JSON is
    plain = [F.to_json(F.struct(n)) if "map<" in t else F.col(n) for n, t in safe.dtypes]
    keyed = safe.withColumn("_row", F.xxhash64(*plain))
    rows = keyed.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), "_row")
    full = rows.mapInArrow(_sketch_batches(shingle, wide), "doc_id long, _row long, fp long, sketch binary, sid long, size long")
    full = cut(full)
    fps = full.select("doc_id", "_row", "fp")
    groups = _groups(fps, radius, _alike(full, rows.select("_row", "text"), wide, similarity))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = fps.join(groups, "fp").groupBy("label").agg(best.alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x._row").alias("_row"))
    kept = kept.select(F.coalesce("_id", F.lit(-(1 << 63))).alias("_id"), "_row")
    found = keyed.withColumn("_id", F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))).join(kept, ["_id", "_row"], "left_semi")
    # rows alike in every column and in their fingerprint: one of them
    alike = fps.groupBy("doc_id", "_row").count().where("count > 1").limit(1).count()
    if alike:
        # the keys of the join come first, so that rows stay where it has put them
        found = found.withColumns({f"_{n}": p for n, p in zip(names, plain)}).dropDuplicates(["_id", "_row", *[f"_{n}" for n in names]])
    return found.select(names).toDF(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_simhash": op1_simhash}
SQL: dict[str, str] = {}
