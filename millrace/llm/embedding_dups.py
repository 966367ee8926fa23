"""Near-duplicate vectors by sorted projection passes.

Each pass orders all vectors lexicographically by a row of random hashes and
compares each with the next ones in that order; pairs of a high cosine are
verified and united across passes.  The window is bounded, so in a dense group
it sees a part of the links only: they are found again, without a bound, by
comparing the members of each united group block by block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage_table
from .components import connected_components

COSINE = 0.9
WINDOW = 64
#: A pair of exactly the least cosine is missed by all passes with this probability at most.
MISSED = 1e-3
#: A hash is the place and sign of the largest of so many projections; eight of them make a key.
PROJECTIONS, HASHES = 64, 8
#: Chance that one such hash is the same for two vectors of cosine 0.9, measured (0.466).
SAME_HASH = 0.46
SEED = 20260731
#: Members of a block, and rounds of block pairs that one job compares.
BLOCK, ROUNDS = 512, 2
STEP = 256


def passes(n: int, window: int = WINDOW, missed: float = MISSED) -> int:
    """How many orders are needed: some n / window vectors must be told apart by hashes that a pair shares only with luck."""
    if n <= window:
        return 1
    p = SAME_HASH ** (math.log(n / window) / math.log(2 * PROJECTIONS))
    return math.ceil(math.log(missed) / math.log1p(-p))


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(column: pa.Array, kind: str) -> list[np.ndarray]:
    """Vectors of a binary column."""
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _by_length(vectors: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each length that is there."""
    size = np.array([len(v) for v in vectors], np.int64)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, _unit(np.stack([vectors[i] for i in rows]))


def _valid(kind: str):
    """(vec_id, digest, raw) of each row; both are null where the vector takes part in nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for v in batch.column(1):
                x = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    x = x.tobytes() if np.isfinite(x).all() and x.any() else None
                raw.append(x)
            digest = [x and hashlib.blake2b(x, digest_size=24).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "digest", "raw"])

    return run


def keys(x: np.ndarray, turn: int) -> np.ndarray:
    """The hashes of a pass, concatenated to one whole number, of unit vectors of one length."""
    out = np.zeros(len(x), np.int64)
    for h in range(HASHES):
        p = x @ np.random.default_rng([SEED, turn, h, x.shape[1]]).standard_normal((x.shape[1], PROJECTIONS))
        k = np.abs(p).argmax(axis=1)
        out = out * (2 * PROJECTIONS) + 2 * k + (p[np.arange(len(x)), k] > 0)
    return out


def _keyed(kind: str, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch.column(1), kind)
            key = np.zeros(len(vectors), np.int64)
            for rows, x in _by_length(vectors):
                key[rows] = keys(x, turn)
            size = np.array([len(v) for v in vectors], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(key), batch.column(0), batch.column(1)], ["size", "key", "kid", "raw"])

    return run


def _spans(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a symmetric matrix of links, and for each the least row that it reaches in it, itself left out."""
    label = np.arange(len(near))
    some = np.flatnonzero(near.any(axis=1))
    links = near[np.ix_(some, some)]
    low = label[some]
    while len(some):
        new = np.minimum(low, np.where(links, low[None, :], len(near)).min(axis=1))
        if (new == low).all():
            break
        low = new
    label[some] = low
    rows = np.flatnonzero(label < np.arange(len(near)))
    return rows, label[rows]


def _links(x: np.ndarray, cosine: float, window: int | None) -> np.ndarray:
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if window is not None:
        at = np.arange(len(x))
        near &= np.abs(at[:, None] - at[None, :]) <= window
    return near


#: kind 0: a link (u, v); 1: a vector u near a border of the partition, the at-th of it; 2: the partition has ``at`` vectors.
_PASS = "kind int, part int, at long, u long, v long, size int, raw binary"


def _compare(kind: str, cosine: float, window: int):
    """Verified pairs of an ordered partition, as a spanning forest of each stretch, and its rows near either border."""

    def batch_of(k: int, part: int, at, u, v, size, raw) -> pa.RecordBatch:
        n = len(at)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(np.asarray(at, np.int64)), pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(size, pa.int32()), pa.array(raw, pa.binary())], [x.split()[0] for x in _PASS.split(", ")]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        kids, vectors = np.zeros(0, np.int64), []  # the last ones before a batch
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(kids)
            kids = np.concatenate([kids, batch.column(2).to_numpy()])
            vectors = vectors + _vectors(batch.column(3), kind)
            head = [i for i in range(old, len(kids)) if n + i - old < window]
            if head:
                yield batch_of(1, part, [n + i - old for i in head], kids[head], [None] * len(head), [len(vectors[i]) for i in head], [vectors[i].tobytes() for i in head])
            us, vs = [], []
            for start in range(old, len(kids), STEP):
                first, end = max(0, start - window), min(len(kids), start + STEP)
                for rows, x in _by_length(vectors[first:end]):
                    at, root = _spans(_links(x, cosine, window if len(rows) == end - first else None))
                    us.append(kids[first + rows[at]])
                    vs.append(kids[first + rows[root]])
            u = np.concatenate(us)
            if len(u):
                none = [None] * len(u)
                yield batch_of(0, part, np.zeros(len(u)), u, np.concatenate(vs), none, none)
            n += len(kids) - old
            kids, vectors = kids[-window:], vectors[-window:]
        rest = [i for i in range(len(kids)) if n - len(kids) + i >= window]
        if rest:
            yield batch_of(1, part, [n - len(kids) + i for i in rest], kids[rest], [None] * len(rest), [len(vectors[i]) for i in rest], [vectors[i].tobytes() for i in rest])
        if n:
            yield batch_of(2, part, [n], [None], [None], [None], [None])

    return run


def _across(kind: str, cosine: float):
    """Links among the rows at either side of a border between partitions."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        kid = p["u"].to_numpy(np.int64)
        us, vs = [], []
        for rows, x in _by_length([np.frombuffer(r, kind) for r in p["raw"]]):
            at, root = _spans(_links(x, cosine, None))
            us.append(kid[rows[at]])
            vs.append(kid[rows[root]])
        return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return run


def found_links(vectors: DataFrame, kind: str, cosine: float, window: int, turns: int) -> DataFrame:
    """(u, v): links found in ``turns`` orders of (kid, raw), enough of them to reach what all found ones reach.

    Where partitions meet, the rows at most a window from the border are compared
    once more; all rows of partitions shorter than a window are such rows.
    """
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ran = []
    for turn in range(turns):
        keyed = vectors.mapInArrow(_keyed(kind, turn), "size int, key long, kid long, raw binary")
        ordered = keyed.repartitionByRange(n, "size", "key", "kid").sortWithinPartitions("size", "key", "kid")
        ran.append(stage_table(ordered.mapInArrow(_compare(kind, cosine, window), _PASS), "pass").withColumn("turn", F.lit(turn)))
    rows = ran[0]
    for r in ran[1:]:
        rows = rows.union(r)
    upto = Window.partitionBy("turn").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = rows.where("kind = 2").select("turn", "part", (F.sum("at").over(upto) - F.col("at")).alias("start"))
    edge = rows.where("kind = 1").join(starts, ["turn", "part"]).select("turn", "u", "raw", (F.col("start") + F.col("at")).alias("pos"))
    # a border at x concerns the places from x - window to x + window - 1
    slot = F.explode(F.sequence(F.floor((F.col("pos") - window + 1) / window), F.floor((F.col("pos") + window) / window)))
    border = starts.where("start > 0").select("turn", F.col("start").alias("x"), F.floor(F.col("start") / window).alias("slot"))
    near = edge.withColumn("slot", slot).join(border, ["turn", "slot"]).where((F.col("pos") >= F.col("x") - window) & (F.col("pos") < F.col("x") + window))
    across = near.groupBy("turn", "x").applyInPandas(_across(kind, cosine), "u long, v long")
    return rows.where("kind = 0").select("u", "v").union(across)


def _degrees(kind: str, cosine: float):
    """Per key (label, turn, block): links between the left rows and the right ones, or among the left ones where there are no others."""

    def score(kids: np.ndarray, right: np.ndarray, times: np.ndarray, vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = np.zeros(len(kids), np.int64)
        for rows, x in _by_length(vectors):
            side, k = right[rows], times[rows]
            if side.any():
                near = x[~side] @ x[side].T >= cosine
                n[rows[~side]] = near @ k[side]
                n[rows[side]] = k[~side] @ near
            else:
                n[rows] = _links(x, cosine, None) @ k
        return kids, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(table: pa.Table, upto: int) -> pa.RecordBatch:
            key = np.stack([table.column(c).to_numpy() for c in range(3)])[:, :upto]
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [upto]])
            right, kid, times = (table.column(c).to_numpy()[:upto] for c in (3, 4, 5))
            vectors = _vectors(table.column(6).slice(0, upto), kind)
            out = [score(kid[a:b], right[a:b].astype(bool), times[a:b], vectors[a:b]) for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1]
            kids, n = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(kids), pa.array(n)], ["kid", "links"])

        def last_key(batch: pa.RecordBatch) -> int:
            """Where the last key of a batch begins."""
            key = np.stack([batch.column(c).to_numpy() for c in range(3)])
            other = np.flatnonzero((key != key[:, -1:]).any(axis=0))
            return int(other[-1]) + 1 if len(other) else 0

        for batch in batches:
            if not batch.num_rows:
                continue
            same = bool(held) and all(batch.column(c)[0] == held[-1].column(c)[held[-1].num_rows - 1] for c in range(3))
            at = last_key(batch)
            if at or not same:
                table = pa.Table.from_batches([*held, batch.slice(0, at)] if same or at else held) if held or at else None
                if table is not None and table.num_rows:
                    yield settle(table.combine_chunks(), table.num_rows)
                held = [batch.slice(at)]
            else:
                held.append(batch)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield settle(table, table.num_rows)

    return run


def degrees(members: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(kid, links) from (label, kid, times, raw): for each member how many vectors of its group it links with, each as often as it is there.

    Members are dealt to blocks; every two blocks meet once, in rounds of which a
    job takes a few, so that a vector is copied a bounded number of times at once.
    """
    size = members.groupBy("label").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK)
    size = size.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).select("label", "blocks")
    large = stage_table(size, "large")
    most = large.agg(F.max("blocks")).first()[0] or 1
    told = members.join(large, "label", "left").na.fill(1, ["blocks"]) if most > 1 else members.withColumn("blocks", F.lit(1))
    told = told.withColumn("block", F.pmod(F.xxhash64("kid"), "blocks").cast("int"))
    half, out = most // 2 + 1, []
    for start in range(0, half, ROUNDS):
        turn, block, blocks = F.col("turn"), F.col("block"), F.col("blocks")
        ahead = told.withColumn("turn", F.explode(F.sequence(F.lit(start), F.lit(min(start + ROUNDS, half) - 1)))).where(turn <= F.floor(blocks / 2))
        # a half turn pairs each two blocks twice: the lower half goes on its own
        once = (2 * turn < blocks) | (blocks == 1)
        sides = F.array(
            F.struct(block.alias("key"), F.lit(0).alias("right"), (once | (block < turn)).alias("on")),
            F.struct(F.pmod(block - turn, blocks).alias("key"), F.lit(1).alias("right"), ((turn > 0) & (once | (F.pmod(block - turn, blocks) < turn))).alias("on")),
        )
        dealt = ahead.withColumn("side", F.explode(sides)).where("side.on").select("label", "turn", F.col("side.key").alias("key"), F.col("side.right").alias("right"), "kid", "times", "raw")
        counted = dealt.repartition("label", "turn", "key").sortWithinPartitions("label", "turn", "key", "right").mapInArrow(_degrees(kind, cosine), "kid long, links long")
        out.append(stage_table(counted.groupBy("kid").agg(F.sum("links").alias("links")), "degrees"))
    total = out[0]
    for x in out[1:]:
        total = total.union(x)
    return total.groupBy("kid").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", cosine: float = COSINE, window: int = WINDOW, missed: float = MISSED) -> DataFrame:
    """Links and group of each vector: vec_id, n_links, component_id, kept.

    ``vectors`` needs an id and an array of numbers; other columns are ignored.
    A vector that is null, empty or all zero, or holds a null, NaN or infinite
    component, has no link and is its own group; so has one whose length no other
    shares.  Equal vectors link with each other, and repeated rows count as one
    vector each, also under one id.  A row without an id counts as a vector, is no
    group's id and is not kept; a group without any id has none.  An empty table
    gives an empty result.

    Pairs are found with a probability (see ``passes``; the constants hold for a
    cosine of 0.9 or more); within a group that was found no link is missed.
    """
    spark = vectors.sparkSession
    kind = "<f4" if isinstance(vectors.schema[column].dataType.elementType, T.FloatType) else "<f8"
    given = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("vector"))
    rows = given.mapInArrow(_valid(kind), "vec_id long, digest binary, raw binary")
    one = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.first("raw").alias("raw"), F.min("vec_id").alias("low"), F.count("*").alias("times"))
    one = stage_table(one.withColumn("kid", F.monotonically_increasing_id()), "vectors")

    links = stage_table(found_links(one.select("kid", "raw"), kind, cosine, window, passes(one.count(), window, missed)), "links")
    groups = stage_table(connected_components(links).select(F.col("node").alias("kid"), "label"), "groups")
    members = one.join(groups, "kid").select("label", "kid", "times", "low", "raw")
    lowest = members.groupBy("label").agg(F.min("low").alias("lowest"))
    reach = groups.join(lowest, "label").select("kid", "lowest")
    told = one.select("digest", "kid", "low", "times").join(reach, "kid", "left").join(degrees(members.drop("low"), kind, cosine), "kid", "left")
    told = told.select("digest", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("lowest", "low").alias("component_id"))
    ids = rows.select("vec_id", "digest")
    out = ids.where("digest IS NOT NULL").join(told, "digest").select("vec_id", "n_links", "component_id")
    out = out.union(ids.where("digest IS NULL").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op12_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_embedding_dups": op12_embedding_dups}
#: All pairs in SQL are too slow on whole tables; a test compares with brute force.
SQL: dict[str, str] = {}
