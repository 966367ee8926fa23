"""Work that needs an order, in blocks of it: no task sees a whole series.

Rows are dealt to ranges of their order, numbered from the counts of the ranges
before, and so to blocks of a fixed number of rows.  A frame that looks back a
few rows gets the block's halo, the last rows of the block before; a recurrence
is folded to one affine map a block, the maps are composed in turn, and each
block is replayed from the state that reaches it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows of a block.
ROWS = 1 << 16


def meet(rows: DataFrame, told: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with what ``told`` says of their keys; nulls are equal."""
    other = {c: f"_of_{i}" for i, c in enumerate(keys)}
    right = told.withColumnsRenamed(other)
    cond = F.lit(True)
    for c, o in other.items():
        cond = cond & F.col(c).eqNullSafe(F.col(o))
    return rows.join(right, cond).drop(*other.values())


def positions(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Adds ``_pos``, the place in ``order`` within ``by`` from 0 on, and its block ``_block``.

    Equal rows of the order have places in no given order.  The ranges are written
    once, so that later steps see the same places even if a task is run again.
    """
    n, keys = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*by, *order]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id())
    ranged = cut(ranged)
    sizes = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    if by:
        base = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")
        starts = sizes.select(*by, "_part", (base - F.col("_first")).alias("_shift"))
    else:
        # one row a range: as many as there are partitions
        told, upto = [], 0
        for r in sorted(sizes.collect(), key=lambda r: r["_part"]):
            told.append((r["_part"], upto - r["_first"]))
            upto += r["_n"]
        starts = F.broadcast(df.sparkSession.createDataFrame(told, "_part int, _shift long"))
    placed = meet(ranged, starts, [*by, "_part"]).select(*df.columns, (F.col("_seq") + F.col("_shift")).alias("_pos"))
    return placed.withColumn("_block", F.floor(F.col("_pos") / (rows or ROWS)).cast("long"))


def halo(placed: DataFrame, width: int, rows: int | None = None) -> DataFrame:
    """Rows of ``positions`` with ``_in``, the block they are seen in, and ``_own``: the last ``width`` rows of a block are seen in the next one too."""
    rows = rows or ROWS
    if width > rows:
        raise ValueError(f"a frame of {width} rows is longer than a block of {rows}")
    block = F.col("_block")
    seen = F.when(F.col("_pos") % rows >= rows - width, F.array(block, block + 1)).otherwise(F.array(block))
    return placed.withColumn("_in", F.explode(seen)).withColumn("_own", F.col("_in") == block)


def prefix(maps: np.ndarray, segment: np.ndarray | None = None, longest: int | None = None) -> np.ndarray:
    """Each of the matrices times all before it, within its segment if given, by doubling; segments are at most ``longest`` rows."""
    out, step = maps.copy(), 1
    while step < (longest or len(out)):
        if segment is None:
            out[step:] = out[step:] @ out[:-step]
        else:
            at = np.flatnonzero(segment[step:] == segment[:-step])
            out[at + step] = out[at + step] @ out[at]
        step *= 2
    return out


def _runs(frames: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of ordered rows, with the rows at which the key is another than in the row before."""
    last = None
    for p in frames:
        if len(p):
            first = np.ones(len(p), bool)
            own = p[list(keys)]
            told = own.astype(object).where(own.notna(), None)
            first[1:] = (told.to_numpy()[1:] != told.to_numpy()[:-1]).any(axis=1)
            first[0] = last is None or tuple(told.iloc[0]) != last
            last = tuple(told.iloc[-1])
            yield p.reset_index(drop=True), first


def _longest(first: np.ndarray) -> int:
    return int(np.diff(np.concatenate([[0], np.flatnonzero(first), [len(first)]])).max())


def _walk(maps: np.ndarray, first: np.ndarray, start: np.ndarray, carry: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """States after each row and before it; a run begins with its start, and the first row goes on from ``carry`` if it begins none."""
    n, size = len(maps), maps.shape[1]
    seed = np.concatenate([start, np.ones((n, 1))], axis=1)
    begins = first.copy()
    if not first[0]:
        seed[0, : size - 1], begins[0] = carry, True
    at = np.flatnonzero(begins)
    # where a run begins the map is a constant, so that nothing before it counts
    given = (maps[at] @ seed[at][:, :, None])[:, :, 0]
    maps = maps.copy()
    maps[at] = 0.0
    maps[at, :, -1] = given
    after = prefix(maps, None, _longest(begins))[:, :-1, -1]
    before = np.concatenate([seed[:1, :-1], after[:-1]])
    before[at] = seed[at, :-1]
    return after, before


def scan(placed: DataFrame, by: Sequence[str], states: int, maps: Callable[[pd.DataFrame], np.ndarray], out: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """A recurrence s -> M s over the rows of each key in order; states begin at 0.

    ``maps`` gives, for any rows, their (n, states + 1, states + 1) matrices over
    (state, 1).  ``out`` takes rows, their states and the states before them
    (n, states) and gives what ``schema`` says.  Blocks of many keys share a task.
    """
    size, group = states + 1, [*by, "_block"]
    types = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    keys = ", ".join([*(f"`{c}` {types[c]}" for c in by), "_block long"])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The product of each block's maps."""
        held = None
        for p, first in _runs(frames, group):
            m = maps(p)
            if held is not None and first[0]:
                yield held
            elif held is not None:
                m[0] = m[0] @ np.asarray(held["_map"].iloc[0]).reshape(size, size)
            ends = np.append(np.flatnonzero(first[1:]), len(p) - 1)
            total = prefix(m, np.cumsum(first), _longest(first))[ends]
            told = p.loc[ends, group].assign(_map=list(total.reshape(len(ends), -1)))
            if len(told) > 1:
                yield told.iloc[:-1]
            held = told.iloc[-1:]
        if held is not None:
            yield held

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The state that reaches each block, from the maps of those before."""
        carry = None
        for p, first in _runs(frames, by):
            after, before = _walk(np.stack(p["_map"].to_list()).reshape(len(p), size, size), first, np.zeros((len(p), states)), carry)
            carry = after[-1]
            yield p[group].assign(_state=list(before))

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for p, first in _runs(frames, group):
            start = np.stack(p["_state"].to_list()) if "_state" in p else np.zeros((len(p), states))
            after, before = _walk(maps(p), first, start, carry)
            carry = after[-1]
            yield out(p, after, before)

    if (placed.agg(F.max("_block")).first()[0] or 0) > 0:
        folded = placed.repartition(*group).sortWithinPartitions(*group, "_pos").mapInPandas(fold, f"{keys}, _map array<double>")
        reach = folded.repartition(*by).sortWithinPartitions(*group) if by else folded.coalesce(1).sortWithinPartitions(*group)
        placed = meet(placed, reach.mapInPandas(chain, f"{keys}, _state array<double>"), group)
    return placed.repartition(*group).sortWithinPartitions(*group, "_pos").mapInPandas(replay, schema)


def since_valid(placed: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Adds ``_start``, the place of a key's first value of ``column``, and ``_last``, that of the last one before the row; null where there is none."""
    valid = F.when(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")), F.col("_pos"))
    marks = placed.groupBy(*by, "_block").agg(F.min(valid).alias("_lo"), F.max(valid).alias("_hi"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(*by, "_block", F.min("_lo").over(Window.partitionBy(*by)).alias("_start"), F.max("_hi").over(earlier).alias("_before"))
    inside = Window.partitionBy(*by, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    return meet(placed, marks, [*by, "_block"]).withColumn("_last", F.coalesce(F.max(valid).over(inside), "_before")).drop("_before")
