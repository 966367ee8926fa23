"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces.  A text
that holds the item within k edits holds one piece unchanged, so exact piece
hits, found by one automaton for all pieces, give every candidate window.  Each
window is verified by Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, filter_rows, stage_table

#: One edit is allowed for so many code points of an item.
CHARS_PER_EDIT = 20
#: Items are matched in blocks of at most about so many bytes; a worker's automaton takes some 50 times as much.
BLOCK_BYTES = 4 << 20


def normal(text: str | None) -> str:
    """Lower case, with each run of white space as one blank."""
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces (offset, text) of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(item: str, text: str, k: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """Least (distance, end) of ``item`` in any substring of ``text``, if at most k."""
    m = len(item)
    if masks is None:
        masks = char_masks(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, i + 1)
            if not score:
                break
    return best


def char_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items, self.budget = [], []
        places: dict[str, list[tuple[int, int]]] = {}
        known: dict[str, int] = {}
        self.ids: list[list[int]] = []
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            if text in known:
                self.ids[known[text]].append(item_id)
                continue
            known[text] = at = len(self.items)
            self.items.append(text)
            self.ids.append([item_id])
            self.budget.append(len(text) // CHARS_PER_EDIT)
            for off, piece in pieces(text, self.budget[-1]):
                places.setdefault(piece, []).append((at, off))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, distance) of each item the text holds within its budget."""
        text = normal(text)
        if not self.items or not text:
            return []
        starts: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for at, off in where:
                starts.setdefault(at, []).append(end + 1 - size - off)
        out = []
        for at, found in starts.items():
            item, k = self.items[at], self.budget[at]
            best = None
            found.sort()
            low = high = found[0]
            for s in [*found[1:], None]:
                if s is not None and s <= high + len(item) + 2 * k:
                    high = s
                    continue
                got = myers(item, text[max(0, low - k) : high + len(item) + k], k)
                if got is not None and (best is None or got[0] < best):
                    best = got[0]
                if best == 0 or s is None:
                    break
                low = high = s
            if best is not None:
                out += [(i, best) for i in self.ids[at]]
        return out


def blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """Distinct items on the driver, in blocks of bounded size.

    The benchmark's size is read first; a block is collected at a time and only
    blocks, not the table, are broadcast.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-size // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    for i in range(n):
        mine = items if n == 1 else items.where(part == i)
        yield sorted(((r["item_id"], r["text"]) for r in mine.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _match_batches(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in batches:
            matcher = matcher or Matcher(items.value)
            rows = [(d, i, k) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for i, k in matcher.find(t.as_py())]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "distance"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance) for each document that holds an item.

    ``distance`` is the least number of edits between the item and a passage,
    after lower-casing and joining white space, at most one per CHARS_PER_EDIT
    code points.  Null and empty texts and items hold nothing; repeated document
    rows give repeated results, repeated items count once; null ids are kept.
    Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in blocks(benchmark):
        got = rows.mapInArrow(_match_batches(spark.sparkContext.broadcast(items)), "doc_id long, item_id long, distance long")
        out = got if out is None else out.union(got)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no item of the benchmark.

    Each block of items is a pass of its own over what the one before kept, so that
    a task holds one block's automaton; the table between two passes is written and
    goes with the next one.
    """
    staged = None
    for k, items in enumerate(blocks(benchmark)):
        if k:
            docs, before = stage_table(docs, "kept"), staged
            staged = docs
            if before is not None:
                drop_staged(before)
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def make(sent=sent):
            matcher = Matcher(sent.value)
            return lambda column: np.array([not matcher.find(t.as_py()) for t in column], bool)

        docs = filter_rows(docs, "text", make)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
SQL: dict[str, str] = {}
