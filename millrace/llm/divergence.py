"""Source divergence audit by systolic rotation.

The sources of a language are its groups.  Terms of each group are counted, and
groups are dealt to blocks of a few, whose count vectors are cut into shards of
terms and compressed: a cell is one block's vectors in one shard.  Cells stay
where they are; in the rounds of a round-robin tournament between blocks a copy
of each visiting cell travels to its host, which evaluates every meeting of two
groups in both directions.  Terms that rank for a group are first chosen by a
heap in each cell.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_staged, pieces, stage_table, utf8

SCALE = 1_000_000_000
MIN_DOCS, TOP = 3, 200
#: Groups of a block, about how many counts a cell holds, and rounds whose visitors travel in one job.
BLOCK_GROUPS, CELL_COUNTS, ROUNDS = 8, 1 << 14, 4
#: Different terms that a task counts before it hands them on.
HELD = 1 << 17
SALTS = 64

# letters and bytes beyond ASCII are kept, A-Z lower-cased, others part terms
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's texts, handed on whenever many are held."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            size = len(terms)
            cols = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array([t.decode() for t in terms], pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        data, off = utf8(batch.column(2))
        raw = memoryview(data)
        for i, key in enumerate(zip(langs, sources)):
            n, docs = held.setdefault(key, (Counter(), Counter()))
            seen: set[bytes] = set()
            for piece in pieces(raw[off[i] : off[i + 1]], cut=_FOLD):
                split = piece.split()
                n.update(split)
                seen.update(split)
            docs.update(seen)
            if i % 64 == 0 and sum(len(x[0]) for x in held.values()) > HELD:
                yield from out()
    yield from out()


def probability(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / total), exact: divided in three steps of a thousand, as the product may pass 64 bits."""
    top = np.asarray(count, np.int64) + 1
    q, r = top // total, top % total
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + r // total, r % total
    return 1 + q


def divergence(p, q):
    """floor((p - q)^2 / q); the square stays below 2^63."""
    return (p - q) * (p - q) // q


def pack(ids: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """Sparse vectors of a block: gaps of ids and counts, compressed."""
    gaps = [np.diff(x, prepend=0) for x in ids]
    return zlib.compress(np.concatenate([np.array([len(x) for x in ids], np.int64), *gaps, *counts]).astype("<i8").tobytes(), 1)


def unpack(blob: bytes, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    flat = np.frombuffer(zlib.decompress(blob), "<i8")
    at = k + np.concatenate([[0], np.cumsum(flat[:k])])
    span = int(at[-1]) - k
    cut = [(int(a), int(b)) for a, b in zip(at[:-1], at[1:])]
    return [np.cumsum(flat[a:b]) for a, b in cut], [flat[a + span : b + span] for a, b in cut]


def _dense(cell: tuple, union: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of a cell's groups over some terms, and of a term without a count."""
    totals, blob, v = cell
    ids, counts = unpack(blob, len(totals))
    none = np.array([probability(np.zeros(1, np.int64), n + v)[0] for n in totals])
    out = np.repeat(none[:, None], len(union), axis=1)
    for k, n in enumerate(totals):
        out[k, np.searchsorted(union, ids[k])] = probability(counts[k], n + v)
    return out, none


def meet(a: tuple, b: tuple, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f over a shard's terms: each group of cell ``a`` against each of ``b`` (rows: a), and in the other direction.

    A cell is (totals, blob, v).  Terms that no group of either cell has count by
    their number alone; they are added for all v terms where ``whole`` says so, in
    one shard of the language, and each shard adds how its terms differ from that.
    """
    v = a[2]
    shape = (len(a[0]), len(b[0]))
    if not v:
        return np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    union = np.unique(np.concatenate([np.zeros(0, np.int64), *unpack(a[1], shape[0])[0], *unpack(b[1], shape[1])[0]]))
    (p, p0), (q, q0) = _dense(a, union), _dense(b, union)
    there, back = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    for i in range(shape[0]):
        for j in range(shape[1]):
            for out, x, y, x0, y0 in ((there, p[i], q[j], p0[i], q0[j]), (back, q[j], p[i], q0[j], p0[i])):
                base = int(divergence(x0, y0))
                out[i, j] = int(divergence(x, y).sum()) - base * len(union) + (base * v if whole else 0)
    return there, back


def _evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of all meetings of host and visitor; a cell without a visitor plays its own groups."""
    for batch in batches:
        for row in batch.to_pylist():
            a = (row["totals"], row["blob"], row["v"])
            home = row["other_blob"] is None
            b = a if home else (row["other_totals"], row["other_blob"], row["v"])
            x, y = row["names"], row["names"] if home else row["other_names"]
            there, back = meet(a, b, row["shard"] == 0)
            pairs = [(x[i], y[j], int(there[i, j])) for i in range(len(x)) for j in range(len(y)) if not home or i != j]
            if not home:
                pairs += [(y[j], x[i], int(back[i, j])) for i in range(len(x)) for j in range(len(y))]
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(pairs), pa.string()), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array([p[2] for p in pairs], pa.int64())], ["lang", "source", "item", "value"])


def _cell(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
    """One block's vectors in one shard, and for each of its groups the heap of terms that lie most above the language."""
    heads = p[p["id"] < 0].sort_values("gid")
    body = p[p["id"] >= 0].sort_values(["gid", "id"])
    names, totals = heads["source"].tolist(), heads["n"].astype("int64").tolist()
    v, whole = int(heads["v"].iloc[0]), int(heads["whole"].iloc[0])
    groups = dict(tuple(body.groupby("gid", sort=False)))
    ids, counts, tops = [], [], []
    for gid, source, total in zip(heads["gid"], names, totals):
        g = groups.get(gid, body.iloc[:0])
        ids.append(g["id"].to_numpy(np.int64))
        counts.append(g["n"].to_numpy(np.int64))
        if len(g):
            own, lang = probability(counts[-1], total + v), probability(g["everywhere"].to_numpy(np.int64), whole + v)
            over = np.flatnonzero((own > lang) & (counts[-1] > 0))
            value, terms = divergence(own, lang)[over], g["term"].to_numpy()[over]
            tops += [(source, t.decode(), -x) for x, t in heapq.nsmallest(TOP, zip((-value).tolist(), (t.encode() for t in terms)))]
    made = pd.DataFrame([(names, totals, pack(ids, counts), None, None, None), *[(None, None, None, *t) for t in tops]], columns=["names", "totals", "blob", "source", "item", "value"])
    made["value"] = made["value"].astype("Int64")
    for name, x in zip(("lang", "shard", "block", "blocks", "v"), (*key, int(heads["blocks"].iloc[0]), v)):
        made[name] = x
    return made


CELL = "lang string, shard int, block int, blocks int, v long, names array<string>, totals array<long>, blob binary, source string, item string, value long"


def host_of(block, blocks, turn):
    """The block that ``block`` meets in a round of the circle method; without a number of its own where the count is odd."""
    even = blocks + blocks % 2
    ring = F.greatest(even - 1, F.lit(1))
    other = F.pmod(2 * turn - block, ring)
    return F.when(block == even - 1, turn).when(other == block, even - 1).otherwise(other).cast("int")


def cells(docs: DataFrame) -> DataFrame:
    """Cells and the terms their heaps keep (those have no blob), written to the shared folder."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = counted.withColumns({"everywhere": F.sum("n").over(term), "there": F.sum("docs").over(term), "first": (F.row_number().over(term.orderBy("source")) == 1).cast("long")}).where(F.col("there") >= MIN_DOCS)
    kept = stage_table(kept.drop("docs", "there"), "terms")

    lang = kept.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("whole"), F.count("*").alias("entries"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per = Window.partitionBy("lang")
    groups = (
        rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(lang, "lang", "left").na.fill(0, ["total", "v", "whole", "entries"])
        .withColumn("gid", (F.row_number().over(per.orderBy("source")) - 1).cast("int")).withColumn("block", F.floor(F.col("gid") / BLOCK_GROUPS).cast("int")).withColumn("blocks", (F.max("block").over(per) + 1).cast("int"))
        .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("entries") / (CELL_COUNTS * F.col("blocks")))).cast("int"))
    )
    groups = stage_table(groups, "groups")
    fixed = ["lang", "source", "gid", "block", "blocks", "v", "whole"]
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    body = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"]).select(*fixed, F.pmod(F.xxhash64("term", F.lit(1)), "shards").cast("int").alias("shard"), "term", "n", "everywhere")
    heads = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(*fixed, "shard", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), F.lit(0).cast("long").alias("everywhere"))
    # heads have no term and so come first: terms are numbered from 0
    told = body.union(heads).withColumn("id", (F.dense_rank().over(Window.partitionBy("lang", "shard").orderBy(F.col("term").asc_nulls_first())) - 2).cast("long"))
    made = stage_table(told.groupBy("lang", "shard", "block").applyInPandas(_cell, CELL), "cells")
    drop_staged(kept)
    drop_staged(groups)
    return made


def tournament(spark: SparkSession, table: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of groups, from cells."""
    where = ["lang", "shard", "block"]
    resident = table.where("blob IS NOT NULL").select(*where, "blocks", "v", "names", "totals", "blob").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *where).persist(StorageLevel.DISK_ONLY)
    most = resident.agg(F.max("blocks")).first()[0] or 0
    kind = "lang string, source string, item string, value long"
    none = [F.lit(None).cast(t).alias(f"other_{c}") for c, t in (("names", "array<string>"), ("totals", "array<long>"), ("blob", "binary"))]
    given = ["lang", "shard", "v", "names", "totals", "blob"]
    sums = [resident.select(*given, *none).mapInArrow(_evaluate, kind)]
    last = most + most % 2 - 1 if most > 1 else 0
    for start in range(0, last, ROUNDS):
        turns = F.sequence(F.lit(start), F.lit(min(start + ROUNDS, last) - 1))
        turn = F.col("turn")
        visit = resident.withColumn("turn", F.explode(turns)).where(turn < F.col("blocks") + F.col("blocks") % 2 - 1).withColumn("host", host_of(F.col("block"), F.col("blocks"), turn)).where("host < block")
        visit = visit.select("lang", "shard", F.col("host").alias("block"), *[F.col(c).alias(f"other_{c}") for c in ("names", "totals", "blob")])
        sums.append(resident.join(visit, where).select(*given, *[f"other_{c}" for c in ("names", "totals", "blob")]).mapInArrow(_evaluate, kind))
    out = []
    for s in sums:
        out.append(stage_table(s.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "meetings"))
    resident.unpersist()
    total = out[0]
    for s in out[1:]:
        total = total.union(s)
    return total.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame) -> DataFrame:
    """How far each source of a language lies from each other one, and which terms tell it from the language.

    ``docs`` needs text, lang and source; other columns are ignored.  Nulls of the
    three count as ''.  Every row is a document, repeated ones too.  A group
    without terms takes part with counts of zero; in a language without kept terms
    all pairs have the value 0 and no term ranks.  Equal values rank by item.  An
    empty table gives an empty result.
    """
    table = cells(docs)
    pairs = tournament(docs.sparkSession, table)
    terms = table.where("blob IS NULL").select("lang", "source", "item", "value")
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).cast("int").alias("rank"))

    return ranked(pairs, "pair").union(ranked(terms, "term").where(F.col("rank") <= TOP))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS everywhere FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.everywhere, coalesce(x.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p,
  1 + (1000000000 * (everywhere + 1)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang, source)) AS q FROM c),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM term) z WHERE rank <= 200"""

QUERIES = {"op13_source_divergence": op13_source_divergence}
SQL = {"op13_source_divergence": _ORACLE}
