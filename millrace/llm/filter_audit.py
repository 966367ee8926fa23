"""Filter interaction audit by inclusion-exclusion.

Five filters are applied to every document.  Per part of the corpus the joint
failures of all 32 sets of filters are counted as sums of flag products.  Every
figure of every order follows from those counts: Moebius inversion over the
supersets gives survivors, documents that one filter alone fails and those that
an earlier one had taken; the Harsanyi dividend of a set is its joint count with
the sign of its size, and a filter's Shapley value is its share of the dividends.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, pieces, stage_table, utf8

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
MIN_WORDS = 200
#: Percentages: different words of words, capitals of code points.
LEAST_DISTINCT, MOST_CAPITALS = 50, 2
SYMBOLS = b"#$%&*|"
#: Rows without an id share no key; they are dealt to so many.
SALTS = 1024

# bytes that begin a code point, capitals and symbols
_LEAD = (np.arange(256) & 0xC0) != 0x80
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def text_flags(text: bytes | memoryview, limit: int = CHUNK_BYTES) -> int:
    """Which of the filters A to D a whole text fails, as bits."""
    n_words, points, capitals, symbol, seen = 0, 0, 0, False, set()
    for piece in pieces(memoryview(text), limit):
        split = piece.split()
        n_words += len(split)
        seen.update(split)
        raw = np.frombuffer(piece, np.uint8)
        points += int(np.count_nonzero(_LEAD[raw]))
        capitals += int(np.count_nonzero(_CAPITAL[raw]))
        symbol = symbol or bool(_SYMBOL[raw].any())
    return (n_words < MIN_WORDS) | (100 * len(seen) < LEAST_DISTINCT * n_words) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | symbol << 3


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "part", "digest", "flags"]
    for batch in batches:
        data, off = utf8(batch.column(2))
        raw = memoryview(data)
        flags = np.array([text_flags(raw[off[i] : off[i + 1]]) for i in range(len(off) - 1)], np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(flags)], names)


def flagged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, flags) of each row: the text's SHA-256 and its failures of A to D."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return rows.mapInArrow(_flag, "doc_id long, part string, digest binary, flags int")


def joint_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n0..n31, good0.., toxic0..): documents of a part that fail all filters of a set, bit k of its number the k-th filter.

    The digest alone never is a key that rows are dealt by: the first id of each
    text is a partial aggregate, and rows meet it by id and digest.
    """
    rows = stage_table(flagged(docs), "flagged")
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("doc_id IS NOT NULL").withColumn("salt", F.lit(0))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS)) + 1).otherwise(0).cast("int")
    joined = rows.withColumn("salt", salt).join(told, ["doc_id", "salt"], "left").join(first, ["doc_id", "digest"], "left")
    again = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    masks = joined.groupBy("part", (F.col("flags") + F.when(again, 16).otherwise(0)).alias("mask")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(F.col("toxic"), 1)).alias("toxic")
    )
    flag = [(F.shiftright("mask", k) % 2).cast("long") for k in range(len(FILTERS))]

    def product(s: int, x: str):
        out = F.col(x)
        for k in range(len(FILTERS)):
            out = out * flag[k] if s >> k & 1 else out
        return F.sum(out).alias(f"{x}{s}")

    return masks.groupBy("part").agg(*[product(s, x) for x in ("n", "good", "toxic") for s in range(SETS)])


def _orders() -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names of all orders; of each order and step, the set of filters before and the filter's place."""
    names = ["".join(p) for p in permutations(FILTERS)]
    at = np.array([[FILTERS.index(c) for c in name] for name in names])
    before = np.cumsum(1 << at, axis=1) - (1 << at)
    return names, before, at


def alternating() -> np.ndarray:
    """Row P of the matrix gives, from joint failures, the documents that fail none of the filters of P."""
    s = np.arange(SETS)
    return np.where((s[None, :] & ~s[:, None]) == 0, 1 - 2 * (np.bitwise_count(s)[None, :] & 1).astype(np.int64), 0)


def shapley_shares() -> np.ndarray:
    """Row k gives, from joint failures, the sum over all orders of what filter k removes: 120 times its dividends by size."""
    s, size = np.arange(SETS), np.bitwise_count(np.arange(SETS)).astype(np.int64)
    dividend = np.where(size > 0, (2 * (size & 1) - 1) * 120 // np.maximum(size, 1), 0)
    return np.array([np.where(s >> k & 1, dividend, 0) for k in range(len(FILTERS))])


def _invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, before, at = _orders()
    none, share = alternating(), shapley_shares()
    s = np.arange(SETS)
    # documents that fail the filter and none of the earlier ones: joint counts of the sets with the filter put in
    hit = np.zeros((len(FILTERS), SETS, SETS), np.int64)
    for k in range(len(FILTERS)):
        for p in range(SETS):
            np.add.at(hit[k, p], s | 1 << k, none[p])
    bit = 1 << at
    for frame in frames:
        for row in frame.to_dict("records"):
            n, good, toxic = (np.array([row[f"{x}{i}"] for i in s], np.int64) for x in ("n", "good", "toxic"))
            fails, removed = n[1 << np.arange(len(FILTERS))], (hit @ n)[at, before]
            others = (hit @ n)[np.arange(len(FILTERS)), SETS - 1 - (1 << np.arange(len(FILTERS)))]
            made = {
                "part": row["part"], "filter_order": np.repeat(names, at.shape[1]), "step": np.tile(np.arange(1, at.shape[1] + 1, dtype=np.int32), len(names)), "kept": (none @ n)[before | bit].ravel(), "removed": removed.ravel(),
                "redundant": (fails[at] - removed).ravel(), "unique_fails": others[at].ravel(), "good_lost": (hit @ good)[at, before].ravel(), "toxic_lost": (hit @ toxic)[at, before].ravel(), "shapley": (share @ n)[at].ravel(),
            }
            yield pd.DataFrame(made)


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Effect of each filter at each step of all 120 orders, per part.

    ``docs`` needs doc_id, text and source; ``labels`` doc_id, quality and toxic;
    other columns are ignored.  A part is a source, null and empty together.  A
    null text is empty and so fails A alone, unless it repeats.  A row fails E if
    a row of smaller id has the same text (by SHA-256); rows without an id neither
    fail it nor make others fail, and have no labels.  Repeated rows count each;
    if labels repeat an id, one that says 1 decides.  An empty table gives an
    empty result; a part without failures has its rows all the same.
    """
    return joint_failures(docs, labels).mapInPandas(_invert, RESULT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Each order is walked document by document (by their failures), without inclusion-exclusion.
_ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
  CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN w.doc_id > first_id THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM c a, c b, c d, c e, c g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, left(filter_order, step - 1) AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step) k),
x AS (SELECT m.part, s.filter_order, s.step, s.f, m.n, m.good, m.toxic, m.fails, contains(m.fails, s.f) AS fails_it, len(list_intersect(string_split(s.before, ''), string_split(m.fails, ''))) > 0 AND s.before <> '' AND m.fails <> '' AS gone FROM m, s),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND fails_it THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails_it THEN toxic ELSE 0 END) AS toxic_lost FROM x GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""

QUERIES = {"op11_filter_audit": op11_filter_audit}
SQL = {"op11_filter_audit": _ORACLE}
