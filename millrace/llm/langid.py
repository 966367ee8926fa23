"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Character n-grams of folded text (lower case, everything but letters is one
blank) are hashed to ``DIMS`` buckets.  Weights come from follow-the-regularised
-leader with elastic-net penalties over a bounded sample of labelled rows, and
a temperature is fitted on rows of that sample which were kept aside.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, filter_rows, ranges, utf8

DIMS = 1 << 13
ORDERS = (1, 2, 3)
#: Texts and bytes that are counted at once.
ROWS, CHUNK = 64, 1 << 20
#: Bounds of the training sample: rows aimed at per language, at least and in all, and bytes of a text.
ROWS_PER_LANG, LEAST_ROWS, MAX_ROWS, MAX_TRAIN_BYTES = 600, 20, 6000, 20_000


def fold_table() -> np.ndarray:
    """Code point to its lower-case letter, zero for anything that isn't a letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def ngram_counts(data: np.ndarray, off: np.ndarray, table: np.ndarray, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-gram counts of at most ROWS texts, as (row, slot, count) in order of both, and the number of letters of each text."""
    n = len(off) - 1
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    first = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), off)
    sym = table[code]
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    letters = np.bincount(doc[sym > 0], minlength=n)
    keep = np.ones(len(sym), bool)  # runs of blanks become one
    keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0) | (doc[1:] != doc[:-1])
    sym, doc = sym[keep], doc[keep]
    out = np.zeros(n * dims, np.int64)
    for at in range(0, len(sym), CHUNK):  # long texts are hashed a piece at a time
        some, of = sym[at : at + CHUNK + ORDERS[-1] - 1].astype(np.uint64), doc[at : at + CHUNK + ORDERS[-1] - 1]
        for order in ORDERS:
            m = min(CHUNK, len(some) - order + 1)
            if m <= 0:
                break
            h = some[:m] + np.uint64(1)
            for k in range(1, order):
                h = h * np.uint64(0x9E3779B97F4A7C15) + some[k : m + k]
            h = (h ^ np.uint64(order)) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            cell = (h >> np.uint64(40)).astype(np.int64) % dims + of[:m].astype(np.int64) * dims
            ok = of[:m] == of[order - 1 : m + order - 1]
            if order == 1:
                ok = ok & (some[:m] > 0)
            out += np.bincount(cell[ok], minlength=n * dims)
    cell = np.flatnonzero(out)
    return cell // dims, cell % dims, out[cell], letters


def tfidf(row: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Values of rows of length one, for the entries (row, count, idf of the slot) of ``n`` texts."""
    x = np.log1p(count) * idf
    return x / np.maximum(np.sqrt(np.bincount(row, x * x, minlength=n)), 1e-12)[row]


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class FTRL:
    """Multinomial FTRL-proximal with elastic-net penalties on sparse rows."""

    def __init__(self, dims: int, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01):
        self.z = np.zeros((dims + 1, classes))
        self.n = np.zeros((dims + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax((x @ w)[None, :])[0]
        p[y] -= 1
        g = x[:, None] * p[None, :]
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


def pieces(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most ROWS texts and about CHUNK bytes."""
    for i, j in chunks(off, CHUNK):
        for k in range(i, j, ROWS):
            yield k, min(j, k + ROWS)


def logits(model: dict, row: np.ndarray, slot: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Scores (texts x languages) of sparse counts of at most ROWS texts."""
    x = np.zeros((n, model["dims"]), np.float32)
    x[row, slot] = tfidf(row, count, model["idf"][slot], n)
    return x @ model["w"] + model["b"]


def fit(texts: list[str], labels: list[str], dims: int = DIMS, epochs: int = 3, seed: int = 7) -> dict:
    """Fit weights and temperature; every fifth row is kept aside for the latter."""
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    table = fold_table()
    data, off = utf8(pa.array(texts, pa.string()))
    parts = []
    for i, j in pieces(off):
        row, slot, count, _ = ngram_counts(data[off[i] : off[j]], off[i : j + 1] - off[i], table, dims)
        parts.append((row + i, slot.astype(np.int32), count.astype(np.int32)))
    row, slot, count = (np.concatenate(x) for x in zip(*parts))
    begin = np.searchsorted(row, np.arange(len(y) + 1))
    idf = (np.log((1 + len(y)) / (1 + np.bincount(slot, minlength=dims))) + 1).astype(np.float32)
    value = tfidf(row, count, idf[slot], len(y))
    aside = np.arange(len(y)) % 5 == 4
    if aside.sum() < 2 or (~aside).sum() < 1:
        aside[:] = False
    ftrl, rng = FTRL(dims, len(names)), np.random.default_rng(seed)
    train = np.flatnonzero(~aside)
    for _ in range(epochs):
        for i in rng.permutation(train):
            mine = slice(begin[i], begin[i + 1])
            ftrl.learn(np.append(slot[mine], dims), np.append(value[mine], 1.0), int(y[i]))
    w = ftrl.weights()
    model = {"names": names, "idf": idf, "w": w[:-1].astype(np.float32), "b": w[-1], "t": 1.0, "dims": dims}
    if aside.any() and len(names) > 1:
        z = []
        kept = np.flatnonzero(aside)
        for k in range(0, len(kept), ROWS):
            some = kept[k : k + ROWS]
            at = ranges(begin[some], begin[some + 1] - begin[some])
            z.append(logits(model, np.searchsorted(some, row[at]), slot[at], count[at], len(some)))
        model["t"] = temperature(np.concatenate(z), y[aside])
    return model


def temperature(z: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, of a grid from 1/20 to 20."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(truth)), truth], 1e-12)).mean() + 1e-6 * abs(np.log(t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def predict(model: dict, data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text; ``und`` with score 0 where no letter is."""
    names, scores = [], [np.zeros(0)]
    for i, j in pieces(off):
        row, slot, count, letters = ngram_counts(data[off[i] : off[j]], off[i : j + 1] - off[i], table, model["dims"])
        if not model["names"]:
            names += ["und"] * (j - i)
            scores.append(np.zeros(j - i))
            continue
        p = softmax(logits(model, row, slot, count, j - i) / model["t"])
        best = p.argmax(axis=1)
        names += [model["names"][k] if n else "und" for k, n in zip(best.tolist(), letters.tolist())]
        scores.append(np.where(letters > 0, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0))
    return names, np.concatenate(scores)


def _predict_batches(model, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(model.value, *utf8(batch.column(2)), table.value)
            cols = [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out() -> F.Column:
    """True where crc32(doc_id as text) mod 5 is 0; rows without an id are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> dict:
    """Fit on a bounded sample of the labelled rows that may be learned from.

    Of each language about ``rows_per_lang`` rows are taken by a hash of text and
    id, or fewer where all come to more than MAX_ROWS, but LEAST_ROWS at least, of
    texts up to MAX_TRAIN_BYTES.  Every language with such a text is learnt.
    """
    open_rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= MAX_TRAIN_BYTES))
    open_rows = open_rows.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text", "doc_id").alias("k"))
    sizes = open_rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.pmod("k", F.lit(1 << 30))).alias("low")).toPandas()
    if not len(sizes):
        return {"names": [], "dims": DIMS}
    aim = min(rows_per_lang, max(LEAST_ROWS, MAX_ROWS // len(sizes)))
    # the row of least hash is always taken
    sizes["upto"] = np.maximum(sizes["low"], np.minimum(1.0, aim / sizes["n"]) * (1 << 30)).astype(np.int64)
    upto = docs.sparkSession.createDataFrame(sizes[["lang", "upto"]], "lang string, upto long")
    drawn = open_rows.join(F.broadcast(upto), "lang").where(F.pmod("k", F.lit(1 << 30)) <= F.col("upto"))
    got = drawn.select("text", "lang", "k").limit(2 * aim * len(sizes)).toPandas().sort_values(["k", "text"])
    return fit(got["text"].tolist(), got["lang"].tolist())


def classify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, in one pass over whole texts."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict_batches(sc.broadcast(model), sc.broadcast(fold_table())), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is told with a score of ``least`` or more.

    Texts that are null or hold no letter are ``und`` and go.
    """
    sc = docs.sparkSession.sparkContext
    model, table = sc.broadcast(train(docs)), sc.broadcast(fold_table())

    def make():
        def test(column: pa.Array) -> np.ndarray:
            names, score = predict(model.value, *utf8(column), table.value)
            return (score >= least) & (np.array(names, object) != "und")

        return test

    return filter_rows(docs, "text", make)


def language_id(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` and predict each of its rows.

    Returns doc_id, held_out, lang_pred and score.  Null texts and texts without
    a letter are ``und`` with score 0, as is everything where no labelled row
    may be learned from.  Rows with a null doc_id count as held out.  Repeated
    rows stay, other columns are ignored, an empty table gives an empty result.
    """
    return classify(docs, train(docs))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_langid": op6_langid}
SQL: dict[str, str] = {}
