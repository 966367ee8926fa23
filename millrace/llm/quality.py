"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared
with references per language by Jensen-Shannon distance.  References are exact
counts over all documents with a language, for every language.  The word limit loosens for short texts, and
texts of fewer than ``MIN_WORDS`` words are not judged by distance at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, cut, per_doc, ranges, utf8, words, xxh64

MIN_WORDS = 50
CLASS_LIMIT = 0.30
WORD_LIMIT, WORD_SLACK = 0.40, 1.2
TOP_WORDS = 100
SYMBOLS = b"#*$%&|<>"

# classes: lower, upper, blank, digit, symbol, other ASCII, beyond ASCII
N_CLASSES = 7
_CLASS = np.full(256, 6, np.uint8)
_CLASS[:128] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 2
_CLASS[list(SYMBOLS)] = 4
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _lexical(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased buffer, and word ends without one final full stop or comma."""
    end = e - ((e - s > 1) & np.isin(data[e - 1], (44, 46)))
    return _LOWER[data], end


def class_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Code points of each class and text (documents x classes)."""
    n = len(off) - 1
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    doc = np.searchsorted(off, lead, side="right") - 1 if n > 1 else np.zeros(len(lead), np.int64)
    return np.bincount(doc * N_CLASSES + _CLASS[data[lead]], minlength=n * N_CLASSES).reshape(n, N_CLASSES)


def counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of whole texts, and the words they were taken from."""
    n = len(off) - 1
    s, e, doc = words(data, off)
    n_words = np.bincount(doc, minlength=n)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    h = xxh64(data, s, e - s)
    repeat = np.zeros(len(s), bool)
    if len(s) > 2:
        same = doc[2:] == doc[:-2]
        g = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + h[2:] + doc[2:].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        g = (g ^ (g >> np.uint64(31)))[same]
        at = np.flatnonzero(same)
        order = np.argsort(g)
        twin = np.zeros(len(g) + 1, bool)
        twin[1:-1] = g[order][1:] == g[order][:-1]
        again = at[order[twin[1:] | twin[:-1]]]
        for k in range(3):
            repeat[again + k] = True
    dup = np.zeros(n, np.int64)
    raw = data.tobytes()
    for i in range(n):
        if off[i] < off[i + 1]:
            lines = [x for x in raw[off[i] : off[i + 1]].split(b"\n") if x.strip()]
            dup[i] = len(lines) - len(set(lines))
    return {
        "n_words": n_words, "word_chars": per_doc(lead[e] - lead[s], n_words), "n_symbols": per_doc(symbol[data], np.diff(off)),
        "n_dup_lines": dup, "n_repeat_words": per_doc(repeat, n_words), "s": s, "e": e, "doc": doc,
    }


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of the rows of ``p`` from each row of ``q``."""
    out = np.zeros((len(p), len(q)))
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(len(q)):
            m = (p + q[k]) / 2
            a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
            b = np.where(q[k] > 0, q[k] * np.log2(q[k] / m), 0).sum(axis=1)
            out[:, k] = np.sqrt(np.maximum(0, (a + b) / 2))
    return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, h, n): class totals (kind 0, h the class), word totals (kind 1), counts of words (kind 2, h the hash)."""
    for batch in batches:
        names = batch.column(0).to_pylist()
        data, off = utf8(batch.column(1))
        known = {x: k for k, x in enumerate(dict.fromkeys(names))}
        lang = np.array([known[x] for x in names], np.int64)
        back = pa.array(list(known), pa.string())
        for i, j in chunks(off, 4 << 20):
            part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            mine = lang[i:j]
            classes = class_counts(part, o)
            s, e, doc = words(part, o)
            low, end = _lexical(part, s, e)
            h = xxh64(low, s, end - s)
            of = mine[doc]
            out = []
            for k in np.unique(mine).tolist():
                rows = classes[mine == k].sum(axis=0)
                some, n = np.unique(h[of == k], return_counts=True)
                out.append((k, 0, np.flatnonzero(rows), rows[rows > 0]))
                out.append((k, 1, np.zeros(1, np.int64), np.array([n.sum()])))
                out.append((k, 2, some.view(np.int64), n))
            size = [len(x[2]) for x in out]
            cols = [back.take(pa.array(np.repeat([x[0] for x in out], size))), pa.array(np.repeat([x[1] for x in out], size).astype(np.int32)), *(pa.array(np.concatenate([x[k] for x in out]).astype(np.int64)) for k in (2, 3))]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "kind", "h", "n"])


def references(docs: DataFrame) -> dict:
    """Histograms of every language with words, counted exactly over all documents.

    A language lists its TOP_WORDS most frequent words of a 2000th of its words or
    more; each language's counts of all listed words reach the driver, the others
    are summed up.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    tally = cut(rows.mapInArrow(_tally, "lang string, kind int, h long, n long").groupBy("lang", "kind", "h").agg(F.sum("n").alias("n")))
    totals = tally.where("kind = 1 AND n > 0").select("lang", F.col("n").alias("total"))
    size = {lang: n for lang, n in totals.toPandas().itertuples(index=False)}
    langs = sorted(size)
    if not langs:
        return {"langs": [], "hash": np.zeros(0, np.uint64), "words": [], "classes": np.zeros((0, N_CLASSES))}
    found = tally.where("kind = 2").join(F.broadcast(totals), "lang")
    # at most 2,000 words of a language have such a share
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "h"))
    top = found.where("n >= total * 0.0005").withColumn("rank", rank).where(F.col("rank") <= TOP_WORDS).select("h").distinct()
    common = found.join(F.broadcast(top), "h").select("lang", "h", "n").toPandas()
    place = {lang: k for k, lang in enumerate(langs)}
    c = np.zeros((len(langs), N_CLASSES))
    for lang, at, n in tally.where("kind = 0").select("lang", "h", "n").toPandas().itertuples(index=False):
        if lang in place:
            c[place[lang], at] = n
    h = np.sort(common["h"].unique().astype(np.int64).view(np.uint64))
    w = [(np.array([len(h)]), np.ones(1))] * len(langs)
    for lang, mine in common.groupby("lang"):
        at, n = np.searchsorted(h, mine["h"].to_numpy(np.int64).view(np.uint64)), mine["n"].to_numpy(np.int64)
        w[place[lang]] = np.append(at, len(h)), np.append(n, size[lang] - n.sum()) / size[lang]
    return {"langs": langs, "hash": h, "words": w, "classes": c / np.maximum(1, c.sum(axis=1, keepdims=True))}


def least_distance(row: np.ndarray, at: np.ndarray, p: np.ndarray, n: int, q: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Least Jensen-Shannon distance of ``n`` histograms of ``size`` places, given by their entries above zero (row, at, p), from those of ``q`` (places, shares).

    Where a histogram has nothing, a reference adds its own share; shares sum to one.
    """
    least = np.full(n, np.inf)
    whole = np.zeros(size)
    for places, shares in q:
        whole[places] = shares
        r = whole[at]
        whole[places] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            part = p * np.log2(2 * p / (p + r)) + np.where(r > 0, r * np.log2(2 * r / (p + r)), 0) - r
        np.minimum(least, np.bincount(row, part, minlength=n) + 1, out=least)
    return np.sqrt(np.maximum(0, least / 2))


def divergence(ref: dict, data: np.ndarray, off: np.ndarray, got: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least distance to any language: of classes, and of common words."""
    n = len(off) - 1
    if not ref["langs"]:
        return np.zeros(n), np.zeros(n)
    classes = class_counts(data, off).astype(float)
    classes /= np.maximum(1, classes.sum(axis=1, keepdims=True))
    low, end = _lexical(data, got["s"], got["e"])
    h = xxh64(low, got["s"], end - got["s"])
    size = len(ref["hash"])
    at = np.minimum(np.searchsorted(ref["hash"], h), max(0, size - 1)) if size else np.zeros(len(h), np.int64)
    at = np.where(ref["hash"][at] == h, at, size) if size else at
    cell, k = np.unique(got["doc"] * (size + 1) + at, return_counts=True)
    row = cell // (size + 1)
    return js_distance(classes, ref["classes"]).min(axis=1), least_distance(row, cell % (size + 1), k / np.bincount(row, k, minlength=n)[row], n, ref["words"], size + 1)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def judge(ref: dict, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    got = counts(data, off)
    dc, dw = divergence(ref, data, off, got)
    n = got["n_words"]
    failed = (n < 50) | (100 * got["n_repeat_words"] > 50 * n)
    judged = n >= MIN_WORDS
    far = judged & ((dc > CLASS_LIMIT) | (dw > WORD_LIMIT + WORD_SLACK / np.sqrt(np.maximum(1, n))))
    return [n, got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"], failed, ~failed & ~far, dc, dw]


def _judge_batches(ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(x.split()[0] for x in COLUMNS.split(", "))]
        for batch in batches:
            data, off = utf8(batch.column(1))
            parts = [judge(ref.value, data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in chunks(off)]
            if parts:
                cols = [np.concatenate(x) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.int64) if k < 5 else x) for k, x in enumerate(cols))], names)

    return run


def quality(docs: DataFrame) -> DataFrame:
    """Base counts and verdict of each row.

    ``docs`` needs doc_id, text and lang.  Null and empty texts have zero counts
    and fail; rows without a language are judged but not part of a reference; if
    no row has one, only the base rules count.  Repeated rows and null ids stay,
    other columns are ignored, an empty table gives an empty result.
    """
    ref = docs.sparkSession.sparkContext.broadcast(references(docs))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_judge_batches(ref), "doc_id long, " + COLUMNS)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_quality": op10_quality}
SQL: dict[str, str] = {}
