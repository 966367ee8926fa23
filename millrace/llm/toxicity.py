"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the presence of six-byte grams of folded text.  Positives
are confirmed toxic rows; the unlabelled texts are a sample of all rows that may
be learned from, whatever their label.  The risk
``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` is minimised in numpy with the
class prior ``pi`` counted over all labelled rows that may be learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, utf8

GRAM = 6
MASK = np.uint64((1 << (8 * GRAM)) - 1)
FEATURES = 8192
#: Bounds of the training sample: confirmed rows, unlabelled rows, bytes of a text.
POSITIVES, UNLABELLED, MAX_TRAIN_BYTES = 2500, 5000, 20_000
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def grams(data: np.ndarray) -> np.ndarray:
    """The six-byte gram that starts at each byte of folded text."""
    low = _FOLD[data]
    cap = np.flatnonzero(data[:-1] == 0xC3) + 1  # Latin capitals with accents
    cap = cap[(low[cap] >= 0x80) & (low[cap] <= 0x9E) & (low[cap] != 0x97)]
    low[cap] += 32
    buf = np.concatenate([low, np.zeros(8, np.uint8)])
    return np.ndarray((len(low),), np.dtype("<u8"), buf.data, strides=(1,)) & MASK


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)


def hits(data: np.ndarray, off: np.ndarray, features: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs of a chunk; features sorted."""
    g = grams(data)
    at = np.flatnonzero(sieve[_slot(g)])
    g = g[at]
    f = np.minimum(np.searchsorted(features, g), max(0, len(features) - 1))
    ok = features[f] == g if len(features) else np.zeros(0, bool)
    at, f = at[ok], f[ok]
    doc = np.searchsorted(off, at, side="right") - 1
    inside = at + GRAM <= off[doc + 1]
    pair = np.unique(doc[inside] * max(1, len(features)) + f[inside])
    return pair // max(1, len(features)), pair % max(1, len(features))


def sieve_of(features: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 18, bool)
    out[_slot(features)] = True
    return out


def _collect(texts: list[str], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data, off = utf8(pa.array(texts, pa.string()))
    sieve, docs, feats = sieve_of(features), [], []
    for i, j in chunks(off):
        d, f = hits(data[off[i] : off[j]], off[i : j + 1] - off[i], features, sieve)
        docs.append(d + i)
        feats.append(f)
    return np.concatenate(docs), np.concatenate(feats)


def candidates(texts: list[str], least: int) -> np.ndarray:
    """Grams that at least ``least`` of the texts hold."""
    parts = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        if len(raw) >= GRAM:
            parts.append(np.unique(grams(raw)[: len(raw) - GRAM + 1]))
    if not parts:
        return np.zeros(0, np.uint64)
    g, n = np.unique(np.concatenate(parts), return_counts=True)
    return g[n >= least]


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the estimate: of positives as such, and of negatives (below zero where it overfits), with the logistic loss."""
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean()) - prior * float(np.logaddexp(0, zp).mean())


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Direction of descent by the scores of positives and of unlabelled texts.

    Where the negatives' part is zero or more, it is the slope of the whole
    estimate; below zero that part alone is stepped back up.
    """
    up_p, up_u = -prior * _sig(zp) / len(zp), _sig(zu) / len(zu)
    if risk(zp, zu, prior)[1] >= 0:
        return up_p - prior * _sig(-zp) / len(zp), up_u
    return -up_p, -up_u


def fit(positive: list[str], unlabelled: list[str], prior: float, features: int = FEATURES, rounds: int = 400) -> dict:
    """Choose grams by their lift among positives and minimise the non-negative risk."""
    empty = {"features": np.zeros(0, np.uint64), "w": np.zeros(0), "b": float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))}
    if not positive or not unlabelled or not 0 < prior < 1:
        return empty
    known = candidates(positive, 3 if len(positive) >= 30 else 1)
    if not len(known):
        return empty
    pd, pf = _collect(positive, known)
    ud, uf = _collect(unlabelled, known)
    np_, nu = len(positive), len(unlabelled)
    rate_p = (np.bincount(pf, minlength=len(known)) + 0.1) / (np_ + 0.2)
    rate_u = (np.bincount(uf, minlength=len(known)) + 0.5) / (nu + 1.0)
    gain = np.sqrt(rate_p * np_) * np.log(rate_p / rate_u)
    best = np.sort(np.argsort(-gain, kind="stable")[:features])
    best = best[rate_p[best] > 1.5 * rate_u[best]]
    if not len(best):
        return empty
    known = known[best]
    pd, pf = _collect(positive, known)
    ud, uf = _collect(unlabelled, known)
    size_p, size_u = np.bincount(pd, minlength=np_), np.bincount(ud, minlength=nu)
    x_p, x_u = 1 / np.sqrt(4.0 + size_p), 1 / np.sqrt(4.0 + size_u)
    w, b = np.zeros(len(known)), empty["b"]
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for step in range(1, rounds + 1):
        zp = np.bincount(pd, weights=w[pf], minlength=np_) * x_p + b
        zu = np.bincount(ud, weights=w[uf], minlength=nu) * x_u + b
        gp, gu = slopes(zp, zu, prior)
        grad = np.bincount(pf, weights=(gp * x_p)[pd], minlength=len(known)) + np.bincount(uf, weights=(gu * x_u)[ud], minlength=len(known)) + 1e-5 * w
        full = np.append(grad, gp.sum() + gu.sum())
        m = 0.9 * m + 0.1 * full
        v = 0.999 * v + 0.001 * full * full
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return {"features": known, "w": w, "b": float(b)}


def score(model: dict, data: np.ndarray, off: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    z = np.full(n, model["b"])
    if len(model["features"]) and len(data):
        d, f = hits(data, off, model["features"], sieve)
        size = np.bincount(d, minlength=n)
        z = z + np.bincount(d, weights=model["w"][f], minlength=n) / np.sqrt(4.0 + size)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _score_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = None
        for batch in batches:
            if sieve is None:
                sieve = sieve_of(model.value["features"])
            data, off = utf8(batch.column(2))
            parts = [score(model.value, data[off[i] : off[j]], off[i : j + 1] - off[i], sieve) for i, j in chunks(off)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.3).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def held_out() -> F.Column:
    """True where crc32(doc_id as text) mod 4 is 2; rows without an id are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Fit on bounded samples of the labelled rows that may be learned from.

    The prior is counted over all of them.  Samples are drawn by a hash of the
    id, so at most about POSITIVES + UNLABELLED ids are broadcast and their
    texts, up to MAX_TRAIN_BYTES bytes each, reach the driver.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out() & F.col("toxic").isNotNull())
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("p")).first()
    prior = total["p"] / total["n"] if total["n"] else 0.0
    if not 0 < prior < 1:
        return fit([], [], prior)
    draw = lambda seed: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    pos = known.where((F.col("toxic") == 1) & (draw(1) < POSITIVES / total["p"])).select("doc_id", F.lit(1).alias("part"))
    unl = known.where(draw(2) < UNLABELLED / total["n"]).select("doc_id", F.lit(0).alias("part"))
    ids = pos.union(unl).limit(2 * (POSITIVES + UNLABELLED)).toPandas().drop_duplicates()
    chosen = spark.createDataFrame(ids, "doc_id long, part int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= MAX_TRAIN_BYTES))
    got = texts.join(F.broadcast(chosen), "doc_id").toPandas().sort_values(["doc_id", "part", "text"])
    return fit(got.loc[got["part"] == 1, "text"].tolist(), got.loc[got["part"] == 0, "text"].tolist(), prior)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score each text; ``labels`` needs doc_id and toxic.

    Returns doc_id, held_out, score and predicted (1 at a score of 0.3 or more).
    Null and empty texts get the score of a text without any feature.  Rows with
    a null doc_id count as held out; labels without id or value are left out;
    without both kinds of labels the prior alone is the score.  Repeated rows
    stay, other columns are ignored, an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(_score_batches(model), "doc_id long, held_out boolean, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op5_toxicity": op5_toxicity}
SQL: dict[str, str] = {}
