"""Source divergence against plain Python over whole numbers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import divergence as dv

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        docs[lang].update(set(terms))
        count[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        v = len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + v) for t in kept}
        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            for part, found in (
                ("pair", [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]),
                ("term", sorted([(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]], key=lambda x: (-x[0], x[1].encode()))[:200]),
            ):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def told(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def many(n_sources):
    """A language of many sources, some without kept terms, beside one without any."""
    rows = []
    for s in range(n_sources):
        for k in range(3):
            rows.append((len(rows), " ".join(["gemein", "ßä", "The the THE"] + [f"w{chr(97 + (s * 7 + j * k) % 26)}{chr(97 + j)}" for j in range(12)]) if s % 5 else "", "xx", f"s{s:02d}", 0))
    return rows + [(900, "once only words", "yy", "a", 0), (901, None, "yy", "b", 0), (902, "x", None, None, 0), (902, "x", None, None, 0), (902, "x y", "", "é", 0), (None, "x A1a [a]", "", "", 0)]


@pytest.mark.parametrize("block, cell, rounds", [(8, 1 << 14, 4), (2, 30, 3), (3, 7, 1), (1, 1 << 14, 4)])
def test_divergence_equals_plain_python(spark, monkeypatch, block, cell, rounds):
    monkeypatch.setattr(dv, "BLOCK_GROUPS", block)
    monkeypatch.setattr(dv, "CELL_COUNTS", cell)
    monkeypatch.setattr(dv, "ROUNDS", rounds)
    rows = many(11)
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("term", "n", "docs", "v", "salt", "gid", "shard", "id", "item", "rank")})
    assert told(dv.source_divergence(docs)) == plain(rows)


def test_empty_table_and_long_texts(spark, monkeypatch):
    assert dv.source_divergence(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, "Word,wörd;" * 30000 + f"tail{i % 2}", "en", f"s{i % 3}", 0) for i in range(6)] + [(9, "q" * 50000, "en", "s0", 0)] * 3
    monkeypatch.setattr(dv, "HELD", 1)
    assert told(dv.source_divergence(spark.createDataFrame(rows, DOCS))) == plain(rows)


@pytest.mark.parametrize("blocks", range(1, 12))
def test_all_blocks_meet_once(spark, blocks):
    """Every pair of blocks meets in exactly one round, and a block has one meeting a round at most."""
    frame = spark.range(blocks).select(F.col("id").cast("int").alias("b"), F.lit(blocks).alias("n")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") + F.col("n") % 2 - 2, F.lit(0)))))
    met = [(r["turn"], r["b"], r["h"]) for r in frame.withColumn("h", dv.host_of(F.col("b"), F.col("n"), F.col("turn"))).collect()]
    assert sorted((min(b, h), max(b, h)) for _, b, h in met if h < b) == [(i, j) for i in range(blocks) for j in range(i + 1, blocks)]
    for turn in {t for t, _, _ in met}:
        playing = [x for t, b, h in met if t == turn and h < b for x in (b, h)]
        assert len(playing) == len(set(playing))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**14), st.integers(1, 10**15))
def test_shares_are_exact(count, more):
    assert dv.probability(np.array([count]), count + more)[0] == 1 + 10**9 * (count + 1) // (count + more)


def test_vectors_pack_and_unpack():
    ids = [np.array([0, 5, 6]), np.zeros(0, np.int64), np.array([2])]
    counts = [np.array([1, 2, 3]), np.zeros(0, np.int64), np.array([1 << 40])]
    got = dv.unpack(dv.pack(ids, counts), 3)
    assert [x.tolist() for x in got[0]] == [x.tolist() for x in ids] and [x.tolist() for x in got[1]] == [x.tolist() for x in counts]
