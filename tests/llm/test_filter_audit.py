"""Filter interaction audit against a walk through every order, document by document."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from millrace.llm import filter_audit as fa
from millrace.llm.common import pieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
    return out | ({"D"} if re.search(r"[#$%&*|]", text) else set())


def plain(rows, labels):
    """Every order walked with the documents left in it."""
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, text, source in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = defaultdict(list)
    for i, text, source in rows:
        bad = fails(text or "") | ({"E"} if i is not None and i > first[text or ""] else set())
        parts[source or ""].append((i, bad))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left, gone = list(docs), []
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in gone)
                left, gone = [d for d in left if f not in d[1]], gone + here
                shapley[f] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), redundant, sum(d[1] == {f} for d in docs), sum(d[0] in good for d in here), sum(d[0] in toxic for d in here)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return out


def same(df, rows, labels):
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}
    assert got == plain(rows, labels)


def test_audit_equals_a_walk_through_all_orders(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    same(fa.audit(docs, labels), rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_odd_rows_ties_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [
        (1, long, "en", "a", 1), (1, long, "en", "a", 1), (2, long, "en", "b", 1), (None, long, "en", "a", 1), (None, None, None, None, None), (3, None, "en", "", 0), (4, "", "en", None, 0), (-5, long + " #", "en", "a", 1),
        (6, "word " * 40000, "en", "b", 1), (7, "X" * 50000, "en", "c", 1), (8, "é日本 " * 400, "de", "c", 1), (9, long, "en", "c", 1), (9, "A " * 500, "en", "c", 1),
    ]
    marks = [(1, 1, 0), (2, 1, None), (2, 0, 1), (7, None, 1), (None, 1, 1), (9, 1, 1), (9, 1, 1)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    clash = docs.withColumns({c: F.lit(1) for c in ("part", "digest", "flags", "mask", "salt", "good", "is_first", "n0")})
    same(fa.audit(clash, labels.withColumns({c: F.lit(1) for c in ("good", "salt", "source")})), [(r[0], r[1], r[3]) for r in rows], marks)
    assert fa.audit(docs.limit(0), labels).count() == 0
    same(fa.audit(docs, labels.limit(0)), [(r[0], r[1], r[3]) for r in rows], [])


@pytest.mark.parametrize("limit", [3, 7, 64, 1 << 20])
def test_flags_do_not_depend_on_pieces(limit):
    for text in ("", " ", "one two  three\n four", "x" * 100, "Ab\tcd " * 60 + "é日 #", "word " * 250, " ".join(f"W{i}" for i in range(220))):
        bits = sum(1 << k for k, f in enumerate("ABCD") if f in fails(text))
        assert fa.text_flags(text.encode(), limit) == bits
        assert b"".join(pieces(memoryview(text.encode()), limit)) == text.encode()
