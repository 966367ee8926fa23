"""The audit of a table, by hand and against pandas."""

import numpy as np
import pandas as pd
import pytest

from millrace import registry
from millrace.operators import quality_audit as qa


def test_scores_and_issues_by_hand(spark):
    n = 60
    rows = [
        (i // 2 if i < 4 else i, None if i % 6 == 0 else float(i), "2024/3/%d" % (1 + i % 28) if i % 10 else "soon", f"user{i}@example.com" if i % 3 else "no", "  x " if i == 5 else "x", float("nan") if i == 1 else 1.0, "2024-01-02" if i % 2 else "2024-01-01", "2024-01-01", i % 2 == 0)
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "user_id long, amount double, day string, mail string, tag string, fixed double, start string, `End Day` string, flag boolean")
    scores, issues = qa.audit(df)
    said = {(d, c): k for d, c, k, _ in issues}
    assert scores["missing_values"] == round(100 * (1 - 11 / (9 * n)), 2) and said["missing_values", "amount"] == 10 and said["missing_values", "fixed"] == 1
    assert scores["duplicates"] == 100 and scores["uniqueness"] == 0 and said["uniqueness", "user_id"] == 2
    # day, mail, start and End Day have a format; two of the four have values that are not of it
    assert scores["format_compliance"] == 50 and said["format_compliance", "day"] == 6 and said["format_compliance", "mail"] == 20
    assert scores["whitespace"] == 80 and said["whitespace", "tag"] == 1
    assert said["constant_columns", "fixed"] == 1 and said["constant_columns", "End Day"] == 1 and scores["constant_columns"] == round(100 * (1 - 2 / 9), 2)
    assert said["cross_column", "start,End Day"] == 30 and scores["cross_column"] == 0
    assert {c for d, c in said if d == "cardinality"} == {"fixed", "flag"}
    assert any(s.startswith("16.67 % missing: fill with the median 30") for _, _, _, s in issues)
    total = qa.overall(df).first()
    assert total["score"] == round(sum(scores[k] * w for k, w in qa.WEIGHTS.items()) / sum(qa.WEIGHTS.values()), 2) and total["grade"] == qa.graded(total["score"]) and len(total["suggestions"]) == 10


def test_measures_equal_pandas(spark):
    rng = np.random.default_rng(0)
    x = pd.DataFrame({"a": rng.exponential(size=500) ** 3, "b": rng.integers(0, 40, 500).astype(float)})
    x.loc[::7, "b"] = np.nan
    got = {r["name"]: r for r in qa.profile(spark.createDataFrame(x))}
    for c in x:
        s = x[c].dropna()
        np.testing.assert_allclose([got[c][k] for k in ("q1", "median", "q3", "skew", "mean")], [s.quantile(0.25), s.median(), s.quantile(0.75), s.skew(), s.mean()], rtol=1e-9)
        iqr = s.quantile(0.75) - s.quantile(0.25)
        assert got[c]["outliers"] == int(((s < s.quantile(0.25) - 1.5 * iqr) | (s > s.quantile(0.75) + 1.5 * iqr)).sum())
        assert got[c]["kinds"] == s.nunique() and got[c]["missing"] == x[c].isna().sum()


@pytest.mark.parametrize("name", ["dq_dimension_scores", "dq_audit_issues", "dq_audit_overall"])
def test_empty_table(spark, name):
    out = registry.OPS[name](spark.createDataFrame([], "id long, start date, stop string")).collect()
    assert name == "dq_audit_issues" or all(r["score"] == 100 for r in out)


def test_pairs_by_name():
    assert qa.ordered_pairs(["Start Time", "end_time", "min_x", "max_x", "created", "closed_at", "price", "discount"], {"price", "discount"}) == [("Start Time", "end_time"), ("min_x", "max_x"), ("created", "closed_at"), ("discount", "price")]
