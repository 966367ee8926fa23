"""Hand-computed fixtures for the rules that are easy to get wrong."""

import math

import pytest

from millrace.functions import stats_math as sm
from millrace.operators import finance, planning, quality_dimensions, relational, series, statistics, text
from millrace.plans.sqltools import STATEMENTS, is_read_only, lint, query, read_plan


def bars(spark, closes):
    return spark.createDataFrame([("s", f"2024-01-{i + 1:02d}", float(c), c + 1.0, c - 1.0, float(c), 10.0) for i, c in enumerate(closes)], "symbol string, date string, open double, high double, low double, close double, volume double")


def test_rolling_waits_for_a_full_window(spark):
    rows = [r["sma_5"] for r in series.ind_sma.apply(bars(spark, range(1, 8)), windows=(5,)).orderBy("date").collect()]
    assert rows == [None] * 4 + [3.0, 4.0, 5.0]


def test_moving_average_takes_partial_windows(spark):
    df = spark.createDataFrame([(f"d{i}", float(i)) for i in range(1, 5)], "date string, value double")
    assert [r["mean"] for r in series.win_moving_avg_partial.apply(df, n=3).orderBy("date").collect()] == [1.0, 1.5, 2.0, 3.0]


def test_rsi_has_no_value_without_losses(spark):
    rows = series.ind_rsi.apply(bars(spark, range(1, 20))).orderBy("date").collect()
    assert rows[-1]["rsi"] is None and rows[5]["rsi"] is None


def test_ema_starts_from_the_first_value(spark):
    rows = [r["ema"] for r in series.ema(bars(spark, [10, 13]), 2).orderBy("date").collect()]
    assert rows == pytest.approx([10.0, 12.0])


def test_bollinger_uses_the_population_deviation(spark):
    r = series.ind_bollinger.apply(bars(spark, [1, 3]), n=2).orderBy("date").collect()[-1]
    assert (r["mid"], r["upper"], r["lower"]) == (2.0, 4.0, 0.0)


def test_levels_pass_time_bounds_without_a_time(spark):
    df = spark.createDataFrame([(1, None, "ERROR"), (2, "2020-01-01 00:00:00", "ERROR"), (3, "2024-01-10 00:00:00", "ERROR")], "event_id long, stamp string, level string")
    assert sorted(r["event_id"] for r in relational.filter_level_time.apply(df).collect()) == [1, 3]


def test_fifo_matches_in_order_and_conserves_size(spark):
    df = spark.createDataFrame([(1, 1, "a", "buy", 10, 1.0), (1, 2, "b", "buy", 10, 2.0), (1, 3, "c", "sell", 15, 3.0)], "symbol long, seq long, date string, side string, size long, price double")
    rows = [(r["lot"], r["size"], r["pnl"]) for r in finance.bt_close_fifo.apply(df).orderBy("lot").collect()]
    assert rows == [(1, 10, 20.0), (2, 5, 5.0)]


def test_growth_rules(spark):
    q = spark.sql(f"SELECT {finance.growth('0', '0')} AS a, {finance.growth('5', '0')} AS b, {finance.growth('5', '-10')} AS c").first()
    assert (q["a"], q["b"], q["c"]) == (0.0, None, 1.5)


def test_chunks_keep_the_tail_inside_the_overlap(spark):
    df = spark.createDataFrame([(1, "x" * 950)], "doc_id long, text string")
    rows = [(r["start"], r["size"]) for r in text.text_chunk_overlap.apply(df).orderBy("chunk").collect()]
    assert rows == [(0, 950), (900, 50)]


def test_messages_are_masked_in_order(spark):
    df = spark.createDataFrame([(1, "10.0.0.1:80 took 1.5s id /42 n 12345 at 2024-01-01T00:00:00Z")], "event_id long, message string")
    assert text.str_normalize_message.apply(df).first()["message"] == "<IP> took <DURATION> id /<ID> n <NUM> at <TIMESTAMP>"


def test_skew_is_sample_adjusted(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 1, 1, 1, 1, 10)], "v double")
    assert quality_dimensions.dq_distribution_skew.apply(df, columns=("v",)).first()["skew"] == pytest.approx(2.8284, abs=1e-4)


def test_whitespace_counts_blank_values_twice(spark):
    df = spark.createDataFrame([(" \t",), ("a ",), ("",), ("ok",)], "c string")
    r = quality_dimensions.dq_whitespace.apply(df, columns=("c",)).first()
    assert (r["untrimmed"], r["empty"], r["blank"]) == (2, 2, 1)


def test_distribution_functions():
    assert sm.normal_cdf(1.959963984540054) == pytest.approx(0.975, abs=1e-12)
    assert sm.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert sm.f_upper(3.0, 2, 12) == pytest.approx(0.0877914951989026, abs=1e-9)
    assert sm.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert sm.chi2_upper(10.0, 4) == pytest.approx(math.exp(-5) * 6, abs=1e-12)


def test_shapiro_on_known_samples():
    w, p = sm.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.01) and p < 0.01
    w, p = sm.shapiro([sm.normal_quantile((i + 0.5) / 60) for i in range(60)])
    assert w > 0.99 and p > 0.9


def test_ols_recovers_a_plane(spark):
    df = spark.createDataFrame([(float(a), float(b), 2 + 3.0 * a - b + ((a * 7 + b * 3) % 5 - 2) * 1e-3) for a in range(8) for b in range(5)], "a double, b double, y double")
    got = {r["name"]: r for r in statistics.ols(df, "y", ["a", "b"])[0]}
    assert got["a"]["coef"] == pytest.approx(3, abs=1e-2) and got["b"]["coef"] == pytest.approx(-1, abs=1e-2) and got["a"]["p"] < 1e-9


def test_power_of_no_difference_is_alpha():
    assert statistics.power(0.1, 0.1, 100, 100) == 0.05
    assert statistics.power(0.1, 0.2, 2000, 2000) > 0.99


def test_guard_allows_reading_only(spark):
    assert is_read_only(spark, "SELECT 'drop table x'")[0]
    for bad in ("DROP TABLE t", "SELECT 1; DROP TABLE t", "INSERT INTO t VALUES (1)", "CREATE TABLE t (a INT)"):
        assert not is_read_only(spark, bad)[0]


def test_guard_looks_at_the_whole_plan(spark):
    for text, allowed in STATEMENTS:
        assert is_read_only(spark, text.replace("''", "'"))[0] == allowed, text
    with pytest.raises(PermissionError):
        query(spark, "SELECT java_method('java.lang.System', 'setProperty', 'millrace.test', 'x')")
    assert query(spark, "VALUES (1), (2)").count() == 2


def test_lint_rules(spark):
    assert lint(spark, "SELECT * FROM t") == ["avoid-select-star", "unbounded-query"]
    assert "leading-wildcard-like" in lint(spark, "SELECT a FROM t WHERE a LIKE '%x' LIMIT 1")
    assert lint(spark, "SELECT a FROM t WHERE a = 1 LIMIT 5") == ["no-issues"]
    assert "not-equal-filter" in lint(spark, "SELECT a FROM t WHERE a <> 1 LIMIT 5")
    assert lint(spark, "SELECT a FROM t JOIN u ON t.k = u.k WHERE a = 1 UNION SELECT b FROM v WHERE b = ' OR SELECT * '") == ["no-issues"]


def test_plan_reader_sees_wrong_estimates_and_large_scans(spark):
    spark.range(5000).selectExpr("id", "id % 7 AS k").write.mode("overwrite").saveAsTable("estimates")
    try:
        spark.sql("ANALYZE TABLE estimates COMPUTE STATISTICS FOR ALL COLUMNS")
        before = spark.conf.get("spark.sql.cbo.enabled")
        spark.conf.set("spark.sql.cbo.enabled", "true")
        got = read_plan(spark.sql("SELECT a.id FROM estimates a WHERE a.k = 3 AND a.id * 2 > 0"))
        assert any("large scan" == r for _, r in got)
        off = read_plan(spark.sql("SELECT k FROM estimates WHERE id % 100 = 3 GROUP BY k"), analyze=True)
        assert isinstance(off, list)
        wrong = read_plan(spark.sql("SELECT explode(sequence(1, 50)) AS x FROM estimates WHERE id = 3"), analyze=True)
        assert any("estimate is off" in r for _, r in wrong)
    finally:
        spark.conf.set("spark.sql.cbo.enabled", before)
        spark.sql("DROP TABLE estimates")


def chain(n):
    return [(i, i - 1 if i > 1 else None, float(i % 3 + 1)) for i in range(1, n + 1)]


def plain_times(rows):
    """Earliest and latest times of an acyclic graph, by repeated passes."""
    length, deps = {}, {}
    for i, dep, d in rows:
        length[i] = d
        deps.setdefault(i, set()).update({dep} - {None})
    es = dict.fromkeys(length, 0.0)
    for _ in length:
        es = {i: max((es[d] + length[d] for d in deps[i]), default=0.0) for i in length}
    end = max(es[i] + length[i] for i in length)
    ls = {i: end - length[i] for i in length}
    for _ in length:
        ls = {i: min((ls[j] for j in length if i in deps[j]), default=end) - length[i] for i in length}
    return {i: (es[i], ls[i]) for i in length}


def test_graphs_by_rounds(spark):
    schema = "id long, dep long, duration double"
    layers = [(10 * k + i, 10 * (k - 1) + j if k else None, float(1 + (i * k) % 3)) for k in range(6) for i in range(4) for j in range(4 if k else 1)]
    got = {r["id"]: r for r in planning.critical_path(spark.createDataFrame(layers, schema)).collect()}
    want = plain_times(layers)
    assert {i: (r["es"], r["ls"]) for i, r in got.items()} == want and all(r["critical"] == (abs(r["slack"]) < 1e-9) for r in got.values())
    cycle = spark.createDataFrame([*chain(4), (5, 6, 1.0), (6, 5, 1.0), (7, 5, 1.0), (6, 4, 1.0)], schema)
    assert [(r["id"], r["level"], r["place"]) for r in planning.toposort(cycle).orderBy("id").collect()] == [(i, i - 1, i) for i in range(1, 5)]
    with pytest.raises(ValueError):
        planning.toposort(cycle, strict=True)
    assert planning.toposort(cycle.limit(0)).count() == 0


def test_quantiles_of_groups_with_nulls_and_ties(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(None if i % 11 == 0 else f"g{i % 3}", None if i % 7 == 0 else float(rng.integers(0, 40)) if i % 2 else float(rng.lognormal())) for i in range(900)]
    rows.append(("empty", None))
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["median"]) for r in relational.agg_group_stats.apply(df, group="g", value="v").collect()}
    for g in {r[0] for r in rows}:
        mine = [v for k, v in rows if k == g and v is not None]
        assert got[g] == (len(mine), None if not mine else pytest.approx(float(np.median(mine)), abs=1e-4))
    q = relational.agg_quantile.apply(df, column="v", qs=(0.1, 0.995)).first()
    whole = [v for _, v in rows if v is not None]
    assert (q["q10"], q["q99_5"]) == (pytest.approx(np.quantile(whole, 0.1), abs=1e-4), pytest.approx(np.quantile(whole, 0.995), abs=1e-4))


def test_walk_looks_below_its_root_only(spark, tmp_path):
    from millrace.sources import files

    root = tmp_path / "build" / "x"
    for name in ("a.txt", "dist/b.txt", "sub/c.py", "sub/d.png", "e.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("" if name == "e.txt" else "text")
    assert sorted(r["relative_path"] for r in files.walk(spark, str(root)).collect()) == ["a.txt", "sub/c.py"]


def test_subtitles_fold_into_paragraphs(spark):
    import re

    def plain(srt):
        kept = []
        for line in map(str.strip, srt.split("\n")):
            if not line or re.match(r"^\d+$", line) or re.match(r"\d{2}:\d{2}:\d{2}", line):
                continue
            line = re.sub(r"align:.*$|position:.*$", "", re.sub(r"<[^>]+>", "", line)).strip()
            if line and (not kept or kept[-1] != line):
                kept.append(line)
        done, now = [], []
        for line in kept:
            now.append(line)
            if len(" ".join(now)) > 200 or re.search(r"[。！？.!?]$", line):
                done.append(" ".join(now))
                now = []
        return "\n\n".join([*done, *([" ".join(now)] if now else [])])

    rows = ["1\n00:00:01,000 --> 00:00:02,000 align:start\n<i>one</i>\none\ntwo.\n\n2\nthree", "x" * 90 + "\n" + "y" * 90 + "\n" + "z" * 90 + "\nend", "", "12\n\n", "a!\na!\nb？\nc position:9%"]
    got = [r["text"] for r in text.srt_clean(spark.createDataFrame(list(enumerate(rows)), "id long, s string"), "id", "s").orderBy("id").collect()]
    assert got == [plain(r) for r in rows]


def test_page_structure():
    html = """<html><head><title> T &amp; U </title><meta name="description" content="d"><meta property="og:title" content="o"><link rel="canonical" href="/c"></head>
      <body><header><a href="/h"> Home </a><a href="/h">again</a><a href="/e"></a></header><main id="m" class="k"><h1>One <b>two</b></h1><p>three four</p><script>no words</script><h2>Five</h2></main><footer role="f"></footer></body></html>"""
    got = text.page_structure(html)
    assert got[0] == "T & U" and got[1] == [(1, "One two"), (2, "Five")] and got[2] == [("Home", "/h")]
    assert got[3] == [("main", "m", "k", None), ("footer", None, None, "f")] and got[4] == 5 and got[5:] == ("d", None, "/c", "o")
    assert text.page_structure(None)[:5] == ("", [], [], [], None)


def test_headers_with_lists():
    got = text.header_of("---\ntitle: 'A: b'\n# no\ntags:\n- x\n- \"y\"\nempty:\nplain\n---\nbody: no")
    assert got == {"title": "A: b", "tags": ["x", "y"], "empty": []} and text.header_of("no header") == {} and text.header_of(None) == {}


def test_json_paths(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1, "c": [1, {"d": 2}]}, "e": {}}'), (2, "not json"), (3, None), (4, "[1]")], "id long, s string")
    assert sorted((r["id"], r["path"]) for r in text.flatten_keys(df, "id", "s").collect()) == [(1, "a.b"), (1, "a.c"), (1, "e")]


def test_load_test_reports(spark):
    wrk = "  Latency     3.50ms    1.2ms\n     50%    900us\n     90%    1.10ms\n     99%    2.0s\n  120 requests in 10s\n  Socket errors: connect 1, read 2, write 3, timeout 4\n  Non-2xx or 3xx responses: 5\nRequests/sec:   12.5"
    r = text.perf_parse_wrk.apply(spark.createDataFrame([(1, wrk)], "id long, output string")).first()
    assert tuple(r)[1:] == (12.5, 3.5, 0.9, 1.1, 2000.0, 120, 15)
    ab = "Complete requests:      100\nFailed requests:        3\nRequests per second:    9.50 [#/sec] (mean)\nTime per request:       1.250 [ms] (mean)\n  50%      4\n  90%      8\n  99%     19"
    df = spark.createDataFrame([(1, ab, None), (2, ab, "Percentage served,Time in ms\n50,3.5\n89,7\n95,9.25\n100,20")], "id long, output string, percentiles string")
    assert [tuple(r) for r in text.perf_parse_ab.apply(df).orderBy("id").collect()] == [(1, 9.5, 1.25, 4.0, 8.0, 19.0, 100, 3), (2, 9.5, 1.25, 3.5, 9.25, 20.0, 100, 3)]


def test_operators_on_a_table_of_the_users_own(spark):
    sizes = spark.createDataFrame([("a", 0.5), ("b", 1.0), ("c", 1536.0), ("d", 1024.0**2 * 1.5)], "f string, kb double")
    assert [r["text"] for r in text.fmt_bytes.apply(sizes, key="f", kb="kb").orderBy("f").collect()] == ["512 B", "1 KB", "1.5 MB", "1.5 GB"]
    spans = spark.createDataFrame([("a", -1), ("b", 59), ("c", 3661), ("d", None)], "f string, s long")
    assert [r["text"] for r in text.dur_format.apply(spans, key="f", seconds="s").orderBy("f").collect()] == ["N/A", "0m", "1h1m", None]
    clock = spark.createDataFrame([(1, "23:30", "00:15"), (2, "9:05", "12:00"), (3, "x", "1:00"), (4, None, "1:00")], "f long, p string, q string")
    assert [r["text"] for r in text.dur_hhmm.apply(clock, key="f", start="p", end="q").orderBy("f").collect()] == ["45m", "2h55m", None, None]
    whole = spark.createDataFrame([(1, 999), (2, 12345), (3, 2_500_000)], "f long, n long")
    assert [r["text"] for r in text.fmt_number_compact.apply(whole, key="f", number="n", whole=True).orderBy("f").collect()] == ["999", "12,345", "2.5M"]
    air = spark.createDataFrame([(1, 20.0, 50.0)], "f long, t double, h double")
    e = 6.1094 * math.exp(17.625 * 20 / 263.04) * 0.5
    assert text.sci_humidity_ratio.apply(air, key="f", temperature="t", humidity="h").first()["w"] == pytest.approx(0.622 * e / (1013.25 - e), abs=1e-8)
    used, have = (spark.createDataFrame([(x,) for x in rows], "k string") for rows in (["a", "b", "c"], ["a", "b_many"]))
    assert [r["k"] for r in relational.join_anti_missing_keys.apply(used, have=have).collect()] == ["c"]
    assert [r["k"] for r in relational.set_except.apply(used, other=have).collect()] == ["b", "c"]
    people = spark.createDataFrame([("1", "x", ["7"]), ("7", "y", []), ("2", "z", ["q"])], "id string, name string, aliases array<string>")
    assert [tuple(relational.lookup_by_id_or_alias.apply(people, wanted=w).first()) for w in ("7", "q")] == [("7", "y", 0), ("2", "z", 1)]
    pairs, extra = (spark.createDataFrame(rows, "zh string, en string") for rows in ([("a", "b")], [("a", "x"), ("c", "d")]))
    catalog = spark.createDataFrame([("a", None), ("b", "B"), ("c", "C")], "k string, category string")
    assert sorted(tuple(r) for r in relational.join_pairs_fill.apply(pairs, extra=extra, catalog=catalog).collect()) == [("a", "b", "B", "B", False), ("c", "d", "C", "C", True)]
    flows = spark.createDataFrame([("c", 100.0)], "firm string, f double")
    assert finance.val_dcf.apply(flows, company="firm", flow="f", growth=0.0, rate=0.1, terminal=0.0, years=1).first()["pv_flows"] == pytest.approx(90.91)
    dims = spark.createDataFrame([("missing_values", 0.0), ("duplicates", 50.0)], "dimension string, score double")
    assert tuple(quality_dimensions.dq_overall_score.apply(dims).first()) == (80.0, "B")


def test_regressions_equal_plain_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = 1 + x @ [2, -1, 0] + rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, r), float(v), int(p)) for r, v, p in zip(x, y, rng.random(300) < 1 / (1 + np.exp(-x[:, 0])))], "a double, b double, c double, y double, t int")
    rows, fit = statistics.ols(df, "y", ["a", "b", "c"])
    full = np.column_stack([np.ones(300), x])
    b, rss = np.linalg.lstsq(full, y, rcond=None)[:2]
    assert [r["coef"] for r in rows] == pytest.approx(b.tolist()) and fit["r2"] == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum())
    se = np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * rss[0] / 296)
    assert [r["high"] - r["coef"] for r in rows] == pytest.approx((1.9680 * se).tolist(), rel=1e-3) and fit["aic"] == pytest.approx(300 * np.log(2 * np.pi * rss[0] / 300) + 300 + 8)
    inv = np.linalg.inv(x.T @ x)
    assert statistics.vif(df, ["a", "b", "c"]) == pytest.approx({c: (x.T @ x)[i, i] * inv[i, i] for i, c in enumerate("abc")})
    assert statistics.vif(df, ["a"]) == {"a": None}
    w, t = np.zeros(4), np.array([r["t"] for r in df.select("t").collect()])
    for _ in range(30):
        p = 1 / (1 + np.exp(-full @ w))
        w += np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]), full.T @ (t - p))
    got = {r["name"]: r for r in statistics.logit(df, "t", ["a", "b", "c"]).collect()}
    assert [got[n]["coef"] for n in ("const", "a", "b", "c")] == pytest.approx(w.tolist(), abs=1e-4)
    ll, base = (t * np.log(p) + (1 - t) * np.log(1 - p)).sum(), 300 * (t.mean() * np.log(t.mean()) + (1 - t.mean()) * np.log(1 - t.mean()))
    assert got["a"]["log_likelihood"] == pytest.approx(ll, abs=1e-3) and got["a"]["pseudo_r2"] == pytest.approx(1 - ll / base, abs=1e-5) and got["a"]["llr_p"] == pytest.approx(sm.chi2_upper(2 * (ll - base), 3), abs=1e-5)


def test_selection_of_tests(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [("ab"[i % 2], "xyz"[i % 3], float(rng.normal(i % 2)), float(rng.exponential()), float(rng.normal()), "uv"[int(rng.random() < 0.5)]) for i in range(240)]
    df = spark.createDataFrame(rows, "g2 string, g3 string, normal double, skewed double, other double, label string")
    name = lambda *a, **k: statistics.auto_select(df, *a, **k).first()["test"]
    assert name("g2", "normal") in ("ttest", "welch") and name("g2", "skewed") == "mann_whitney" and name("g3", "skewed") == "kruskal" and name("g3", "other") == "anova"
    assert name("g2", "label") == "chi_square" and name("g2", "skewed", force="t-test") in ("ttest", "welch") and name("g3", "other", force="kruskal-wallis") == "kruskal"
    assert name(pair=("normal", "other")) in ("paired_t", "wilcoxon") and name(pair=("normal", "other"), force="wilcoxon") == "wilcoxon"
    with pytest.raises(ValueError):
        name("g2", "normal", force="nothing")
    with pytest.raises(ValueError):
        name("g2", "normal", force="wilcoxon")


def test_trades_that_look_ahead_are_found(spark):
    from millrace.operators import strategies

    good = ("s", "d2", "d4", 1.0, 1.0, 1.0, 0.0, "cross", "d1", "d3")
    bad = [("s", "d2", "d4", 1.0, 1.0, 1.0, 0.0, "cross", "d2", "d3"), ("s", "d2", "d4", 1.0, 1.0, 1.0, 0.0, "cross", "d1", "d4"), ("s", "d2", "d1", 1.0, 1.0, 1.0, 0.0, "end", "d1", None), ("s", "d2", "d4", 1.0, 1.0, 1.0, 0.0, "cross", None, None)]
    got = strategies.lookahead(spark.createDataFrame([good, *bad], strategies.TRADES)).collect()
    assert [r["violations"] for r in got] == [2, 2, 1]


def test_event_study_export(spark, tmp_path):
    import json

    from millrace.sources import files

    rows = [("2024-01-01", "a", 10.0, 3.0), ("2024-01-01", "b", 5.0, 2.0), ("2024-01-02", "a", 12.0, 3.0), ("2024-01-03", "a", 12.0, 3.0), ("2024-01-03", "b", 4.0, 2.0)]
    made = files.export_event_study(spark.createDataFrame(rows, "date string, ticker string, close double, shares double"), {"a": ("A", "core"), "b": ("B", "edge")}, "2024-01-01", str(tmp_path))
    nav = {r["date"]: (float(r["mcap_weighted_nav"]), float(r["equal_weighted_nav"])) for r in spark.read.csv(f"{tmp_path}/portfolio.csv", header=True).collect()}
    assert nav["2024-01-01"] == (100, 100) and nav["2024-01-02"] == pytest.approx((115, 110)) and nav["2024-01-03"] == pytest.approx((115 * 0.95, 110 * 0.9))
    summary = json.loads(spark.read.text(f"{tmp_path}/summary.json", wholetext=True).first()["value"])["summary"]
    assert summary["hhi"] == pytest.approx(0.625) and summary["top_weight_ticker"] == "a" and summary["single_stock_weight_gt_30pct"] and summary["mcap_change_to_peak_pct"] == pytest.approx(15)
    assert {r["name"] for r in made.collect()} == {"prices.csv", "portfolio.csv", "summary.json"}


def test_sheets_hold_what_was_written(spark, tmp_path):
    from millrace.sources import files

    rows = [(1, "a & <b>", 1.5, None), (2, None, -2.0, " padded ")]
    df = spark.createDataFrame(rows, "n int, s string, x double, t string")
    files.write_sheet(df, str(tmp_path))
    assert sorted(map(tuple, files.scan_sheet(spark, str(tmp_path), "n int, s string, x double, t string").collect())) == rows


def test_plan_reader_sees_joins(spark):
    a = spark.range(10).crossJoin(spark.range(10).withColumnRenamed("id", "b"))
    assert any("every row" in r for _, r in read_plan(a))


def test_average_cost_starts_anew_at_zero(spark):
    df = spark.createDataFrame([(1, 1, "buy", 10, 1.0), (1, 2, "sell", 10, 2.0), (1, 3, "buy", 5, 4.0)], "symbol long, seq long, side string, size long, price double")
    r = finance.average_cost(df).first()
    assert (r["held"], r["cost"], r["pnl"]) == (5.0, 20.0, 10.0)


def found(df, key):
    return {(r[key], r["rule"]): r for r in df.collect()}


def test_owasp_rules_and_excuses_by_line(spark):
    assert len(text.OWASP) == 27
    html = "x.innerHTML = a\ny.outerHTML=b\ndocument.writeln(c)\n<p v-html='d'>\nlocalhost test consent\nx.innerhtml = e"
    df = spark.createDataFrame([(1, html), (2, "yaml.load(a)\nyaml.load(b, SafeLoader)\nnp.eval(x) reeval(y)")], "page_id long, html string")
    got = {k: r["n"] for k, r in found(text.sec_owasp_patterns.apply(df), "page_id").items()}
    assert got == {(1, "inner_html"): 2, (1, "outer_html"): 1, (1, "document_write"): 1, (1, "v_html"): 1}
    got = {k: r["n"] for k, r in found(text.sec_owasp_patterns.apply(df, languages=("py",)), "page_id").items()}
    assert got == {(2, "yaml_load"): 1, (2, "eval"): 1}


def test_secret_rules_of_the_survey(spark):
    assert len(text.SECRET_RULES) == 17
    lines = ["github_pat_" + "a1" * 41, "pk_live_" + "a" * 24, "HEROKU_API_KEY=01234567-0123-0123-0123-0123456789ab", 'token = "s3cret!value"', 'credential = "not short"', 'auth: "abcdefghijklmnopqrstuvwxyz0123456789"', 'api = "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"', '// x = "pk_live"']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {k: r["n"] for k, r in found(text.sec_secret_patterns.apply(df), "doc_id").items()}
    assert got == {(0, "github_pat"): 1, (1, "stripe_publishable"): 1, (2, "heroku_key"): 1, (3, "generic_secret"): 1, (4, "generic_secret"): 1, (5, "high_entropy"): 1}


def test_rate_checks_count_as_with_look_around(spark):
    import re

    rules = {"simile": r"像是|好像|仿佛|如同|宛如|宛若|犹如|好似|(?<![好想象映图])像(?![素章片机样])", "tic": r"缓缓|微微|轻轻(?!松)|淡淡|嘴角"}
    rows = ["图像是好像像素想像像是像样", "轻轻轻松轻轻松轻轻", "像" * 3 + "象像像章仿佛像", "——他——", "# t\n**b** `c` [1] turn2search", "也许是他也许。或许是她或许。也许是它或许", "plain"]
    got = found(text.text_rate_checks.apply(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")), "doc_id")
    assert len(got) == 10 * len(rows)
    for i, t in enumerate(rows):
        for rule, p in rules.items():
            assert got[i, rule]["hits"] == len(re.findall(p, t))
    assert got[3, "dash"]["rate"] == 2000.0 and got[3, "dash"]["over_cap"] and not got[6, "dash"]["over_cap"]
    assert all(got[4, k]["over_cap"] for k in text.LEAKS) and not any(got[6, k]["over_cap"] for k in text.LEAKS)
    assert got[5, "hedging"]["hits"] == 3 and got[5, "hedging"]["over_cap"]


def test_rates_against_a_reference(spark):
    reference = spark.createDataFrame([("缓缓" + "字" * 98 + "“”",)], "text string")
    rows = ["缓缓" + "字" * 98 + "“", "缓缓" * 10 + '"', "plain", "——字字"]
    got = found(text.text_rate_reference.apply(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), reference=reference), "doc_id")
    assert got[0, "tic"]["rate"] == got[0, "tic"]["reference_rate"] == 10.0 and got[0, "tic"]["passed"] and got[0, "quotes"]["passed"]
    assert got[1, "tic"]["rate"] == 500.0 and not got[1, "tic"]["passed"] and not got[1, "quotes"]["passed"]
    assert all(got[2, k]["passed"] for k in (*text.RATES, "quotes")) and not got[3, "dash"]["passed"]
