"""Correlation, regression, hypothesis tests and A/B tests.

Sums and ranks are computed in Spark; p-values come from ``functions.stats_math``
on the driver for single results, through the ``*_report`` functions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats_math as sm
from ..plans import fixtures as fx
from ..plans.blocks import halo, positions
from ..plans.dialect import Registry, on_tables
from ..plans.ranks import quantiles, tie_ranks
from .relational import C, ones

R = Registry()
op = R.op

LINES = lambda d: "SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS x, l_extendedprice AS y, l_discount AS z, l_tax AS w, l_linestatus AS g2, l_returnflag AS g3 FROM lineitem"


# --- correlation ---


@op("corr_pearson", LINES, columns=("x", "y", "z", "w"))
def corr_pearson(d, rel, columns):
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    m = ", ".join(f"corr({a}, {b}) AS r{i}, {ones(f'{a} IS NOT NULL AND {b} IS NOT NULL')} AS n{i}" for i, (a, b) in enumerate(pairs))
    rows = d.long("", "m", [{"a": f"'{a}'", "b": f"'{b}'", "r": f"r{i}", "n": f"n{i}"} for i, (a, b) in enumerate(pairs)])
    return f"WITH m AS (SELECT {m} FROM {rel} t) SELECT a, b, n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t FROM ({rows}) q"


def _ranked(d, rel, a, b):
    """Average ranks of complete pairs."""
    whole = f"(SELECT {a}, {b} FROM {rel} t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"SELECT p.r AS ra, q.r AS rb FROM {whole} t JOIN ({tie_ranks(d, whole, a)}) p ON t.{a} = p.v JOIN ({tie_ranks(d, whole, b)}) q ON t.{b} = q.v"


@op("corr_spearman", LINES, a="x", b="y")
def corr_spearman(d, rel, a, b):
    return f"SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM ({_ranked(d, rel, a, b)}) k"


@op("corr_partial", LINES, a="x", b="y", given="z")
def corr_partial(d, rel, a, b, given):
    """Correlation of a and b without what ``given`` explains, with its t."""
    m = f"SELECT corr({a}, {b}) AS ab, corr({a}, {given}) AS az, corr({b}, {given}) AS bz, count(*) AS n FROM {rel} t"
    return f"SELECT round(r, 6) AS r, round(r * sqrt(n - 3) / sqrt(1 - r * r), 4) AS t FROM (SELECT (ab - az * bz) / sqrt((1 - az * az) * (1 - bz * bz)) AS r, n FROM ({m}) m) q"


def partial_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """All partial correlations from one Gram aggregate; the inverse is taken on the driver."""
    k = len(columns)
    rows = df.dropna(subset=columns).agg(*[F.corr(a, b).alias(f"r{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]).first()
    m = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            m[i, j] = m[j, i] = rows[f"r{i}_{j}"]
    p = np.linalg.pinv(m)
    s = np.sqrt(np.outer(np.diag(p), np.diag(p)))
    return np.clip(np.where(np.eye(k, dtype=bool), 1.0, -p / s), -1, 1)


def spurious(df: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """Pairs that correlate while their partial correlation is weak or much smaller."""
    part, n = partial_matrix(df, columns), df.dropna(subset=columns).count()
    got = df.dropna(subset=columns).agg(*[F.corr(a, b).alias(f"{a}|{b}") for i, a in enumerate(columns) for b in columns[i + 1 :]]).first().asDict()
    rows = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            r, q, df_p = got[f"{a}|{columns[j]}"], float(part[i, j]), n - len(columns)
            p = sm.t_two_sided(r * ((n - 2) / max(1e-300, 1 - r * r)) ** 0.5, n - 2)
            pp = sm.t_two_sided(q * (df_p / max(1e-300, 1 - q * q)) ** 0.5, df_p)
            rows.append((a, columns[j], r, p, q, pp, bool(p < alpha and (pp >= alpha or abs(q) < 0.5 * abs(r)))))
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double, p double, partial double, partial_p double, spurious boolean")


@R.query("corr_spurious", on=spurious)
def corr_spurious(spark, sf_dir):
    return spurious(on_tables(spark, sf_dir, LINES(None)), ["x", "y", "z", "w"])


@op("corr_strength_label", lambda d: "SELECT p_partkey AS id, (p_partkey % 201 - 100) / 1e2 AS r, p_partkey % 97 / 1e3 AS p FROM part")
def corr_strength_label(d, rel):
    return f"""SELECT id, CASE WHEN abs(r) >= 8e-1 THEN 'very strong' WHEN abs(r) >= 6e-1 THEN 'strong' WHEN abs(r) >= 4e-1 THEN 'moderate' WHEN abs(r) >= 2e-1 THEN 'weak' ELSE 'very weak' END AS strength,
      CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'none' END AS direction, CASE WHEN p < 1e-3 THEN '***' WHEN p < 1e-2 THEN '**' WHEN p < 5e-2 THEN '*' ELSE '' END AS stars FROM {rel} t"""


@op("corr_pairwise_skipnull", lambda d: "SELECT c_nationkey AS k, c_acctbal AS a, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 100 AS DOUBLE) END AS b, 1e0 AS flat FROM customer")
def corr_pairwise_skipnull(d, rel):
    def one(a, b):
        x, y = (f"CASE WHEN {q} IS NOT NULL THEN {p} END" for p, q in ((a, b), (b, a)))
        return f"SELECT '{a}-{b}' AS pair, round(covar_samp({a}, {b}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0), 6) AS r FROM {rel} t"

    return f"{one('a', 'b')} UNION ALL {one('a', 'flat')}"


# --- regression ---


@op("reg_detect_type", "labels", target="toxic")
def reg_detect_type(d, rel, target):
    return f"SELECT CASE WHEN count(DISTINCT {target}) = 2 AND min({target}) = 0 AND max({target}) = 1 THEN 'logistic' ELSE 'linear' END AS kind FROM {rel} t"


@op("reg_vif", LINES, a="x", b="z")
def reg_vif(d, rel, a, b):
    """Uncentred, as the design has no constant: the same for both of two columns."""
    return f"SELECT round(1 / (1 - sum({a} * {b}) * sum({a} * {b}) / (sum({a} * {a}) * sum({b} * {b}))), 6) AS vif FROM {rel} t"


def ols_sql(rel, y, x):
    return f"SELECT regr_slope({y}, {x}) AS b, regr_intercept({y}, {x}) AS a, regr_r2({y}, {x}) AS r2, count(*) AS n, var_samp({x}) AS vx, var_samp({y}) AS vy FROM {rel} t"


@op("reg_ols", LINES, y="y", x="x")
def reg_ols(d, rel, y, x):
    """Coefficients, errors, R2, F, AIC and BIC of one regressor."""
    e = f"SELECT *, (1 - r2) * vy * (n - 1) AS rss FROM ({ols_sql(rel, y, x)}) o"
    ll = "(-n / 2e0 * (ln(2 * pi()) + ln(rss / n) + 1))"
    return f"""SELECT round(a, 4) AS intercept, round(b, 4) AS slope, round(sqrt(rss / (n - 2) / (vx * (n - 1))), 4) AS se, round(b / sqrt(rss / (n - 2) / (vx * (n - 1))), 4) AS t, round(r2, 6) AS r2,
      round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r2, round(r2 / ((1 - r2) / (n - 2)), 2) AS f, round(-2 * {ll} + 4, 2) AS aic, round(-2 * {ll} + 2 * ln(n), 2) AS bic FROM ({e}) e"""


def _residual_order(df: DataFrame, y: str, x: str, order: str) -> DataFrame:
    return halo(positions(df.select(order, y, x), [order]), 1)


@op("reg_durbin_watson", lambda d: f"SELECT date AS id, value AS y, CAST(row_number() OVER (ORDER BY date) AS DOUBLE) AS x FROM ({fx.daily(d)}) s", _residual_order, y="y", x="x", order="id")
def reg_durbin_watson(d, rel, y, x, order):
    """Residuals in the order of a key; a block's first one is compared with the last of the block before."""
    if not d.spark:
        e = f"SELECT {order}, {y} - (a + b * {x}) AS e FROM {rel} t CROSS JOIN ({ols_sql(rel, y, x)}) o"
        return f"SELECT round(sum(de * de) / sum(e * e), 6) AS dw FROM (SELECT e, e - lag(e) OVER (ORDER BY {order}) AS de FROM ({e}) r) q"
    e = f"SELECT _in, _pos, _own, {y} - (a + b * {x}) AS e FROM {rel} t CROSS JOIN ({ols_sql(f'(SELECT * FROM {rel} h WHERE _own)', y, x)}) o"
    return f"SELECT round(sum(de * de) / sum(e * e), 6) AS dw FROM (SELECT _own, e, e - lag(e) OVER (PARTITION BY _in ORDER BY _pos) AS de FROM ({e}) r) q WHERE _own"


def _gram(df: DataFrame, features: list[str], target: str | None = None, const: bool = True) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """X'X, X'y, y'y, sum of y and rows, of complete rows, from one aggregate; its size follows from the number of columns alone."""
    cols = [*([F.lit(1.0)] if const else []), *[F.col(c).cast("double") for c in features]]
    y = F.col(target).cast("double") if target else F.lit(0.0)
    k = len(cols)
    rows = df.dropna(subset=[*features, *([target] if target else [])])
    got = rows.agg(*[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(c * y).alias(f"v{i}") for i, c in enumerate(cols)], F.sum(y * y).alias("yy"), F.sum(y).alias("sy"), F.count("*").alias("n")).first()
    g = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    return g, np.array([got[f"v{i}"] for i in range(k)], float), float(got["yy"] or 0), float(got["sy"] or 0), got["n"]


def vif(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Variance inflation of each column in a design without a constant (uncentred); None for a single column."""
    if len(columns) < 2:
        return dict.fromkeys(columns)
    g = _gram(df, columns, const=False)[0]
    inv = np.linalg.pinv(g)
    return {c: float(g[i, i] * inv[i, i]) for i, c in enumerate(columns)}


def vif_table(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, None if v is None else round(v, 4)) for c, v in vif(df, columns).items()], "name string, vif double")


def ols(df: DataFrame, target: str, features: list[str], level: float = 0.95) -> tuple[list[dict], dict]:
    """Any number of regressors: normal equations from one aggregate, solved on the driver.

    Gives coefficients with errors, t, p and intervals, and of the model R2,
    adjusted R2, F with its p, AIC and BIC.
    """
    g, v, yy, sy, n = _gram(df, features, target)
    k = len(v)
    if n <= k:
        raise ValueError(f"{n} complete rows are too few for {k} coefficients")
    inv = np.linalg.pinv(g)
    b = inv @ v
    rss, tss = max(0.0, yy - float(b @ v)), max(0.0, yy - sy * sy / n)
    se = np.sqrt(np.maximum(0, np.diag(inv)) * rss / (n - k))
    wide = sm.t_critical(n - k, level)
    rows = []
    for i, name in enumerate(["const", *features]):
        t = float(b[i] / se[i]) if se[i] > 0 else float("inf")
        rows.append({"name": name, "coef": float(b[i]), "se": float(se[i]), "t": t, "p": sm.t_two_sided(t, n - k) if np.isfinite(t) else 0.0, "low": float(b[i] - wide * se[i]), "high": float(b[i] + wide * se[i])})
    r2 = 1 - rss / tss if tss > 0 else 0.0
    f = r2 / (k - 1) / ((1 - r2) / (n - k)) if k > 1 and r2 < 1 else float("inf")
    loglik = -n / 2 * (np.log(2 * np.pi) + np.log(max(rss, 1e-300) / n) + 1)
    fit = {"n": n, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k), "f": f, "f_p": sm.f_upper(f, k - 1, n - k) if np.isfinite(f) else 0.0, "aic": float(2 * k - 2 * loglik), "bic": float(k * np.log(n) - 2 * loglik)}
    return rows, fit


def ols_table(df: DataFrame, target: str, features: list[str], level: float = 0.95) -> DataFrame:
    """One row a coefficient, with the model's figures and the regressor's VIF on each."""
    rows, fit = ols(df, target, features, level)
    inflation = vif(df, features)
    out = [(r["name"], *(round(r[c], 6) for c in ("coef", "se", "t", "p", "low", "high")), inflation.get(r["name"]), fit["n"], *(round(float(fit[c]), 6) for c in ("r2", "adj_r2", "f", "f_p", "aic", "bic"))) for r in rows]
    return df.sparkSession.createDataFrame(out, "name string, coef double, se double, t double, p double, low double, high double, vif double, n long, r2 double, adj_r2 double, f double, f_p double, aic double, bic double")


@R.query("reg_ols_many", on=ols_table)
def reg_ols_many(spark, sf_dir):
    return ols_table(on_tables(spark, sf_dir, LINES(None)), "y", ["x", "z", "w"])


def _det3(m) -> str:
    return " + ".join(f"({sign}{m(0, i)} * ({m(1, j)} * {m(2, k)} - {m(1, k)} * {m(2, j)}))" for i, j, k, sign in ((0, 1, 2, ""), (1, 0, 2, "-"), (2, 0, 1, "")))


def _vif3() -> str:
    """Closed form for three columns: g_ii times its cofactor over the determinant."""
    c = ("x", "z", "w")
    g = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    sums = ", ".join(f"sum({c[i]} * {c[j]}) AS g{i}{j}" for i in range(3) for j in range(i, 3))
    one = lambda i: [j for j in range(3) if j != i]
    rows = " UNION ALL ".join(f"SELECT '{c[i]}' AS name, round({g(i, i)} * ({g(one(i)[0], one(i)[0])} * {g(one(i)[1], one(i)[1])} - {g(*one(i))} * {g(*one(i))}) / ({_det3(g)}), 4) AS vif FROM m" for i in range(3))
    return f"WITH m AS (SELECT {sums} FROM ({LINES(None)}) t) {rows}"


@R.query("reg_vif_many", _vif3(), vif_table)
def reg_vif_many(spark, sf_dir):
    return vif_table(on_tables(spark, sf_dir, LINES(None)), ["x", "z", "w"])


def partial_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Partial correlation of each pair given all other columns, with its t and p."""
    m, n = partial_matrix(df, columns), df.dropna(subset=columns).count()
    rows = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            r, free = float(m[i, j]), n - len(columns)
            t = r * np.sqrt(free) / np.sqrt(max(1e-300, 1 - r * r))
            rows.append((a, columns[j], round(r, 6), round(float(t), 4), round(sm.t_two_sided(float(t), free), 6)))
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double, t double, p double")


_XZW = "SELECT corr(x, z) AS ab, corr(x, w) AS ac, corr(z, w) AS bc, count(*) AS n FROM ({}) t".format(LINES(None))


@R.query(
    "corr_partial_many",
    "WITH m AS ({}), p AS ({}) SELECT a, b, round(r, 6) AS r, round(r * sqrt(n - 3) / sqrt(1 - r * r), 4) AS t FROM p".format(
        _XZW, " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, ({x} - {y} * {z}) / sqrt((1 - {y} * {y}) * (1 - {z} * {z})) AS r, n FROM m" for a, b, x, y, z in (("x", "z", "ab", "ac", "bc"), ("x", "w", "ac", "ab", "bc"), ("z", "w", "bc", "ab", "ac")))
    ),
    partial_table,
)
def corr_partial_many(spark, sf_dir):
    return partial_table(on_tables(spark, sf_dir, LINES(None)), ["x", "z", "w"]).drop("p")


def logit(df: DataFrame, target: str, features: list[str], level_z: float = 1.959963984540054) -> DataFrame:
    """Coefficients, errors, z, p, odds ratios and intervals of a binary target; log likelihood, McFadden's R2, the likelihood ratio's p, AIC and BIC on each row."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = df.dropna(subset=[target, *features]).select(F.col(target).cast("double").alias("label"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    rows = VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features").transform(rows)
    fit = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=100).fit(rows)
    s, n, k = fit.summary, rows.count(), len(features) + 1
    loglik = -s.deviance / 2
    whole = (round(loglik, 4), round(1 - s.deviance / s.nullDeviance, 6), round(sm.chi2_upper(max(0.0, s.nullDeviance - s.deviance), k - 1), 6), round(2 * k - 2 * loglik, 4), round(float(k * np.log(n) - 2 * loglik), 4))
    coef = [*fit.coefficients.toArray().tolist(), fit.intercept]
    out = [(name, *(round(float(x), 6) for x in (c, e, t, p, np.exp(c), c - level_z * e, c + level_z * e)), n, *whole) for name, c, e, t, p in zip([*features, "const"], coef, s.coefficientStandardErrors, s.tValues, s.pValues)]
    return df.sparkSession.createDataFrame(out, "name string, coef double, se double, z double, p double, odds_ratio double, low double, high double, n long, log_likelihood double, pseudo_r2 double, llr_p double, aic double, bic double")


@R.query("reg_logit", on=logit)
def reg_logit(spark, sf_dir):
    df = on_tables(spark, sf_dir, "SELECT toxic, quality, ln(1 + n_chars) AS size FROM labels JOIN documents ON labels.doc_id = documents.doc_id")
    return logit(df, "toxic", ["quality", "size"])


@op("reg_fit_label", lambda d: "SELECT p_partkey AS id, p_partkey % 101 / 1e2 AS r2, CAST(p_size AS DOUBLE) / 4 AS vif FROM part")
def reg_fit_label(d, rel):
    return f"""SELECT id, CASE WHEN r2 >= 8e-1 THEN 'very good' WHEN r2 >= 5e-1 THEN 'good' WHEN r2 >= 3e-1 THEN 'fair' ELSE 'poor' END AS fit, CASE WHEN r2 >= 4e-1 THEN 'excellent' WHEN r2 >= 2e-1 THEN 'good' ELSE 'weak' END AS pseudo_fit,
      CASE WHEN vif >= 10 THEN 'severe' WHEN vif >= 5 THEN 'moderate' ELSE 'none' END AS collinearity FROM {rel} t"""


# --- hypothesis tests ---


@op("test_is_categorical", "lineitem", columns=("l_linenumber", "l_partkey", "l_returnflag"), text=("l_returnflag",))
def test_is_categorical(d, rel, columns, text):
    m = ", ".join(f"count(DISTINCT {c}) AS k{i}" for i, c in enumerate(columns))
    rows = d.long("", "m", [{"col": f"'{c}'", "categorical": "true" if c in text else f"k{i} <= 20 AND k{i} * 1e0 / n < 5e-2"} for i, c in enumerate(columns)])
    return f"WITH m AS (SELECT {m}, count(*) AS n FROM {rel} t) {rows}"


def anova_sql(rel, g, v):
    return f"""SELECT k, n, ssb, ssw, (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM (SELECT count(*) AS k, CAST(sum(c) AS DOUBLE) AS n, sum(c * (m - gm) * (m - gm)) AS ssb, sum((c - 1) * s) AS ssw FROM (
      SELECT {g}, CAST(count({v}) AS DOUBLE) AS c, avg({v}) AS m, var_samp({v}) AS s FROM {rel} t GROUP BY {g}) q CROSS JOIN (SELECT avg({v}) AS gm FROM {rel} t) a) r"""


@op("test_levene", LINES, g="g3", v="y")
def test_levene(d, rel, g, v):
    """Distances from each group's median; the medians go to the rows, as few groups would be few tasks."""
    z = f"(SELECT {'/*+ BROADCAST(m) */ ' if d.spark else ''}t.{g}, abs(t.{v} - m.med) AS z FROM {rel} t JOIN (SELECT g AS k, q0 AS med FROM ({quantiles(d, rel, v, (0.5,), g)}) u) m ON t.{g} = m.k)"
    return f"SELECT round(f, 4) AS f FROM ({anova_sql(z, g, 'z')}) a"


def two_groups(rel, g, v):
    return f"SELECT a.c AS n1, b.c AS n2, a.m AS m1, b.m AS m2, a.s AS s1, b.s AS s2 FROM (SELECT 1 AS j, {g} AS k, CAST(count({v}) AS DOUBLE) AS c, avg({v}) AS m, var_samp({v}) AS s, row_number() OVER (ORDER BY {g}) AS rn FROM {rel} t GROUP BY {g}) a JOIN (SELECT 1 AS j, {g} AS k, CAST(count({v}) AS DOUBLE) AS c, avg({v}) AS m, var_samp({v}) AS s, row_number() OVER (ORDER BY {g}) AS rn FROM {rel} t GROUP BY {g}) b ON a.j = b.j AND a.rn = 1 AND b.rn = 2"


POOLED = "((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2)"


@op("test_ttest", LINES, g="g2", v="y")
def test_ttest(d, rel, g, v):
    return f"SELECT round((m1 - m2) / sqrt({POOLED} * (1 / n1 + 1 / n2)), 6) AS t, round((m1 - m2) / sqrt({POOLED}), 6) AS cohens_d, CAST(n1 + n2 - 2 AS BIGINT) AS df FROM ({two_groups(rel, g, v)}) q"


@op("test_welch", LINES, g="g2", v="y")
def test_welch(d, rel, g, v):
    """The pooled degrees of freedom are reported here too."""
    return f"SELECT round((m1 - m2) / sqrt(s1 / n1 + s2 / n2), 6) AS t, round((m1 - m2) / sqrt({POOLED}), 6) AS cohens_d, CAST(n1 + n2 - 2 AS BIGINT) AS df FROM ({two_groups(rel, g, v)}) q"


def ranks_sql(d, rel, g, v):
    """Average ranks by way of counts per value."""
    return f"SELECT t.{g} AS g, c.r, c.ties FROM {rel} t JOIN ({tie_ranks(d, rel, v)}) c ON t.{v} = c.v"


@op("test_mann_whitney", LINES, g="g2", v="x")
def test_mann_whitney(d, rel, g, v):
    q = f"SELECT g, CAST(count(*) AS DOUBLE) AS n, sum(r) AS s, row_number() OVER (ORDER BY g) AS rn FROM ({ranks_sql(d, rel, g, v)}) r GROUP BY g"
    return f"SELECT u, round(1 - 2 * u / (n1 * n2), 6) AS rank_biserial FROM (SELECT a.s - a.n * (a.n + 1) / 2 AS u, a.n AS n1, b.n AS n2 FROM ({q}) a JOIN ({q}) b ON a.rn = 1 AND b.rn = 2) x"


@op("test_anova", LINES, g="g3", v="y")
def test_anova(d, rel, g, v):
    return f"SELECT round(f, 4) AS f, round(ssb / (ssb + ssw), 8) AS eta_squared FROM ({anova_sql(rel, g, v)}) a"


@op("test_kruskal", LINES, g="g3", v="x")
def test_kruskal(d, rel, g, v):
    """Corrected for ties."""
    r = ranks_sql(d, rel, g, v)
    h = f"SELECT count(*) AS k, sum(n) AS n, sum(s * s / n) AS q FROM (SELECT g, CAST(count(*) AS DOUBLE) AS n, sum(r) AS s FROM ({r}) r GROUP BY g) x"
    t = f"SELECT sum(ties * ties - 1) AS c FROM ({r}) z"
    return f"SELECT round(h, 4) AS h, round(greatest((h - k + 1) / (n - k), 0), 6) AS epsilon_squared FROM (SELECT k, n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - c / (n * n * n - n)) AS h FROM ({h}) h CROSS JOIN ({t}) t) y"


def chi_sql(rel, a, b):
    o = f"SELECT p.{a}, q.{b}, coalesce(o.c, 0) AS o, p.c * q.c / n.c AS e FROM (SELECT {a}, CAST(count(*) AS DOUBLE) AS c FROM {rel} t GROUP BY {a}) p CROSS JOIN (SELECT {b}, CAST(count(*) AS DOUBLE) AS c FROM {rel} t GROUP BY {b}) q CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS c FROM {rel} t) n LEFT JOIN (SELECT {a} AS a2, {b} AS b2, CAST(count(*) AS DOUBLE) AS c FROM {rel} t GROUP BY {a}, {b}) o ON p.{a} = o.a2 AND q.{b} = o.b2"
    return f"SELECT count(DISTINCT {a}) AS r, count(DISTINCT {b}) AS k, sum(o) AS n, sum((o - e) * (o - e) / e) AS plain, sum((abs(o - e) - least(5e-1, abs(o - e))) * (abs(o - e) - least(5e-1, abs(o - e))) / e) AS yates, min(e) AS min_expected FROM ({o}) o"


@op("test_chi_square", "orders", a="o_orderstatus", b="o_orderpriority")
def test_chi_square(d, rel, a, b):
    """Yates' correction for two by two only."""
    return f"SELECT round(x, 6) AS chi2, CAST((r - 1) * (k - 1) AS BIGINT) AS df, round(sqrt(x / (n * (least(r, k) - 1))), 6) AS cramers_v, round(min_expected, 4) AS min_expected FROM (SELECT *, CASE WHEN r = 2 AND k = 2 THEN yates ELSE plain END AS x FROM ({chi_sql(rel, a, b)}) c) q"


@op("test_paired_t", LINES, a="z", b="w")
def test_paired_t(d, rel, a, b):
    return f"SELECT round(m / (s / sqrt(n)), 4) AS t, round(abs(m) / s, 6) AS cohens_d, n - 1 AS df FROM (SELECT avg({a} - {b}) AS m, stddev_samp({a} - {b}) AS s, count({a} - {b}) AS n FROM {rel} t) q"


@op("test_wilcoxon", lambda d: "SELECT CAST(round(l_discount * 100) AS BIGINT) AS a, CAST(round(l_tax * 100) AS BIGINT) AS b FROM lineitem")
def test_wilcoxon(d, rel):
    """Zeros go before ranking, while the effect size uses all pairs."""
    x = f"(SELECT CASE WHEN a > b THEN 1 ELSE -1 END AS g, abs(a - b) AS v FROM {rel} z WHERE a <> b)"
    w = f"SELECT least(sum(CASE WHEN g > 0 THEN r ELSE 0 END), sum(CASE WHEN g < 0 THEN r ELSE 0 END)) AS w FROM ({ranks_sql(d, x, 'g', 'v')}) r"
    return f"SELECT w, round(1 - 2 * w / (n * (n + 1) / 2e0), 6) AS r FROM ({w}) w CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM {rel} t) c"


@op("test_effect_label", lambda d: "SELECT p_partkey AS id, p_partkey % 150 / 1e2 AS e FROM part")
def test_effect_label(d, rel):
    band = lambda a, b, c: f"CASE WHEN e < {a} THEN 'negligible' WHEN e < {b} THEN 'small' WHEN e < {c} THEN 'medium' ELSE 'large' END"
    return f"SELECT id, {band('2e-1', '5e-1', '8e-1')} AS cohens_d, {band('1e-1', '3e-1', '5e-1')} AS r, {band('1e-2', '6e-2', '14e-2')} AS eta_squared FROM {rel} t"


def normality(df: DataFrame, column: str, cap: int = 5000) -> tuple[float, float, int]:
    """Shapiro-Wilk W and p over at most ``cap`` values, drawn by hash."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"), F.xxhash64(*df.columns).alias("h"))
    got = [r["v"] for r in rows.orderBy("h", "v").limit(cap).collect()]
    return (*sm.shapiro(got), len(got)) if len(got) >= 3 else (float("nan"), 0.0, len(got))


@R.query("test_shapiro")
def test_shapiro(spark, sf_dir):
    w, p, n = normality(on_tables(spark, sf_dir, "SELECT event_id, value FROM events"), "value")
    return spark.createDataFrame([(round(w, 6), round(p, 6), n, p > 0.05)], "w double, p double, n long, normal boolean")


FORCED = {"t-test": "ttest", "welch": "welch", "mann-whitney": "mann_whitney", "anova": "anova", "kruskal-wallis": "kruskal", "chi-square": "chi_square", "paired-ttest": "paired_t", "wilcoxon": "wilcoxon"}
CHOSEN = "test string, statistic double, effect double, normal boolean, equal_variance boolean"


def categorical(df: DataFrame, column: str) -> bool:
    """Text, or at most 20 different values that are less than a twentieth of the rows."""
    if dict(df.dtypes)[column] == "string":
        return True
    got = df.agg(F.count_distinct(column).alias("k"), F.count(column).alias("n")).first()
    return got["k"] <= 20 and got["k"] < 0.05 * max(1, got["n"])


def _paired(df: DataFrame, a: str, b: str, force: str | None, alpha: float) -> tuple:
    rows = df.dropna(subset=[a, b]).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    if rows.limit(3).count() < 3:
        raise ValueError("3 complete pairs are needed")
    normal = normality(rows.select((F.col("a") - F.col("b")).alias("v"), "a", "b"), "v")[1] > alpha
    name = FORCED[force] if force in ("paired-ttest", "wilcoxon") else "paired_t" if normal else "wilcoxon"
    got = test_paired_t.apply(rows, a="a", b="b").first() if name == "paired_t" else test_wilcoxon.apply(rows).first()
    return name, float(got[0]), float(got[1]), normal, None


def conditions(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> tuple[int, bool, bool]:
    """What a choice goes by: the number of groups, whether all are normal, and whether variances are equal."""
    df = df.where(F.col(value).isNotNull())
    groups = sorted(r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().limit(51).collect())
    if len(groups) < 2 or len(groups) > 50:
        raise ValueError("2 to 50 groups are needed")
    normal = all(normality(df.where(F.col(group) == g), value)[1] > alpha for g in groups)
    return len(groups), normal, sm.f_upper(test_levene.apply(df, g=group, v=value).first()["f"], len(groups) - 1, df.count() - len(groups)) > alpha


def auto_select(df: DataFrame, group: str | None = None, value: str | None = None, pair: tuple[str, str] | None = None, force: str | None = None, alpha: float = 0.05, known: tuple[int, bool, bool] | None = None) -> DataFrame:
    """Choose a test by the kinds of columns, the number of groups, normality and equal variances, and run it.

    ``pair`` names two columns of paired values.  ``force`` is a name of FORCED.
    Two categorical columns are tested for independence.  Of two groups of unequal
    variances that are normal, Welch's test is taken.  ``known`` are ``conditions``
    of the same columns, for a caller that runs several tests on them.
    """
    if force is not None and force not in FORCED:
        raise ValueError(f"unknown test {force}")
    if pair is not None:
        return df.sparkSession.createDataFrame([_paired(df, *pair, force, alpha)], CHOSEN)
    if group is None or value is None:
        raise ValueError("name group and value, or a pair")
    if force == "chi-square" or (force is None and categorical(df, group) and categorical(df, value)):
        got = test_chi_square.apply(df.dropna(subset=[group, value]), a=group, b=value).first()
        return df.sparkSession.createDataFrame([("chi_square", float(got["chi2"]), float(got["cramers_v"]), None, None)], CHOSEN)
    n_groups, normal, equal = known or conditions(df, group, value, alpha)
    df = df.where(F.col(value).isNotNull())
    if force is not None:
        name = FORCED[force]
        name = "welch" if name == "ttest" and not equal else name
    elif n_groups == 2:
        name = ("ttest" if equal else "welch") if normal else "mann_whitney"
    else:
        name = "anova" if normal else "kruskal"
    runs = {"ttest": test_ttest, "welch": test_welch, "mann_whitney": test_mann_whitney, "anova": test_anova, "kruskal": test_kruskal}
    if name not in runs:
        raise ValueError(f"{force} needs a pair")
    got = runs[name].apply(df, g=group, v=value).first()
    return df.sparkSession.createDataFrame([(name, float(got[0]), float(got[1]), normal, equal)], CHOSEN)


@R.query("test_auto_select", on=auto_select)
def test_auto_select(spark, sf_dir):
    """Each branch that the data reach: groups, pairs, counts and a forced test."""
    df = on_tables(spark, sf_dir, LINES(None))
    known = conditions(df, "g3", "y")
    got = auto_select(df, "g3", "y", known=known).union(auto_select(df, "g2", "y")).union(auto_select(df, pair=("z", "w"))).union(auto_select(df, "g2", "g3"))
    return got.union(auto_select(df, "g3", "y", force="anova", known=known)).union(auto_select(df, pair=("z", "w"), force="paired-ttest"))


# --- A/B tests ---

PURCHASE = "event_type = 'purchase'"
ARMS = lambda d: f"SELECT CAST(user_id % 2 AS BIGINT) AS arm, count(*) AS visitors, {ones(PURCHASE)} AS conversions FROM events GROUP BY user_id % 2"
_AB = "SELECT a.visitors * 1e0 AS n1, a.conversions * 1e0 AS x1, b.visitors * 1e0 AS n2, b.conversions * 1e0 AS x2, a.conversions * 1e0 / a.visitors AS p1, b.conversions * 1e0 / b.visitors AS p2 FROM {rel} a JOIN {rel} b ON a.arm = 0 AND b.arm = 1"


def ab(rel):
    return f"SELECT *, (x1 + x2) / (n1 + n2) AS p FROM ({_AB.format(rel=rel)}) q"


_SE = "sqrt(p * (1 - p) * (1 / n1 + 1 / n2))"


@op("ab_ztest", ARMS)
def ab_ztest(d, rel):
    return f"SELECT round(p1, 6) AS control_rate, round(p2, 6) AS treatment_rate, round(CASE WHEN {_SE} = 0 THEN 0 ELSE (p2 - p1) / {_SE} END, 6) AS z FROM ({ab(rel)}) a"


@op("ab_chi2", ARMS)
def ab_chi2(d, rel):
    """Without Yates' correction, so it is the square of z."""
    e = "(n1 + n2) * (x1 * (n2 - x2) - x2 * (n1 - x1)) * (x1 * (n2 - x2) - x2 * (n1 - x1)) / nullif(n1 * n2 * (x1 + x2) * (n1 + n2 - x1 - x2), 0)"
    return f"SELECT round({e}, 6) AS chi2 FROM ({ab(rel)}) a"


Z975 = 1.959963984540054


@op("ab_ci", ARMS)
def ab_ci(d, rel):
    se = "sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)"
    return f"SELECT round(p2 - p1 - {Z975:.15e} * {se}, 6) AS low, round(p2 - p1 + {Z975:.15e} * {se}, 6) AS high FROM ({ab(rel)}) a"


@op("ab_sample_size", ARMS, power_z=0.8416212335729143)
def ab_sample_size(d, rel, power_z):
    """Per arm for the difference seen, or one point where there is none."""
    mde = "CASE WHEN abs(p2 - p1) > 0 THEN abs(p2 - p1) ELSE 1e-2 END"
    return f"SELECT {C(f'ceil(pow({Z975:.15e} + {power_z:.15e}, 2) * (p1 * (1 - p1) + p2 * (1 - p2)) / pow({mde}, 2))')} AS n FROM ({ab(rel)}) a"


@op("ab_validate", lambda d: "SELECT p_partkey AS id, p_size AS visitors, p_partkey % 60 - 5 AS conversions, p_partkey % 12 / 1e1 AS alpha FROM part")
def ab_validate(d, rel):
    return f"SELECT id, CASE WHEN visitors <= 0 THEN 'visitors' WHEN conversions < 0 THEN 'negative' WHEN conversions > visitors THEN 'more conversions than visitors' WHEN alpha <= 0 OR alpha >= 1 THEN 'alpha' ELSE 'ok' END AS verdict FROM {rel} t"


@op("ab_recommend", ARMS)
def ab_recommend(d, rel):
    z = f"(p2 - p1) / nullif({_SE}, 0)"
    return f"SELECT CASE WHEN {z} > {Z975:.15e} THEN 'ship treatment' WHEN {z} < -{Z975:.15e} THEN 'keep control' ELSE 'no difference shown' END AS decision FROM ({ab(rel)}) a"


def power(p1: float, p2: float, n1: float, n2: float, alpha: float = 0.05) -> float:
    """Two-sided normal power; alpha without a difference, 1 without an error."""
    if p1 == p2:
        return alpha
    se = (p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) ** 0.5
    if se == 0:
        return 1.0
    z, k = abs(p2 - p1) / se, sm.normal_quantile(1 - alpha / 2)
    return sm.normal_cdf(z - k) + sm.normal_cdf(-z - k)


def _phi(x: str) -> str:
    """The oracle's normal distribution: Simpson's rule from zero."""
    return f"(5e-1 + {x} / 6e3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow({x} * i / 2e3, 2) / 2))))"


_POWER = f"SELECT round(CASE WHEN p1 = p2 THEN 5e-2 WHEN z IS NULL THEN 1e0 ELSE {_phi(f'(z - {Z975:.15e})')} + {_phi(f'(-z - {Z975:.15e})')} END, 6) AS power FROM (SELECT p1, p2, abs(p2 - p1) / nullif(sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2), 0) AS z FROM ({{}}) a) b"


@R.query("ab_power", _POWER.format(ab(f"({ARMS(None)})")))
def ab_power(spark, sf_dir):
    r = on_tables(spark, sf_dir, ab(f"({ARMS(None)})")).first()
    return spark.createDataFrame([(round(power(r["p1"], r["p2"], r["n1"], r["n2"]), 6),)], "power double")
