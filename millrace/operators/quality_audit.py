"""An audit of a whole table: twelve dimensions with scores, issues and suggestions.

The table is unpivoted once to (column, value, count).  Missing cells, modes,
distinct values, constants, repeated ids, number-like texts, formats, blanks,
quantiles and moments of every column all follow from that one table of counts;
besides it only whole rows are compared, for repeated rows and for pairs of columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import fixtures as fx
from ..plans.dialect import DUCK, SPARK, Dialect, Registry, on_tables
from ..plans.ranks import quantiles
from ..session import staged
from .quality_dimensions import EMAIL, STRIP, WEIGHTS, column_naming, graded

R = Registry()

# fixed values: formats in the order in which they are tried, and what a share of the values must pass
PHONE = r"^([+]?[0-9]{1,4}[ -]?)?[(]?[0-9]{2,4}[)]?[ -]?[0-9]{3,4}[ -]?[0-9]{4}$"
URL = r"^https?://[^ \t\n]+$"
PATTERNS, PATTERN_SHARE = {"email": EMAIL, "phone": PHONE, "url": URL}, 0.5
DATES, DATE_SHARE = ["%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y%m%d", "%m/%d/%Y", "%m-%d-%Y"], 0.7
# fixed values: words in names of columns of which the first should not be above the second
EARLIER_LATER = [(["start", "begin", "from"], ["end", "finish", "to"]), (["create", "signup", "register", "open", "birth"], ["update", "modify", "close", "last_login", "login", "expire"])]
HIGHER_LOWER = [("price", "discount"), ("total", "tax")]


def spark_format(fmt: str) -> str:
    """A date format in Spark's letters; single digits pass, as they do where it comes from."""
    if fmt == "%Y%m%d":
        return "yyyyMMdd"
    for a, b in {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s"}.items():
        fmt = fmt.replace(a, b)
    return fmt


def is_id(name: str) -> bool:
    low = name.lower().strip()
    return low in ("id", "uuid", "key") or low.endswith("_id") or low.startswith("id_") or any(w in low for w in ("uuid", "编号", "编码"))


def ordered_pairs(columns: list[str], numeric: set[str]) -> list[tuple[str, str]]:
    """(low, high): columns of which, by their names, the first should not be above the second."""
    low = [c.lower().replace(" ", "_") for c in columns]
    out = []
    for i, a in enumerate(low):
        for j in range(i + 1, len(low)):
            b = low[j]
            if any(any(w in a for w in x) and any(w in b for w in y) for x, y in EARLIER_LATER) or ("min" in a and "max" in b and a.replace("min", "") == b.replace("max", "")):
                out.append((columns[i], columns[j]))
    for i, a in enumerate(low):
        for j in range(i + 1, len(low)):
            if columns[i] in numeric and columns[j] in numeric and any(x in a and y in low[j] for x, y in HIGHER_LOWER):
                out.append((columns[j], columns[i]))
    return out


def value_counts(df: DataFrame) -> DataFrame:
    """(c, v, x, k): how often each value of the c-th column is there, as text and, of a column of numbers, as a number; null and NaN are missing."""
    cells = []
    for i, f in enumerate(df.schema.fields):
        col = F.col(f"c{i}")
        number = isinstance(f.dataType, T.NumericType)
        gone = col.isNull() | F.isnan(col) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col.isNull()
        cells.append(F.struct(F.lit(i).alias("c"), F.when(~gone, col.cast("string")).alias("v"), (F.when(~gone, col.cast("double")) if number else F.lit(None).cast("double")).alias("x")))
    one = df.toDF(*[f"c{i}" for i in range(len(cells))]).select(F.explode(F.array(*cells)).alias("cell"))
    return one.groupBy("cell.c", "cell.v", "cell.x").agg(F.count("*").alias("k"))


def profile(df: DataFrame) -> list[dict]:
    """What the dimensions need of each column, one row a column, from the table of counts."""
    counts = staged(value_counts(df))
    v, k, there = F.col("v"), F.col("k"), F.col("v").isNotNull()
    of = lambda cond: F.sum(F.when(cond, k).otherwise(0))
    bare = F.trim(v)
    tests = {name: bare.rlike(p) for name, p in PATTERNS.items()} | {f"date:{fmt}": F.try_to_timestamp(bare, F.lit(spark_format(fmt))).isNotNull() for fmt in DATES}
    blank = v.rlike(f"^{STRIP}*$")
    measures = {
        "filled": of(there), "missing": of(~there), "kinds": F.count(F.when(there, 1)), "numbers": of(v.try_cast("double").isNotNull()), "untrimmed": of(v.rlike(f"(^{STRIP}|{STRIP}$)")), "empty": of(blank), "blank": of(blank & (F.length(v) > 0)),
        "repeats": F.sum(F.when(there, k - 1)), "lo": F.min("x"), "hi": F.max("x"), "mean": F.sum(F.col("x") * k) / F.sum(F.when(F.col("x").isNotNull(), k)), "mode": F.min(F.when(there, F.struct((-k).alias("k"), "v")))["v"],
    } | {name: of(test) for name, test in tests.items()}
    first = counts.groupBy("c").agg(*[m.alias(f"m{i}") for i, m in enumerate(measures.values())])
    rows = {r["c"]: dict(zip(measures, r[1:])) for r in first.collect()}
    if any(r["mean"] is not None for r in rows.values()):
        counts.createOrReplaceTempView(view := "audit_counts")
        q = df.sparkSession.sql(quantiles(SPARK, f"(SELECT * FROM {view} t WHERE x IS NOT NULL)", "x", (0.25, 0.5, 0.75), "c", "k"))
        told = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in q.collect()}
        df.sparkSession.catalog.dropTempView(view)
        # one row for each column of numbers
        marks = F.broadcast(df.sparkSession.createDataFrame([(c, rows[c]["mean"], a, b) for c, (a, _, b) in told.items()], "c int, mu double, a double, b double"))
        x, spread = F.col("x"), 1.5 * (F.col("b") - F.col("a"))
        second = counts.where("x IS NOT NULL").join(marks, "c").groupBy("c").agg(of((x < F.col("a") - spread) | (x > F.col("b") + spread)).alias("outliers"), *[F.sum(k * F.pow(x - F.col("mu"), F.lit(p))).alias(f"s{p}") for p in (2, 3)])
        for r in second.collect():
            n, row = rows[r["c"]]["filled"], rows[r["c"]]
            row |= {"q1": told[r["c"]][0], "median": told[r["c"]][1], "q3": told[r["c"]][2], "outliers": r["outliers"]}
            row["skew"] = (n * (n - 1)) ** 0.5 / (n - 2) * (r["s3"] / n) / (r["s2"] / n) ** 1.5 if n > 2 and r["s2"] > 0 else 0.0
    none = dict.fromkeys(measures, 0) | {"mean": None, "mode": None, "lo": None, "hi": None}
    return [{"name": f.name, "type": f.dataType} | none | rows.get(i, {}) for i, f in enumerate(df.schema.fields)]


def pct(part: int, whole: int) -> float:
    return round(part / whole * 100, 2) if whole else 0.0


def audit(df: DataFrame, id_columns: list[str] | None = None) -> tuple[dict[str, float], list[tuple[str, str, int, str]]]:
    """Scores of the twelve dimensions, and issues (dimension, column, how many, suggestion) in their order.

    Formats are told from all values of a column, and not from its first hundred.
    A table without rows or columns scores 100 throughout.
    """
    cols = profile(df)
    n, names = (cols[0]["filled"] + cols[0]["missing"], [c["name"] for c in cols]) if cols else (0, [])
    number = lambda c: isinstance(c["type"], T.NumericType)
    text = [c for c in cols if isinstance(c["type"], T.StringType)]
    numeric, issues, scores = [c for c in cols if number(c)], [], {}

    def score(name: str, bad: float, of: float) -> None:
        scores[name] = max(0.0, round(100 * (1 - bad / of), 2)) if of and n else 100.0

    for c in cols:
        if c["missing"]:
            fill = f"fill with the median {c['median']:.4g} or the mean" if number(c) and c["filled"] else f"fill with the mode '{c['mode']}', or mark as missing" if c["filled"] else "drop the column or find its source"
            issues.append(("missing_values", c["name"], c["missing"], f"{pct(c['missing'], n)} % missing: {fill}"))
    score("missing_values", sum(c["missing"] for c in cols), n * len(cols))

    safe = df.toDF(*[f"c{i}" for i in range(len(cols))])
    same = safe.groupBy(*[F.to_json(F.struct(a)) if "map<" in t else F.col(a) for a, t in safe.dtypes]).agg(F.count("*").alias("k")).agg(F.sum(F.col("k") - 1).alias("d")).first()["d"] or 0 if cols else 0
    if same:
        issues.append(("duplicates", "(rows)", same, f"{pct(same, n)} % of the rows repeat others: drop them"))
    score("duplicates", same, n)

    mixed = [c for c in text if 0 < c["numbers"] < c["filled"] and c["numbers"] > 0.5 * c["filled"]]
    issues += [("type_consistency", c["name"], c["filled"] - c["numbers"], "all other values are numbers: clean these and convert the column") for c in mixed]
    score("type_consistency", len(mixed), len(cols))

    ranged = [c for c in numeric if c["filled"] >= 4 and c["outliers"]]
    issues += [("value_range", c["name"], c["outliers"], f"outside {c['q1'] - 1.5 * (c['q3'] - c['q1']):.4g} to {c['q3'] + 1.5 * (c['q3'] - c['q1']):.4g}: check for errors of entry") for c in ranged]
    score("value_range", sum(pct(c["outliers"], c["filled"]) > 1 for c in ranged), len(numeric))

    told = {}
    for c in text:
        formats = [(f, PATTERN_SHARE) for f in PATTERNS] + [(f"date:{f}", DATE_SHARE) for f in DATES]
        found = next((f for f, share in formats if c["filled"] and c[f] > share * c["filled"]), None)
        if found:
            told[c["name"]] = c["filled"] - c[found]
            if told[c["name"]]:
                issues.append(("format_compliance", c["name"], told[c["name"]], f"{pct(told[c['name']], c['filled'])} % are not {found}: use one format"))
    score("format_compliance", sum(x > 0 for x in told.values()), len(told))

    ids = [c for c in cols if (c["name"] in id_columns if id_columns else is_id(c["name"]))]
    issues += [("uniqueness", c["name"], c["repeats"], f"{pct(c['repeats'], c['filled'])} % of an id's values repeat others: check the source or add a key") for c in ids if c["repeats"]]
    score("uniqueness", sum((c["repeats"] or 0) > 0 for c in ids), len(ids))

    padded = [c for c in text if c["untrimmed"] + c["empty"]]
    issues += [("whitespace", c["name"], c["untrimmed"] + c["empty"], f"{c['untrimmed']} untrimmed, {c['empty']} empty, {c['blank']} blank: trim, and make empty texts missing") for c in padded]
    score("whitespace", len(padded), len(text))

    constant = [c for c in cols if c["kinds"] <= 1]
    issues += [("constant_columns", c["name"], c["kinds"], f"the only value is {c['mode']}: drop the column") for c in constant]
    score("constant_columns", len(constant), len(cols))

    skewed = [c for c in numeric if c["filled"] >= 8 and abs(c["skew"]) > 1]
    issues += [("distribution_skew", c["name"], c["filled"], f"skewness {c['skew']:.2f}: " + ("take logarithms or a power" if abs(c["skew"]) > 3 else "consider a transformation before regressions")) for c in skewed]
    score("distribution_skew", sum(abs(c["skew"]) > 3 for c in skewed), len(numeric))

    naming = column_naming(df).collect()
    issues += [("column_naming", r["col"], 1, f"{r['problems']}: rename in snake_case") for r in naming if r["problems"] != "none"]
    scores["column_naming"] = naming[0]["score"]

    few = [c for c in cols if (number(c) or isinstance(c["type"], T.BooleanType)) and c["kinds"] <= 2 and c["filled"] > 20]
    many = [c for c in cols if not number(c) and not isinstance(c["type"], T.BooleanType) and c["filled"] > 50 and c["kinds"] / c["filled"] > 0.95]
    issues += [("cardinality", c["name"], c["kinds"], "few different numbers: perhaps a category") for c in few] + [("cardinality", c["name"], c["kinds"], "nearly all texts differ: perhaps free text") for c in many]
    score("cardinality", len(few) + len(many), len(cols))

    pairs = ordered_pairs(names, {c["name"] for c in numeric})
    broken = 0
    if pairs and n:
        at, kind = {c: i for i, c in enumerate(names)}, {c["name"]: c["type"] for c in cols}
        as_number = lambda c: F.col(f"c{at[c]}").cast("string").try_cast("double") if not isinstance(kind[c], T.NumericType) else F.col(f"c{at[c]}").cast("double")
        as_time = lambda c: F.col(f"c{at[c]}").cast("string").try_cast("timestamp")
        aggs = []
        for i, (a, b) in enumerate(pairs):
            for form, make in (("n", as_number), ("t", as_time)):
                x, y = make(a), make(b)
                aggs += [F.count(x).alias(f"{form}x{i}"), F.count(y).alias(f"{form}y{i}"), F.count(F.when(x > y, 1)).alias(f"{form}v{i}"), F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias(f"{form}k{i}")]
        got = safe.agg(*aggs).first()
        for i, (a, b) in enumerate(pairs):
            form = "n" if got[f"nx{i}"] and got[f"ny{i}"] else "t"
            wrong, valid = got[f"{form}v{i}"], got[f"{form}k{i}"]
            if wrong:
                broken += 1
                issues.append(("cross_column", f"{a},{b}", wrong, f"{pct(wrong, valid)} % of the rows have {a} above {b}: check them"))
    score("cross_column", broken, len(pairs))
    order = list(WEIGHTS)
    return {k: scores[k] for k in order}, sorted(issues, key=lambda x: order.index(x[0]))


def dimension_table(df: DataFrame, id_columns: list[str] | None = None) -> DataFrame:
    """(dimension, weight, score) of all twelve."""
    scores, _ = audit(df, id_columns)
    return df.sparkSession.createDataFrame([(k, WEIGHTS[k], float(v)) for k, v in scores.items()], "dimension string, weight int, score double")


def issue_table(df: DataFrame, id_columns: list[str] | None = None) -> DataFrame:
    """(dimension, col, n, suggestion)."""
    _, issues = audit(df, id_columns)
    return df.sparkSession.createDataFrame([(a, b, int(c), s) for a, b, c, s in issues], "dimension string, col string, n long, suggestion string")


def overall(df: DataFrame, id_columns: list[str] | None = None, top: int = 10) -> DataFrame:
    """The weighted mean of the twelve scores, its grade and the first suggestions."""
    scores, issues = audit(df, id_columns)
    s = round(sum(scores[k] * w for k, w in WEIGHTS.items()) / sum(WEIGHTS.values()), 2)
    return df.sparkSession.createDataFrame([(s, graded(s), len(issues), [x[3] for x in issues[:top]])], "score double, grade string, issues long, suggestions array<string>")


# --- the test table and its oracle, dimension by dimension over the rows themselves ---

NUMERIC, TEXTS = ("cust_id", "total_balance", "tax_rate", "c_const", "start_day", "end_day"), ("c_name", "c_mktsegment", "c_mail", "opened", "code_text")


def audited(d: Dialect) -> str:
    """Customers with gaps, padded names, repeated rows, mixed columns and days out of order."""
    opened = "CASE WHEN c_custkey % 20 = 0 THEN 'n/a' WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('2024-0', CAST(1 + c_custkey % 9 AS VARCHAR(5)), '-1', CAST(c_custkey % 10 AS VARCHAR(5))) END"
    code = "CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE CAST(c_custkey % 9 AS VARCHAR(20)) END"
    return f"SELECT c_custkey AS cust_id, c_name, c_acctbal AS total_balance, c_nationkey AS tax_rate, c_mktsegment, c_const, c_mail, {opened} AS opened, {code} AS code_text, c_custkey % 28 AS start_day, c_custkey % 30 AS end_day FROM ({fx.dirty(d)}) z"


def _scores_sql() -> str:
    rel, every = f"({audited(DUCK)})", (*NUMERIC, *TEXTS)
    n_of = lambda cond: f"count(*) FILTER ({cond})"
    yes = lambda conds: " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conds)
    bare = {c: f"trim({c})" for c in TEXTS}

    def share(bad: str, of: str, source: str = f"{rel} t") -> str:
        return f"SELECT round(100 * (1 - ({bad}) / ({of} * 1e0)), 2) AS s FROM {source}"

    tests = {"email": lambda c: DUCK.like(bare[c], EMAIL), "phone": lambda c: DUCK.like(bare[c], PHONE), "url": lambda c: DUCK.like(bare[c], URL)} | {f: (lambda c, f=f: f"try_strptime({bare[c]}, '{f}') IS NOT NULL") for f in DATES}
    found = " UNION ALL ".join(f"SELECT '{c}' AS c, count({c}) AS filled, {', '.join(f'{n_of(t(c))} AS f{i}' for i, t in enumerate(tests.values()))} FROM {rel} t" for c in TEXTS)
    first = "CASE " + " ".join(f"WHEN f{i} > filled * {PATTERN_SHARE if k in PATTERNS else DATE_SHARE} THEN filled - f{i}" for i, k in enumerate(tests)) + " END"
    outside = {c: f"{n_of(f'{c} < {c}_1 - 1.5 * ({c}_3 - {c}_1) OR {c} > {c}_3 + 1.5 * ({c}_3 - {c}_1)')} * 100.0 / nullif(count({c}), 0) > 1 AND count({c}) >= 4" for c in NUMERIC}
    cuts = f"(SELECT {', '.join(f'quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3' for c in NUMERIC)} FROM {rel} u)"
    sql = {
        "missing_values": share(" + ".join(n_of(f"{c} IS NULL") for c in every), f"count(*) * {len(every)}"),
        "duplicates": share("sum(k - 1)", "sum(k)", f"(SELECT count(*) AS k FROM {rel} t GROUP BY {', '.join(every)}) g"),
        "type_consistency": share(yes(f"count(try_cast({c} AS DOUBLE)) > 0 AND count(try_cast({c} AS DOUBLE)) < count({c}) AND count(try_cast({c} AS DOUBLE)) > 0.5 * count({c})" for c in TEXTS), str(len(every))),
        "value_range": share(yes(outside.values()), str(len(NUMERIC)), f"{rel} t CROSS JOIN {cuts} q"),
        "format_compliance": f"SELECT CASE WHEN count(bad) = 0 THEN 100.0 ELSE round(100 * (1 - count(*) FILTER (bad > 0) * 1e0 / count(bad)), 2) END AS s FROM (SELECT {first} AS bad FROM ({found}) f) b",
        "uniqueness": share(yes(["count(cust_id) > count(DISTINCT cust_id)"]), "1"),
        "whitespace": share(yes(n_of(f"{c} <> trim({c}, ' \t\n\r\x0b\x0c') OR trim({c}, ' \t\n\r\x0b\x0c') = ''") + " > 0" for c in TEXTS), str(len(TEXTS))),
        "constant_columns": share(yes(f"count(DISTINCT {c}) <= 1" for c in every), str(len(every))),
        "distribution_skew": share(yes(f"count({c}) >= 8 AND count(DISTINCT {c}) > 1 AND abs(skewness({c})) > 3" for c in NUMERIC if c != "c_const"), str(len(NUMERIC))),
        "column_naming": "SELECT 100e0 AS s",
        "cardinality": share(yes([*(f"count(DISTINCT {c}) <= 2 AND count({c}) > 20" for c in NUMERIC), *(f"count({c}) > 50 AND count(DISTINCT {c}) > 0.95 * count({c})" for c in TEXTS)]), str(len(every))),
        "cross_column": share(yes([n_of("start_day > end_day") + " > 0", n_of("tax_rate > total_balance") + " > 0"]), "2"),
    }
    return " UNION ALL ".join(f"SELECT '{k}' AS dimension, CAST({WEIGHTS[k]} AS INT) AS weight, CAST(s AS DOUBLE) AS score FROM ({q}) q_{k}" for k, q in sql.items())


@R.query("dq_dimension_scores", _scores_sql(), dimension_table)
def dq_dimension_scores(spark, sf_dir):
    return dimension_table(on_tables(spark, sf_dir, audited(SPARK)))


@R.query("dq_audit_issues", None, issue_table)
def dq_audit_issues(spark, sf_dir):
    return issue_table(on_tables(spark, sf_dir, audited(SPARK)))


@R.query("dq_audit_overall", f"SELECT round(sum(score * weight) / sum(weight), 2) AS score, CASE {' '.join(f'WHEN round(sum(score * weight) / sum(weight), 2) >= {x} THEN {DUCK.lit(g)}' for x, g in ((95, 'A+'), (90, 'A'), (80, 'B'), (60, 'C'), (40, 'D')))} ELSE 'F' END AS grade FROM ({_scores_sql()}) d", overall)
def dq_audit_overall(spark, sf_dir):
    return overall(on_tables(spark, sf_dir, audited(SPARK))).select("score", "grade")
