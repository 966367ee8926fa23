"""Operators declared once as SQL over a relation, rendered per dialect.

An operator is a function ``build(d, rel, **params)`` that gives a SELECT over
the relation ``rel``.  Spark runs the Spark rendering, over any DataFrame or over
the test tables; the other rendering is the oracle's.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows of a relation that one task sorts, and how many times as many at most where more tasks would make those that read hold what they have read.
TASK_ROWS, MORE = 250_000, 5
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Dialect:
    """Spelling of what the two dialects say differently."""

    def __init__(self, spark: bool, session: SparkSession | None = None):
        self.spark, self.session = spark, session

    def lit(self, text: str) -> str:
        if self.spark:
            return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + "'"
        return "'" + text.replace("'", "''") + "'"

    def pct(self, x: str, q: float) -> str:
        return f"percentile({x}, {q})" if self.spark else f"quantile_cont({x}, {q})"

    def day(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd')" if self.spark else f"strftime({ts}, '%Y-%m-%d')"

    def month(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM')" if self.spark else f"strftime({ts}, '%Y-%m')"

    def stamp(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss')" if self.spark else f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.lit(pattern)})" if self.spark else f"regexp_matches({x}, {self.lit(pattern)})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        if self.spark:
            return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)})"
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(re.sub(r'[$]([0-9])', r'\\\1', by))}, 'g')"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def count_of(self, x: str, pattern: str) -> str:
        return f"CAST(regexp_count({x}, {self.lit(pattern)}) AS BIGINT)" if self.spark else f"CAST(len(regexp_extract_all({x}, {self.lit(pattern)})) AS BIGINT)"

    def extract_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def unnest(self, x: str) -> str:
        return f"explode({x})" if self.spark else f"unnest({x})"

    def seq(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})" if self.spark else f"range({a}, ({b}) + 1)"

    def size(self, x: str) -> str:
        return f"CAST(size({x}) AS BIGINT)" if self.spark else f"CAST(len({x}) AS BIGINT)"

    def joined(self, x: str, order: str | None = None) -> str:
        """Distinctly ordered list of strings, comma-joined, per group."""
        return f"array_join(array_sort(collect_list({x})), ',')" if self.spark else f"string_agg({x}, ',' ORDER BY {order or x})"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.lit(re.escape(sep))})" if self.spark else f"string_split({x}, {self.lit(sep)})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def try_double(self, x: str) -> str:
        return f"try_cast({x} AS DOUBLE)"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '$.{path}')" if self.spark else f"json_extract_string({x}, '$.{path}')"

    def lam(self, var: str, body: str) -> str:
        return f"{var} -> {body}" if self.spark else f"lambda {var}: {body}"

    def each(self, arr: str, var: str, body: str) -> str:
        return f"transform({arr}, {self.lam(var, body)})" if self.spark else f"list_transform({arr}, {self.lam(var, body)})"

    def only(self, arr: str, var: str, body: str) -> str:
        return f"filter({arr}, {self.lam(var, body)})" if self.spark else f"list_filter({arr}, {self.lam(var, body)})"

    def distinct(self, arr: str) -> str:
        return f"array_distinct({arr})" if self.spark else f"list_distinct({arr})"

    def codepoint(self, x: str) -> str:
        return f"ascii({x})" if self.spark else f"ord({x})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"list_value({', '.join(items)})"

    def may_hold(self, x: str, literals: str) -> str:
        """Whether any of the literals is in ``x``: a cheap test before patterns that all need one; the oracle does without it."""
        return "(" + " OR ".join(f"contains({x}, {self.lit(w)})" for w in literals.split()) + ")" if self.spark else "true"

    def dealt(self, rel: str, key: str, rows: int | None = None) -> str:
        """A table or view dealt by ``key`` to tasks of some ``rows`` (``TASK_ROWS``) rows, so that what a task sorts does not grow with it.

        The number is given with the rows, as adaptive execution would join the session's partitions to larger tasks.
        A shuffle to more than ``spark.shuffle.sort.bypassMergeThreshold`` partitions holds all rows of a split while it is read,
        so up to ``MORE`` times that number of tasks there are no more than it.
        What one task holds, or without a session that can count, stays as it is.
        """
        if self.session is None or not re.fullmatch(r"\w+", rel):
            return rel
        n = -(-self.session.table(rel).count() // (rows or TASK_ROWS))
        unheld = int(self.session.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
        if rows is None and unheld < n <= MORE * unheld:
            n = unheld
        cores = min(self.session.sparkContext.defaultParallelism, int(self.session.conf.get("spark.sql.shuffle.partitions")))
        return f"(SELECT /*+ REPARTITION({max(n, cores)}, {key}) */ * FROM {rel})" if n > 1 else rel

    def long(self, key: str, rel: str, rows: list[dict[str, str]]) -> str:
        """Several rows for each row of ``rel``: in Spark exploded, so that ``rel`` is read once, as a CTE is copied to each use."""
        key = f"{key}, " if key else ""
        if not self.spark:
            return " UNION ALL ".join(f"SELECT {key}{', '.join(f'{v} AS {k}' for k, v in row.items())} FROM {rel} t" for row in rows)
        made = self.array(*[f"named_struct({', '.join(f"'{k}', {v}" for k, v in row.items())})" for row in rows])
        return f"SELECT {key}{', '.join(f'r.{k} AS {k}' for k in rows[0])} FROM (SELECT {key}explode({made}) AS r FROM {rel} t) wide"

    def but(self, column: str) -> str:
        """All columns but one."""
        return f"* EXCEPT ({column})" if self.spark else f"* EXCLUDE ({column})"

    def commas(self, x: str) -> str:
        """A whole number with its thousands set apart."""
        return f"format_number({x}, 0)" if self.spark else f"format('{{:,}}', {x})"

    def struct_text(self, x: str) -> str:
        return f"CAST({x} AS STRING)" if self.spark else f"CAST({x} AS VARCHAR)"


SPARK, DUCK = Dialect(True), Dialect(False)


def on_tables(spark: SparkSession, sf_dir: str, sql: str | Callable[[Dialect], str]) -> DataFrame:
    """Run SQL, or what gives it for a dialect, over the test tables below ``sf_dir``."""
    named = sql(SPARK) if callable(sql) else sql
    for t in TABLES:
        if re.search(rf"\b{t}\b", named):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql(Dialect(True, spark)) if callable(sql) else sql)


def _nested(rel: str) -> str:
    return rel if re.fullmatch(r"\w+", rel) else f"({rel})"


class Registry:
    """Operators of a module, their queries and the oracle's SQL."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}
        self.ops: dict[str, Callable] = {}

    def op(self, name: str, source: Callable[[Dialect], str] | str, prepare: Callable[..., DataFrame] | None = None, **params):
        """Register ``build(d, rel, **params)`` under ``name``, with a query over ``source``.

        ``prepare(df, **params)`` gives the DataFrame that takes the place of ``rel``
        on Spark, for operators that need rows placed in an order first.

        The decorated function gets ``apply(df, **params)`` to run on a DataFrame.
        A parameter that is a relation is a function of the dialect here, and a
        DataFrame or the name of a view for ``apply``.
        """

        def keep(build):
            def text(d: Dialect) -> str:
                rel = source(d) if callable(source) else source
                return build(d, _nested(rel), **{k: _nested(v(d)) if callable(v) else v for k, v in params.items()})

            if prepare is None:
                self.queries[name] = lambda spark, sf_dir: on_tables(spark, sf_dir, text)
            else:
                self.queries[name] = lambda spark, sf_dir: apply(on_tables(spark, sf_dir, lambda d: f"SELECT * FROM {_nested(source(d) if callable(source) else source)} t"))
            self.sql[name] = text(DUCK)

            def apply(df: DataFrame, **given) -> DataFrame:
                views = []

                def view(x: DataFrame) -> str:
                    views.append(f"src_{uuid.uuid4().hex}")
                    x.createOrReplaceTempView(views[-1])
                    return views[-1]

                try:
                    told = {k: view(v) if isinstance(v, DataFrame) else _nested(v(SPARK)) if callable(v) else v for k, v in (params | given).items()}
                    rel = df if prepare is None else prepare(df, **(params | given))
                    return df.sparkSession.sql(build(Dialect(True, df.sparkSession), view(rel), **told))
                finally:
                    for v in views:
                        df.sparkSession.catalog.dropTempView(v)

            build.apply = apply
            self.ops[name] = apply
            return build

        return keep

    def query(self, name: str, sql: str | None = None, on: Callable | None = None):
        """Register a function of (spark, sf_dir), with the oracle's SQL if any; ``on`` is its form for DataFrames."""

        def keep(run):
            self.queries[name] = run
            if on is not None:
                self.ops[name] = on
            if sql is not None:
                self.sql[name] = sql
            return run

        return keep
