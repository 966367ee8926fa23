"""Weighted scores, estimates, task graphs and shadows on a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import fixtures as fx
from ..plans.dialect import DUCK, SPARK, Registry, on_tables
from ..session import staged

R = Registry()
op = R.op


def scores(d) -> str:
    """Market segments against four dimensions, scored 1 to 5."""
    base = "SELECT c_mktsegment AS opt, round(avg(c_acctbal), 2) AS a, max(c_acctbal) AS b, count(*) AS c, min(c_acctbal) AS e FROM customer GROUP BY c_mktsegment"
    return " UNION ALL ".join(f"SELECT opt, '{n}' AS dim, CAST(ntile(5) OVER (ORDER BY {c}, opt) AS DOUBLE) AS score, {w} AS weight, {i} AS place FROM ({base}) b{i}" for i, (n, c, w) in enumerate((("mean", "a", "4e0"), ("top", "b", "3e0"), ("size", "c", "2e0"), ("low", "e", "1e0")), 1))


def weighted(rel, weight="weight"):
    return f"SELECT opt, sum(score * {weight}) / sum({weight}) AS total FROM {rel} t GROUP BY opt"


@op("score_weighted", scores)
def score_weighted(d, rel):
    return f"SELECT opt, round(total, 4) AS total FROM ({weighted(rel)}) w"


@op("score_roc_weights", "region", n=5)
def score_roc_weights(d, rel, n):
    """Rank-order centroid: the mean of 1/j from a rank to the last."""
    return f"SELECT CAST(k AS BIGINT) AS k, round(sum(1e0 / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) / {n}, 6) AS weight FROM (SELECT {d.unnest(d.seq('1', str(n)))} AS k) s"


@op("score_normalize", scores)
def score_normalize(d, rel):
    return f"SELECT dim, round(w / nullif(sum(w) OVER (), 0), 6) AS weight FROM (SELECT dim, max(weight) AS w FROM {rel} t GROUP BY dim) x"


@op("score_zero_discrimination", lambda d: f"{scores(d)} UNION ALL SELECT DISTINCT c_mktsegment, 'flat', 3e0, 1e0, 5 FROM customer")
def score_zero_discrimination(d, rel):
    return f"SELECT dim FROM {rel} t GROUP BY dim HAVING count(DISTINCT score) = 1"


@op("score_sensitivity", scores)
def score_sensitivity(d, rel):
    """Winner with each weight moved by a tenth either way, and whether it changes."""
    moved = f"SELECT t.opt, t.score, p.dim AS moved, f.f, t.weight * CASE WHEN t.dim = p.dim THEN f.f ELSE 1e0 END AS w FROM {rel} t CROSS JOIN (SELECT DISTINCT dim FROM {rel} u) p CROSS JOIN (SELECT 9e-1 AS f UNION ALL SELECT 11e-1) f"
    rank = f"SELECT moved, f, opt, row_number() OVER (PARTITION BY moved, f ORDER BY round(sum(score * w) / sum(w), 9) DESC, opt) AS rn FROM ({moved}) m GROUP BY moved, f, opt"
    top = f"SELECT opt FROM (SELECT opt, row_number() OVER (ORDER BY round(total, 9) DESC, opt) AS rn FROM ({weighted(rel)}) w) x WHERE rn = 1"
    return f"SELECT r.moved, r.f AS factor, r.opt AS winner, r.opt <> b.opt AS changes FROM ({rank}) r CROSS JOIN ({top}) b WHERE r.rn = 1"


@op("est_pert", lambda d: "SELECT p_partkey AS id, 1e0 + p_size % 5 AS o, 3e0 + p_size % 9 AS m, 8e0 + p_size AS p FROM part")
def est_pert(d, rel):
    """Expected total with intervals of one to three deviations, floored at zero, and wide tasks."""
    s = f"SELECT sum((o + 4 * m + p) / 6) AS e, sqrt(sum(((p - o) / 6) * ((p - o) / 6))) AS sd, CAST(sum(CASE WHEN p - o > m * 2 THEN 1 ELSE 0 END) AS BIGINT) AS risky FROM {rel} t"
    return f"SELECT round(e, 4) AS expected, round(sd, 4) AS sd, " + ", ".join(f"round(greatest(e - {k} * sd, 0), 4) AS low_{n}, round(e + {k} * sd, 4) AS high_{n}" for n, k in (("68", "1e0"), ("90", "1645e-3"), ("95", "196e-2"), ("99", "2576e-3"))) + f", risky FROM ({s}) s"  # noqa: F541


# fixed values: days per size, and function-point weights
TSHIRT = {"XS": (0.25, 0.5, 1), "S": (0.5, 1, 2.5), "M": (2, 3.5, 7), "L": (5, 10, 20), "XL": (15, 25, 50), "XXL": (40, 70, 150)}
FPA = {"ILF": (7, 10, 15), "EIF": (5, 7, 10), "EI": (3, 4, 6), "EO": (4, 5, 7), "EQ": (3, 4, 6)}


@op("est_tshirt", lambda d: "SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'XS' WHEN 1 THEN 'S' WHEN 2 THEN 'M' WHEN 3 THEN 'L' WHEN 4 THEN 'XL' ELSE 'XXL' END AS size FROM part")
def est_tshirt(d, rel):
    dim = " UNION ALL ".join(f"SELECT '{k}' AS k, {o:e} AS o, {m:e} AS m, {p:e} AS p" for k, (o, m, p) in TSHIRT.items())
    return f"SELECT id, size, round((o + 4 * m + p) / 6, 6) AS days, round((o + 4 * m + p) / 6 * 115e-2, 6) AS with_15, round((o + 4 * m + p) / 6 * 13e-1, 6) AS with_30 FROM {rel} t JOIN ({dim}) s ON size = k"


@op("est_fpa", lambda d: "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'ILF' WHEN 1 THEN 'EIF' WHEN 2 THEN 'EI' WHEN 3 THEN 'EO' ELSE 'EQ' END AS kind, CASE p_partkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS complexity, p_size AS n FROM part")
def est_fpa(d, rel):
    dim = " UNION ALL ".join(f"SELECT '{k}' AS k, '{c}' AS c, {w} AS w" for k, ws in FPA.items() for c, w in zip(("low", "medium", "high"), ws))
    return f"SELECT kind, CAST(sum(w * n) AS BIGINT) AS points FROM {rel} t JOIN ({dim}) s ON kind = k AND complexity = c GROUP BY kind"


#: How much the edges may grow by while paths are doubled.
GROWTH = 4


def longest_paths(tasks: DataFrame) -> DataFrame:
    """(id, dep, duration) rows, one for each dependency, to (id, duration, level, start): one row a task.

    Max-plus path doubling.  An edge (u, d, w) says that u starts w after d at the
    earliest, and ``a`` holds what is known of a task's start already.  A round
    puts, in place of each edge to a task of few open edges, the edges of that
    task, so that edges come to span twice as many steps; edges to told tasks
    become part of ``a``.  Chains and trees need as many rounds as the logarithm of
    their depth; a task of many open edges is passed over while the edges would
    grow beyond GROWTH times their number.  Told tasks are appended and not
    written again.

    Tasks in a cycle or behind one are never told: once none is, all that are left
    are such.  A task without dependencies has one row with a null dep; unknown
    ones are ignored.
    """
    every = staged(tasks.groupBy("id").agg(F.max("duration").alias("duration")))
    known = every.select(F.col("id").alias("d"), F.col("duration").cast("double").alias("w"))
    edges = staged(tasks.where("dep IS NOT NULL").select(F.col("id").alias("u"), F.col("dep").alias("d")).distinct().join(known, "d").select("u", "d", "w", F.lit(1).cast("long").alias("steps")))
    n, nodes, told = every.count(), every.select("id", F.lit(0.0).alias("a"), F.lit(0).cast("long").alias("level")), []
    room, widths = GROWTH * (n + edges.count()), (1, 2, 4, 16, 256)
    while True:
        degree = edges.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))
        nodes = staged(nodes.join(degree, "id", "left").fillna(0, ["degree"]))
        told.append(nodes.where("degree = 0").select("id", "a", "level"))
        met = edges.join(nodes.withColumnRenamed("id", "d"), "d")
        # edges after this round, for each number of open edges up to which tasks are spanned
        after = met.agg(*[F.sum(F.when(F.col("degree") <= m, F.col("degree")).otherwise(1)).alias(f"m{m}") for m in widths], F.count(F.when(F.col("degree") == 0, 1)).alias("now")).first()
        if after["m1"] is None or not (after["now"] or told[-1].limit(1).count()):
            break
        most = max((m for m in widths if after[f"m{m}"] <= room), default=1)
        second = met.select(F.col("u").alias("d"), F.col("d").alias("e"), F.col("w").alias("w2"), F.col("steps").alias("steps2"), F.col("a").alias("a_e"), F.col("level").alias("level_e"), F.col("degree").alias("degree_e"))
        longer = met.where((F.col("degree") >= 1) & (F.col("degree") <= most)).join(second, "d").select("u", F.col("e").alias("d"), (F.col("w") + F.col("w2")).alias("w"), F.least(F.col("steps") + F.col("steps2"), F.lit(n)).alias("steps"), F.col("a_e").alias("a"), F.col("level_e").alias("level"), F.col("degree_e").alias("degree"))
        every_way = staged(met.select("u", "d", "w", "steps", "a", "level", "degree", (F.col("degree") > most).alias("on")).union(longer.withColumn("on", F.col("degree") > 0)))
        more = every_way.groupBy(F.col("u").alias("id")).agg(F.max(F.col("a") + F.col("w")).alias("a2"), F.max(F.col("level") + F.col("steps")).alias("level2"))
        edges = staged(every_way.where("on").groupBy("u", "d").agg(F.max("w").alias("w"), F.max("steps").alias("steps")))
        nodes = nodes.where("degree > 0").join(more, "id", "left").select("id", F.greatest("a", "a2").alias("a"), F.greatest("level", "level2").alias("level"))
    out = told[0]
    for t in told[1:]:
        out = out.union(t)
    return every.join(out, "id").select("id", "duration", F.col("level").cast("int").alias("level"), F.col("a").alias("start"))


def toposort(tasks: DataFrame, strict: bool = False) -> DataFrame:
    """Level and place of each task; tasks in a cycle are not listed, or an error where ``strict``."""
    told = longest_paths(tasks)
    if strict and told.count() != tasks.select("id").distinct().count():
        raise ValueError("the tasks depend on each other in a cycle")
    # places from the sizes of the levels before, so that no window holds all tasks
    sizes = told.groupBy("level").agg(F.count("*").alias("n"))
    before = sizes.select("level", (F.sum("n").over(Window.orderBy("level")) - F.col("n")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("level").orderBy("id"))
    return told.join(F.broadcast(before), "level").select("id", F.col("level").cast("long").alias("level"), place.cast("long").alias("place"))


def critical_path(tasks: DataFrame) -> DataFrame:
    """Earliest and latest start and end, slack, and whether there is none, of each task outside cycles.

    Starts from the front and from the back are one set of paths, told apart by a side.
    """
    lengths = tasks.groupBy("id").agg(F.max("duration").alias("duration"))
    back = tasks.where("dep IS NOT NULL").select(F.col("dep").alias("id"), F.col("id").alias("dep"))
    sides = [tasks.select("id", "dep", "duration"), lengths.join(back, "id", "left").select("id", "dep", "duration")]

    def marked(k: int, rows: DataFrame) -> DataFrame:
        return rows.select(F.struct(F.lit(k).alias("side"), "id").alias("id"), F.when(F.col("dep").isNotNull(), F.struct(F.lit(k).alias("side"), F.col("dep").alias("id"))).alias("dep"), "duration")

    paths = longest_paths(marked(0, sides[0]).union(marked(1, sides[1])))
    there = paths.where("id.side = 0").select("id.id", "duration", "start")
    tail = paths.where("id.side = 1").select("id.id", F.col("start").alias("tail"))
    whole = there.agg(F.max(F.col("start") + F.col("duration")).alias("whole"))
    rows = there.join(tail, "id").crossJoin(F.broadcast(whole))
    rows = rows.select("id", F.col("start").alias("es"), (F.col("start") + F.col("duration")).alias("ef"), (F.col("whole") - F.col("tail") - F.col("duration")).alias("ls"), (F.col("whole") - F.col("tail")).alias("lf"))
    return rows.withColumn("slack", F.col("ls") - F.col("es")).withColumn("critical", F.abs("slack") < 1e-9)


def _walked(body: str) -> str:
    """The oracle's recursive walk over the task tree."""
    rel = f"({fx.tasks(DUCK)})"
    return f"""WITH RECURSIVE lv AS (SELECT id, 0 AS level, duration, 0e0 AS es FROM {rel} t WHERE dep IS NULL UNION ALL SELECT t.id, lv.level + 1, t.duration, lv.es + lv.duration FROM lv JOIN {rel} t ON t.dep = lv.id),
      up AS (SELECT id AS start, dep, 0e0 AS tail, duration FROM {rel} a UNION ALL SELECT e.id, e.dep, up.tail + up.duration, e.duration FROM up JOIN {rel} e ON up.dep = e.id), longest AS (SELECT start AS id, max(tail) AS tail FROM up GROUP BY start), total AS (SELECT max(es + duration) AS w FROM lv) {body}"""


R.query("graph_toposort", _walked("SELECT id, CAST(level AS BIGINT) AS level, CAST(row_number() OVER (ORDER BY level, id) AS BIGINT) AS place FROM lv"), toposort)(lambda spark, sf_dir: toposort(on_tables(spark, sf_dir, fx.tasks(SPARK))))
R.query(
    "graph_critical_path",
    _walked("SELECT l.id, es, es + duration AS ef, w - tail - duration AS ls, w - tail AS lf, w - tail - duration - es AS slack, abs(w - tail - duration - es) < 1e-9 AS critical FROM lv l JOIN longest g ON l.id = g.id CROSS JOIN total"),
    critical_path,
)(lambda spark, sf_dir: critical_path(on_tables(spark, sf_dir, fx.tasks(SPARK))))


def _grid(d) -> str:
    return "SELECT CAST(floor((p_partkey - 1) / 100e0) AS INT) AS r, CAST((p_partkey - 1) % 100 AS INT) AS c, CAST(p_size AS DOUBLE) AS z FROM part"


@op("geo_shadow_grid", _grid, dr=-1, dc=1, rise=4.0)
def geo_shadow_grid(d, rel, dr, dc, rise):
    """Cells (r, c, z) shaded by a higher one along the ray to the sun, which goes on to the edge of the grid; cells without a height are shaded and shade none.

    Cells of one ray line share the cross product with its direction and a rest;
    along it each cell needs only the highest of z - t rise of the cells further
    on, t the steps: one running maximum a line.
    """
    if d.spark:
        x, step = ("r", dr) if dr else ("c", dc)
        t = f"CAST(({x} - pmod({x}, {abs(step)})) / ({step}) AS BIGINT)"
        line = f"SELECT r, c, z, r * {dc} - c * {dr} AS across, pmod({x}, {abs(step)}) AS rest, {t} AS t FROM {rel} g"
        high = f"SELECT r, c, z, z - t * {rise:e} AS h, max(z - t * {rise:e}) OVER (PARTITION BY across, rest ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS beyond FROM ({line}) l"
        return f"SELECT r, c, coalesce(beyond > h, z IS NULL) AS shaded FROM ({high}) h"
    room = [f"floor(({'mr - r' if dr > 0 else 'r'}) / {abs(dr)}e0)"] if dr else []
    room += [f"floor(({'mc - c' if dc > 0 else 'c'}) / {abs(dc)}e0)"] if dc else []
    steps = f"least({', '.join(room)}, 2 * greatest(mr, mc) + 1)"
    ray = f"SELECT r, c, z, {d.unnest(d.seq('1', 'CAST(steps AS INT)'))} AS k FROM (SELECT r, c, z, {steps} AS steps FROM {rel} a CROSS JOIN (SELECT max(r) AS mr, max(c) AS mc FROM {rel} e) m) w WHERE steps >= 1 AND z IS NOT NULL"
    hit = f"SELECT DISTINCT p.r, p.c FROM ({ray}) p JOIN (SELECT r AS r2, c AS c2, z AS z2 FROM {rel} g) b ON b.r2 = p.r + {dr} * p.k AND b.c2 = p.c + {dc} * p.k WHERE b.z2 > p.z + p.k * {rise:e}"
    return f"SELECT t.r, t.c, (h.r IS NOT NULL OR t.z IS NULL) AS shaded FROM {rel} t LEFT JOIN ({hit}) h ON t.r = h.r AND t.c = h.c"
