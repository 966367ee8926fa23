"""Paths, rays and imports against plain loops."""

import random

import pytest

from millrace.operators import planning, relational
from millrace.session import staged

TASKS = "id long, dep long, duration double"


def loop(rows):
    """{id: (level, start)} by waves."""
    duration, deps = {}, {}
    for i, dep, d in rows:
        duration[i] = max(d, duration.get(i, d))
        deps.setdefault(i, set()).update(set() if dep is None else {dep})
    deps = {i: {x for x in s if x in duration} for i, s in deps.items()}
    told = {}
    while True:
        new = {i: (max([told[x][0] + 1 for x in s], default=0), max([told[x][1] + duration[x] for x in s], default=0.0)) for i, s in deps.items() if i not in told and s <= told.keys()}
        if not new:
            return told
        told |= new


def told(df):
    return {r["id"]: (r["level"], r["start"]) for r in df.collect()}


def graph(kind):
    rng = random.Random(7)
    if kind == "tree":
        return [(i, i // 2 or None, 1.0 + i % 5) for i in range(1, 200)]
    if kind == "ladder":
        return [(10 * k + i, 10 * (k - 1) + j if k else None, 1.0 + (k * i) % 4) for k in range(6) for i in range(3) for j in range(3 if k else 1)]
    rows = [(i, rng.randrange(1, i) if i > 1 else None, float(rng.randint(1, 9))) for i in range(1, 60) for _ in range(rng.randint(1, 3))]
    if kind == "cycles":
        rows += [(300, 301, 1.0), (301, 302, 1.0), (302, 300, 1.0), (303, 302, 1.0), (303, 5, 2.0), (304, 303, 1.0), (305, 305, 1.0), (306, 999, 4.0), (307, 306, 1.0), (306, 7, 4.0)]
        rows += [(400 + i, 400 + j, 1.0) for i in range(4) for j in range(4) if i != j]
    return rows


@pytest.mark.parametrize("kind, growth", [("tree", 0), ("ladder", 0), ("ladder", 4), ("random", 4), ("cycles", 4)])
def test_longest_paths_equal_a_loop(spark, monkeypatch, kind, growth):
    monkeypatch.setattr(planning, "GROWTH", growth)
    rows = graph(kind)
    assert told(planning.longest_paths(spark.createDataFrame(rows, TASKS))) == loop(rows)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(planning, "staged", lambda df: (calls.append(1), staged(df))[1])
    rows = [(i, i - 1 or None, 1.0) for i in range(1, 5001)]
    got = told(planning.longest_paths(spark.createDataFrame(rows, TASKS)))
    assert got == {i: (i - 1, i - 1.0) for i in range(1, 5001)}
    assert len(calls) <= 2 + 3 * 15


@pytest.mark.parametrize("dr, dc, rise", [(-1, 1, 4.0), (1, 0, 2.0), (0, -2, 3.0), (2, -3, 0.5), (-2, -2, 1.0), (0, 1, 0.0)])
def test_shadows_equal_a_walk(spark, dr, dc, rise):
    rng = random.Random(1)
    cells = {(r, c): None if rng.random() < 0.1 else float(rng.randint(0, 30)) for r in range(-4, 9) for c in range(-3, 11) if rng.random() < 0.95}
    want = {}
    for (r, c), z in cells.items():
        high = [cells[r + k * dr, c + k * dc] for k in range(1, 40) if cells.get((r + k * dr, c + k * dc)) is not None and z is not None and cells[r + k * dr, c + k * dc] > z + k * rise]
        want[r, c] = z is None or bool(high)
    df = spark.createDataFrame([(r, c, z) for (r, c), z in cells.items()], "r int, c int, z double")
    assert {(x["r"], x["c"]): x["shaded"] for x in planning.geo_shadow_grid.apply(df, dr=dr, dc=dc, rise=rise).collect()} == want


def test_imports_of_any_depth(spark):
    deep = ".".join(f"d{k}" for k in range(15))
    modules = spark.createDataFrame([("a.py", deep), ("b.py", "d14"), ("c.py", "pkg.util"), ("d.py", "util"), ("e.py", "solo")], "file string, module string")
    wanted = [("b.py", "x.y.z." + deep), ("a.py", "other.d14"), ("d.py", "src/pkg/util"), ("c.py", "src\\pkg\\util"), ("c.py", "util"), ("d.py", "very." * 20 + "util"), ("e.py", "nothing.here"), ("e.py", None), ("e.py", "solo"), ("e.py", "solo")]
    imports = spark.createDataFrame(wanted, "file string, wanted string")
    got = {(r["file"], r["wanted"]): r["target"] for r in relational.join_import_resolution.apply(modules, imports=imports).collect()}
    # the longest suffix decides: a file's import of itself is no edge, whatever shorter suffixes are
    assert got == {("b.py", "x.y.z." + deep): "a.py", ("a.py", "other.d14"): "b.py", ("d.py", "src.pkg.util"): "c.py", ("c.py", "util"): "d.py"}


def test_missing_dependencies_of_a_sound_table(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 9)], "id long, dep long")
    assert [tuple(r) for r in relational.join_semi_fk.apply(df).collect()] == [(3, 9)]
    assert relational.join_semi_fk.apply(df.where("id < 3")).count() == 0
