"""Ranks and exact quantiles from counts of distinct values.

No task sees all values: on Spark the distinct values are dealt to CUTS ranges by
an approximate quantile sketch, ordered within each, and placed by the sums of the
ranges before.  The sketch decides only how even the ranges are.
"""

from __future__ import annotations

from .dialect import Dialect

CUTS = 200


def range_of(value: str) -> str:
    """How many of the ordered ``cuts`` are smaller, by halves: a look at all of them for each value took most of the time."""
    steps = ", ".join(str(1 << i) for i in reversed(range(CUTS.bit_length())))
    return f"aggregate(array({steps}), 0, (at, n) -> IF(at + n <= size(cuts) AND get(cuts, at + n - 1) < {value}, at + n, at))"


def placed(d: Dialect, rel: str, value: str, group: str | None = None, weight: str | None = None) -> str:
    """(g, v, k, below): each distinct value of a group, how often it is there, and how many rows are smaller; nulls are left out. Rows of counted values say by ``weight`` for how many they stand."""
    by = f"{group}, {value}" if group else value
    counted = f"SELECT {group or '0'} AS g, {value} AS v, {f'sum({weight})' if weight else 'count(*)'} AS k FROM {rel} t WHERE {value} IS NOT NULL GROUP BY {by}"
    if not d.spark:
        return f"SELECT g, v, k, CAST(sum(k) OVER (PARTITION BY g ORDER BY v) AS BIGINT) - k AS below FROM ({counted}) q"
    shares = ", ".join(f"{i / CUTS:g}" for i in range(1, CUTS))
    return f"""WITH q AS ({counted}), c AS (SELECT approx_percentile(v, array({shares})) AS cuts FROM q),
      b AS (SELECT g, v, k, {range_of('v')} AS b FROM q CROSS JOIN c),
      s AS (SELECT g, b, sum(n) OVER (PARTITION BY g ORDER BY b) - n AS before FROM (SELECT g, b, sum(k) AS n FROM b GROUP BY g, b) z)
      SELECT b.g, b.v, b.k, s.before + sum(b.k) OVER (PARTITION BY b.g, b.b ORDER BY b.v) - b.k AS below FROM b JOIN s ON b.g <=> s.g AND b.b = s.b"""


def tie_ranks(d: Dialect, rel: str, value: str) -> str:
    """(v, r, ties): the average rank of each distinct value and how often it is there."""
    return f"SELECT v, below + (k + 1) / 2e0 AS r, CAST(k AS DOUBLE) AS ties FROM ({placed(d, rel, value)}) p"


def quantiles(d: Dialect, rel: str, value: str, qs: tuple[float, ...], group: str | None = None, weight: str | None = None) -> str:
    """(g, q0, q1, ...): exact quantiles of each group, interpolated linearly at (n - 1) q."""
    x = f"CAST({value} AS DOUBLE)"
    if not d.spark:
        return f"SELECT {group or '0'} AS g, {', '.join(f'quantile_cont({x}, {q}) AS q{i}' for i, q in enumerate(qs))} FROM {rel} t" + (f" GROUP BY {group}" if group else "")
    at = [f"((n - 1) * {q}D)" for q in qs]
    pick = lambda f, a: f"max(CASE WHEN below <= {f}({a}) AND {f}({a}) < below + k THEN v END)"
    ends = ", ".join(f"{pick('floor', a)} AS a{i}, {pick('ceil', a)} AS b{i}" for i, a in enumerate(at))
    size = f"SELECT {group or '0'} AS h, {f'sum(CASE WHEN {value} IS NOT NULL THEN {weight} END)' if weight else f'count({value})'} AS n FROM {rel} t" + (f" GROUP BY {group}" if group else "")
    told = f"SELECT h AS g, n, {ends} FROM ({size}) z LEFT JOIN ({placed(d, rel, x, group, weight)}) p ON p.g <=> z.h GROUP BY h, n"
    return f"SELECT g, {', '.join(f'a{i} + (b{i} - a{i}) * ({a} - floor({a})) AS q{i}' for i, a in enumerate(at))} FROM ({told}) w"
