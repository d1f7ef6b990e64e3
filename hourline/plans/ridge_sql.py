"""SQL text for checking least-squares models: normal equations solved by Gauss-Jordan steps."""

from __future__ import annotations

from math import pi

from hourline.functions.dates import HOLIDAY_NAMES
from hourline.operators.decompose import Additive


def solve_sql(name: str, gram: str, keys: str, p: int) -> str:
    """CTEs ``<name>_m``, ``<name>_gj`` and ``<name>`` (keys, coef) from cells (keys, i, j, v).

    Cells are rows i = 1..p and columns j = 1..p + 1 of [X'X + penalty | X'y].
    """
    return f"""{name}_rows AS (SELECT {keys}, i, list(v ORDER BY j) AS r FROM {gram} WHERE i <= {p} GROUP BY {keys}, i),
    {name}_m AS (SELECT {keys}, list(r ORDER BY i) AS m FROM {name}_rows GROUP BY {keys}),
    {name}_gj AS (
      SELECT {keys}, 0 AS done, m FROM {name}_m
      UNION ALL
      SELECT {keys}, done + 1,
        list_transform(range(1, {p + 1}), lambda i: CASE WHEN i = done + 1 THEN piv ELSE
          list_transform(range(1, {p + 2}), lambda j: m[i][j] - m[i][done + 1] * piv[j]) END)
      FROM (SELECT *, list_transform(m[done + 1], lambda v: v / m[done + 1][done + 1]) AS piv FROM {name}_gj WHERE done < {p})),
    {name} AS (
      SELECT {keys}, list_transform(range(1, {p + 1}), lambda i: m[i][{p + 1}]) AS coef FROM {name}_gj WHERE done = {p})"""


def gram_sql(name: str, rows: str, keys: str, p: int) -> str:
    """Cells (keys, i, j, v) of [X y]'[X y] from rows with lists ``xy`` of p + 1 numbers."""
    return f"""{name} AS (
      SELECT {keys}, i, j, sum(xy[i] * xy[j]) AS v
      FROM {rows}, (SELECT unnest(range(1, {p + 2})) AS i) ii, (SELECT unnest(range(1, {p + 2})) AS j) jj
      GROUP BY {keys}, i, j)"""


def penalty_sql(penalty) -> str:
    cells = ", ".join(f"({i + 1}, {v!r}::DOUBLE)" for i, v in enumerate(penalty))
    return f"penalty AS (SELECT * FROM (VALUES {cells}) AS t(i, w))"


def design_sql(model: Additive, ts="ts") -> str:
    """List expression of the additive design row; needs columns f and l (history range) and holiday."""
    t = f"(epoch({ts}) - epoch(f)) / (epoch(l) - epoch(f))"
    days = f"(epoch({ts}) / 86400.0::DOUBLE)"
    terms = ["1.0::DOUBLE", t]
    for j in range(1, model.changepoints + 1):
        terms.append(f"greatest({t} - {model.changepoint_range * j / model.changepoints!r}::DOUBLE, 0)")
    for period, order in model.seasons.values():
        for k in range(1, order + 1):
            terms += [f"{f}({2 * pi * k / period!r}::DOUBLE * {days})" for f in ("cos", "sin")]
    if model.holidays:
        names = [n.replace("'", "''") for n in HOLIDAY_NAMES]
        terms += [f"coalesce(holiday = '{n}', false)::INT::DOUBLE" for n in names]
    return "[" + ", ".join(terms) + "]"


NAMED_DAYS_SQL = """named_days AS (
  SELECT ds, min(replace(holiday, ' (Observed)', '')) AS holiday FROM holidays GROUP BY 1)"""


def dot_sql(x: str, coef: str, start: int, width: int) -> str:
    return f"list_sum(list_transform(range({start}, {start + width}), lambda q: {x}[q] * {coef}[q]))"
