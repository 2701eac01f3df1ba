"""Least squares in SQL, for the twins of the model queries.

A twin brings rows with key columns and a list ``x`` of inputs with the target
last. The sums of products per key are reduced to coefficients by elimination,
one recursion step per input.
"""

from __future__ import annotations


def cells(rows: str, keys: str, name: str) -> str:
    """Sums of products of all input pairs per key."""
    return f"""
    {name}_c AS (SELECT {keys}, i, j, sum(x[i] * x[j]) AS g, count(*) AS n, any_value(len(x)) - 1 AS d
      FROM {rows} CROSS JOIN LATERAL (SELECT unnest(generate_series(1, len(x))) AS i)
                  CROSS JOIN LATERAL (SELECT unnest(generate_series(1, len(x))) AS j) GROUP BY {keys}, i, j)"""


def solution(keys: str, name: str, penalty: str = "0") -> str:
    """Coefficient lists ``b`` from cells; ``penalty`` is added to diagonal cell ``i``."""
    return f"""
    {name}_r AS (SELECT {keys}, i, any_value(d) AS d, list(g + CASE WHEN i = j THEN {penalty} ELSE 0 END ORDER BY j) AS line
      FROM {name}_c WHERE i <= d GROUP BY {keys}, i),
    {name}_m AS (SELECT {keys}, any_value(d) AS d, list(line ORDER BY i) AS m FROM {name}_r GROUP BY {keys}),
    {name}_s AS (SELECT {keys}, d, 1 AS k, m FROM {name}_m UNION ALL
      SELECT {keys}, d, k + 1, [[CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END
                                 for j in generate_series(1, d + 1)] for i in generate_series(1, d)] FROM {name}_s WHERE k <= d),
    {name} AS (SELECT {keys}, d, [m[i][d + 1] for i in generate_series(1, d)] AS b FROM {name}_s WHERE k = d + 1)"""


def rss(keys: str, name: str) -> str:
    """Residual sum of squares of an unpenalised fit, with its rows ``n`` and coefficients ``d``."""
    using = f"USING ({keys})"
    return f"""
    {name}_e AS (SELECT {keys}, any_value({name}.d) AS d, any_value(n) AS n,
        sum(CASE WHEN i = {name}.d + 1 THEN g ELSE -b[i] * g END) AS rss
      FROM {name}_c JOIN {name} {using} WHERE j = {name}.d + 1 GROUP BY {keys})"""


def least_squares(rows: str, keys: str, name: str, penalty: str = "0") -> str:
    return cells(rows, keys, name) + "," + solution(keys, name, penalty)


def lags(column: str, count: int, first: int = 1) -> str:
    return ", ".join(f"lag({column}, {i}) OVER w" for i in range(first, first + count))


def inner(betas: str, inputs: str) -> str:
    """Inner product of two lists."""
    return f"list_sum([{betas}[i] * {inputs}[i] for i in generate_series(1, len({betas}))])"


def shrunk(rows: str, key: str, name: str, weight: str, settings: str = "", setting_names: str = "") -> str:
    """Coefficients under normal priors with ``weight`` for input ``i``; the noise comes from a nearly free fit.

    ``settings`` is a relation with the columns ``setting_names``; each of its rows gives one solution.
    """
    free, h = f"{name}f", inner("b", "x")
    every = f" CROSS JOIN {settings}" if settings else ""
    return (
        least_squares(rows, key, free, "1e-6")
        + f""",
    {name}_v AS (SELECT {key}, greatest(sum((y - h) * (y - h)) / greatest(count(*) - any_value(d), 1), 1e-12) AS v
      FROM (SELECT {key}, d, x[len(x)] AS y, {h} AS h FROM {rows} JOIN {free} USING ({key})) GROUP BY {key}),
    {name}_c AS (SELECT * FROM {free}_c JOIN {name}_v USING ({key}){every}),"""
        + solution(f"{key}, {setting_names}" if settings else key, name, f"v * ({weight})")
    )
