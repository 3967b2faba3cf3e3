"""DuckDB SQL of the ridge regression that ``operators.linear`` defines, solved by elimination."""

from __future__ import annotations

from panelcraft.plans.q_stats import dbl


def ridge_ctes(rows: str, features: list[str], alpha: float) -> str:
    """CTEs up to ``fitted(fold, mean, sd, b, w)``: the model of all rows of other folds (lists by feature).

    ``rows``: a query of ``key, fold, y`` and whole-number features without nulls; a fold of NULL means no folds.
    """
    x = [*features, "y"]
    p = len(features)
    sums = ", ".join(f"SUM(CAST(x.{c} AS HUGEINT)) AS s{i}" for i, c in enumerate(x))
    products = ", ".join(f"SUM(CAST(x.{x[i]} AS HUGEINT) * x.{x[j]}) AS q{i}_{j}" for i in range(p + 1) for j in range(i, p + 1))
    centred = ", ".join(f"{dbl(f'(n * q{i}_{j} - s{i} * s{j})')} AS c{i}_{j}" for i in range(p + 1) for j in range(i, p + 1))
    c = lambda i, j: f"c{min(i, j)}_{max(i, j)}"
    n = "CAST(n AS DOUBLE)"
    cell = lambda i, j: f"{c(i, j)} / (sqrt({c(i, i)}) * sqrt({c(j, j)})) * (({n} - 1) / {n}){f' + {alpha!r}::DOUBLE' if i == j else ''}"
    sd = lambda i: f"(sqrt({c(i, i)}) / sqrt({n} * ({n} - 1)))"
    matrix = ", ".join(f"[{', '.join(cell(i, j) for j in range(p))}, {c(i, p)} / ({n} * {n}) / {sd(i)}]" for i in range(p))
    return f"""
data AS MATERIALIZED ({rows}),
parts AS (SELECT DISTINCT fold FROM data),
summed AS (SELECT f.fold, COUNT(*) AS n, {sums}, {products} FROM parts f JOIN data x ON f.fold IS NULL OR x.fold <> f.fold GROUP BY f.fold),
about AS (SELECT fold, n, {", ".join(f"s{i}" for i in range(p + 1))}, {centred} FROM summed),
steps(fold, k, m) AS (
  SELECT fold, 0, [{matrix}] FROM about
  UNION ALL
  SELECT fold, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda v: v / row[k + 1])
    ELSE list_transform(row, lambda v, j: v - row[k + 1] * (m[k + 1][j] / m[k + 1][k + 1])) END)
  FROM steps WHERE k < {p}
),
fitted AS (SELECT a.fold, [{", ".join(f"{dbl(f's{i}')} / {n}" for i in range(p))}] AS mean, [{", ".join(sd(i) for i in range(p))}] AS sd,
                  {dbl(f"s{p}")} / {n} AS b, list_transform(m, lambda row: row[{p + 1}]) AS w
           FROM about a JOIN steps t ON a.fold IS NOT DISTINCT FROM t.fold WHERE k = {p})"""


def ridge_prediction(features: list[str], row: str = "d", model: str = "t") -> str:
    terms = (f"({row}.{c} - {model}.mean[{i + 1}]) / {model}.sd[{i + 1}] * {model}.w[{i + 1}]" for i, c in enumerate(features))
    return f"({model}.b + {' + '.join(terms)})"
