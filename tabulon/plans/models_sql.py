"""DuckDB SQL for estimates: least squares, likelihoods, and their inference.

A design row is a list ``x``; products are summed by pairs of its places, and their
matrix is inverted by sweeping one pivot a step of a recursive table.  This is a
second way to the numbers, beside the code that the queries run.
"""

from __future__ import annotations

SWEEP = (
    "list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: "
    "CASE WHEN i = k AND j = k THEN 1 / m[k][k] WHEN i = k THEN m[k][j] / m[k][k] WHEN j = k THEN -m[i][k] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END))"
)
#: the normal quantile of 0.975, fixed value
Z = 1.959963984540054


def matrix(source: str, k: int, value: str) -> str:
    """Rows to one row ``m``: the k x k matrix of sums of ``value``, in i and j."""
    cells = f"SELECT i, j, fsum({value}) AS v FROM {source}, range(1, {k + 1}) a(i), range(1, {k + 1}) b(j) GROUP BY i, j"
    return f"SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM ({cells}) GROUP BY i)"


def vector(source: str, k: int, value: str) -> str:
    """Rows to one row ``v``: the sums of ``value``, in i."""
    return f"SELECT list(v ORDER BY i) AS v FROM (SELECT i, fsum({value}) AS v FROM {source}, range(1, {k + 1}) a(i) GROUP BY i)"


def least_squares(p: str, rows: str, k: int) -> str:
    """Tables ``<p>b`` (b, inv) and ``<p>e`` (the rows with residual e) for rows of (y, x, ...)."""
    return f"""{p}d AS MATERIALIZED ({rows}), {p}xx AS MATERIALIZED ({matrix(f'{p}d', k, 'x[i] * x[j]')}), {p}xy AS MATERIALIZED ({vector(f'{p}d', k, 'x[i] * y')}),
{p}s(k, m) AS (SELECT 1, m FROM {p}xx UNION ALL SELECT k + 1, {SWEEP} FROM {p}s WHERE k <= {k}),
{p}b AS MATERIALIZED (SELECT m AS inv, list_transform(m, lambda r: list_dot_product(r, v)) AS b FROM {p}s, {p}xy WHERE k = {k + 1}),
{p}e AS MATERIALIZED (SELECT {p}d.*, y - list_dot_product(x, b) AS e FROM {p}d, {p}b)"""


def covariance(p: str, k: int, vcov: str = "classical", df_used: str = "0") -> str:
    """Table ``<p>v`` (v, df); ``vcov`` is classical, hc1 or cluster, by the rows' cl."""
    resid = f"(count(*) - {k} - {df_used})"
    if vcov == "classical":
        return f"{p}v AS MATERIALIZED (SELECT list_transform(inv, lambda r: list_transform(r, lambda z: z * s2)) AS v, df FROM {p}b, (SELECT fsum(e * e) / {resid} AS s2, CAST({resid} AS DOUBLE) AS df FROM {p}e))"
    if vcov == "hc1":
        meat, scale = matrix(f"{p}e", k, "e * e * x[i] * x[j]"), f"SELECT count(*) * 1.0 / {resid} AS f FROM {p}e"
    else:
        sums = f"(SELECT cl, list(u ORDER BY i) AS u FROM (SELECT cl, i, fsum(e * x[i]) AS u FROM {p}e, range(1, {k + 1}) a(i) GROUP BY cl, i) GROUP BY cl)"
        meat = matrix(sums, k, "u[i] * u[j]")
        scale = f"SELECT count(DISTINCT cl) * 1.0 / (count(DISTINCT cl) - 1) * (count(*) - 1) / {resid} AS f FROM {p}e"
    return f"""{p}m AS MATERIALIZED ({meat}),
{p}v AS MATERIALIZED (SELECT list_transform(inv, lambda a: list_transform(inv, lambda b: f * list_dot_product(a, list_transform(m, lambda r: list_dot_product(r, b))))) AS v, CAST(NULL AS DOUBLE) AS df FROM {p}b, {p}m, ({scale}))"""


def effects(p: str, targets: dict[str, list[float]]) -> str:
    """(name, b, se, df) of linear combinations of the coefficients."""
    values = ", ".join(f"('{n}', {[float(a) for a in c]}::DOUBLE[])" for n, c in targets.items())
    return f"SELECT name, list_dot_product(c, b) AS b, sqrt(list_dot_product(c, list_transform(v, lambda r: list_dot_product(r, c)))) AS se, df FROM {p}b, {p}v, (VALUES {values}) t(name, c)"


def units(*names: str) -> dict[str, list[float]]:
    return {n: [float(i == j) for j in range(len(names))] for i, n in enumerate(names)}


def inference(rel: str, digits: int, exponentiate: bool = False, key: str = "name", more: str = "") -> str:
    """(key, b, se, stat, p, low, high, more) of rows of (name, b, se, df, more): normal where df
    is null, else Student's t; tails by Simpson's rule, quantiles by expansion in 1/df."""
    steps = 4000
    density = "CASE WHEN df IS NULL THEN exp(-u * u / 2) / sqrt(2 * pi()) ELSE exp(lgamma((df + 1) / 2) - lgamma(df / 2) - (df + 1) / 2 * ln(1 + u * u / df)) / sqrt(df * pi()) END"
    z = Z
    q = f"({z} + CASE WHEN df IS NULL THEN 0 ELSE {(z**3 + z) / 4} / df + {(5 * z**5 + 16 * z**3 + 3 * z) / 96} / df ** 2 + {(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384} / df ** 3 + {(79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160} / df ** 4 END)"
    e = (lambda x: f"exp({x})") if exponentiate else (lambda x: x)
    se = "se * exp(b)" if exponentiate else "se"
    inner = f"SELECT name, b, se, df{more}, h, fsum(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density}) AS mass FROM (SELECT *, i * h AS u FROM (SELECT *, least(abs(b / se), 40) / {steps} AS h FROM ({rel})), range({steps + 1}) g(i)) GROUP BY ALL"
    return f"SELECT name AS {key}, round({e('b')}, {digits}) AS b, round({se}, {digits}) AS se, round(b / se, {digits}) AS stat, round(greatest(1 - 2 * mass * h / 3, 0), {digits}) AS p, round({e(f'b - {q} * se')}, {digits}) AS low, round({e(f'b + {q} * se')}, {digits}) AS high{more} FROM ({inner})"


def regression(rows: str, names: list[str], digits: int, vcov: str = "classical", df_used: str = "0", before: str = "", targets: dict[str, list[float]] | None = None) -> str:
    """The table of coefficients of rows of (y, x, cl); ``before`` are tables that the rows use."""
    k = len(names)
    made = f"{least_squares('o', rows, k)}, {covariance('o', k, vcov, df_used)}"
    return f"WITH RECURSIVE {before}{made} {inference(effects('o', {**units(*names), **(targets or {})}), digits)}"


def cdf(x: str, terms: int = 40) -> str:
    """The normal distribution function, by its series around zero."""
    inner = "1.0"
    for n in range(terms, 0, -1):
        inner = f"(1 + ({x}) * ({x}) / {2 * n + 1} * {inner})"
    return f"(0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * ({x}) * {inner})"


PDF = "exp(-({0}) * ({0}) / 2) / sqrt(2 * pi())"


def likelihood(rows: str, k: int, start: str, scored: str, g: str, h: str, rounds: int = 8) -> str:
    """Tables ``ob`` (b, inv) and ``ov`` (v, df) after Newton steps from the list ``start``.

    ``scored`` selects from ``r``, the rows of (y, x, w, o) with the list b, what the
    gradient ``g`` (in i) and the information ``h`` (in i and j) of a row need.
    """
    parts = [f"d AS MATERIALIZED ({rows})", f"t0 AS MATERIALIZED (SELECT {start} AS b FROM d LIMIT 1)"]
    for n in range(1, rounds + 1):
        parts += [
            f"q{n} AS MATERIALIZED ({scored.replace('{r}', f'(SELECT * FROM d, t{n - 1})')})",
            f"h{n} AS MATERIALIZED ({matrix(f'q{n}', k, h)})",
            f"g{n} AS MATERIALIZED ({vector(f'q{n}', k, g)})",
            f"s{n}(k, m) AS (SELECT 1, m FROM h{n} UNION ALL SELECT k + 1, {SWEEP} FROM s{n} WHERE k <= {k})",
            f"t{n} AS MATERIALIZED (SELECT list_transform(range(1, {k + 1}), lambda i: b[i] + list_dot_product(m[i], v)) AS b, m AS inv FROM s{n}, g{n}, (SELECT b FROM t{n - 1}) WHERE k = {k + 1})",
        ]
    parts += [f"ob AS (SELECT b FROM t{rounds})", f"ov AS (SELECT inv AS v, CAST(NULL AS DOUBLE) AS df FROM t{rounds})"]
    return "WITH RECURSIVE " + ",\n".join(parts)


def simpson(density: str, upper: str, steps: int = 4000) -> str:
    """The integral of ``density``, in u, from 0 to ``upper``."""
    return f"(SELECT fsum(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({density})) * any_value(h) / 3 FROM (SELECT i, i * h AS u, h FROM (SELECT ({upper}) / {steps} AS h), range({steps + 1}) g(i)))"
