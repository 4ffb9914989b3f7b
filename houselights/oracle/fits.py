"""Model fits as plain SQL: least squares by elimination, polynomials by recurrence, smoothing by recursion."""

from __future__ import annotations

import functools
import math

import numpy as np

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(120)


def least_squares(source: str, predictors: list[str], name: str, errors: bool = False) -> list[str]:
    """Expressions ending in `<name>_beta` (one row: b0 intercept, b1.. in order) for column y of `source`.

    Predictors are standardised; the normal equations are solved by elimination, one recursion step per predictor, beside
    the unit matrix. With `errors` the row also has the standard errors e0, e1... Needs WITH RECURSIVE.
    """
    p = len(predictors)
    ks, width = range(1, p + 1), 2 * p + 1 if errors else p + 1
    columns = ", ".join(f"CAST({x} AS DOUBLE)" for x in predictors)
    means, deviations = (", ".join(f"{f}(x[{k}])" for k in ks) for f in ("avg", "stddev_pop"))
    unit = {i: [f"CAST({int(i == j)} AS DOUBLE)" for j in ks] if errors else [] for i in ks}
    rows = ", ".join("[" + ", ".join([f"sum(z[{i}] * z[{j}])" for j in ks] + [f"sum(z[{i}] * y)"] + unit[i]) + "]" for i in ks)
    betas = ", ".join(f"a[{k}][{p + 1}] / s[{k}] AS b{k}" for k in ks)
    intercept = "my - (" + " + ".join(f"a[{k}][{p + 1}] / s[{k}] * m[{k}]" for k in ks) + ")"
    out = [
        f"{name}_x AS MATERIALIZED (SELECT CAST(y AS DOUBLE) AS y, [{columns}] AS x FROM {source})",
        f"{name}_m AS MATERIALIZED (SELECT count(*) AS n, avg(y) AS my, [{means}] AS m, [{deviations}] AS s FROM {name}_x)",
        f"{name}_z AS MATERIALIZED (SELECT y - my AS y, list_transform(range(1, {p + 1}), lambda k: (x[k] - m[k]) / s[k]) AS z "
        f"FROM {name}_x, {name}_m)",
        f"{name}_a AS MATERIALIZED (SELECT [{rows}] AS a FROM {name}_z)",
        _elimination(name, p, width)]
    spread = ""
    if errors:
        out.append(f"{name}_r AS MATERIALIZED (SELECT sum(pow(y - list_sum(list_transform(range(1, {p + 1}), lambda k: "
                   f"z[k] * a[k][{p + 1}])), 2)) / (count(*) - {p + 1}) AS v FROM {name}_z, {name}_e WHERE k = {p})")
        centre = " + ".join(f"a[{i}][{p + 1 + j}] * m[{i}] / s[{i}] * m[{j}] / s[{j}]" for i in ks for j in ks)
        spread = f", sqrt(v * (1.0 / n + {centre})) AS e0, " + ", ".join(
            f"sqrt(v * a[{k}][{p + 1 + k}]) / s[{k}] AS e{k}" for k in ks)
    return [*out, f"{name}_beta AS MATERIALIZED (SELECT {intercept} AS b0, {betas}{spread} FROM {name}_e, {name}_m"
                  + (f", {name}_r" if errors else "") + f" WHERE k = {p})"]


def _elimination(name: str, p: int, width: int) -> str:
    return f"""{name}_e(k, a) AS (
  SELECT 0, a FROM {name}_a
  UNION ALL
  SELECT k + 1, list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {width + 1}), lambda j:
           CASE WHEN i = k + 1 THEN a[i][j] / a[i][i] ELSE a[i][j] - a[i][k + 1] * a[k + 1][j] / a[k + 1][k + 1] END))
  FROM {name}_e WHERE k < {p})"""


def logistic(source: str, predictors: list[str], name: str, steps: int = 9) -> list[str]:
    """Expressions ending in `<name>_beta` (one row: list b, intercept first) for the 0/1 column y of `source`: a fixed
    number of Newton steps from zero, each solved by elimination. Needs WITH RECURSIVE."""
    p = len(predictors) + 1
    columns = ", ".join(["CAST(1 AS DOUBLE)", *(f"CAST({x} AS DOUBLE)" for x in predictors)])
    out = [f"{name}_x AS MATERIALIZED (SELECT CAST(y AS DOUBLE) AS y, [{columns}] AS x FROM {source})",
           f"{name}0_beta AS MATERIALIZED (SELECT list_transform(range({p}), lambda k: CAST(0 AS DOUBLE)) AS b)"]
    for t in range(1, steps + 1):
        now, before = f"{name}{t}", f"{name}{t - 1}"
        rows = ", ".join("[" + ", ".join([f"sum(w * x[{i}] * x[{j}])" for j in range(1, p + 1)]
                                         + [f"sum((y - m) * x[{i}])"]) + "]" for i in range(1, p + 1))
        out += [
            f"{now}_p AS MATERIALIZED (SELECT y, x, m, m * (1 - m) AS w FROM (SELECT y, x, 1 / (1 + exp(-list_dot_product(x, b))) "
            f"AS m FROM {name}_x, {before}_beta))",
            f"{now}_a AS MATERIALIZED (SELECT [{rows}] AS a FROM {now}_p)",
            _elimination(now, p, p + 1),
            f"{now}_beta AS MATERIALIZED (SELECT list_transform(range(1, {p + 1}), lambda i: b[i] + a[i][{p + 1}]) AS b "
            f"FROM {now}_e, {before}_beta WHERE k = {p})"]
    return [*out, f"{name}_beta AS (SELECT b FROM {name}{steps}_beta)"]


def fitted(predictors: list[str]) -> str:
    return "b0" + "".join(f" + b{k} * CAST({x} AS DOUBLE)" for k, x in enumerate(predictors, 1))


@functools.cache
def student_point(freedom: int, share: float = 0.95) -> float:
    """Two-sided point of Student's t by bisecting a Gauss-Legendre sum over its density."""
    scale = math.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(math.pi)
    # The substitution t = sqrt(freedom) * tan(a) makes the density scale * cos(a)**(freedom - 1).
    low, high = 0.0, math.pi / 2
    for _ in range(60):
        middle = (low + high) / 2
        inside = scale * middle * (_WEIGHTS @ np.cos(middle * (_NODES + 1) / 2) ** (freedom - 1))
        low, high = (middle, high) if inside < share else (low, middle)
    return math.sqrt(freedom) * math.tan(low)


def polynomial(source: str, degree: int) -> list[str]:
    """Expressions ending in `curve` (series_id, month, y, fitted, low, high): orthogonal polynomials on even steps."""
    steps = [f"""
poly0 AS (
  SELECT series_id, month, y, n, (2.0 * i - n - 1) / (n - 1) AS t, CAST(1.0 AS DOUBLE) AS p0
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month) AS i,
               count(*) OVER (PARTITION BY series_id) AS n FROM {source}))"""]
    for k in range(1, degree + 1):
        previous = "" if k == 1 else (f" - p{k - 2} * sum(p{k - 1} * p{k - 1}) OVER s / sum(p{k - 2} * p{k - 2}) OVER s")
        steps.append(f"poly{k} AS (SELECT *, t * p{k - 1}{previous} AS p{k} FROM poly{k - 1} "
                     "WINDOW s AS (PARTITION BY series_id))")
    terms = range(degree + 1)
    curve = " + ".join(f"p{k} * sum(y * p{k}) OVER s / sum(p{k} * p{k}) OVER s" for k in terms)
    leverage = " + ".join(f"p{k} * p{k} / sum(p{k} * p{k}) OVER s" for k in terms)
    steps.append(f"shape AS (SELECT series_id, month, y, n, {curve} AS fitted, {leverage} AS h FROM poly{degree} "
                 "WINDOW s AS (PARTITION BY series_id))")
    points = ", ".join(f"{f}: {student_point(f)!r}" for f in range(1, 121))
    steps.append(f"""
band AS (
  SELECT *, n - {degree + 1} AS f, sqrt(sum((y - fitted) * (y - fitted)) OVER (PARTITION BY series_id) / (n - {degree + 1}))
            * sqrt(h) * (MAP {{{points}}})[n - {degree + 1}] AS half FROM shape),
curve AS (SELECT series_id, month, y, fitted, fitted - half AS low, fitted + half AS high FROM band)""")
    return steps


#: Upper tail of the chi-square distribution with seven degrees of freedom at small - large: closed form over the odd
#: degrees below, with the normal tail by the midpoint rule after t = sqrt(x) + u / (1 - u).
CHI_SQUARE_7 = """(
  sqrt(2 / pi()) * exp(-(small - large) / 2) * (sqrt(small - large) + pow(small - large, 1.5) / 3 + pow(small - large, 2.5) / 15)
  + 2 / sqrt(2 * pi()) * (SELECT sum(exp(-pow(sqrt(small - large) + u / (1 - u), 2) / 2) / pow(1 - u, 2)) / 20000
                          FROM (SELECT (i + 0.5) / 20000 AS u FROM range(20000) r(i))))"""

#: Upper tail of the chi-square distribution at q with "lag" degrees of freedom, for one to four.
CHI_SQUARE_1_TO_4 = """CASE "lag" WHEN 2 THEN exp(-q / 2) WHEN 4 THEN exp(-q / 2) * (1 + q / 2)
  ELSE CASE WHEN "lag" = 3 THEN sqrt(2 * q / pi()) * exp(-q / 2) ELSE 0 END
  + 2 / sqrt(2 * pi()) * (SELECT sum(exp(-pow(sqrt(q) + u / (1 - u), 2) / 2) / pow(1 - u, 2)) / 20000
                          FROM (SELECT (i + 0.5) / 20000 AS u FROM range(20000) r(i))) END"""

#: Two-sided tail of Student's t at estimate / std_error with f degrees of freedom: after t = sqrt(f) tan(a) the density is
#: in proportion to cos(a)**(f - 1), so the tail is a share of two sums by the midpoint rule.
STUDENT_TAIL = """(SELECT sum(pow(cos(atan(abs(estimate / std_error) / sqrt(f)) + (pi() / 2 - atan(abs(estimate / std_error) / sqrt(f))) * u), f - 1))
    * (pi() / 2 - atan(abs(estimate / std_error) / sqrt(f))) / (sum(pow(cos(pi() / 2 * u), f - 1)) * pi() / 2)
  FROM (SELECT (i + 0.5) / 20000 AS u FROM range(20000) r(i)))"""

SMOOTHING = """
listed AS (SELECT series_id, list(y ORDER BY month) AS ys, count(*) AS n, max(month) AS last_month FROM series GROUP BY 1),
starts AS (
  SELECT *, list_avg(ys[1:12]) AS centre, (list_avg(ys[13:24]) - list_avg(ys[1:12])) / 12 AS slope
  FROM listed WHERE n >= 24),
states(series_id, a, b, g, t, n, level, trend, season, sse, se, sae) AS (
  SELECT series_id, a, b, g, 12, n, centre + 5.5 * slope, slope,
         list_transform(range(1, 13), lambda i: ys[i] - centre - (i - 6.5) * slope), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE)
  FROM starts, (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.8)) x(a), (VALUES (0.01::DOUBLE), (0.1), (0.3)) v(b),
       (VALUES (0.05::DOUBLE), (0.2), (0.5)) w(g)
  UNION ALL
  SELECT series_id, a, b, g, t + 1, n, now, b * (now - level) + (1 - b) * trend,
         list_transform(range(1, 13), lambda i: CASE WHEN i = spot THEN g * (y - now) + (1 - g) * effect ELSE season[i] END),
         sse + err * err, se + err, sae + abs(err)
  FROM (SELECT *, y - (level + trend + effect) AS err, a * (y - effect) + (1 - a) * (level + trend) AS now
        FROM (SELECT s.*, l.ys[s.t + 1] AS y, s.t % 12 + 1 AS spot, s.season[s.t % 12 + 1] AS effect
              FROM states s JOIN listed l USING (series_id) WHERE s.t < s.n))),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY sse) AS pick FROM states WHERE t = n)
  WHERE pick = 1),
forecasts AS (
  SELECT series_id, CAST(last_month + to_months(CAST(h AS INTEGER)) AS DATE) AS month,
         level + h * trend + season[(n + h - 1) % 12 + 1] AS forecast,
         sqrt((sse - se * se / (n - 12)) / (n - 13)) AS residual_sd,
         sqrt(1 + list_sum(list_transform(range(0, h), lambda j: CASE WHEN j = 0 THEN 0.0 ELSE pow(a * (1 + j * b), 2) END)))
           AS spread
  FROM best JOIN (SELECT series_id, last_month FROM listed) USING (series_id), (SELECT unnest(range(1, 13)) AS h))"""
