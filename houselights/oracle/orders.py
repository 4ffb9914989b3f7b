"""The choice of autoregressive orders as plain SQL: joins and windows for differences and lags, elimination by recursion."""

from __future__ import annotations

from itertools import product

LONG = 13
LAGS = (1, 2, 3, 12)
WIDTH = 10


def _products(width: int) -> str:
    return "[" + ", ".join("[" + ", ".join(f"sum(z[{i}] * z[{j}])" for j in range(1, width + 1)) + "]"
                           for i in range(1, width + 1)) + "]"


def _eliminate(name: str, source: str, width: int, keys: str) -> str:
    """Eliminate the columns listed in `ps` one by one, leaving out those that have lost all but 1e-9 of their square."""
    return f"""{name}({keys}, ps, k, done, a, a0) AS (
  SELECT {keys}, ps, 0, CAST([] AS INTEGER[]), a, a FROM {source}
  UNION ALL
  SELECT {keys}, ps, k + 1, CASE WHEN free THEN list_append(done, p) ELSE done END,
         CASE WHEN free THEN list_transform(range(1, {width + 1}), lambda i: list_transform(range(1, {width + 1}), lambda j:
           CASE WHEN i = p THEN a[i][j] / a[i][i] ELSE a[i][j] - a[i][p] * a[p][j] / a[p][p] END)) ELSE a END, a0
  FROM (SELECT *, ps[k + 1] AS p, a[ps[k + 1]][ps[k + 1]] > 1e-9 * a0[ps[k + 1]][ps[k + 1]] AS free
        FROM {name} WHERE k < len(ps)))"""


def _orders() -> list[tuple[int, int, int, int]]:
    found = [o for o in product(range(4), range(4), range(2), range(2)) if sum(o) <= 5]
    return sorted(found, key=lambda o: (sum(o), o))


def choice() -> list[str]:
    """From `series` and the decomposition's `trends` and `effects` to `best`, one row for each series that is long enough."""
    values = []
    for at, (p, q, sp, sq) in enumerate(_orders()):
        own = [*range(2, 2 + p), *([5] if sp else [])]
        shock = [*range(6, 6 + q), *([9] if sq else [])]
        values.append(f"({at}, {p}, {q}, {sp}, {sq}, {[*own, *shock]}::INTEGER[])")
    lags = ", ".join(f"lag(v, {k}) OVER w" for k in range(1, LONG + 1))
    both = ", ".join(f"lag({x}, {k}) OVER w" for x in ("v", "e") for k in LAGS)
    return [f"""
strengths AS (
  SELECT t.series_id, greatest(0, 1 - var_pop(y - trend - effect) / nullif(var_pop(y - trend), 0)) AS strength
  FROM trends t JOIN effects e ON e.series_id = t.series_id AND e.m = t.m WHERE trend IS NOT NULL GROUP BY 1),
yearly AS (
  SELECT series_id, count(*) AS n, CASE WHEN count(*) >= 48 AND max(strength) > 0.64 THEN 1 ELSE 0 END AS sd, max(strength) AS strength
  FROM series JOIN strengths USING (series_id) GROUP BY 1),
x0 AS (
  SELECT series_id, month, CASE WHEN sd = 1 THEN y - lag(y, 12) OVER (PARTITION BY series_id ORDER BY month) ELSE y END AS x
  FROM series JOIN yearly USING (series_id)),
x1 AS (SELECT series_id, month, x - lag(x) OVER (PARTITION BY series_id ORDER BY month) AS x FROM x0 WHERE x IS NOT NULL),
x2 AS (SELECT series_id, month, x - lag(x) OVER (PARTITION BY series_id ORDER BY month) AS x FROM x1 WHERE x IS NOT NULL),
xs AS MATERIALIZED (
  SELECT r, series_id, row_number() OVER s AS i, x, x - avg(x) OVER (PARTITION BY r, series_id) AS c,
         count(*) OVER (PARTITION BY r, series_id) AS n
  FROM (SELECT 0 AS r, * FROM x0 UNION ALL SELECT 1, * FROM x1 UNION ALL SELECT 2, * FROM x2) WHERE x IS NOT NULL
  WINDOW s AS (PARTITION BY r, series_id ORDER BY month)),
steady AS (
  SELECT p.r, p.series_id, n < 12 OR coalesce(ss / nullif(n * (g0 + coalesce(g, 0)), 0), 0) <= 0.463 AS ok
  FROM (SELECT r, series_id, sum(s * s) AS ss, sum(c * c) AS g0, max(n) AS n
        FROM (SELECT *, sum(c) OVER (PARTITION BY r, series_id ORDER BY i) AS s FROM xs) GROUP BY 1, 2) p
  LEFT JOIN (SELECT a.r, a.series_id, sum(2 * (1 - (a.i - b.i) / (floor(3 * sqrt(a.n) / 13) + 1)) * a.c * b.c) AS g
             FROM xs a JOIN xs b ON a.r = b.r AND a.series_id = b.series_id
               AND a.i - b.i BETWEEN 1 AND floor(3 * sqrt(a.n) / 13) GROUP BY 1, 2) q
  ON p.r = q.r AND p.series_id = q.series_id),
differences AS (
  SELECT series_id, sd, strength, CASE WHEN a.ok THEN 0 WHEN b.ok THEN 1 ELSE 2 END AS d,
         CASE WHEN a.ok THEN 0 WHEN b.ok THEN 1 ELSE 2 END + sd <= 1 AS constant
  FROM yearly JOIN (SELECT series_id, ok FROM steady WHERE r = 0) a USING (series_id)
  JOIN (SELECT series_id, ok FROM steady WHERE r = 1) b USING (series_id)),
scales AS (
  SELECT series_id, sd, d, constant, strength, count(*) AS n, CASE WHEN constant THEN avg(x) ELSE 0 END AS centre,
         sqrt(CASE WHEN constant THEN var_pop(x) ELSE avg(x * x) END) AS spread
  FROM xs JOIN differences USING (series_id) WHERE r = d GROUP BY 1, 2, 3, 4, 5),
v AS MATERIALIZED (
  SELECT series_id, i, (x - centre) / spread AS v FROM xs JOIN scales USING (series_id) WHERE r = d),
z1 AS MATERIALIZED (
  SELECT * FROM (SELECT series_id, i, v, [1, {lags}, v] AS z FROM v WINDOW w AS (PARTITION BY series_id ORDER BY i)) WHERE i > {LONG}),
g1 AS MATERIALIZED (
  SELECT series_id, CASE WHEN constant THEN range(1, {LONG + 2}) ELSE range(2, {LONG + 2}) END::INTEGER[] AS ps, a
  FROM (SELECT series_id, {_products(LONG + 2)} AS a FROM z1 GROUP BY 1) JOIN scales USING (series_id) WHERE n >= 45)""",
            _eliminate("s1", "g1", LONG + 2, "series_id"), f"""
e AS MATERIALIZED (
  SELECT v.series_id, v.i, v.v, CASE WHEN z IS NULL THEN 0.0 ELSE v.v - list_sum(list_transform(range(1, {LONG + 2}), lambda j:
         CASE WHEN list_contains(done, j::INTEGER) THEN a[j][{LONG + 2}] * z[j] ELSE 0.0 END)) END AS e
  FROM v JOIN (SELECT * FROM s1 WHERE k = len(ps)) f USING (series_id) LEFT JOIN z1 ON z1.series_id = v.series_id AND z1.i = v.i),
z2 AS MATERIALIZED (
  SELECT series_id, z FROM (SELECT series_id, i, [1, {both}, v] AS z FROM e WINDOW w AS (PARTITION BY series_id ORDER BY i))
  WHERE i > {LONG + 12}),
grid(pos, p, q, sp, sq, own) AS (VALUES {", ".join(values)}),
g2 AS MATERIALIZED (
  SELECT series_id, pos, months, CASE WHEN constant THEN list_prepend(1::INTEGER, own) ELSE own END AS ps, a
  FROM (SELECT series_id, count(*) AS months, {_products(WIDTH)} AS a FROM z2 GROUP BY 1) JOIN scales USING (series_id), grid)""",
            _eliminate("s2", "g2", WIDTH, "series_id, pos, months"), f"""
fits AS MATERIALIZED (
  SELECT series_id, pos, len(done) + 1 AS k, months, greatest(a[{WIDTH}][{WIDTH}], 1e-12) AS rss,
         list_transform(range(1, {WIDTH}), lambda j: CASE WHEN list_contains(done, j::INTEGER) THEN a[j][{WIDTH}] ELSE 0.0 END) AS b
  FROM s2 WHERE k = len(ps)),
memory(series_id, pos, part, weights, h, past) AS (
  SELECT series_id, pos, part, CASE WHEN part = 0 THEN b[2:5] ELSE list_transform(b[6:9], lambda x: -x) END, 0,
         [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]::DOUBLE[] FROM fits, (VALUES (0), (1)) t(part)
  UNION ALL
  SELECT series_id, pos, part, weights, h + 1, list_append(past[2:12], weights[1] * past[12] + weights[2] * past[11]
         + weights[3] * past[10] + weights[4] * past[1]) FROM memory WHERE h < 120),
sound AS (SELECT series_id, pos FROM memory WHERE h = 120 GROUP BY 1, 2
          HAVING bool_and(list_max(list_transform(past, lambda x: abs(x))) <= 0.35)),
judged AS (
  SELECT *, months * ln(rss / months) + 2 * k + 2.0 * k * (k + 1) / (months - k - 1) AS aicc,
         rss / (months - k + 1) AS variance FROM fits JOIN sound USING (series_id, pos)),
best AS MATERIALIZED (
  SELECT series_id, c.sd, c.d, c.constant, c.strength, c.centre, c.spread, j.aicc, j.variance, j.b,
         printf('(%d,%d,%d)(%d,%d,%d)[12]', p, c.d, q, sp, c.sd, sq) AS orders
  FROM scales c JOIN (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p + q + sp + sq, aicc, pos) AS pick
    FROM (SELECT *, min(aicc) OVER (PARTITION BY series_id) AS least FROM judged JOIN grid USING (pos)) WHERE aicc <= least + 2) j
  USING (series_id) WHERE pick = 1)"""]


def forecasts() -> list[str]:
    """From `best` to `ahead` (series_id, h, y, answer): the model's path, and its answer to one shock."""
    def back(name: str, k: int) -> str:
        return f"{name}[-{k}]"

    def terms(v: str, e: str) -> str:
        return " + ".join([f"b[{2 + i}] * {back(v, k)}" for i, k in enumerate(LAGS)]
                          + [f"b[{6 + i}] * {back(e, k)}" for i, k in enumerate(LAGS)])

    def undone(y: str) -> str:
        return (f"CASE d WHEN 0 THEN 0 WHEN 1 THEN {back(y, 1)} ELSE 2 * {back(y, 1)} - {back(y, 2)} END + CASE WHEN sd = 0 THEN 0 "
                f"WHEN d = 0 THEN {back(y, 12)} WHEN d = 1 THEN {back(y, 12)} - {back(y, 13)} "
                f"ELSE {back(y, 12)} - 2 * {back(y, 13)} + {back(y, 14)} END")

    zeros = "[" + ", ".join(["0.0"] * 14) + "]::DOUBLE[]"
    return [f"""
ahead(series_id, h, v, e, y, pv, pe, py) AS (
  SELECT series_id, 0, vs, es, ys, {zeros}, {zeros}, {zeros}
  FROM (SELECT series_id, list(v ORDER BY i) AS vs, list(e ORDER BY i) AS es FROM e GROUP BY 1)
  JOIN (SELECT series_id, list(y ORDER BY month) AS ys FROM series GROUP BY 1) USING (series_id)
  UNION ALL
  SELECT series_id, h + 1, list_append(v, nv), list_append(e, 0.0), list_append(y, nv * spread + centre + {undone("y")}),
         list_append(pv, npv), list_append(pe, CASE WHEN h = 0 THEN 1.0 ELSE 0.0 END), list_append(py, npv + {undone("py")})
  FROM (SELECT a.*, m.*  EXCLUDE (series_id), b[1] + {terms("v", "e")} AS nv,
               CASE WHEN h = 0 THEN 1 ELSE 0 END + {terms("pv", "pe")} AS npv
        FROM ahead a JOIN best m USING (series_id) WHERE h < 12))"""]
