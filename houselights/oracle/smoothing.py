"""The choice among smoothing forms as plain SQL: one recursion over the months for each round of points."""

from __future__ import annotations

_POINT = "trend, season, a, b, g, phi"
_SUMS = "sse, srel, slog, se, sae, sape, lowest"


def _fold(turn: int) -> str:
    return f"""
fold{turn}(series_id, own, {_POINT}, t, n, level, slope, effects, {_SUMS}) AS (
  SELECT p.series_id, own, {_POINT}, 0, n::INTEGER, CASE WHEN trend > 0 THEN start ELSE flat END::DOUBLE,
         CASE WHEN trend > 0 THEN m.slope ELSE 0 END::DOUBLE,
         CASE season WHEN 2 THEN times WHEN 1 THEN added ELSE list_transform(range(12), lambda i: 0.0::DOUBLE) END,
         0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 1e300::DOUBLE
  FROM points{turn} p JOIN sm m USING (series_id)
  UNION ALL
  SELECT series_id, own, {_POINT}, t + 1, n, base + a * below, phi * slope + a * b * below,
         list_append(effects[2:12], CASE season WHEN 0 THEN 0 WHEN 2 THEN effect + (1 - a) * g * (err / nullif(base, 0))
                                    ELSE effect + (1 - a) * g * err END),
         sse + err * err, srel + pow(err / nullif(mu, 0), 2), slog + ln(nullif(abs(mu), 0)), se + err, sae + abs(err),
         sape + abs(err / nullif(y, 0)), least(lowest, mu)
  FROM (SELECT *, y - mu AS err, CASE WHEN season = 2 THEN (y - mu) / nullif(effect, 0) ELSE y - mu END AS below
        FROM (SELECT *, CASE WHEN season = 2 THEN base * effect ELSE base + effect END AS mu
              FROM (SELECT f.*, m.ys[f.t + 1] AS y, f.level + f.phi * f.slope AS base, f.effects[1] AS effect
                    FROM fold{turn} f JOIN sm m USING (series_id) WHERE f.t < f.n)))),
won{turn} AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id, error, trend, season ORDER BY fit, a, b, g, phi) AS pick FROM (
      SELECT f.*, 0 AS error, CASE WHEN season < 2 THEN n * ln(greatest(sse, 1e-12 * n)) END AS fit FROM fold{turn} f WHERE t = n
      UNION ALL
      SELECT f.*, 1, CASE WHEN positive AND lowest > 0 THEN f.n * ln(greatest(srel, 1e-12 * f.n)) + 2 * slog END
      FROM fold{turn} f JOIN sm USING (series_id) WHERE t = f.n) WHERE fit IS NOT NULL AND (own IS NULL OR own = error))
  WHERE pick = 1)"""


def _around(turn: int, share: float, damping: float) -> str:
    def moved(name: str, needed: str, step: float, low: float, high: float) -> str:
        return f"CASE WHEN {needed} THEN greatest({low}, least({high}, {name} + d{name} * {step}::DOUBLE)) ELSE {name} END AS {name}"

    return f"""
points{turn} AS (
  SELECT series_id, error AS own, trend, season, {moved("a", "true", share, 0.001, 0.999)},
         {moved("b", "trend > 0", share, 0.001, 0.999)}, {moved("g", "season > 0", share, 0.001, 0.999)},
         {moved("phi", "trend = 2", damping, 0.8, 0.98)}
  FROM won{turn - 1}, (VALUES (-1), (0), (1)) x(da), (VALUES (-1), (0), (1)) y(db), (VALUES (-1), (0), (1)) z(dg),
       (VALUES (-1), (0), (1)) w(dphi)
  WHERE (trend > 0 OR db = 0) AND (season > 0 OR dg = 0) AND (trend = 2 OR dphi = 0))"""


def choice() -> list[str]:
    """From `series` to `chosen`, one row for each series."""
    return ["""
sm0 AS (SELECT series_id, list(y ORDER BY month) AS ys, count(*) AS n, max(month) AS last_month, min(y) > 0 AS positive
        FROM series GROUP BY 1),
sm1 AS (SELECT *, n >= 24 AS years, CASE WHEN n >= 24 THEN list_avg(ys[1:12]) ELSE list_avg(ys[1:least(n, 6)]) END AS flat FROM sm0),
sm2 AS (SELECT *, CASE WHEN years THEN (list_avg(ys[13:24]) - flat) / 12
                  ELSE coalesce((ys[least(n, 6)] - ys[1]) / nullif(least(n, 6) - 1, 0), 0) END AS slope FROM sm1),
sm3 AS (SELECT *, CASE WHEN years THEN flat - 6.5 * slope ELSE ys[1] - slope END AS start FROM sm2),
sm4 AS (
  SELECT *, CASE WHEN years THEN list_transform(range(1, 13), lambda i: (ys[i] + ys[i + 12]) / 2 - start - slope * (i + 6)) END AS a0,
         CASE WHEN years AND positive THEN list_transform(range(1, 13), lambda i:
           (ys[i] / (start + slope * i) + ys[i + 12] / (start + slope * (i + 12))) / 2) END AS t0 FROM sm3),
sm AS MATERIALIZED (
  SELECT *, list_transform(a0, lambda x: x - list_avg(a0)) AS added, list_transform(t0, lambda x: x / list_avg(t0)) AS times FROM sm4),
points0 AS (
  SELECT series_id, CAST(NULL AS INTEGER) AS own, trend, season, a::DOUBLE AS a, b::DOUBLE AS b, g::DOUBLE AS g, phi::DOUBLE AS phi
  FROM sm, (VALUES (0), (1), (2)) t(trend), (VALUES (0), (1), (2)) s(season),
       (VALUES (0.02::DOUBLE), (0.1), (0.25), (0.45), (0.7), (0.9)) x(a), (VALUES (0.0::DOUBLE), (0.02), (0.15), (0.5)) y(b),
       (VALUES (0.0::DOUBLE), (0.02), (0.15), (0.5)) z(g), (VALUES (1.0::DOUBLE), (0.85), (0.96)) w(phi)
  WHERE (season = 0 OR years) AND (season < 2 OR positive) AND (trend = 0) = (b = 0) AND (season = 0) = (g = 0)
    AND (trend = 2) = (phi < 1))""", _fold(0), _around(1, 0.08, 0.04), _fold(1), _around(2, 0.03, 0.015), _fold(2), """
chosen AS MATERIALIZED (
  SELECT *, 'ETS(' || ['A', 'M'][error + 1] || ',' || ['N', 'A', 'Ad'][trend + 1] || ',' || ['N', 'A', 'M'][season + 1] || ')' AS form,
         CASE WHEN error = 0 THEN sse ELSE srel END / CASE WHEN n >= k THEN n - k + 1 END AS variance
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY aicc IS NULL, coalesce(aicc, k), error, trend, season) AS best
        FROM (SELECT *, CASE WHEN n - k > 1 THEN fit + 2 * k + 2.0 * k * (k + 1) / (n - k - 1) END AS aicc
              FROM (SELECT *, 3 + CASE WHEN trend > 0 THEN 2 ELSE 0 END + CASE WHEN season > 0 THEN 12 ELSE 0 END
                           + CASE WHEN trend = 2 THEN 1 ELSE 0 END AS k FROM won2)))
  WHERE best = 1)"""]


def forecasts() -> list[str]:
    """From `chosen` to `ahead` (series_id, h, done: the expected squares of the mean path)."""
    return ["""
carried AS (
  SELECT *, list_transform(range(1, 13), lambda h: list_sum(list_transform(range(1, h + 1), lambda i: pow(phi, i)))) AS up FROM chosen),
paths AS MATERIALIZED (
  SELECT *, list_transform(range(1, 13), lambda h: level + up[h] * slope + CASE WHEN season = 2 THEN 0 ELSE effects[(h - 1) % 12 + 1] END) AS means,
         list_transform(range(1, 13), lambda j: a + a * b * up[j] + CASE WHEN season = 1 AND j % 12 = 0 THEN (1 - a) * g ELSE 0 END) AS weights
  FROM carried),
ahead(series_id, h, done) AS (
  SELECT series_id, 0, CAST([] AS DOUBLE[]) FROM paths
  UNION ALL
  SELECT series_id, h + 1, list_append(done, pow(means[h + 1], 2) + variance * coalesce(list_sum(list_transform(range(1, h + 1),
         lambda j: pow(weights[j], 2) * done[h + 1 - j])), 0))
  FROM ahead JOIN paths USING (series_id) WHERE h < 12),
spreads AS (
  SELECT series_id, h, form, means[h] * scale AS forecast, 1.959964 * scale * sqrt(CASE WHEN error = 0
           THEN variance * (1 + coalesce(list_sum(list_transform(range(1, h), lambda j: pow(weights[j], 2))), 0))
           ELSE greatest(0, done[h] * (1 + variance) * CASE WHEN season = 2
             THEN pow(1 + pow((1 - a) * g, 2) * variance, (h - 1) // 12) ELSE 1 END - pow(means[h], 2)) END) AS half
  FROM (SELECT *, CASE WHEN season = 2 THEN effects[(h - 1) % 12 + 1] ELSE 1 END AS scale FROM ahead JOIN paths USING (series_id))
  WHERE h > 0)"""]
