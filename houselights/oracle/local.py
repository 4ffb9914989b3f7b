"""Decomposition by local regression as plain SQL: one pair of expressions for every turn."""

from __future__ import annotations


def decomposition(inner: int, outer: int) -> list[str]:
    """From `series` to `parts` (series_id, month, y, trend, seasonal)."""
    out = ["""
w0 AS MATERIALIZED (
  SELECT series_id, month, y, 0.0::DOUBLE AS trend, 1.0::DOUBLE AS w, i, n,
         greatest(0, least(i - 9, n - 19)) AS lo FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n
    FROM series))"""]
    turns = inner * (outer + 1)
    for k in range(1, turns + 1):
        weights = "w"
        if outer and k % inner == 0 and k < turns:
            weights = ("CASE WHEN r <= 0.001 * h THEN 1.0 WHEN r <= 0.999 * h THEN pow(1 - pow(r / h, 2), 2) ELSE 0.0 END")
        out.append(f"""
e{k} AS (SELECT series_id, i % 12 AS m, sum(w * (y - trend)) / sum(w) AS effect FROM w{k - 1} GROUP BY 1, 2),
d{k} AS MATERIALIZED (
  SELECT s.*{" EXCLUDE (seasonal)" if k > 1 else ""}, effect - centre AS seasonal, y - (effect - centre) AS x
  FROM w{k - 1} s JOIN e{k} e ON s.series_id = e.series_id AND s.i % 12 = e.m
  JOIN (SELECT series_id, avg(effect) AS centre FROM e{k} GROUP BY 1) c ON c.series_id = s.series_id),
p{k} AS MATERIALIZED (
  SELECT a.series_id, a.i, a.n, b.i AS j, b.x, b.w * CASE
           WHEN abs(a.i - b.i) <= 0.001 * reach THEN 1.0 WHEN abs(a.i - b.i) <= 0.999 * reach
           THEN pow(1 - pow(abs(a.i - b.i)::DOUBLE / reach, 3), 3) ELSE 0.0 END AS q
  FROM (SELECT *, greatest(i - lo, least(n - 1, lo + 18) - i) AS reach FROM d{k}) a
  JOIN d{k} b ON a.series_id = b.series_id AND b.i BETWEEN a.lo AND a.lo + 18),
m{k} AS (SELECT series_id, i, sum(q * j) / sum(q) AS middle FROM p{k} GROUP BY 1, 2),
l{k} AS (
  SELECT p.series_id, p.i, CASE WHEN sqrt(sum(q * pow(j - middle, 2)) / sum(q)) > 0.001 * (max(n) - 1)
           THEN sum(q * x) / sum(q) + (p.i - max(middle)) * sum(q * (j - middle) * x) / sum(q * pow(j - middle, 2))
           ELSE sum(q * x) / sum(q) END AS trend
  FROM p{k} p JOIN m{k} m ON p.series_id = m.series_id AND p.i = m.i GROUP BY 1, 2),
w{k} AS MATERIALIZED (
  SELECT series_id, month, y, trend, {weights} AS w, i, n, lo, seasonal FROM (
    SELECT *, 6 * median(r) OVER (PARTITION BY series_id) AS h FROM (
      SELECT d.* EXCLUDE (trend), l.trend, abs(y - seasonal - l.trend) AS r
      FROM d{k} d JOIN l{k} l ON d.series_id = l.series_id AND d.i = l.i)))""")
    return [*out, f"parts AS (SELECT series_id, month, y, trend, seasonal, y - trend - seasonal AS remainder FROM w{turns})"]
