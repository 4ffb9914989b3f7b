"""Smooth densities of a measure per group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from houselights.functions.arrays import places, total

POINTS = 128


def kernel_density(df: DataFrame, groups: Sequence[str], value: str, points: int = POINTS) -> DataFrame:
    """Gaussian kernel density of each group on `points` even places, three bandwidths beyond its ends.

    The bandwidth is 0.9 times the smaller of deviation and quartile range / 1.34, times n to the power -1/5. Every value is
    shared between the two places around it, so what is shuffled is a weight for each place and partition; the kernel then
    runs over places, however many values a group has. NULL and undefined values are left out; a group with one value
    throughout has a bandwidth of 1.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *groups, F.col(value).cast("double").alias("_v"))
    quartiles = F.percentile("_v", F.array(F.lit(0.25), F.lit(0.75)))
    stats = known.groupBy(F.struct(*groups).alias("_g")).agg(
        F.count("*").alias("n"), F.stddev_samp("_v").alias("_sd"), quartiles.alias("_q"), F.min("_v").alias("_low"),
        F.max("_v").alias("_high"))
    range_ = (F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))) / 1.34
    spread = F.coalesce(F.nullif(F.least("_sd", range_), F.lit(0.0)), F.nullif(F.col("_sd"), F.lit(0.0)))
    width = F.coalesce(0.9 * spread * F.pow(F.col("n"), F.lit(-0.2)), F.lit(1.0))
    stats = stats.withColumn("bandwidth", width).select(
        "_g", "n", "bandwidth", (F.col("_low") - 3 * F.col("bandwidth")).alias("_from"),
        ((F.col("_high") - F.col("_low") + 6 * F.col("bandwidth")) / (points - 1)).alias("_step"))
    at = (F.col("_v") - F.col("_from")) / F.col("_step")
    placed = known.withColumn("_g", F.struct(*groups)).join(stats, "_g").withColumns({"_at": at, "_cell": F.floor(at)})
    part = F.col("_at") - F.col("_cell")
    shares = F.array(F.struct(F.col("_cell").alias("cell"), (1 - part).alias("w")),
                     F.struct((F.col("_cell") + 1).alias("cell"), part.alias("w")))
    cells = (placed.withColumn("s", F.explode(shares)).groupBy("_g", "n", "bandwidth", "_from", "_step", "s.cell")
             .agg(F.sum("s.w").alias("w")))
    # At most `points` cells for each group.
    listed = cells.groupBy("_g", "n", "bandwidth", "_from", "_step").agg(
        F.sort_array(F.collect_list(F.struct("cell", "w"))).alias("_cells"))
    scale = F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi)
    curve = F.transform(places(0, points - 1), lambda j: F.struct(
        (F.col("_from") + j * F.col("_step")).alias("x"), (total(F.transform("_cells", lambda c: c["w"] * F.exp(-0.5 * F.pow(
            (j - c["cell"]) * F.col("_step") / F.col("bandwidth"), F.lit(2.0))))) / scale).alias("density")))
    return listed.select("_g.*", "n", "bandwidth", F.explode(curve).alias("p")).select(*groups, "n", "bandwidth", "p.*")
