"""Two-variant conversion test in closed form: Beta posterior of each variant's rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from houselights.functions import columns as c

Z_95 = 1.959964  # Fixed value: two-sided 95 % point of the normal distribution.


def conversion(outcomes: DataFrame) -> DataFrame:
    """Size, conversions, rate and the Beta(conversions, size - conversions) posterior with a 95 % interval."""
    a, b = F.col("conversions").cast("double"), (F.col("size") - F.col("conversions")).cast("double")
    mean, variance = a / (a + b), a * b / (F.pow(a + b, 2) * (a + b + 1))
    sd = F.sqrt(variance)
    return (outcomes.groupBy("variant")
            .agg(F.count("*").alias("size"), F.sum("converted").alias("conversions"))
            .select("variant", "size", "conversions", c.ratio(F.col("conversions"), F.col("size")).alias("rate"),
                    mean.alias("posterior_mean"), variance.alias("posterior_variance"),
                    (mean - Z_95 * sd).alias("low"), (mean + Z_95 * sd).alias("high")))


def separated(conversions: DataFrame, better: str, worse: str) -> DataFrame:
    """Do the two intervals stay apart? Both sides are one row."""
    low = F.max(F.when(F.col("variant") == better, F.col("low")))
    high = F.max(F.when(F.col("variant") == worse, F.col("high")))
    return conversions.agg(low.alias("better_low"), high.alias("worse_high"), (low > high).alias("is_separated"))
