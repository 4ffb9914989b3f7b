"""Purchase baskets: which performances are bought together."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from houselights.operators import ranking
from houselights.plans.marketing import exclusive_singles
from houselights.session import materialise


def baskets(tickets: DataFrame, performances: DataFrame) -> DataFrame:
    """Customer and the set of programmes attended, for customers without a subscription.

    Tickets become one row per customer and performance before the join; performances without a name are no item.
    """
    attended = exclusive_singles(tickets, perf_dt=F.col("perf_dt")).select("summary_cust_id", "perf_dt")
    return (attended.join(performances, "perf_dt").where(F.col("name").isNotNull())
            .groupBy("summary_cust_id").agg(F.sort_array(F.collect_set("name")).alias("items")))


def fit(basket_rows: DataFrame, support: float, confidence: float) -> FPGrowthModel:
    return FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(basket_rows)


def _total(basket_rows: DataFrame):
    return basket_rows.agg(F.count("*").alias("v")).scalar()


def frequent_itemsets(basket_rows: DataFrame, support: float = 0.1, least_items: int = 2,
                      k: int | None = 10) -> DataFrame:
    """Item sets bought together by at least `support` of the customers; the k most frequent."""
    basket_rows = materialise(basket_rows)
    found = (fit(basket_rows, support, 0.5).freqItemsets.where(F.size("items") >= least_items)
             .withColumn("items", F.concat_ws("|", F.sort_array("items")))
             .withColumn("total", _total(basket_rows))
             .select("items", "freq", (F.col("freq") / F.col("total")).alias("support")))
    return found if k is None else ranking.top_k(found, k, "freq", ["items"])


def association_rules(basket_rows: DataFrame, support: float = 0.1, confidence: float = 0.4) -> DataFrame:
    """If-then rules with confidence, lift and support."""
    rules = fit(materialise(basket_rows), support, confidence).associationRules
    return rules.select(F.concat_ws("|", F.sort_array("antecedent")).alias("antecedent"),
                        F.concat_ws("|", "consequent").alias("consequent"), "confidence", "lift", "support")
