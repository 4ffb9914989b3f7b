"""Mixing sources to target weights by temperature.

The weight of a source is its share of all tokens to the power of an exponent between 0 (all alike) and 1 (as found),
normalised. The exponent is bisected until the weights reach a target entropy, or until no source is repeated more than a
limit allows. A budget of tokens, times the weight, is what a source contributes: some whole epochs and a part of one more.

Epochs are permutations of blocks. A document's block comes from a hash of its id and text; in each epoch of a source the
blocks stand in an order of their own, and the part epoch takes blocks from the front. The block that the budget cuts is
cut again, into blocks of its own, so a source misses its budget by half of one such block at most (a 4096th of a 4096th of
its tokens, or one document). Only sums by source and block are gathered, and by source on the driver.

Without a budget the smallest one is taken that uses every document at least once, so nothing is lost by mixing.

Defined results: a null source is a source; null and empty texts have no tokens and ride along with their block; a source
without tokens has weight 0 and one epoch; repeated rows lie in one block and are mixed alike; an empty table gives no rows;
columns of the input, whatever their names, are kept by `mixed` and left out by `plan_rows`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from houselights.llm.common import stored, utf8_rows

BLOCK_BITS = 12
MAX_REPEATS = 1.5
MAX_SOURCES = 100_000
SEED = 11


@dataclass(frozen=True)
class Target:
    """Either an entropy as a share of its maximum, or the most epochs that any source may be used."""
    entropy_share: float | None = None
    max_repeats: float | None = None

    def __post_init__(self):
        if (self.entropy_share is None) == (self.max_repeats is None):
            raise ValueError("give an entropy share or a repetition limit")


def weights(totals: list[float], exponent: float) -> list[float]:
    """Shares to the power of the exponent, normalised; nothing for sources without tokens."""
    whole = math.fsum(totals)
    raised = [(x / whole) ** exponent if x > 0 else 0.0 for x in totals]
    norm = math.fsum(raised)
    return [x / norm for x in raised]


def entropy(shares: list[float]) -> float:
    return -math.fsum(x * math.log(x) for x in shares if x > 0)


def smallest_budget(totals: list[float], shares: list[float]) -> float:
    """Tokens with which every source is used at least once."""
    return max((t / w for t, w in zip(totals, shares) if w > 0), default=0.0)


def epochs(totals: list[float], shares: list[float], budget: float) -> list[float]:
    return [w * budget / t if t > 0 else 1.0 for t, w in zip(totals, shares)]


def exponent_for(totals: list[float], target: Target, budget: float | None = None, steps: int = 60) -> float:
    """The least exponent that keeps within the repetition limit, or the greatest that reaches the entropy; 1 or 0 where
    no exponent does."""
    def flat_enough(a: float) -> bool:
        if target.entropy_share is not None:
            return entropy(weights(totals, a)) >= target.entropy_share * math.log(max(2, sum(t > 0 for t in totals)))
        shares = weights(totals, a)
        size = budget if budget is not None else smallest_budget(totals, shares)
        return max(epochs(totals, shares, size)) > target.max_repeats
    # True near 0, where weights are flat and small sources repeat; False near 1.
    low, high = 0.0, 1.0
    if not flat_enough(low):
        return 0.0
    if flat_enough(high):
        return 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        if flat_enough(middle):
            low = middle
        else:
            high = middle
    return low if target.entropy_share is not None else high


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = pa.array([len((x or b"").split()) for x in utf8_rows(batch.column(3))], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], counts], ["doc_id", "source", "pick", "n_tokens"])


def _pick(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(SEED), doc_id, F.xxhash64(text))


def _block(pick: Column, level: int = 0) -> Column:
    return F.shiftrightunsigned(pick, level * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _order(block: Column, epoch: Column) -> Column:
    """The place of a block in an epoch's permutation, between 0 and 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), block, epoch.cast("bigint")), 11) / F.lit(float(1 << 53))


def _cuts(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source how far its part epoch goes: `reach` over its blocks and `inner` inside the block at the cut."""
    key = F.col("source").eqNullSafe(F.col("_source"))
    rows = slim.join(F.broadcast(plan), key)
    blocks = (rows.groupBy("_source", "whole", "wanted", _block(F.col("pick")).alias("block")).agg(F.sum("n_tokens").alias("n"))
              .withColumn("at", _order(F.col("block"), F.col("whole"))))
    # A source has at most 2**BLOCK_BITS blocks.
    before = Window.partitionBy("_source").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, -1)
    edge = (blocks.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .where("below < wanted and below + n >= wanted")
            .select(F.col("_source").alias("_edge"), F.col("at").alias("reach"), F.col("block").alias("_block"),
                    (F.col("wanted") - F.col("below")).alias("left")))
    inside = (rows.join(F.broadcast(edge), F.col("_source").eqNullSafe(F.col("_edge")) & (_block(F.col("pick")) == F.col("_block")))
              .groupBy("_edge", "reach", "left", "whole", _block(F.col("pick"), 1).alias("block"))
              .agg(F.sum("n_tokens").alias("n")).withColumn("at", _order(F.col("block"), F.col("whole") + 1)))
    before = Window.partitionBy("_edge").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, -1)
    return (inside.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .groupBy("_edge", "reach").agg(F.max(F.when(F.col("below") + F.col("n") / 2 <= F.col("left"), F.col("at"))).alias("inner")))


@dataclass
class Mixture:
    exponent: float
    budget: float
    rows: list[tuple]  # source, tokens, weight, epochs
    cuts: list[tuple]  # source, whole epochs, epochs, reach, inner


def fit(docs: DataFrame, target: Target, budget: float | None = None) -> tuple[Mixture, DataFrame]:
    """The mixture for the documents, and their slim rows (doc_id, source, pick, n_tokens), stored."""
    spark = docs.sparkSession
    slim = stored(docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"),
                              _pick(F.col("doc_id"), F.col("text")).alias("pick"), "text")
                  .mapInArrow(_tokens, "doc_id bigint, source string, pick bigint, n_tokens bigint"), "mix-rows")
    totals = slim.groupBy("source").agg(F.sum("n_tokens").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix them by a coarser column")
    totals = sorted(((r["source"], float(r["n"])) for r in totals), key=lambda x: (x[0] is not None, x[0]))
    names, sizes = [x[0] for x in totals], [x[1] for x in totals]
    if not any(sizes):
        return Mixture(1.0, 0.0, [(s, 0.0, 0.0, 1.0) for s in names], [(s, 1, 1.0, None, None) for s in names]), slim
    exponent = exponent_for(sizes, target, budget)
    shares = weights(sizes, exponent)
    budget = smallest_budget(sizes, shares) if budget is None else budget
    used = epochs(sizes, shares, budget)
    # An epoch that lacks less than a token is whole.
    whole = [int(math.floor(e + 1 / max(t, 1.0))) for e, t in zip(used, sizes)]
    plan = spark.createDataFrame(
        [(s, q, max(0.0, (e - q) * t)) for s, q, e, t in zip(names, whole, used, sizes)],
        "_source string, whole int, wanted double")
    found = {r["_edge"]: (r["reach"], r["inner"]) for r in _cuts(slim, plan).collect()}
    return Mixture(exponent, budget, list(zip(names, sizes, shares, used)),
                   [(s, q, e, *found.get(s, (None, None))) for s, q, e in zip(names, whole, used)]), slim


def _with_copies(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """Rows with `_pick` and `_source` times their epochs: adds `_epoch`, `_block` and `_order`."""
    cuts = rows.sparkSession.createDataFrame(
        mixture.cuts, "_name string, _whole int, _epochs double, _reach double, _inner double")
    at, inner = _order(_block(F.col("_pick")), F.col("_whole")), _order(_block(F.col("_pick"), 1), F.col("_whole") + 1)
    part = (at < F.col("_reach")) | ((at == F.col("_reach")) & (inner <= F.col("_inner")))
    copies = F.col("_whole") + F.coalesce(part, F.lit(False)).cast("int")
    # At most MAX_SOURCES rows of five values are broadcast.
    out = rows.join(F.broadcast(cuts), F.col("_source").eqNullSafe(F.col("_name")))
    out = out.withColumn("_epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1))))
    out = out.withColumn("_block", _block(F.col("_pick")))
    return out.withColumn("_order", F.least(
        F.lit(1.0), (F.col("_epoch") + _order(F.col("_block"), F.col("_epoch"))) / F.greatest(F.col("_epochs"), F.lit(1e-9))))


def plan_rows(docs: DataFrame, target: Target, budget: float | None = None) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block and mix_order, a row for each use of a document. Sorted by mix_order, every
    stretch holds the sources in their weights."""
    mixture, slim = fit(docs, target, budget)
    rows = slim.withColumnsRenamed({"pick": "_pick"}).withColumn("_source", F.col("source"))
    return _with_copies(rows, mixture).select(
        "doc_id", "source", "n_tokens", F.col("_epoch").alias("epoch"), F.col("_block").cast("int").alias("block"),
        F.col("_order").alias("mix_order"))


def mixed(docs: DataFrame, target: Target, budget: float | None = None) -> DataFrame:
    """The input rows with all their columns, as often as the mixture uses them. No text is exchanged."""
    mixture, _ = fit(docs, target, budget)
    rows = docs.select(F.struct("*").alias("_row"), _pick(F.col("doc_id").cast("bigint"), F.col("text")).alias("_pick"),
                       F.col("source").cast("string").alias("_source"))
    return _with_copies(rows, mixture).select("_row.*")
