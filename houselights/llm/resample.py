"""Target-distribution importance resampling: array-scored weights, a distributed LSD radix sort for the draw.

A feature is a run of 1 to `runs` words; its bucket is a CRC modulo `buckets`. Every batch counts its buckets in an array,
and the counts of all documents and of all target texts give each bucket its integer gain. A document's weight is the sum
of the gains array over its features; Gumbel noise from a hash of its id is added, so the highest scores are a draw
without replacement in proportion to the exponentiated weights.

The draw sorts by a composite key, score descending, then id ascending, nulls last. Rows keep a position, and `BLOCK`
positions are a block. A pass takes the next digit of the key from below: each block counts its digits, the prefix sums of
the counts over (digit, block) say where each block's rows with a digit begin, and a stable counting sort inside the block
gives every row its new position. After the last pass positions are ranks. A block is one task's work whatever its digits
are, so ties and frequent scores weigh on none.

Defined results: null and wordless texts have no features, weight 0 and are never drawn where words are demanded; a null id
is hashed as an empty text; rows with equal id and score are ranked in any order; without target or corpus features the
gains follow from counts of zero; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from houselights.llm.common import ArrowMap, stored, utf8_rows

BUCKETS = 10_000
RUNS = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
DIGIT_BITS = 8
BLOCK_BITS = 12
_MEMO = 300_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Everything but a-z, 0-9 and what lies beyond ASCII parts words.
_TO_WORDS = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in _LOWER)


class _Buckets(dict):
    """Bucket of each word, worked out once."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: bytes) -> int:
        found = zlib.crc32(word) % self.n
        if len(word) <= 64 and len(self) < _MEMO:
            self[word] = found
        return found


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


def features(words: list[bytes], known: _Buckets, runs: int) -> np.ndarray:
    """The buckets of all runs of 1 to `runs` words, with repeats."""
    parts = [np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
    for k in range(2, min(runs, len(words)) + 1):
        joined = map(b" ".join, zip(*(words[i:] for i in range(k))))
        parts.append(np.fromiter((zlib.crc32(x) % known.n for x in joined), np.int64, len(words) - k + 1))
    return np.concatenate(parts)


def _count(buckets: int, runs: int) -> ArrowMap:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), _Buckets(buckets)
        for batch in batches:
            for text in utf8_rows(batch.column(0)):
                total += np.bincount(features(words_of(text), known, runs), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, runs: int = RUNS) -> np.ndarray:
    """How often each bucket occurs in all texts: one number for each bucket reaches the driver."""
    out = np.zeros(buckets, np.int64)
    for bucket, n in (texts.select("text").mapInArrow(_count(buckets, runs), "bucket bigint, n bigint")
                      .groupBy("bucket").agg(F.sum("n")).collect()):
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    n, whole, wanted = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (whole + n) / ((s + 1) * (wanted + n))))
                     for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gain: np.ndarray, runs: int, seed: int) -> ArrowMap:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(len(gain))
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, utf8_rows(batch.column(1))):
                words = words_of(text)
                found = features(words, known, runs)
                weight = int(gain[found].sum())
                rows.append((len(words), len(found), weight, weight + noise(doc_id, seed)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [()] * 4))],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def scores(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    gain = gains(bucket_counts(docs, buckets, runs), bucket_counts(target, buckets, runs))
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _score(gain, runs, seed), "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


# --- the sort ------------------------------------------------------------------------------------------------


def _counting_sort(bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One block: its rows with digit and place, and the first places of its digits, to rows with their new place."""
    def run(rows: pa.Table, firsts: pa.Table) -> pa.Table:
        digit, at = rows["digit"].to_numpy(), rows["at"].to_numpy()
        first = np.zeros(1 << bits, np.int64)
        first[firsts["digit"].to_numpy()] = firsts["first"].to_numpy()
        order = np.argsort(at, kind="stable")
        counts = np.bincount(digit, minlength=1 << bits)
        begin = np.cumsum(counts) - counts
        order = order[np.argsort(digit[order], kind="stable")]
        sorted_digit = digit[order]
        place = np.empty(len(at), np.int64)
        place[order] = first[sorted_digit] + np.arange(len(at)) - begin[sorted_digit]
        return rows.select(["row", "high", "low"]).append_column("at", pa.array(place))

    return run


def _digit(shift: int, bits: int, high_bits: int, low_bits: int) -> Column:
    """Bits [shift, shift + bits) of the key (high, low), counted from below."""
    mask = (1 << bits) - 1
    if shift >= low_bits:
        return F.shiftrightunsigned("high", shift - low_bits).bitwiseAND(F.lit(mask))
    part = F.shiftrightunsigned("low", shift).bitwiseAND(F.lit(mask))
    over = shift + bits - low_bits
    if over > 0 and high_bits:
        upper = F.col("high").bitwiseAND(F.lit((1 << over) - 1))
        part = part.bitwiseOR(F.shiftleft(upper, bits - over))
    return part


def radix_sort(rows: DataFrame, high: Column, low: Column, high_bits: int, low_bits: int, digit_bits: int = DIGIT_BITS,
               block_bits: int = BLOCK_BITS) -> DataFrame:
    """The rows with `at`, their rank from 0 by (high, low); equal keys keep an order of their own.

    The keys are numbers from 0 below 2 to the power of their bits. Each pass moves the rows once.
    """
    names = rows.columns
    now = stored(rows.select(F.struct(*names).alias("row"), high.alias("high"), low.alias("low"),
                             F.monotonically_increasing_id().alias("at")), "radix")
    schema = now.schema
    for shift in range(0, max(1, high_bits + low_bits), digit_bits):
        now = now.withColumns({"block": F.shiftright("at", block_bits),
                               "digit": _digit(shift, digit_bits, high_bits, low_bits).cast("int")})
        counts = stored(now.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n")), "radix-counts")
        # One total for each digit: at most 2 to the power of `digit_bits`.
        below, firsts = 0, []
        for digit, n in sorted(tuple(r) for r in counts.groupBy("digit").agg(F.sum("n")).collect()):
            firsts.append((digit, below))
            below += n
        if not firsts:
            break
        base = counts.sparkSession.createDataFrame(firsts, "digit int, base bigint")
        places = _prefix(counts).join(F.broadcast(base), "digit").select(
            "block", "digit", (F.col("base") + F.col("before")).alias("first"))
        now = stored(now.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(
            _counting_sort(digit_bits), schema), "radix")
    return now.select("row.*", "at")


def _prefix(counts: DataFrame, fan_bits: int = 12) -> DataFrame:
    """For every (block, digit) the count of the digit in all blocks before: sums over groups of blocks, then inside."""
    def before(*keys: str) -> WindowSpec:
        return Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)

    cells = counts.withColumn("group", F.shiftright("block", fan_bits))
    groups = cells.groupBy("digit", "group").agg(F.sum("n").alias("n")).select(
        "digit", "group", F.coalesce(F.sum("n").over(before("digit", "group")), F.lit(0)).alias("earlier"))
    return cells.withColumn("inside", F.coalesce(F.sum("n").over(before("digit", "group", "block")), F.lit(0))).join(
        groups, ["digit", "group"]).select("block", "digit", (F.col("earlier") + F.col("inside")).alias("before"))


def bits_of(n: int) -> int:
    return max(0, n).bit_length()


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The scored documents with `rank` 1, 2, 3... of those drawn: `percent` of the documents of `min_words` words or more,
    highest scores first, ties to smaller ids."""
    scored = stored(scored, "resample-scores")
    fit = F.col("n_words") >= min_words
    n, least, most, first, last = scored.where(fit).agg(
        F.count(F.lit(1)), F.min("score"), F.max("score"), F.min("doc_id"), F.max("doc_id")).first()
    out = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~fit).select(*out, F.lit(None).cast("bigint").alias("rank"))
    if not n:
        return rest
    # The key: descending score, then whether the id is null, then the id from the least one on.
    first, last = (0, 0) if first is None else (first, last)
    wide = bits_of(last - first) > 62
    low = F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63))) if wide else F.col("doc_id") - F.lit(first)
    high = 2 * (F.lit(most) - F.col("score")) + F.col("doc_id").isNull().cast("bigint")
    ranked = radix_sort(scored.where(fit).select(*out), high, F.coalesce(low, F.lit(0).cast("bigint")),
                        bits_of(2 * (most - least) + 1), 64 if wide else bits_of(last - first))
    rank = F.when(F.col("at") < percent * n // 100, F.col("at") + 1).cast("bigint")
    return ranked.select(*out, rank.alias("rank")).union(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and, if drawn, rank."""
    return draw(scores(docs, target, **options), percent, min_words)


ORACLE_SQL = """
WITH RECURSIVE poly AS (
  SELECT n::BIGINT AS n, n::BIGINT AS c, 0 AS step FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM poly WHERE step < 8
), crc_table AS (SELECT list(c ORDER BY n) AS t FROM poly WHERE step = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
said AS (
  SELECT r, text FROM d UNION ALL SELECT -row_number() OVER (), text FROM benchmark
), w AS MATERIALIZED (
  SELECT r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM said
), spelt AS (
  SELECT word, list_transform(range(0, strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS bytes
  FROM (SELECT DISTINCT word FROM w)
), b AS MATERIALIZED (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes),
    lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]))) % 10000 AS bucket
  FROM spelt, crc_table
), seen AS MATERIALIZED (SELECT r, bucket FROM w JOIN b USING (word)),
n AS (SELECT bucket, (count(*) FILTER (r > 0))::DOUBLE AS s, (count(*) FILTER (r < 0))::DOUBLE AS t FROM seen GROUP BY 1),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain
  FROM n, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM n)
), f AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM seen JOIN g USING (bucket) WHERE r > 0 GROUP BY 1),
x AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln(((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
      + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN f USING (r)
), k AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (
    PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place,
    count(*) FILTER (n_features >= 20) OVER () AS fit
  FROM x
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN place <= 10 * fit // 100 THEN place END::BIGINT AS rank
FROM k
"""
