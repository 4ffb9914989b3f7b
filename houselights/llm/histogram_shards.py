"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by a key made of the MD5 of the text, the document id and the row's place in the scan, so equal texts
stand next to each other and a group of copies, however large, can still be cut between two rows, equal ids or not. The
byte position of every splitter is found by counting: each round sums the exact bytes under all candidate boundaries (the
next three digits of the key) inside the intervals that still hold a splitter, and goes on inside the child that holds it.
The rows then travel once.

Defined results: a null text counts as empty (size 1, CRC 0); a null id sorts before others; repeated rows differ in their
place alone, so they are cut like other copies and take any order of slots; an empty table gives no rows; all input
columns but `doc_id` and `text` are left out of the digest, so clashing names do no harm. With `carry` the input is read
twice and should be a stored table, so that places stay as they are.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from houselights.llm.common import stored

DIGITS = 3
_LOCAL_BITS = 33


@dataclass
class _Interval:
    """Keys that begin with `prefix`; `below` bytes lie under them."""
    prefix: str
    below: int


def sort_key(text: Column, doc_id: Column) -> Column:
    """65 hex digits that sort as (MD5 of the text, id, place of the row)."""
    signed = F.hex(doc_id.cast("bigint").bitwiseXOR(F.lit(-(1 << 63))))
    return F.concat(
        F.md5(F.coalesce(text, F.lit("")).cast("binary")),
        F.coalesce(F.concat(F.lit("1"), F.lpad(signed, 16, "0")), F.lit("0" * 17)),
        F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))


def splitters(keyed: DataFrame, shards: int, tolerance: int = 0) -> list[str]:
    """For each boundary between shards the last key that stays below it. With tolerance 0 shard i ends with the key
    whose bytes reach i/shards of the total; with more, any key within that many bytes of it will do.

    Each round brings back at most (shards - 1) * 16**DIGITS sums, whatever the number of rows.
    """
    found: dict[int, str] = {}
    open_: dict[int, _Interval] = {i: _Interval("", 0) for i in range(1, shards)}
    total = None
    while open_:
        prefixes = sorted({x.prefix for x in open_.values()})
        inside = F.coalesce(*[F.when(F.col("key").startswith(p), F.lit(n)) for n, p in enumerate(prefixes)])
        depth = F.element_at(F.array(*[F.lit(len(p)) for p in prefixes]), F.col("interval") + 1)
        counts: dict[str, list] = {p: [] for p in prefixes}
        for row in (keyed.withColumn("interval", inside).where("interval is not null")
                    .groupBy("interval", F.substring(F.col("key"), depth + 1, F.lit(DIGITS)).alias("digits"))
                    .agg(F.sum("size").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last"))
                    .collect()):
            counts[prefixes[row["interval"]]].append((row["digits"], row["bytes"], row["first"], row["last"]))
        if total is None:
            total = sum(x[1] for x in counts[""])
        if not total:
            return []
        for i, interval in list(open_.items()):
            below = interval.below
            for _, size, first, last in sorted(counts[interval.prefix]):
                if shards * (below + size) >= i * total:
                    break
                below += size
            if first == last or shards * (below + size) - i * total <= shards * tolerance:
                found[i] = last
                del open_[i]
            else:
                open_[i] = _Interval(os.path.commonprefix([first, last]), below)
    return [found[i] for i in range(1, shards)]


def shard_of(key: Column, bounds: list[str]) -> Column:
    """The number of boundaries below the key."""
    out = F.lit(0)
    for bound in bounds:
        out = out + (key > F.lit(bound)).cast("int")
    return out


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row, plus the columns named in `carry`.

    A slot is a row's place in its shard, without gaps. It comes from the place in the range partition after the only
    exchange and the counts of the partitions before it, so no task holds a whole shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        sort_key(F.col("text"), F.col("doc_id")).alias("key"), *([F.struct(*carry).alias("carried")] if carry else []))
    if carry:
        bounds = splitters(stored(keyed.select("key", "size"), "shard-keys"), shards, tolerance)
    else:
        keyed = stored(keyed, "shard-keys")
        bounds = splitters(keyed, shards, tolerance)
    placed = stored(
        keyed.repartitionByRange("key").sortWithinPartitions("key")
        .withColumn("shard", shard_of(F.col("key"), bounds)).withColumn("at", F.monotonically_increasing_id())
        .drop("key"), "shard-rows").withColumns({
            "part": F.shiftright("at", _LOCAL_BITS), "at": F.col("at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))})
    cells = placed.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition and each boundary: bounded by the settings, not by the data.
    cells = cells.select("part", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(cells), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"),
        *([f"carried.{name}" for name in carry]))


def digest(sharded: DataFrame) -> DataFrame:
    """The columns by which a sharding is compared: law `bytes`, whose shards hold nearly equal sizes."""
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        *[c for c in sharded.columns if c not in ("doc_id", "size", "text_crc32", "shard", "slot")])


ORACLE_SQL = """
WITH RECURSIVE poly AS (
  SELECT n::BIGINT AS n, n::BIGINT AS c, 0 AS step FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM poly WHERE step < 8
), crc_table AS (SELECT list(c ORDER BY n) AS t FROM poly WHERE step = 8),
d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, md5(coalesce(text, '')) AS h, hex(encode(coalesce(text, ''))) AS hx
  FROM documents
), b AS (
  SELECT doc_id, size, h, list_transform(range(0, size - 1), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT) AS bytes
  FROM d
), c AS (
  SELECT doc_id, size, h, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes),
    lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]))) AS text_crc32
  FROM b, crc_table
), s AS (
  SELECT *, row_number() OVER (ORDER BY h, doc_id NULLS FIRST) AS n, sum(size) OVER () AS total FROM c
), p AS (
  SELECT *, (16 * (sum(size) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) - size) // total)::INTEGER AS shard FROM s
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY n) - 1)::BIGINT AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""
