"""Near-duplicate groups of documents by SimHash, searched through a Gray-order hierarchical index.

Fingerprints are compared only inside buckets that share a masked bit pattern: of four blocks of bits at least one is
untouched by three or fewer differences, so each distinct fingerprint goes to four buckets and no pair is lost. A bucket
with more than `hot` fingerprints is split again by the same rule over its free bits, level by level, until its parts are
small; after the last level a bucket has 15 free bits and so a size bounded by construction. Inside a bucket the
fingerprints are sorted by Gray rank, eight neighbours at a time share a node that holds the bits they agree on, and a
search from the root adds up the differences on each node's own bits and leaves a whole group once they exceed the radius.

A bucket reports a spanning forest of its links, not its pairs; the forests are joined into components by alternating
star contractions over tables in the shared folder.

Defined results: null and wordless texts have fingerprint zero and are linked like any other; repeated rows get one row
each; a null id never names a component unless all its ids are null; an empty table gives no rows; other input columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from houselights.llm.common import ArrowMap, stored, utf8_rows

RADIUS = 3
FANOUT = 8
LEVELS = 5
SEED = 42
_CHUNK = 1 << 18


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of the lower-cased words' shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    counts, total = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, _CHUNK):
        part = words[at:at + _CHUNK + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.array([digest(x, SEED) for x in grams], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and `bits`, the fingerprint as a signed number, of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(x, shingle) for x in utf8_rows(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, bits bigint")


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """The place of each pattern in the reflected Gray code."""
    rank = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets that the pairs connect; parent points every element at the least of its set."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
    return parent


class GrayIndex:
    """The hierarchical index over whole buckets of fingerprints, sorted by Gray rank inside each."""

    def __init__(self, bits: np.ndarray, bucket: np.ndarray):
        """bucket: non-decreasing bucket numbers of the rows."""
        self.bits, n = bits, len(bits)
        self.first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, np.int64)
        self.size = np.diff(np.r_[self.first, n])
        # A level holds the first child (or row) of each node, the shared pattern, the mask, and the last row below it.
        own, ones, zeros, last = np.repeat(np.arange(len(self.first)), self.size), bits, bits, np.arange(n)
        self.levels = []
        child_mask = np.full(n, ~np.uint64(0))
        while len(own) and (not self.levels or len(own) > len(self.first)):
            head = np.searchsorted(own, np.arange(len(self.first)))
            group = (np.arange(len(own)) - head[own]) // FANOUT
            start = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (group[1:] != group[:-1])])
            end = np.r_[start[1:], len(own)]
            below = {"pattern": ones, "last": last}
            ones, zeros = np.bitwise_and.reduceat(ones, start), np.bitwise_or.reduceat(zeros, start)
            mask = ~(ones ^ zeros)
            # The children keep only the bits that the parent does not already fix.
            below["mask"] = child_mask & ~np.repeat(mask, end - start)
            self.levels.append((start, end - start, below))
            child_mask, own, last = mask, own[start], last[end - 1]

    def links(self, radius: int, room: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one bucket that differ in at most `radius` bits, a part at a time."""
        buckets = np.flatnonzero(self.size > 1)
        rows = np.repeat(self.first[buckets], self.size[buckets])
        rows = rows + np.arange(len(rows)) - np.repeat(np.cumsum(self.size[buckets]) - self.size[buckets], self.size[buckets])
        top, width = np.repeat(buckets, self.size[buckets]), np.cumsum(np.repeat(self.size[buckets], self.size[buckets]))
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(width, (width[at - 1] if at else 0) + room)))
            query, node, seen = rows[at:to], top[at:to], np.zeros(to - at, np.uint8)
            for start, count, child in reversed(self.levels):
                n = count[node]
                query, seen = np.repeat(query, n), np.repeat(seen, n)
                node = np.repeat(start[node] - np.cumsum(n) + n, n) + np.arange(len(query))
                seen = seen + np.bitwise_count((self.bits[query] ^ child["pattern"][node]) & child["mask"][node])
                keep = (seen <= radius) & (child["last"][node] > query)
                query, node, seen = query[keep], node[keep], seen[keep]
            yield query, node
            at = to


def _bucket_forests(radius: int) -> ArrowMap:
    """From rows (mask, pattern, bits) sorted by bucket: links that span each bucket's components."""
    def solve(mask: np.ndarray, pattern: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        bits = bits.view(np.uint64)
        bucket = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])])
        order = np.lexsort((gray_rank(bits), bucket))
        bits, parent = bits[order], np.arange(len(bits))
        for a, b in GrayIndex(bits, bucket).links(radius):
            parent = _roots(parent, a, b)
        linked = np.flatnonzero(parent != np.arange(len(bits)))
        return pa.RecordBatch.from_arrays(
            [pa.array(bits[linked].view(np.int64)), pa.array(bits[parent[linked]].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(held, batch.columns)]
            if len(held[0]) >= _CHUNK:
                # All but the last bucket are complete.
                cut = int(np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))[-1:].sum() + 1)
                if cut > 1:
                    yield solve(*(x[:cut] for x in held))
                    held = [x[cut:] for x in held]
        if len(held[0]):
            yield solve(*held)

    return run


def _blocks(mask: int) -> list[int]:
    """The masks that fix, beside `mask`, one of four runs of its free bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // 4 for k in range(5)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spread(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Each row of bucket `mask` goes to the four buckets below it."""
    choices = F.coalesce(*[F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(x)) for x in _blocks(m)]))
                           for m in masks])
    return rows.select(F.explode(choices).alias("mask"), "bits").select(
        "mask", F.col("bits").bitwiseAND(F.col("mask")).alias("pattern"), "bits")


def links(distinct: DataFrame, radius: int = RADIUS, hot: int = 1024) -> DataFrame:
    """Links (a, b) between distinct fingerprints `bits` whose components are those of all pairs within the radius."""
    if radius > RADIUS:
        raise ValueError("four blocks find at most three differences")
    out, masks = [], [0]
    rows = distinct.select(F.lit(0).cast("bigint").alias("mask"), "bits")
    schema = "a bigint, b bigint"
    for level in range(LEVELS):
        rows = _spread(rows, masks)
        masks = [x for m in masks for x in _blocks(m)]
        crowded = None
        if level < LEVELS - 1:
            rows = stored(rows, "simhash-buckets")
            crowded = stored(rows.groupBy("mask", "pattern").count().where(F.col("count") > hot), "simhash-crowded")
            crowded = None if crowded.isEmpty() else crowded.withColumnRenamed("count", "crowd")
        calm = rows if crowded is None else rows.join(crowded, ["mask", "pattern"], "left").where("crowd is null")
        out.append(calm.select("mask", "pattern", "bits").repartition("mask", "pattern")
                   .sortWithinPartitions("mask", "pattern").mapInArrow(_bucket_forests(radius), schema))
        if crowded is None:
            break
        rows = rows.join(crowded, ["mask", "pattern"]).select("mask", "bits")
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node reachable, for every node of an edge (a, b) but the roots: large and small stars in
    turn."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            .alias("e")).select("e.u", "e.v").where("u != v").distinct()
        edges = stored(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, hot: int = 1024) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least id among the documents reachable over links of
    at most `radius` differing bits."""
    marked = stored(fingerprints(docs, shingle), "simhash")
    distinct = stored(marked.groupBy("bits").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = components(links(distinct, radius, hot))
    rooted = distinct.join(roots, distinct["bits"] == roots["node"], "left").select(
        "bits", "least_id", F.coalesce("root", "bits").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root")
    return marked.join(named.select("bits", "component_id"), "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The input rows without near duplicates: of every component the row with the least id and text hash, null ids last;
    of repeated rows one."""
    key = {"_id": F.coalesce("doc_id", F.lit(0)), "_no_id": F.col("doc_id").isNull(), "_text": F.xxhash64("text")}
    named = [c.alias(n) for n, c in key.items()]
    # Components named by text hashes, which are never null, keep apart what null and repeated ids would mix up.
    parts = near_duplicates(docs.select(F.xxhash64("text").alias("doc_id"), "text"), **options).select(
        F.col("doc_id").alias("_text"), "component_id").distinct()
    least = docs.select(*named).groupBy("_text").agg(F.min(F.struct("_no_id", "_id")).alias("least"))
    stay = least.join(parts, "_text").groupBy("component_id").agg(
        F.min(F.struct("least._no_id", "least._id", "_text")).alias("least")).select("least.*")
    kept = docs.select(F.struct("*").alias("_row"), *named).join(stay, list(key), "left_semi")
    # The join has dealt rows by key, so repeated rows meet without a further exchange.
    return kept.dropDuplicates(list(key)).select("_row.*")
