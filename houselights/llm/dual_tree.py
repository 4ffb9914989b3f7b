"""Vector code compression: product codebooks by Lloyd's rounds over pairs of trees.

Vectors become integers, are cut into equal parts, and every part position has a codebook. The parts of a block of
vectors stand in the order of a tree that halves them along their widest dimension; the order is worked out once and
stored. Each round builds the same kind of tree over the entries of a codebook and walks both from their roots, level by
level, over pairs of nodes with their bounding boxes. A pair goes once the least distance of its boxes exceeds the greatest
distance to another candidate, so no nearest entry is lost and ties stay. A node of parts with one entry left takes it as a
whole, with its sum from running totals; what is open at the leaves is settled by integer distances, ties to the lower
index. Blocks report counts and sums of each entry alone, and the driver holds the codebooks.

Defined results: null vectors and vectors with null, infinite or undefined components are dropped; null ids come behind
all others; rows with one id are taken in order of their vectors; with fewer vectors than entries each starts an entry;
repeated vectors give repeated entries of which the lowest index is used; null labels are one label; an empty table gives
no rows; other columns are left out. Vectors of unequal lengths, of a length that the parts do not divide, or with
components so large that squared distances leave 63 bits, are refused with a ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from houselights.llm.common import ArrowMap, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LEAF = 32
BLOCK = 2048
#: A label with more than one of so many rows is joined by broadcast; there are fewer such labels than this.
HOT_SHARE = 1024


# --- trees ---------------------------------------------------------------------------------------------------


def halves(n: int, leaf: int) -> list[np.ndarray]:
    """For every level the first rows of its nodes, and n; nodes of more than `leaf` rows have two halves below."""
    levels = [np.array([0, n])]
    while n and np.diff(levels[-1]).max() > leaf:
        starts, sizes = levels[-1][:-1], np.diff(levels[-1])
        middle = starts + (sizes + 1) // 2
        levels.append(np.unique(np.r_[starts, middle[sizes > leaf], n]))
    return levels


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """The rows so that every node of `halves` is a run of them, each cut along its widest dimension."""
    order = np.arange(len(points))
    for bounds in halves(len(points), leaf)[:-1]:
        now, starts = points[order], bounds[:-1]
        widest = np.argmax(np.maximum.reduceat(now, starts) - np.minimum.reduceat(now, starts), axis=1)
        node = np.repeat(np.arange(len(starts)), np.diff(bounds))
        order = order[np.lexsort((now[np.arange(len(now)), widest[node]], node))]
    return order


@dataclass
class Tree:
    """Rows in tree order, the bounds of the nodes of each level, and the boxes around them."""
    points: np.ndarray
    bounds: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]

    @classmethod
    def over(cls, points: np.ndarray, leaf: int) -> Tree:
        bounds = halves(len(points), leaf)
        low, high = [np.minimum.reduceat(points, bounds[-1][:-1])], [np.maximum.reduceat(points, bounds[-1][:-1])]
        for level, below in zip(bounds[-2::-1], bounds[:0:-1]):
            first = np.searchsorted(below, level[:-1])
            low.append(np.minimum.reduceat(low[-1], first))
            high.append(np.maximum.reduceat(high[-1], first))
        return cls(points, bounds, low[::-1], high[::-1])

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of the next level below the given ones, and how many each has."""
        if level + 1 == len(self.bounds):
            return nodes, np.ones(len(nodes), np.int64)
        first = np.searchsorted(self.bounds[level + 1], self.bounds[level])
        count = np.diff(first)[nodes]
        return np.repeat(first[nodes] - np.cumsum(count) + count, count) + np.arange(count.sum()), count


def assign(parts: Tree, entries: Tree, index: np.ndarray
           ) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries: whole nodes as (start, end, entry) triples, then rows with their entry and squared distance.

    index: the index of each row of `entries`, whose leaves are single rows.
    """
    whole, query, entry = [], np.zeros(1, np.int64), np.zeros(1, np.int64)
    p = e = 0
    while True:
        low, high = parts.low[p][query], parts.high[p][query]
        near, far = entries.low[e][entry], entries.high[e][entry]
        least = (np.maximum(0, np.maximum(low - far, near - high)) ** 2).sum(axis=1)
        most = (np.maximum(high - near, far - low) ** 2).sum(axis=1)
        head = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        size = np.diff(np.r_[head, len(query)])
        keep = least <= np.repeat(np.minimum.reduceat(most, head), size)
        left = np.add.reduceat(keep, head)
        if e + 1 == len(entries.bounds):
            sure = np.repeat(left == 1, size)
            done = keep & sure
            if done.any():
                whole.append((parts.bounds[p][query[done]], parts.bounds[p][query[done] + 1], index[entry[done]]))
            keep &= ~sure
        query, entry = query[keep], entry[keep]
        at_leaves = p + 1 == len(parts.bounds) and e + 1 == len(entries.bounds)
        if at_leaves or not len(query):
            break
        below, count = parts.children(p, query)
        under, count = entries.children(e, np.repeat(entry, count))
        query, entry = np.repeat(below, count), under
        order = np.lexsort((entry, query))
        query, entry = query[order], entry[order]
        p, e = min(p + 1, len(parts.bounds) - 1), min(e + 1, len(entries.bounds) - 1)
    return whole, *_settle(parts, entries, index, query, entry)


def _settle(parts: Tree, entries: Tree, index: np.ndarray, query: np.ndarray, entry: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of open leaves, the index of their nearest entry and its distance: one product of whole numbers for each leaf."""
    head = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    reach = max(np.abs(parts.points).max(initial=0), np.abs(entries.points).max(initial=0))
    # Doubles hold whole numbers below 2**53 exactly, and their products are faster.
    kind = np.float64 if 4 * max(1, parts.points.shape[1]) * int(reach) ** 2 < 1 << 53 else np.int64
    points, books = parts.points.astype(kind), entries.points.astype(kind)
    square, size = (points * points).sum(axis=1), (books * books).sum(axis=1)
    bounds, found, n = parts.bounds[-1], [], len(index)
    for start, end in zip(head, np.r_[head[1:], len(query)]):
        a, b, some = bounds[query[start]], bounds[query[start] + 1], entry[start:end]
        away = square[a:b, None] + size[some] - 2 * (points[a:b] @ books[some].T)
        best = (away.astype(np.int64) * n + index[some]).min(axis=1)
        found.append((np.arange(a, b), best % n, best // n))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def nearest(parts: Tree, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of every row of the tree, counts and sums of each entry."""
    order = tree_order(codebook, 1)
    whole, rows, chosen, _ = assign(parts, Tree.over(codebook[order], 1), order)
    codes = np.empty(len(parts.points), np.int64)
    counts, sums = np.zeros(len(codebook), np.int64), np.zeros(codebook.shape, np.int64)
    if whole:
        start, end, entry = (np.concatenate(x) for x in zip(*whole))
        running = np.zeros((len(parts.points) + 1, codebook.shape[1]), np.int64)
        np.cumsum(parts.points, axis=0, out=running[1:])
        np.add.at(counts, entry, end - start)
        np.add.at(sums, entry, running[end] - running[start])
        size = end - start
        codes[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(entry, size)
    codes[rows] = chosen
    np.add.at(counts, chosen, 1)
    np.add.at(sums, chosen, parts.points[rows])
    return codes, counts, sums


# --- jobs ----------------------------------------------------------------------------------------------------


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and label of the rows whose vectors are whole and finite."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull()).where(whole).select(
        F.col("vec_id").cast("bigint"), "embedding", F.col("label").cast("bigint"))


def integers(vectors: list | np.ndarray, scale: int, limit: int) -> np.ndarray:
    out = np.floor(np.asarray(vectors, np.float64) * scale)
    if out.size and np.abs(out).max() >= limit:
        raise ValueError("a component is too large: squared distances would leave 63 bits")
    return out.astype(np.int64)


def limit_for(width: int, entries: int) -> int:
    """Components below this keep width * (2 * component)**2 * entries inside 62 bits, and fit 32."""
    return min(1 << 31, int((2**62 / max(1, width * entries)) ** 0.5) // 2)


def _blocks(length: int, parts: int, scale: int, limit: int, block: int) -> ArrowMap:
    """Vectors to blocks: ids, labels, and for every part position the tree order and the integers in it."""
    width = length // parts

    def pack(ids: list, labels: list, points: np.ndarray) -> pa.RecordBatch:
        points = points.reshape(len(points), parts, width)
        order = [tree_order(points[:, k], LEAF) for k in range(parts)]
        packed = b"".join(points[o, k].astype("<i4").tobytes() for k, o in enumerate(order))
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.int64())),
             pa.array([np.concatenate(order).astype("<i4").tobytes()], pa.binary()), pa.array([packed], pa.binary())],
            ["ids", "labels", "places", "points"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, list, np.ndarray]] = []
        for batch in batches:
            vectors = batch.column(1)
            if (np.diff(vectors.offsets.to_numpy()) != length).any():
                raise ValueError("vectors of unequal lengths")
            points = integers(vectors.flatten().to_numpy(zero_copy_only=False), scale, limit).reshape(batch.num_rows, length)
            held.append((batch.column(0).to_pylist(), batch.column(2).to_pylist(), points))
            while sum(len(x[0]) for x in held) >= block:
                ids, labels = (sum((x[k] for x in held), []) for k in (0, 1))
                points = np.concatenate([x[2] for x in held])
                for at in range(0, len(ids) - block + 1, block):
                    yield pack(ids[at:at + block], labels[at:at + block], points[at:at + block])
                rest = len(ids) % block
                held = [(ids[len(ids) - rest:], labels[len(labels) - rest:], points[len(points) - rest:])]
        if sum(len(x[0]) for x in held):
            yield pack(*(sum((x[k] for x in held), []) for k in (0, 1)), np.concatenate([x[2] for x in held]))

    return run


def _trees(row_points: bytes, n: int, parts: int) -> list[Tree]:
    points = np.frombuffer(row_points, "<i4").astype(np.int64).reshape(parts, n, -1)
    return [Tree.over(x, LEAF) for x in points]


def _tally(codebooks: np.ndarray) -> ArrowMap:
    """Blocks to cells (part, entry, place) and totals; place 0 is the count, the sums follow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((*codebooks.shape[:2], codebooks.shape[2] + 1), np.int64)
        for batch in batches:
            for n, points in zip(batch.column(0).to_pylist(), batch.column(1)):
                for k, tree in enumerate(_trees(points.as_py(), n, len(codebooks))):
                    _, counts, sums = nearest(tree, codebooks[k])
                    totals[k, :, 0] += counts
                    totals[k, :, 1:] += sums
        flat = totals.reshape(-1)
        seen = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(flat[seen])], ["cell", "total"])

    return run


def _encode(codebooks: np.ndarray) -> ArrowMap:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, places, points in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(ids)
                place = np.frombuffer(places, "<i4").reshape(len(codebooks), n)
                codes, error = np.empty((n, len(codebooks)), np.int64), np.zeros(n, np.int64)
                for k, tree in enumerate(_trees(points, n, len(codebooks))):
                    chosen, *_ = nearest(tree, codebooks[k])
                    codes[place[k], k] = chosen
                    error[place[k]] += ((tree.points - codebooks[k][chosen]) ** 2).sum(axis=1)
                text = [row.tobytes().hex() for row in codes.astype(np.uint8)] if codebooks.shape[1] <= 256 else [
                    "".join(f"{x:04x}" for x in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(text, pa.string()), pa.array(error)],
                    ["vec_id", "label", "code", "error"])

    return run


@dataclass
class Codebooks:
    """Fitted entries: an array of (part, entry, position)."""
    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             block: int = BLOCK) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code and error of every kept vector, and the codebooks. A code has two hex digits for each part (four
    with more than 256 entries)."""
    whole = kept(vectors)
    first = [r.embedding for r in whole.select("vec_id", "embedding").orderBy(
        F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()]
    length = len(first[0]) if first else 0
    if any(len(x) != length for x in first) or length % parts:
        raise ValueError(f"vectors need one length that {parts} divides")
    width = length // parts
    limit = limit_for(width, entries)
    codebooks = integers(first, scale, limit).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    blocks = stored(whole.mapInArrow(_blocks(length, parts, scale, limit, block),
                                     "ids array<bigint>, labels array<bigint>, places binary, points binary"), "code-blocks")
    for _ in range(rounds if first else 0):
        totals = np.zeros((*codebooks.shape[:2], width + 1), np.int64)
        flat = totals.reshape(-1)
        # One total for each number of the codebooks.
        for cell, total in (blocks.select(F.size("ids").cast("bigint"), "points").mapInArrow(
                _tally(codebooks), "cell bigint, total bigint").groupBy("cell").agg(F.sum("total")).collect()):
            flat[cell] = total
        used = totals[:, :, 0] > 0
        codebooks[used] = totals[used][:, 1:] // totals[used][:, :1]
    coded = blocks.mapInArrow(_encode(codebooks), "vec_id bigint, label bigint, code string, error bigint")
    return coded, Codebooks(codebooks)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The rows with label_error, the sum of `error` over their label. Frequent labels, fewer than HOT_SHARE, are joined by
    broadcast, so that none of them lands in one task."""
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    total = sums.agg(F.sum("n")).first()[0] or 0
    sums = sums.withColumn("hot", F.col("n") * HOT_SHARE > total).withColumnRenamed("label", "of")
    hot, rest = sums.where("hot").select("of", "label_error"), sums.where(~F.col("hot")).select("of", "label_error")
    same = F.col("label").eqNullSafe(F.col("of"))
    hot = F.broadcast(hot)
    return coded.join(hot, same).drop("of").union(coded.join(hot, same, "left_anti").join(rest, same).drop("of"))


def digest(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    coded, codebooks = compress(vectors, **options)
    return with_label_errors(stored(coded, "codes")).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks.digest()).alias("codebooks_sha256"))


def decode(code: str, codebooks: Codebooks, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for."""
    digits = 2 if codebooks.entries.shape[1] <= 256 else 4
    picks = [int(code[at:at + digits], 16) for at in range(0, len(code), digits)]
    return np.concatenate([codebooks.entries[k, x] for k, x in enumerate(picks)]) / scale


def _statement(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    steps = [f"""
k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, part, list_slice(v, part * len(v) // {parts} + 1, (part + 1) * len(v) // {parts}) AS x
  FROM k, (SELECT unnest(range({parts})) AS part)
), c0 AS MATERIALIZED (SELECT part, r - 1 AS e, x AS c FROM p WHERE r <= {entries})"""]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT part, r, best % {entries} AS e, best // {entries} AS d FROM (
    SELECT p.part, p.r, min(list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT
                            * {entries} + c.e) AS best
    FROM p JOIN c{t} c ON p.part = c.part GROUP BY 1, 2))""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (
  SELECT c.part, c.e, coalesce(m.c, c.c) AS c FROM c{t} c LEFT JOIN (
    SELECT part, e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (
      SELECT part, e, i, sum(y)::DOUBLE AS s, count(*) AS n
      FROM (SELECT part, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM p JOIN a{t} USING (part, r)) GROUP BY 1, 2, 3)
    GROUP BY 1, 2) m ON c.part = m.part AND c.e = m.e)""")
    return "WITH " + ",".join(steps) + f""",
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds}),
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN o USING (r), h
"""


ORACLE_SQL = _statement()
