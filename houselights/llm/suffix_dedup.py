"""Exact removal of repeated passages: every byte covered by a string of `length` bytes that also starts elsewhere.

All suffixes of a corpus cannot be sorted by shuffling them, so they travel in blocks. The suffixes of a document that
start within one window and see the same anchor (the least hash among the 32-byte strings inside their first `length`
bytes) form a block; two equal strings see equal anchors at equal distances, so they lie in blocks with the same anchor.

1. Anchors are counted. A block whose anchor is unique holds no repeated string.
2. Blocks whose whole text occurs twice or more are repeated from end to end and need no sorting.
3. One copy of each remaining block, with its rivals at the same anchor, is range-partitioned at splitters that Spark
   samples, twice: by the bytes from the anchor backwards and by the bytes from the anchor on. Neighbours in either order
   tell how far any other block agrees with this one on that side, and suffixes beyond either reach leave.
4. In the second order each bucket sorts its suffixes by multikey quicksort, with eight bytes as a character: all segments
   of a depth are partitioned together and lone suffixes leave.
5. Suffixes of a bucket's first and last anchor may have equals beyond the boundary. Their distinct strings are compared
   across buckets by a 128-bit hash, in a grouped count with partial sums. So an anchor that a third of the corpus shares
   is cut into many buckets.

No step gathers an anchor's documents: copies are counted, and their positions are joined to the verdict.

Defined results: a null text is empty; texts under `length` bytes lose nothing; repeated rows are copies of each other and
lose their bytes alike; a null id is kept; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from houselights.llm.common import ArrowMap, stored, utf8_rows

LENGTH = 200
ANCHOR = 32
BUCKET_BYTES = 8 << 20
#: Places inside a segment fit beside 40 bits of hash.
_SEGMENT = 1 << 20
_PLACES = (1 << 24) - 1
_WORD = 8
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number that sorts like the bytes."""
    padded = np.concatenate([data, np.zeros(_WORD, np.uint8)])
    return np.ndarray(len(data), ">u8", padded, strides=(1,))


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each position on."""
    n = len(data) - ANCHOR + 1
    words = _words(data).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(ANCHOR // _WORD):
        out ^= words[k * _WORD:k * _WORD + n]
        out *= _K[k]
        out ^= out >> np.uint64(31)
    return out * _K[0]


def blocks(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, anchor place, number of starts and anchor hash of each block of a text."""
    parts = []
    # A very long text goes through in segments that overlap by one string.
    for at in range(0, len(text) - length + 1, _SEGMENT - length + 1):
        data = np.frombuffer(text, np.uint8, min(len(text) - at, _SEGMENT), at)
        marks = _anchor_hashes(data)
        # Least hash first and the last place among equals, in one number.
        rank = marks & ~np.uint64(_PLACES) | (np.uint64(_PLACES) - np.arange(len(marks), dtype=np.uint64))
        width, low = 1, rank
        while 2 * width <= length - ANCHOR + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = length - ANCHOR + 1 - width
        low = np.minimum(low[:len(low) - rest], low[rest:])
        place = np.uint64(_PLACES) - (low & np.uint64(_PLACES))
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        anchor = place[first].astype(np.int64)
        parts.append((first + at, anchor + at, np.diff(np.r_[first, len(place)]), marks[anchor]))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _list_anchors(length: int) -> ArrowMap:
    """Rows (mark, body, doc_id, row, spot); body hashes the block's text, spot packs start, anchor offset and count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            taken = []
            for n, text in enumerate(utf8_rows(batch.column(2))):
                if text is None or len(text) < length:
                    continue
                first, anchor, count, mark = blocks(text, length)
                body = [xxhash.xxh3_128_digest(text[a:a + c + length - 1]) for a, c in zip(first.tolist(), count.tolist())]
                taken.append(np.full(len(first), n))
                out[0].append(mark.view(np.int64))
                out[1].extend(body)
                out[2].append(first << 16 | (anchor - first) << 8 | count - 1)
            if not taken:
                continue
            rows = pa.array(np.concatenate(taken))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(out[0])), pa.array(out[1], pa.binary()), batch.column(0).take(rows),
                batch.column(1).take(rows), pa.array(np.concatenate(out[2]))], ["mark", "body", "doc_id", "row", "spot"])

    return run


def _cut_blocks(length: int) -> ArrowMap:
    """From rows (doc_id, row, packed text, blocks wanted): the bytes before the anchor, last one first, those from the
    anchor on, spot, alone, doc_id, row. A task cuts a repeated row once, so that equal blocks do not pile up in a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int | None, int]] = set()
        for batch in batches:
            for n in range(batch.num_rows):
                name = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                if name in seen:
                    continue
                seen.add(name)
                text = unpack(batch.column(2)[n].as_py())
                wanted = batch.column(3)[n].as_py()
                spots = np.array([x["spot"] for x in wanted], np.int64)
                first, lead = spots >> 16, (spots >> 16) + (spots >> 8 & 255)
                end = first + (spots & 255) + length
                one = pa.array([n] * len(spots))
                yield pa.RecordBatch.from_arrays([
                    pa.array([text[a:b][::-1] for a, b in zip(first.tolist(), lead.tolist())], pa.binary()),
                    pa.array([text[a:b] for a, b in zip(lead.tolist(), end.tolist())], pa.binary()),
                    pa.array(spots), pa.array([x["alone"] for x in wanted], pa.bool_()),
                    batch.column(0).take(one), batch.column(1).take(one)],
                    ["left", "right", "spot", "alone", "doc_id", "row"])

    return run


def _agreement(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def reaches(texts: list[bytes], leads: list[bytes], head: bool, tail: bool) -> np.ndarray:
    """For sorted texts how far the better of two neighbours with the same lead agrees; -1 where there is none. The first
    row of a bucket (head) and its last one (tail) have unseen neighbours: they may agree altogether."""
    out = np.full(len(texts), -1, np.int64)
    for n in range(1, len(texts)):
        if leads[n] == leads[n - 1]:
            both = _agreement(texts[n], texts[n - 1])
            out[n] = both
            out[n - 1] = max(out[n - 1], both)
    if head:
        out[0] = len(texts[0])
    if tail:
        out[-1] = len(texts[-1])
    return out


def _reach_backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to blocks sorted by (lead, left, right) how far any other agrees to the left. A batch waits for the next one,
    so that its last row sees its neighbour."""
    held, head = None, True
    names = ["left", "right", "spot", "alone", "doc_id", "row"]

    def emit(rows: pa.RecordBatch, shown: int, since: int, tail: bool) -> pa.RecordBatch:
        reach = reaches(rows.column(0).to_pylist(), [x[:ANCHOR] for x in rows.column(1).to_pylist()], head, tail)
        rows = rows.slice(since, shown - since)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(reach[since:shown])], [*names, "reach"])

    since = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is None:
            held = batch
            continue
        both = pa.Table.from_batches([held, batch.slice(0, 1)]).combine_chunks().to_batches()[0]
        yield emit(both, held.num_rows, since, False)
        # The last row shown goes on as the neighbour of the next ones.
        held = pa.Table.from_batches([held.slice(held.num_rows - 1), batch]).combine_chunks().to_batches()[0]
        since, head = 1, False
    if held is not None:
        yield emit(held, held.num_rows, since, True)


def multikey_sort(group: np.ndarray, start: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (places in `start`) that share their group and their first `length` bytes with another one: their numbers
    and the numbers of their segments."""
    words = _words(data)
    item = np.argsort(group, kind="stable")
    segment = group[item]
    item, segment = _without_lone(item, segment)
    for depth in range(0, length, _WORD):
        if not len(item):
            break
        depth = min(depth, length - _WORD)
        char = words[start[item] + depth].astype(np.uint64)
        same = segment[1:] == segment[:-1]
        split = same & (char[1:] != char[:-1])
        if not split.any():
            continue
        # Only the segments whose characters differ are partitioned.
        moving = np.isin(segment, np.unique(segment[1:][split]))
        order = np.lexsort((char[moving], segment[moving]))
        item[moving], char[moving] = item[moving][order], char[moving][order]
        segment = np.cumsum(np.r_[False, (segment[1:] != segment[:-1]) | (char[1:] != char[:-1])])
        item, segment = _without_lone(item, segment)
    return item, segment


def _without_lone(item: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.ones(len(segment) + 1, bool)
    edge[1:-1] = segment[1:] != segment[:-1]
    keep = ~(edge[1:] & edge[:-1])[:len(item)]
    return item[keep], segment[keep]


def _string_hashes(start: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the `length` bytes from each place on."""
    words = _words(data)
    one, two = np.zeros(len(start), np.uint64), np.full(len(start), _K[3])
    for depth in [*range(0, length - _WORD, _WORD), length - _WORD]:
        char = words[start + depth].astype(np.uint64)
        one = (one ^ char) * _K[0]
        one ^= one >> np.uint64(32)
        two = (two ^ char) * _K[1]
        two ^= two >> np.uint64(29)
    return (one * _K[2]).view(np.int64), (two * _K[3]).view(np.int64)


def _search_bucket(length: int, room: int = 4 << 20) -> ArrowMap:
    """From blocks sorted by (right, left): spans decided here, and the distinct strings of the bucket's first and last
    lead, whose equals may lie in other buckets. Leads are taken a few at a time, so memory follows `room` or one lead."""
    def solve(rows: list[pa.RecordBatch], open_: list[bool], head: bool, tail: bool) -> pa.RecordBatch:
        batch = pa.Table.from_batches(rows).combine_chunks()
        lefts, rights = batch["left"].to_pylist(), batch["right"].to_pylist()
        leads = [x[:ANCHOR] for x in rights]
        forward, backward = reaches(rights, leads, head, tail), batch["reach"].to_numpy()
        lead = np.cumsum([False, *(a != b for a, b in zip(leads, leads[1:]))])
        spots = batch["spot"].to_numpy()
        data = np.frombuffer(b"".join(x for a, b in zip(lefts, rights) for x in (a[::-1], b)), np.uint8)
        base = np.r_[0, np.cumsum([len(a) + len(b) for a, b in zip(lefts, rights)])][:-1]
        count = (spots & 255) + 1
        block = np.repeat(np.arange(len(rights)), count)
        step = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
        ahead = (spots >> 8 & 255)[block] - step  # of the anchor
        # A string that occurs in another block agrees with it to the left and to the right of the anchor.
        keep = (ahead <= backward[block]) & (length - ahead <= forward[block])
        block, step, ahead = block[keep], step[keep], ahead[keep]
        start, place = base[block] + step, (spots >> 16)[block] + step
        # Equal strings see their anchor at the same distance.
        item, segment = multikey_sort(lead[block] * 256 + ahead, start, data, length)
        alone = batch["alone"].to_numpy(zero_copy_only=False)
        decided = np.sort(item[alone[block[item]]])
        # Adjacent starts of a block give one span.
        new = np.r_[True, (np.diff(place[decided]) != 1) | (np.diff(block[decided]) != 0)][:len(decided)]
        first, last = decided[new], decided[np.r_[new[1:], True][:len(decided)]]
        # One of each segment of equals, and every lone suffix.
        sent = np.array(open_)[block]
        sent[item[1:][segment[1:] == segment[:-1]]] = False
        sent = np.flatnonzero(sent)
        one, two = _string_hashes(start[sent], data, length)
        rows_of, nothing = pa.array(np.concatenate([block[first], block[sent]])), pa.nulls(len(first), pa.int64())
        return pa.RecordBatch.from_arrays([
            batch["doc_id"].combine_chunks().take(rows_of), batch["row"].combine_chunks().take(rows_of),
            pa.array(np.concatenate([place[first], place[sent]])),
            pa.array(np.concatenate([place[last] + length, place[sent] + length])),
            pa.concat_arrays([nothing, pa.array(one)]), pa.concat_arrays([nothing, pa.array(two)]),
        ], ["doc_id", "row", "start", "end", "one", "two"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        """The rows of one lead after the other."""
        name, held = None, []
        for batch in batches:
            leads = [x[:ANCHOR] for x in batch.column(1).to_pylist()]
            cuts = [n for n in range(len(leads)) if not n or leads[n] != leads[n - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(leads)]):
                if leads[a] != name and held:
                    yield held
                    held = []
                name = leads[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, flags, size, head = [], [], 0, True
        waiting = None
        for number, rows in enumerate(groups(batches)):
            if waiting is not None:
                held, flags, size = held + waiting[0], flags + waiting[1], size + waiting[2]
                if size >= room:
                    yield solve(held, flags, head, False)
                    held, flags, size, head = [], [], 0, False
            # Whether a lead is the last one is known only after it: it waits.
            waiting = rows, [number == 0] * sum(x.num_rows for x in rows), sum(x.column(1).nbytes for x in rows)
        if waiting is not None:
            yield solve(held + waiting[0], flags + [True] * len(waiting[1]), head, True)

    return run


def unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = pa.array([squeeze(x or b"") for x in utf8_rows(batch.column(2))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["doc_id", "row", "packed"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_bytes, n_removed, n_spans and the digest of what is left, from (doc_id, row, packed, spans)."""
    for batch in batches:
        out = []
        for packed, spans in zip(batch.column(2), batch.column(3)):
            text = unpack(packed.as_py())
            kept, runs = cut(text, [(x["start"], x["end"]) for x in spans.as_py() or ()])
            out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        a, b, c, d = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()),
             pa.array(d, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the spans, and the maximal removed runs."""
    runs: list[list[int]] = []
    for start, end in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), [tuple(x) for x in runs]


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans (doc_id, row, start, end) in bytes, overlapping, of the strings that occur twice; row hashes the text."""
    if not ANCHOR + _WORD <= length <= ANCHOR + 255:
        raise ValueError(f"length must lie between {ANCHOR + _WORD} and {ANCHOR + 255} bytes")
    texts = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("row"), "text")
    anchors = stored(texts.mapInArrow(
        _list_anchors(length), "mark bigint, body binary, doc_id bigint, row bigint, spot bigint"), "anchors")
    # Counted keys are stored before the join, which can then split a mark that very many rows share.
    common = stored(anchors.groupBy("mark").count().where("count > 1").select("mark"), "marks")
    shared = stored(anchors.join(common, "mark"), "anchors-shared")
    copies = stored(shared.groupBy("mark", "body").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "row", "spot")).alias("at")), "blocks")
    # Where all blocks of an anchor are the same there is nothing to sort.
    rivals = stored(copies.groupBy("mark").count().where("count > 1").select("mark"), "rivals")
    wanted = (copies.join(rivals, "mark").groupBy("at.doc_id", "at.row")
              .agg(F.collect_list(F.struct("at.spot", (F.col("copies") == 1).alias("alone"))).alias("wanted")))
    packed = texts.mapInArrow(_pack, "doc_id bigint, row bigint, packed binary")
    block = "left binary, right binary, spot bigint, alone boolean, doc_id bigint, row bigint"
    cuts = stored(
        packed.join(wanted.withColumnsRenamed({"doc_id": "_id", "row": "_row"}),
                    F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
        .select("doc_id", "row", "packed", "wanted").mapInArrow(_cut_blocks(length), block), "cuts")
    size = cuts.agg(F.sum(F.octet_length("left") + F.octet_length("right"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    backwards = [F.substring("right", 1, ANCHOR), F.col("left"), F.col("right")]
    marked = stored(cuts.repartitionByRange(buckets, *backwards).sortWithinPartitions(*backwards)
                    .mapInArrow(_reach_backwards, f"{block}, reach bigint"), "cuts-backwards")
    found = stored(
        marked.repartitionByRange(buckets, "right", "left").sortWithinPartitions("right", "left")
        .mapInArrow(_search_bucket(length),
                    "doc_id bigint, row bigint, start bigint, end bigint, one bigint, two bigint"), "bucket-spans")
    across = found.where("one is not null")
    again = stored(across.groupBy("one", "two").count().where("count > 1").select("one", "two"), "strings")
    spans = ["doc_id", "row", "start", "end"]
    whole = shared.join(copies.where("copies > 1").select("mark", "body"), ["mark", "body"]).select(
        "doc_id", "row", F.shiftright("spot", 16).alias("start"),
        (F.shiftright("spot", 16) + F.col("spot").bitwiseAND(255) + length).alias("end"))
    return whole.union(found.where("one is null").select(spans)).union(
        across.join(again, ["one", "two"]).select(spans))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    spans = repeated_spans(docs, length).groupBy("doc_id", "row").agg(
        # A set: repeated rows have the same spans, and all of them arrive here.
        F.collect_set(F.struct("start", "end")).alias("spans")).withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    packed = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("row"), "text").mapInArrow(
        _pack, "doc_id bigint, row bigint, packed binary")
    return packed.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left").select(
        "doc_id", "row", "packed", "spans").mapInArrow(
            _remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
