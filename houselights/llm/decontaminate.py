"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's word windows.

Texts are normalised byte by byte (A-Z to a-z, ASCII other than letters and digits to a blank), so a word keeps its place:
the offsets of a hit are those of the original text. Benchmark words get numbers, windows become number sequences in the
automaton, and each document is read once as the sequence of its words' numbers (0: no benchmark word).

The benchmark is a stated test set. Spark writes its rows to files in the shared folder, in as many sets as it takes for an
automaton to hold about `room` words; the driver sees their names only, and a task reads them where it runs. Several
automata are built one after the other, each for `HELD` bytes of documents, so that building is a small part of the work.

Defined results: null, empty and wordless texts have no words, no hits and are clean; null or wordless items have no
window; items with the same id count once; repeated documents get one row each; an empty benchmark leaves all documents
clean; other columns of the input are kept by `clean` and left out by `hits`.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from houselights.llm.common import ArrowMap, utf8_rows
from houselights.session import scratch_folder

WINDOW = 13
ROOM = 2_000_000
#: Bytes of documents that pass one automaton before the next one is built.
HELD = 64 << 20
#: Word bytes stay (capitals as small letters), every other byte becomes a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

SCHEMA = ("doc_id bigint, n_words bigint, n_hit bigint, item_ids array<string>, "
          "spans array<struct<start: bigint, end: bigint>>")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


def windows(item: list[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    if item:
        yield from (tuple(item[i:i + size]) for i in range(max(1, len(item) - size + 1)))


class Matcher:
    """The automaton over the windows of (item id, text) rows."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            for window in windows(words(text), size):
                found.setdefault(tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window), set()).add(name)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, names in found.items():
            self.automaton.add_word(window, (len(window), frozenset(names)))
        self.automaton.make_automaton()
        self.empty = not found

    def search(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The word runs [first, after the last) that windows cover, and the items they come from."""
        if self.empty or not sequence:
            return [], set()
        number = self.numbers.get
        runs, names = [], set()
        for end, (size, owners) in self.automaton.iter(tuple([number(w, 0) for w in sequence])):
            runs.append((end - size + 1, end + 1))
            names |= owners
        return runs, names


def character_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs of words as offsets into the original text, in code points, end exclusive."""
    data = np.frombuffer(text.translate(NORMAL), np.uint8)
    edge = np.diff(np.r_[False, data != 32, False].astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    before = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
    return [(int(before[first[a]]), int(before[last[b - 1]])) for a, b in runs]


_built: dict[str, Matcher] = {}


def read_items(place: str) -> list[tuple[str, bytes]]:
    """The (item id, text) rows of a set's folder."""
    system, folder = fs.FileSystem.from_uri(place)
    rows = []
    for found in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if posixpath.basename(found.path).startswith("part-"):
            for batch in pq.ParquetFile(found.path, filesystem=system).iter_batches(columns=["id", "text"]):
                rows += zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1)))
    return sorted(rows)


def _matcher(place: str, size: int) -> Matcher:
    """The latest automaton stays in the Python worker, for its next tasks; a set's folder is never written twice."""
    key = f"{size} {place}"
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(read_items(place), size)
    return _built[key]


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


_TYPES = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _hits(texts: list[bytes | None], sets: list[str], size: int) -> list[tuple]:
    """n_words, n_hit, item_ids and spans of each text."""
    found = [([], set()) for _ in texts]
    for place in sets:
        matcher = _matcher(place, size)
        for n, text in enumerate(texts):
            runs, names = matcher.search(words(text))
            found[n] = (found[n][0] + runs, found[n][1] | names)
    out = []
    for text, (runs, names) in zip(texts, found):
        runs = _joined(runs)
        spans = [{"start": a, "end": b} for a, b in character_spans(text, runs)] if runs else []
        out.append((len(words(text)), sum(b - a for a, b in runs), sorted(names), spans))
    return out


def _in_turn(batches: Iterator[pa.RecordBatch], sets: list[str], size: int, at: int,
             room: int = HELD) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Each batch with its hits. With several sets batches wait until they hold `room` bytes."""
    held, total = [], 0

    def flush() -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        found = _hits([x for batch in held for x in utf8_rows(batch.column(at))], sets, size)
        since = 0
        for batch in held:
            yield batch, found[since:since + batch.num_rows]
            since += batch.num_rows

    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if len(sets) < 2 or total >= room:
            yield from flush()
            held, total = [], 0
    yield from flush()


def _scan(sets: list[str], size: int) -> ArrowMap:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _in_turn(batches, sets, size, 1):
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES.types[1:]))], schema=_TYPES)

    return run


def _filter(sets: list[str], size: int, at: int) -> ArrowMap:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _in_turn(batches, sets, size, at):
            yield batch.filter(pa.array([not contaminated(n, hit) for n, hit, *_ in found], pa.bool_()))

    return run


def contaminated(n_words, n_hit):
    """At least one word in twenty is covered; for numbers and for columns."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def item_sets(benchmark: DataFrame, room: int = ROOM) -> list[str]:
    """The folders of the benchmark's sets, of about `room` words each, after measuring it on the cluster."""
    clean = benchmark.where("text is not null").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text")
    total = clean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = max(1, -(-total // (2 * room)))  # a word and the blank after it take two bytes at least
    place = scratch_folder(benchmark.sparkSession, "benchmark-sets")
    clean.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(sets))).repartition("part").write.partitionBy(
        "part").parquet(place)
    return [f"{place}/part={k}" for k in range(sets)]


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, room: int = ROOM) -> DataFrame:
    """For every document: n_words, n_hit, the item ids sorted as strings, and hit spans in the original text."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_scan(item_sets(benchmark, room), size), SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, room: int = ROOM) -> DataFrame:
    """The input rows whose text is not contaminated, with all their columns."""
    return docs.mapInArrow(_filter(item_sets(benchmark, room), size, docs.columns.index("text")), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns by which results are compared."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


ORACLE_SQL = r"""
WITH normal AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM item WHERE len(w) > 0)
), spots AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM normal, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), found AS (
  SELECT doc_id, i, s.n, item_id
  FROM spots s JOIN windows v ON v.n = s.n AND v.words = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM normal d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
