"""Token ids in binary plane files.

Documents are dealt by range of (id, hash of the text, row), encoded where they land, and each task writes its files in
order. A file holds blocks of `BLOCK` ids: a block's 32-bit numbers are transposed into four byte planes (or 32 bit
planes), each compressed with zstandard, so that the planes of high bytes shrink to nothing. Blocks of document ids and
lengths are stored alike. The footer is the chunk index: offset, sizes of the planes, count and CRC of every block; a
reader of some positions fetches the blocks that hold them and no others.

File names are never used twice. The table that `write` returns names the files of the tasks that finished, so what a lost
executor leaves half written is not read. Files go through `pyarrow.fs`: a local or mounted folder, S3, GCS or HDFS.

Encoding is that of the `tokenizers` library over whole texts. A vocabulary that drops white space merges letters inside
pre-tokens alone, so each distinct pre-token is encoded once and its ids are joined.

Defined results: null and empty texts have the end id alone; null document ids come first; rows with one id stand in order
of a hash of their text, and equal rows in any order, each with its own place; an empty table writes no file and returns
no rows; other columns are left out.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from houselights.llm.common import ArrowMap, stored, utf8_rows

END = 1
BLOCK = 1 << 16
FILE_IDS = 1 << 25
LEVEL = 3
_MAGIC = b"HLPLANE1"
_KNOWN = 300_000
#: Keys longer than this are encoded each time they occur.
_KNOWN_LENGTH = 64

# How that pre-tokenizer cuts lower-cased words of ASCII and the Latin-1 letters, which its normalizer only
# lowers.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[^a-z0-9\xDF-\xF6\xF8-\xFF\x09-\x0D\x20]+")
_NOT_PLAIN = re.compile(r"[^\x09-\x0D\x20-\x7E\xC0-\xD6\xD8-\xF6\xF8-\xFF]")
_BLANK = re.compile(r"[\x09-\x0D\x20]")
_SLICE = 1 << 18


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible ones for themselves, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


_LETTERS = _byte_letters()
#: What a Latin-1 letter becomes when its two bytes are spelt in such letters.
_SPELT = {c: "".join(_LETTERS[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}

# The steps of a vocabulary that drops white space and looks at nothing beyond it.
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}


class TextEncoder:
    """Ids of texts as little-endian 32-bit numbers: by way of distinct pre-tokens where the vocabulary's steps are
    known to keep to them, else text by text."""

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        steps = json.loads(vocabulary)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [x.content for x in added]
        self.wordwise = all(steps[k] == v for k, v in _WORDWISE.items()) and steps["truncation"] is steps["padding"] is None and all(
            x and len(x.split()) == 1 for x in self.special) and not any(x.lstrip or x.rstrip for x in added)
        # Two generations: what the older one alone holds goes when the younger one is full.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        """A pre-token of plain letters or signs needs the merges alone."""
        spelt = part if part.isascii() else part.translate(_SPELT)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()

    def _joined(self, keys: list[str], encode: Callable[[str], bytes]) -> bytes:
        """The ids of all keys in a row, each distinct key encoded once."""
        if len(self.known) > _KNOWN:
            self.known, self.older = {}, self.known
        known, long = self.known, {}
        for key in set(keys).difference(known):
            (known if len(key) <= _KNOWN_LENGTH else long)[key] = self.older.get(key) or encode(key)
        if long:
            return b"".join(long[x] if x in long else known[x] for x in keys)
        return b"".join(map(known.__getitem__, keys))

    def encode(self, text: bytes | None) -> bytes:
        text = (text or b"").decode(errors="replace")
        if not self.wordwise:
            return self._whole(text)
        out, at = [], 0
        while at < len(text):
            cut = _BLANK.search(text, at + _SLICE)
            piece = text[at:cut.start() if cut else len(text)]
            at += len(piece)
            if _NOT_PLAIN.search(piece) or any(x in piece for x in self.special):
                for word in piece.encode().split():
                    word = word.decode()
                    if _NOT_PLAIN.search(word) or any(x in word for x in self.special):
                        # The blank keeps whole words apart from pre-tokens.
                        out.append(self._joined([" " + word], self._whole))
                    else:
                        out.append(self._joined(_PARTS.findall(word.lower()), self._part))
            else:
                out.append(self._joined(_PARTS.findall(piece.lower()), self._part))
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> TextEncoder:
    """One encoder for all tasks of a Python worker."""
    return TextEncoder(vocabulary)


def split_planes(raw: bytes, width: int, kind: str) -> list[bytes]:
    """The planes of little-endian numbers of `width` bytes: byte by byte, or bit by bit from the lowest."""
    rows = np.frombuffer(raw, np.uint8).reshape(-1, width).T
    if kind == "byte":
        return [np.ascontiguousarray(x).tobytes() for x in rows]
    return [np.packbits(x >> k & 1).tobytes() for x in rows for k in range(8)]


def join_planes(planes: list[bytes], n: int, width: int, kind: str) -> bytes:
    out = np.zeros((n, width), np.uint8)
    for at, plane in enumerate(planes):
        data = np.frombuffer(plane, np.uint8)
        if kind == "byte":
            out[:, at] = data
        else:
            out[:, at // 8] |= np.unpackbits(data, count=n) << (at % 8)
    return out.tobytes()


@dataclass
class _Blocks:
    """One column of a file: numbers of `width` bytes that are written block by block."""
    width: int
    held: bytearray = field(default_factory=bytearray)
    chunks: list = field(default_factory=list)

    def add(self, raw: bytes, out: _Writer, last: bool = False) -> None:
        self.held += raw
        size = out.block * self.width
        while len(self.held) >= size or last and self.held:
            raw = bytes(self.held[:size])
            del self.held[:size]
            packed = [out.packer.compress(p) for p in split_planes(raw, self.width, out.kind)]
            self.chunks.append([out.at, [len(p) for p in packed], len(raw) // self.width, zlib.crc32(raw)])
            out.put(b"".join(packed))


class _Writer:
    """One plane file."""

    def __init__(self, place: str, name: str, kind: str, block: int):
        system, folder = fs.FileSystem.from_uri(place)
        system.create_dir(folder)
        self.stream = system.open_output_stream(f"{folder}/{name}")
        self.name, self.kind, self.block, self.at = name, kind, block, 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.ids, self.names, self.lengths, self.nulls = _Blocks(4), _Blocks(8), _Blocks(8), _Blocks(1)
        self.n_documents = self.n_ids = 0
        self.put(_MAGIC)

    def put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.add(ids, self)
        self.names.add((doc_id or 0).to_bytes(8, "little", signed=True), self)
        self.lengths.add((len(ids) // 4).to_bytes(8, "little"), self)
        self.nulls.add(bytes([doc_id is None]), self)
        self.n_documents += 1
        self.n_ids += len(ids) // 4

    def close(self) -> tuple[str, int, int]:
        columns = {"ids": self.ids, "names": self.names, "lengths": self.lengths, "nulls": self.nulls}
        for column in columns.values():
            column.add(b"", self, last=True)
        footer = json.dumps({"planes": self.kind, "block": self.block, "chunks": {
            name: column.chunks for name, column in columns.items()}}).encode()
        footer = self.packer.compress(footer)
        self.put(footer + len(footer).to_bytes(8, "little") + _MAGIC)
        self.stream.close()
        return self.name, self.n_documents, self.n_ids


class PlaneFile:
    """A plane file open for reading; blocks are fetched as they are asked for."""

    WIDTHS = {"ids": 4, "names": 8, "lengths": 8, "nulls": 1}

    def __init__(self, place: str, name: str):
        system, folder = fs.FileSystem.from_uri(place)
        self.file, self.name = system.open_input_file(f"{folder}/{name}"), name
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != _MAGIC:
            raise ValueError(f"{name} is no plane file")
        length = int.from_bytes(tail[:8], "little")
        self.unpacker = zstandard.ZstdDecompressor()
        footer = json.loads(self.unpacker.decompress(self.file.read_at(length, size - 16 - length)))
        self.kind, self.block, self.chunks = footer["planes"], footer["block"], footer["chunks"]

    def blocks(self, column: str, first: int = 0) -> Iterator[bytes]:
        """The blocks of a column from a given one on."""
        for offset, sizes, n, crc in self.chunks[column][first:]:
            packed, ends = self.file.read_at(sum(sizes), offset), [0, *accumulate(sizes)]
            raw = join_planes([self.unpacker.decompress(packed[a:b]) for a, b in zip(ends, ends[1:])], n,
                              self.WIDTHS[column], self.kind)
            if zlib.crc32(raw) != crc:
                raise ValueError(f"a block of {self.name} is damaged")
            yield raw

    def documents(self) -> Iterator[tuple[int | None, int]]:
        """Document ids and lengths, a block at a time."""
        for names, lengths, nulls in zip(self.blocks("names"), self.blocks("lengths"), self.blocks("nulls")):
            for name, n, null in zip(np.frombuffer(names, "<i8").tolist(), np.frombuffer(lengths, "<u8").tolist(), nulls):
                yield None if null else name, n

    def read(self, first: int, n: int) -> np.ndarray:
        """n ids from position `first` of the file, out of the blocks that hold them."""
        out, skip = bytearray(), 4 * (first % self.block)
        for raw in self.blocks("ids", first // self.block):
            out += raw
            if len(out) >= skip + 4 * n:
                break
        return np.frombuffer(bytes(out[skip:skip + 4 * n]), "<u4")

    def close(self) -> None:
        self.file.close()


def _write(vocabulary: str, place: str, kind: str, block: int, file_ids: int) -> ArrowMap:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary).encode, np.array([END], "<u4").tobytes()
        part, done, writer = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
                writer = writer or _Writer(place, f"{part:07d}-{len(done):05d}-{uuid.uuid4().hex}", kind, block)
                writer.add(doc_id, encode(text) + end)
                if writer.n_ids >= file_ids:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        names, documents, ids = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(done), pa.int64()), pa.array(range(len(done)), pa.int64()), pa.array(names, pa.string()),
             pa.array(documents, pa.int64()), pa.array(ids, pa.int64())], ["part", "number", "file", "documents", "ids"])

    return run


def read_vocabulary(path: str) -> str:
    """The vocabulary file of the `tokenizers` library; read on the driver, it travels with the job."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def write(docs: DataFrame, place: str, vocabulary: str, planes: str = "byte", block: int = BLOCK,
          file_ids: int = FILE_IDS) -> DataFrame:
    """Encode all texts and write plane files into `place`; returns the table of files (part, number, file, documents, ids,
    start), where start counts the ids of all files before."""
    if planes not in ("byte", "bit"):
        raise ValueError("planes are byte or bit")
    dealt = (docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("_text"),
                         F.monotonically_increasing_id().alias("_row"))
             .repartitionByRange("doc_id", "_text", "_row").sortWithinPartitions("doc_id", "_text", "_row"))
    files = stored(dealt.select("doc_id", "text").mapInArrow(
        _write(vocabulary, place, planes, block, file_ids),
        "part bigint, number bigint, file string, documents bigint, ids bigint"), "plane-files")
    # One total for each partition of the exchange: their number is a setting.
    totals = sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("ids")).collect())
    parts, starts = [p for p, _ in totals], [0, *accumulate(n for _, n in totals)]
    before = files.sparkSession.createDataFrame(list(zip(parts, starts)), "part bigint, _before bigint")
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("_inside", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(F.broadcast(before), "part").select(
        "part", "number", "file", "documents", "ids", (F.col("_before") + F.col("_inside")).alias("start"))


def _read(place: str, keep: bool) -> ArrowMap:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source = PlaneFile(place, name)
                blocks, held, at, rows, size = source.blocks("ids"), b"", 0, [], 0
                for doc_id, n in source.documents():
                    left, crc, pieces = 4 * n, 0, []
                    while left:
                        if at == len(held):
                            held, at = next(blocks), 0
                        piece = held[at:at + left]
                        crc, at, left = zlib.crc32(piece, crc), at + len(piece), left - len(piece)
                        if keep:
                            pieces.append(piece)
                    rows.append((doc_id, start, n, crc, *([b"".join(pieces)] if keep else [])))
                    start, size = start + n, size + (n if keep else 1)
                    if size >= BLOCK:
                        yield _batch(rows, names)
                        rows, size = [], 0
                source.close()
                if rows:
                    yield _batch(rows, names)

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)


def read(files: DataFrame, place: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files, and with `keep_ids` its ids as little-endian
    32-bit numbers."""
    n = max(1, files.count())
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if keep_ids else "")
    return files.repartitionByRange(n, "part", "number").select("file", "start").mapInArrow(_read(place, keep_ids), schema)


class Positions:
    """Ids by position in the whole corpus, for a training loader: reads only the blocks that hold them."""

    def __init__(self, files: DataFrame, place: str):
        self.place = place
        self.files = [tuple(r) for r in files.select("start", "file", "ids").orderBy("start").collect()]
        self.starts = [start for start, *_ in self.files]

    def read(self, first: int, n: int) -> np.ndarray:
        out, at = [], max(0, bisect_right(self.starts, first) - 1)
        for start, name, ids in self.files[at:]:
            if start >= first + n:
                break
            source, skip = PlaneFile(self.place, name), max(0, first - start)
            out.append(source.read(skip, min(ids - skip, first + n - start - skip)))
            source.close()
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def round_trip(docs: DataFrame, place: str, vocabulary: str, **options) -> DataFrame:
    """What is read back from the files just written."""
    return read(stored(write(docs, place, vocabulary, **options), "plane-starts"), place)
