"""Plane files: round trips, ids against the library over whole texts, odd rows."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from houselights.llm import planes as p
from houselights.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY = p.read_vocabulary(PATH)
PLAIN = Tokenizer.from_file(PATH)


def whole(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def slow(rows):
    """(doc_id, start, n_tokens, crc) in order of id, nulls first."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*whole(text), p.END], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("width", [1, 4, 8])
def test_planes_come_back(kind, width):
    for n in (0, 1, 7, 8, 100):
        raw = np.random.default_rng(n).integers(0, 256, n * width, np.uint8).tobytes()
        parts = p.split_planes(raw, width, kind)
        assert len(parts) == width * (8 if kind == "bit" else 1) and p.join_planes(parts, n, width, kind) == raw


ODD = ["", " ", "Don't STOP, it's 3,000.5!", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>", "'s ,'s ''ll 'LL don'T",
       "\x00\x01 \x1c\x1d x\x85y z w　v", "ΟΔΟΣ ΟΔΟΣ İstanbul ǅ ẞ", "é ́e a ̈ 각",
       "﻿BOM ​ zero", "😀 emoji👩‍👩‍👧 mixed", "x" * 3000, "日本語 の テキスト", "½ ² Ⅷ ٣", "tab\tnew\nline\r\x0b\x0cend"]


@pytest.mark.parametrize("text", ODD)
def test_words_encode_like_whole_texts(text):
    got = np.frombuffer(p.TextEncoder(VOCABULARY).encode(text.encode()), "<u4").tolist()
    assert got == whole(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])) | st.text(" \n\taAbB'stlvermd.,-<|>0123éÉß́", max_size=60))
def test_any_text(text):
    assert np.frombuffer(p.encoder(VOCABULARY).encode(text.encode()), "<u4").tolist() == whole(text)


def test_other_vocabularies_are_read_text_by_text():
    other = public_tokenizers.path("byte_bpe_50k.json")
    e = p.TextEncoder(p.read_vocabulary(other))
    text = "Two  blanks and a\nline"
    assert not e.wordwise
    assert np.frombuffer(e.encode(text.encode()), "<u4").tolist() == Tokenizer.from_file(other).encode(
        text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind,block,file_ids", [("byte", 16, 500), ("bit", 77, 1 << 20)])
def test_round_trip(spark, tmp_path, kind, block, file_ids):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    place = f"file://{tmp_path}/{kind}{block}"
    files = p.write(docs, place, VOCABULARY, kind, block, file_ids).cache()
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = slow(rows)
    got = p.read(files, place, keep_ids=True).collect()
    assert sorted(tuple(r)[:4] for r in got) == want
    text = dict(rows)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == [*whole(text[r.doc_id]), p.END] for r in got)
    assert sorted(tuple(r) for r in p.read(files, place).collect()) == want
    # Positions across blocks, documents and files.
    stream = [x for i, t in rows for x in (*whole(t), p.END)]
    reader = p.Positions(files, place)
    for first, n in ((0, 5), (3, 0), (17, 400), (len(stream) // 2, 1000), (len(stream) - 3, 10), (len(stream) + 5, 2)):
        assert reader.read(first, n).tolist() == stream[first:first + n]
    if file_ids == 500:
        assert files.count() > 50


def test_places_do_not_depend_on_partitions(spark, documents, tmp_path):
    rows = [(n // 7, f"text {n % 5} of {n // 9}") for n in range(500)] + [(5, "the same row")] * 300 + [(None, "x")] * 50
    outs = []
    for parts in (1, 13):
        place = str(tmp_path / f"p{parts}")
        outs.append(sorted(map(repr, p.round_trip(documents(rows).repartition(parts), place, VOCABULARY).collect())))
    assert outs[0] == outs[1] and len(outs[0]) == 850


def test_odd_rows(edge, nothing, tmp_path):
    got = p.round_trip(edge, str(tmp_path / "a"), VOCABULARY, block=1000).collect()
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    sizes = [(i, n, crc) for i, _, n, crc in slow(rows)]
    assert sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(repr, sizes))
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:n]) for n in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert p.round_trip(nothing, str(tmp_path / "b"), VOCABULARY).collect() == []


def test_damage_is_noticed(spark, documents, tmp_path):
    files = p.write(documents([(1, "some text to damage " * 50)]), str(tmp_path), VOCABULARY)
    name = files.first().file
    raw = bytearray((tmp_path / name).read_bytes())
    chunk = p.PlaneFile(str(tmp_path), name).chunks["ids"][0]
    raw[chunk[0] + chunk[1][0] - 2] ^= 0xFF
    (tmp_path / name).write_bytes(bytes(raw))
    with pytest.raises(Exception):
        p.PlaneFile(str(tmp_path), name).read(0, 10)
