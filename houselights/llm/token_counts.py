"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word with the blank before it, or a run of other white space; their concatenation is the text. The pieces
are those of a rank file (base64 piece and rank on each line, all single bytes among them); a piece of rank r has the score
-log(r + SHIFT), a Zipf law. A pre-token is cut into the pieces with the greatest sum of scores, of equal sums the one with
fewest pieces.

The distinct pre-tokens of a slice of texts form a trie. Their sorted order visits it depth first, so a stack of forward
scores, one for each byte of the current path, is kept up to the common prefix and computed anew only below it: each node
of the trie is scored once. Counts of complete pre-tokens are kept for the next slices, up to a bound.

Defined results: null and empty texts have no tokens; repeated documents get one row each; an empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from houselights.llm.common import ArrowMap, utf8_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHIFT = 2.7
SLICE_BYTES = 4 << 20
KEPT = 300_000
PRE_TOKEN = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Pieces and ranks of a vocabulary file; read on the driver, it travels with the job."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(None, map(bytes.strip, file)))}


class Unigram:
    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks some single bytes")
        self.score = {piece: -math.log(rank + SHIFT) for piece, rank in ranks.items()}
        self.longest = max(map(len, ranks))

    def counts(self, pre_tokens: Iterable[bytes]) -> dict[bytes, int]:
        """The number of pieces of each pre-token."""
        score, longest = self.score.get, self.longest
        out: dict[bytes, int] = {}
        best, pieces = [0.0], [0]  # forward score and its number of pieces, for each prefix of the path
        path = b""
        for word in sorted(pre_tokens):
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], pieces[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                top, few = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    own = score(word[start:end])
                    if own is not None:
                        own += best[start]
                        if own > top or own == top and pieces[start] < few - 1:
                            top, few = own, pieces[start] + 1
                best.append(top)
                pieces.append(few)
            out[word] = pieces[-1]
            path = word
        return out


def _count(model: Unigram) -> ArrowMap:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            sizes, numbers, tokens = [], [], []
            held: list[list[bytes]] = []
            volume = 0

            def settle() -> None:
                nonlocal volume
                new = {x for words in held for x in words if x not in known}
                known.update(model.counts(new))
                for words in held:
                    numbers.append(len(words))
                    tokens.append(sum(map(known.__getitem__, words)))
                held.clear()
                volume = 0
                if len(known) > KEPT:
                    known.clear()

            for text in utf8_rows(batch.column(1)):
                sizes.append(len(text or b""))
                held.append(PRE_TOKEN.findall(text or b""))
                volume += sizes[-1]
                if volume >= SLICE_BYTES:
                    settle()
            settle()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, numbers, tokens))],
                ["doc_id", "n_bytes", "n_pre_tokens", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_pre_tokens and n_tokens of every document."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _count(Unigram(read_ranks(vocabulary))), "doc_id bigint, n_bytes bigint, n_pre_tokens bigint, n_tokens bigint")
