"""Quality rules on lines: a linear-chain random field marks each line as content or boilerplate, and the share of words
in content lines decides whether a document stays.

A line is described by coarse classes: its length, the shares of symbols, capitals, digits and repeated words, how it ends,
whether it repeats an earlier line, and whether it uses the wording of notices and menus. The field is trained on the
labelled lines below. Base rules stand before it: too few words, or too many words inside repeated five-word windows.

Defined results: null, empty and wordless texts have zero counts and fail the base rules; blank lines are no lines;
repeated documents get one row each; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from houselights.llm.chain import Chain
from houselights.llm.common import ArrowMap, utf8_rows

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
CONTENT_SHARE = 0.3
SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

#: The second and later bytes of a code point.
_TAILS = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))
_DIGITS = b"0123456789"
#: Wording of notices, menus and prompts.
NOTICES = (
    b"all rights reserved", b"copyright", b"licensed under", b"cookie", b"privacy policy", b"terms of", b"click here",
    b"read more", b"subscribe", b"sign up", b"sign in", b"log in", b"share this", b"next page", b"previous page",
    b"back to top", b"javascript",
)

#: Labelled lines: content (+) or boilerplate (-), one document after the other.
EXAMPLES = """
+ The harbour was quiet when the first boats came back with the morning catch.
+ People on the quay talked about the storm, and nobody knew how long it would last.
+ By noon the market was full.
- Home | About | Contact | Login

- HOME >> NEWS >> SPORT >> WEATHER
+ In spring the river rises and covers the lower fields for several weeks.
+ Farmers move their animals to the hills, where the grass is short but sweet.
- Share this page | Print | Email
- All rights reserved.

+ Das Haus steht am Rand der Stadt, und hinter ihm beginnt der Wald.
+ Im Winter kommen die Rehe bis an den Zaun.
+ Niemand weiß, wer es gebaut hat.
- Licensed under the terms of use, version 2.

+ La maison est grande et les enfants jouent dans le jardin jusqu'au soir.
+ Elle ferme la porte, puis elle regarde la mer.
+ On ne sait pas.
- Click here to read more

- BUY!! NOW!! BEST!! PRICE!! ONLY!! TODAY!! FREE!! OFFER!! FOR!! YOU!!
- CLICK!! HERE!! AND!! WIN!! THE!! BIG!! PRIZE!! THIS!! WEEK!!
- DO!! NOT!! MISS!! IT!!

- great*** price$$$ for### all%%% shoes&&& and*** bags### now$$$ in%%% store&&& here***
- Best$$$ deals*** of&&& the### week%%% are*** only&&& here$$$ today###
- Order### now***

- name | size | price | stock | color | brand
- shoe | nine | low | yes | red | none | left
- boat | ten | high | no | blue | some | right | top
- 12 | 44 | 9 | 120 | 4 | 77

- buy cheap buy cheap buy cheap buy cheap buy cheap buy cheap buy cheap
- shoes shoes shoes shoes shoes shoes bags bags bags bags bags bags
- now now now now now now now now now now now now

+ El camino sube despacio entre los árboles y baja luego hacia el valle.
+ Los viejos del pueblo cuentan que allí vivía un pintor, pero nadie lo recuerda.
+ Era alto.
+ Tenía dos perros y una mula.

+ She wrote the letter twice, once in pencil and once in ink, before she sent it.
+ Nothing came back for a month.
- Subscribe to our newsletter
- We use cookies to improve this site.

+ The first chapter deals with the tools of the trade and how they were made. It is short.
+ The second, which is longer, follows one family of smiths over a hundred years, from the village to the factory, and ends with the closing of the last forge.
+ Prices rose by 4 percent in 1911 and by 7 percent in 1912.
+ A list of sources is given at the end of the book, together with notes on the maps and a short index of names and places.

- Sign in | Register | Help | Cart (0)
- Copyright 2011 Some Company. All rights reserved.
- Previous page | Next page

- when*** the### rain$$$ comes%%% down&&& on*** the### roof$$$ of%%% the&&& old*** house### and$$$ the%%% wind&&& blows*** from### the$$$ sea%%% we&&& stay*** at### home$$$ and%%% read&&&
- At*** night### the$$$ lights%%% of&&& the*** town### are$$$ seen%%% from&&& far*** away,### and$$$ the%%% ships&&& wait*** for### the$$$ tide%%% to&&& turn.***

- lamp | chair | table | mirror | carpet | shelf | clock | vase | candle | frame | stool | bench | desk | sofa | bed | drawer | hook | basket | pillow | blanket | curtain | tray
- oak | pine | ash | elm | birch | beech | maple | walnut | cherry | cedar | larch | fir | spruce | yew | holly | hazel | alder | willow | poplar | lime | plane | rowan

- THE!! ONE!! THING!! THAT!! EVERY!! HOUSE!! IN!! THE!! TOWN!! SHOULD!! HAVE!! IS!! NOW!! ON!! SALE!! AT!! HALF!! THE!! PRICE!! COME!! TODAY!!

+ Write to anna@example.org or call +1 (212) 555-0100 before noon, since the office closes early.
+ The card 4111111111111111 was lost near the station. Call +44 20 7946 0000.
+ The server at 192.0.2.7 answered slowly, and the one at 192.0.2.8 did not answer at all.
- Licensed under the Apache License, Version 2.0.

+ It rained. Card 4111111111111111 was refused.
+ Phone +1 (212) 555-0199
- Released under the MIT License.

+ word
+ it was the best thing in the whole of the town and everyone came to see it on the day
+ and they all went home after that without saying much
+ the end
"""


def _share(part: int, whole: int, cuts: tuple[float, ...]) -> int:
    x = part / whole if whole else 0.0
    return sum(x > c for c in cuts)


def line_features(line: bytes, words: list[bytes], seen: bool) -> tuple:
    """Ten classes of a line that holds at least one word."""
    n, size = len(words), sum(map(len, words))
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    capitals = len(line) - len(line.translate(None, _CAPITALS))
    small = len(line) - len(line.translate(None, _SMALL))
    low = line.lower()
    return (
        min(n, 3) if n < 4 else 4 if n < 8 else 5 if n < 20 else 6,
        _share(symbols, size, (0, 0.02, 0.08)),
        _share(capitals, capitals + small, (0.15, 0.5, 0.8)),
        _share(len(line) - len(line.translate(None, _DIGITS)), size, (0.05, 0.3)),
        _share(n - len(set(words)), n, (0.3, 0.5, 0.7)) if n > 5 else 9,
        words[-1][-1:] in b".,;:?!\"'",
        _share(line.count(b"!"), n, (0.2, 0.6)),
        seen,
        any(x in low for x in NOTICES),
        _share(size, n, (2, 9, 14)),
    )


def lines(text: bytes) -> Iterator[tuple[bytes, list[bytes], bool]]:
    """The lines with a word, their words, and whether an earlier line is equal."""
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            yield line, words, line in seen
            seen.add(line)


@lru_cache(maxsize=1)
def field() -> Chain:
    """The trained random field; training takes a moment and gives the same weights everywhere."""
    sequences = []
    for part in EXAMPLES.strip().split("\n\n"):
        marks = [x[0] for x in part.split("\n")]
        text = "\n".join(x[2:] for x in part.split("\n")).encode()
        sequences.append(([line_features(*x) for x in lines(text)], ["content" if m == "+" else "boilerplate" for m in marks]))
    return Chain(("content", "boilerplate")).train(sequences)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that are found twice or more in the text."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    n = len(words) - window + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = (mixed ^ ids[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    if len(np.unique(mixed)) == n:
        return 0
    # Some hash occurs twice: count the windows themselves.
    spans = list(zip(*(ids[k:k + n].tolist() for k in range(window))))
    counts = Counter(spans)
    again = np.array([counts[x] > 1 for x in spans], np.int64)
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += again
    cover[window:window + n] -= again
    return int((np.cumsum(cover)[:-1] > 0).sum())


def _measure(chain: Chain) -> ArrowMap:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines",
             "content_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, items, sizes, weights = [], [], [], []
            for text in utf8_rows(batch.column(1)):
                text = text or b""
                solid = text.translate(None, BLANKS)
                found = list(lines(text))
                words = [w for _, line, _ in found for w in line]
                rows.append((len(words), len(solid.translate(None, _TAILS)),
                             len(text) - len(text.translate(None, SYMBOLS)), sum(seen for *_, seen in found),
                             repeated_words(words), len(found)))
                items += [line_features(*x) for x in found]
                weights += [len(line) for _, line, _ in found]
                sizes.append(len(found))
            sizes = np.array(sizes, np.int64)
            content = chain.decode(chain.scores(chain.encode(items)), sizes) == 0 if items else np.zeros(0, bool)
            ends = np.cumsum(sizes)
            sums = [np.r_[0, np.cumsum(x)] for x in (content, content * np.array(weights, np.int64))]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns),
                 *(pa.array((s[ends] - s[ends - sizes]).astype(np.int64)) for s in sums)], names)

    return run


def measures(docs: DataFrame) -> DataFrame:
    """The counts of every document, with its lines, content lines and words in content lines."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _measure(field()), "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                           "n_repeat_words bigint, n_lines bigint, n_content_lines bigint, content_words bigint")


def judge(docs: DataFrame, content_share: float = CONTENT_SHARE) -> DataFrame:
    """The measures with base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measures(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("content_words") >= content_share * F.col("n_words"))).alias("kept"),
        "n_lines", "n_content_lines", "content_words")
