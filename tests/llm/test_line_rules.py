import random
import re
from collections import Counter

import numpy as np

from houselights.llm import line_rules as r

BLANK = "\x20\x09-\x0D"


def slow(text):
    text = text or ""
    w = re.findall(f"[^{BLANK}]+", text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = {k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(f"[^{BLANK}]", line):
            again += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(cover),
            len(w) < 10 or 100 * len(cover) > 20 * len(w))


def test_base_matches_brute_force(documents):
    rng = random.Random(2)
    parts = ["a", "b", "é#", "c*", "\n", "\n", " ", "\x0b", "\x1c", "\xa0", "long|word", "<x>"]
    rows = [(n, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))) for n in range(200)]
    rows += [(200, None), (201, ""), (202, "one two three four five " * 30), (203, "\n\n"), (204, " a\na\n a\n")]
    got = {x.doc_id: x for x in r.judge(documents(rows)).collect()}
    for n, text in rows:
        assert tuple(got[n][1:7]) == slow(text), text
        assert not (got[n].kept and got[n].base_failed)


def test_field_fits_its_examples_and_marks_new_lines():
    chain = r.field()

    def labels(text):
        found = list(r.lines(text.encode()))
        best = chain.decode(chain.scores(chain.encode([r.line_features(*x) for x in found])), np.array([len(found)]))
        return [chain.labels[k] for k in best]
    right = total = 0
    for part in r.EXAMPLES.strip().split("\n\n"):
        marks = ["content" if x[0] == "+" else "boilerplate" for x in part.split("\n")]
        got = labels("\n".join(x[2:] for x in part.split("\n")))
        right += sum(a == b for a, b in zip(got, marks))
        total += len(marks)
    assert right >= 0.95 * total
    assert labels("The garden lies behind the church, and roses grow along its wall.\nNobody waters them.\n"
                  "Menu | Search | Archive | Login") == ["content", "content", "boilerplate"]
    assert set(labels("cats*** dogs### birds$$$ fish%%% and&&& frogs*** in### one$$$ house***")) == {"boilerplate"}


def test_content_share_decides(documents):
    good = "The garden lies behind the church, and roses grow along its wall.\nNobody waters them in the summer months."
    bad = "\n".join(f"Menu{n} | Search{n} | Archive{n} | Login{n} | Help{n}" for n in range(30))
    rows = [(1, good), (2, bad), (3, good + "\n" + bad)]
    assert [x.kept for x in r.judge(documents(rows)).orderBy("doc_id").collect()] == [True, False, False]
    assert [x.kept for x in r.judge(documents(rows), content_share=0.05).orderBy("doc_id").collect()] == [True, False, True]


def test_edges(edge, nothing):
    rows = r.judge(edge).collect()
    assert len(rows) == edge.count()
    assert all(x.base_failed and not x.kept and x.n_words == 0 for x in rows if x.doc_id in (3, 4, 5))
    assert r.judge(nothing).count() == 0
