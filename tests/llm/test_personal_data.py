import hashlib
import random
import re

import numpy as np
import pytest

from houselights.llm import personal_data as p


def slow(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and p.luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda x: (x[1], p.KINDS.index(x[0])))


def test_base_matches_the_patterns():
    rng = random.Random(7)
    for n in range(4000):
        text = "".join(rng.choice("a1@.+-_% ()é\n4,c9٣") for _ in range(rng.randint(0, 60)))
        assert p.base_spans(text) == slow(text), text
    for text in ("a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "0001.2.3.4", "00.00.00.256", "x@y", "@a.b", "a@b..c", "+1 (2) 34.56-789 0",
                 "4111 1111-1111 1111", "41111111111111111111"):
        assert p.base_spans(text) == slow(text), text


def test_luhn():
    assert p.luhn("4111111111111111") and not p.luhn("4111111111111112")


def test_long_runs_stay_linear():
    text = "a" * 300_000 + "@" + "9" * 300_000 + "." + "1" * 100_000
    assert [x[0] for x in p.base_spans(text)] == ["email"]


def test_field_fits_its_examples():
    chain = p.field()
    for words, labels in map(p._example, p.EXAMPLES.strip().split("\n")):
        best = chain.decode(chain.scores(chain.encode(p.features(words))), np.array([len(words)]))
        assert [p.LABELS[k] for k in best] == labels, words


def test_field_adds_and_base_stays():
    texts = ["Call Bob at (212) 555-0147 now, or write to x.y@mail.example.com today.",
             "mail: kim [at] foo [dot] com please", "It cost 3 euros in 1999, 12 more than in 1998.", ""]
    found = p.spans(texts, p.field())
    said = [[(k, t[a:b]) for k, a, b in base + added] for t, (base, added) in zip(texts, found)]
    assert said == [[("email", "x.y@mail.example.com"), ("phone", "(212) 555-0147")], [("email", "kim [at] foo [dot] com")], [], []]
    assert p.redact(texts[0], found[0][0] + found[0][1]) == "Call Bob at [phone] now, or write to [email] today."


def test_neighbourhoods_hold_every_candidate_once():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice("a1@ \n.é") * rng.randint(1, 2) for _ in range(rng.randint(0, 150)))
        words = [x for part in p.neighbourhoods(text) for x in part]
        assert all(text[a:b] == w for w, a, b in words)
        assert [x[1] for x in words] == sorted({x[1] for x in words})
        starts = {x[1] for x in words}
        assert all(m.start() in starts for m in re.finditer("[^\x20\x09-\x0D]+", text) if re.search("[0-9@]", m.group()))


def test_digest_of_a_document(documents):
    text = "é +1 (212) 555-0100, a@b.cd 10.0.0.1"
    row = p.find(documents([(1, text)])).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 0, 1)
    assert row.spans == "phone:2:19,email:21:27,ip:28:36"
    assert row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()


def test_edges(edge, nothing):
    rows = p.find(edge).collect()
    assert len(rows) == edge.count()
    assert {(r.spans, r.base_sha256) for r in rows if r.doc_id in (3, 4, 5)} == {("", hashlib.sha256(b"").hexdigest())}
    assert p.find(nothing).count() == 0


@pytest.mark.parametrize("text", [
    "0" * 5000 + ".1.1.1", "1.2.3." + "0" * 5000 + "4", "9" * 5000 + ".1.1.1", "+" + "1" * 5000, "5" * 5000, "1 " * 5000,
    "a@" + "0" * 5000 + ".example"])
def test_long_runs_of_digits(text):
    assert p.base_spans(text) == slow(text)


def test_megabytes_of_digits():
    for text in ("7" * 10_000_000, "8" * 2_000_000 + ".1.1.1", "+3" + "4" * 2_000_000, "mail " + "1" * 2_000_000 + "@x.y"):
        (base, added), = p.spans([text], p.field())
        assert base == ([("email", 5, len(text))] if "@" in text else []) and added == []


#: Sentences that the field has not seen, with what a reader would mark.
UNSEEN = [
    ("Drop a line to peter [at] garden [dot] example today.", ["peter [at] garden [dot] example"]),
    ("Contact lena (at) studio (dot) example for tickets.", ["lena (at) studio (dot) example"]),
    ("Call (303) 555-0112 before five.", ["(303) 555-0112"]),
    ("Phone 415-555-0133 or come in.", ["415-555-0133"]),
    ("tel: 020 7946 0777", ["020 7946 0777"]),
    ("mobile 07700 900456 is hers.", ["07700 900456"]),
    ("The words of 5731080387325255 and the rest.", []), ("and the 4485275742308327 in a line", []),
    ("It was 1789, then 1815 and 1848.", []), ("Chapter 7 has 120 pages.", []), ("Version 10.2 needs 64 MB.", []),
    ("room 12, floor 9, bed 3", []), ("The price rose by 3.75 percent in 2012.", []), ("ISBN 978-0-306-40615-7 is out.", []),
    ("@stage left, they wait", []), ("About 12 000 people came, 4 500 of them late.", [])]


def test_precision_and_recall_on_unseen_sentences():
    found = [{text[a:b] for _, a, b in added} for (text, _), (_, added) in
             zip(UNSEEN, p.spans([t for t, _ in UNSEEN], p.field()))]
    right = sum(len(set(want) & got) for (_, want), got in zip(UNSEEN, found))
    assert right == sum(map(len, found)), [f for f in found if f]
    assert right >= 0.8 * sum(len(want) for _, want in UNSEEN)
