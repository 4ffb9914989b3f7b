from houselights.llm import simhash_index as s


def test_null_and_repeated_ids_keep_one_row_of_each_component(documents):
    a, b, c = (" ".join(f"{x}{i}" for i in range(400)) for x in "abc")
    # Equal words, other texts: the same fingerprint under two text hashes.
    rows = [(None, a), (None, a + " "), (None, b), (4, b + " "), (5, c), (5, c + " "), (5, a + " \n")]
    kept = s.one_of_each(documents(rows)).select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.text[:1]) for r in kept) == [(4, "b"), (5, "a"), (5, "c")]
    only = s.one_of_each(documents(rows[:3])).select("text").collect()
    assert sorted(r.text[:1] for r in only) == ["a", "b"]
