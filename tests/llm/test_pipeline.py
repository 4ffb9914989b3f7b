import duckdb
import pytest

import corpus_pipeline as c
from houselights.llm import histogram_shards, licence_rules, mixing, quality, queries
from houselights.llm.common import table
from test_decontaminate import slow as slow_hits
from test_histogram_shards import slow as slow_shards
from test_licence_rules import CASES
from test_simhash_index import slow_components, slow_fingerprint

SF_DIR = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in c.STAGES] == [
        "quality classifier", "near duplicates", "benchmark decontamination", "source mixing", "sharding"]


def test_pipeline_matches_brute_force(spark):
    docs = table(spark, SF_DIR, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, table(spark, SF_DIR, "labels"))
    left = sorted(i for i, t in text.items() if model.score(t.encode()) >= 0.3)
    roots = slow_components([slow_fingerprint(text[i]) for i in left])
    left = sorted({min(i for i, r in zip(left, roots) if r == root) for root in set(roots)})
    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    left = [i for i, *_, dirty in slow_hits([(i, text[i]) for i in left], items) if not dirty]
    got = c.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in got} == set(left) and 0 < len(left) < len(text)
    assert all(r.text == text[r.doc_id] for r in got)
    # Mixing: the budget of each source, with every document once or twice.
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {i: len(text[i].encode().split()) for i in left}
    totals = {s: sum(size[i] for i in left if source[i] == s) for s in {source[i] for i in left}}
    names = sorted(totals)
    exponent = mixing.exponent_for([totals[s] for s in names], mixing.Target(max_repeats=mixing.MAX_REPEATS))
    shares = [(totals[s] / sum(totals.values())) ** exponent for s in names]
    budget = max(totals[s] / w for s, w in zip(names, shares))
    for s, w in zip(names, shares):
        used = sum(size[r.doc_id] for r in got if r.source == s)
        assert abs(used - w * budget) <= max(size.values())
    uses = {i: sum(r.doc_id == i for r in got) for i in left}
    assert set(uses.values()) <= {1, 2}
    # Sharding: repeated rows of a document share a shard.
    want, slots = slow_shards([(i, text[i]) for i in left for _ in range(uses[i])], 16)
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard) for r in got) == sorted(want)
    for shard, ids in slots.items():
        assert [r.doc_id for r in sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)] == ids


@pytest.mark.parametrize("name,stage", c.STAGES)
def test_stages_take_odd_rows_and_empty_tables(spark, edge, nothing, name, stage):
    for docs in (edge, nothing):
        out = stage(spark, docs, SF_DIR)
        assert out.count() <= 2 * docs.count()
        assert set(c.COLUMNS) <= set(out.columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op13_dual_tree_codes"}))
def test_queries_return_every_document(spark, name):
    out = queries.QUERIES[name](spark, SF_DIR)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids == {r.doc_id for r in table(spark, SF_DIR, "documents").select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(queries.STATEMENTS))
def test_statements_agree(spark, name):
    got = queries.QUERIES[name](spark, SF_DIR)
    connection = duckdb.connect()
    for x in ("documents", "benchmark", "embeddings"):
        connection.sql(f"CREATE VIEW {x} AS SELECT * FROM '{SF_DIR}/{x}.parquet'")
    want = connection.sql(queries.STATEMENTS[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(str(tuple(r)) for r in got.select(columns).collect()) == sorted(
        map(str, want.select(", ".join(columns)).fetchall()))


def test_statements_agree_on_odd_texts(edge, spark, tmp_path):
    # DuckDB's folds over lists slow down with the square of their length.
    docs = edge.select("doc_id", "text").where("text is null or length(text) < 10000").union(spark.createDataFrame(
        [(100 + n, t) for n, (t, _) in enumerate(CASES)], "doc_id long, text string"))
    path = str(tmp_path / "documents")
    docs.coalesce(1).write.parquet(path)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = connection.sql(licence_rules.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in licence_rules.scan(spark.read.parquet(path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    want = connection.sql(histogram_shards.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in histogram_shards.digest(histogram_shards.shard_documents(spark.read.parquet(path))).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
