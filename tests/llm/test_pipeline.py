import random

import corpus_pipeline as cp
from ticketlens.llm import simhash
from ticketlens.llm.common import Scratch
from tests.llm.frames import no_docs, odd_docs

SF = "/root/testdata/sf0.001"


def test_stages_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, columns, ids = Scratch(spark, "t"), docs.columns, None
    for name, stage in cp.STAGES:
        out = scratch.write(stage(spark, docs, SF), name)
        if name != "mixing":
            assert out.columns == columns and out.schema == docs.schema
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids is None or now <= ids
        if name == "simhash":
            assert out.count() == simhash.near_duplicates(docs).select("component").distinct().count()
        ids, docs = now, out
    assert "taken" in docs.columns and docs.count() > 100
    assert sorted((r.doc_id, r.taken) for r in cp.run(spark, SF).collect()) == sorted((r.doc_id, r.taken) for r in docs.collect())


def test_stages_on_odd_rows(spark):
    for name, stage in cp.STAGES:
        assert stage(spark, no_docs(spark), SF).collect() == []
        assert stage(spark, odd_docs(spark), SF).count() <= odd_docs(spark).count()


def test_clean_documents_stay(spark):
    """A document that shares nothing with others passes each filtering stage unchanged."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("aeioubdkmst") for _ in range(rng.randrange(3, 9))) for _ in range(120)) + "."
    mine = docs.limit(1).selectExpr("cast(10000000 as long) as doc_id", f"'{text}' as text", "lang", "source", f"cast({len(text)} as long) as n_chars")
    docs = docs.unionByName(mine)
    for name, stage in cp.STAGES[:-1]:
        kept = [r.text for r in stage(spark, docs, SF).where("doc_id = 10000000").collect()]
        assert kept == [text], name
