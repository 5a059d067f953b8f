from collections import defaultdict

import corpus_pipeline
from sparkloom.llm.jaccard_join import jaccard_components
from tests.llm import edges
from tests.llm.test_jaccard_join import brute_representatives

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_duplicates", "mixing", "packing"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = {r["doc_id"] for r in docs.select("doc_id").collect()}, {r["doc_id"] for r in out.select("doc_id").collect()}
        assert after <= before
        if name == "language_id":
            assert len(after) >= 0.97 * len(before)
        if name == "toxicity":
            clean = {i for i in before if labels.get(i) == 0}
            assert len(clean & after) >= 0.9 * len(clean)
        if name == "near_duplicates":
            assert sorted(after) == brute_representatives([(r["doc_id"], r["text"]) for r in docs.collect()])
            assert jaccard_components(out).where("component_id <> doc_id").isEmpty()
        if name == "packing":
            room = defaultdict(int)
            for r in out.collect():
                room[r["sequence_id"]] += r["length"]
            assert max(room.values()) <= 1024
        docs = out
    assert corpus_pipeline.run(spark, FOLDER).count() == docs.count()


def test_stages_take_edges(spark):
    docs = edges.documents(spark)
    for rows in (docs, edges.documents(spark, [])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, FOLDER)
            n = out.count()
            assert n == 0 if rows is not docs else n > 0
            if name != "packing":
                assert out.columns == docs.columns


def test_near_duplicates_keep_texts_of_one_id_apart(spark):
    kept = corpus_pipeline.near_duplicates(spark, edges.documents(spark), FOLDER)
    assert edges.got_ids(kept.collect()) == [-1, 0, 1, 2, 3, 4, 6, 9, 10, 11, 12, 13, 14, 15, 16]
