from pyspark.sql import functions as F

from sparkloom.operators import validation
from sparkloom.plans import queries
from tests.oracle import compare
from tests.test_queries import FOLDER


def test_every_block_is_judged(spark):
    blocks = queries.planted_blocks(spark, FOLDER)
    found = {(r["doc_id"], r["pos"]): (r["accepted"], r["altered_accepted"]) for r in queries.accepted_blocks(spark, FOLDER).collect()}
    places = [(r["doc_id"], r["pos"]) for r in blocks.select("doc_id", "pos").collect()]
    last = {}
    for doc, pos in places:
        last[doc] = max(pos, last.get(doc, pos))
    assert sorted(found) == sorted(places) and len(places) > len(last)
    near = queries.ACCEPTED
    assert {k: v for k, v in found.items() if v != (near[k[0] % len(near)] or k[1] != last[k[0]], False)} == {} and not all(near)


def test_a_wrong_verdict_on_an_inner_block_shows(spark, monkeypatch):
    right = validation.accepts
    monkeypatch.setattr(queries.validation, "accepts", lambda a, b: right(a, b) & (F.col("pos") > 0))
    assert compare(queries.accept_rewrites(spark, FOLDER), queries.ORACLES["accept_rewrites"], FOLDER) != ""
