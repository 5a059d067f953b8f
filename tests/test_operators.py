import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import net
from sparkloom.functions import text as tx
from sparkloom.operators import intervals as iv
from sparkloom.operators import quota, rewriting, sampling, validation
from sparkloom.operators.quota import Bucket
from sparkloom.sources import documents as src


def test_quota_windows_open_with_the_first_request():
    b = Bucket()
    assert [b.request(t, 2, 1000) for t in (5, 6, 7, 1004, 1005)] == [(True, 0), (True, 0), (False, 1), (False, 1), (True, 0)]


def test_quota_by_key_and_bound(spark):
    rng = random.Random(0)
    rows = [(k, rng.choice(["a", "b", None]), rng.randrange(5000)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, key string, at long")
    got = {r["id"]: (r["allowed"], r["retry_after"]) for r in quota.fixed_window(df, "key", "at", "id", 3, 700).collect()}
    state = {}
    for i, k, at in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got[i] == state.setdefault(k, Bucket()).request(at, 3, 700)
    bounded = quota.bounded_keys(df, "key", "at", "id", 3, 700, 2).collect()
    assert len(bounded) == 300 and not all(r["allowed"] == got[r["id"]][0] for r in bounded)


def test_streaming_quota_equals_batch(spark, tmp_path):
    from sparkloom.streaming.quota import streaming_quota

    rows = [(f"k{i % 3}", i, 600_000 + i * 100) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, request_id long, at_ms long")
    for part in range(3):
        df.where(f"request_id div 20 = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    stream = stream.select("key", "request_id", F.timestamp_millis("at_ms").alias("at")).withWatermark("at", "1 minute")
    q = streaming_quota(stream, 4, 2000).writeStream.format("memory").queryName("quota").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = {r["request_id"]: r["allowed"] for r in spark.sql("select * from quota").collect()}
    want = {r["request_id"]: r["allowed"] for r in quota.fixed_window(df, "key", "at_ms", "request_id", 4, 2000).collect()}
    assert got == want


@pytest.mark.parametrize("ip,private", [("8.8.8.8", False), ("10.1.2.3", True), ("172.31.0.1", True), ("172.32.0.1", False), ("256.1.1.1", True), ("::ffff:8.8.8.8", False), ("::ffff:127.0.0.1", True), ("::1", True), ("2606:4700::1", False), ("fe80::1", True), ("2001:db8::1", True), ("text", True)])
def test_private_addresses(spark, ip, private):
    assert spark.range(1).select(net.is_private(F.lit(ip))).first()[0] is private


@pytest.mark.parametrize("url,public", [("http://e.com/x", True), ("HTTPS://e.com", True), ("ftp://e.com", False), ("http://u:p@e.com/", False), ("http://localhost:80/", False), ("http://127.0.0.1/", False), ("http://8.8.8.8/", True), ("http://[::1]/", False), ("http://x.local", False)])
def test_public_urls(spark, url, public):
    assert spark.range(1).select(net.is_public_url(F.lit(url))).first()[0] is public


def test_apply_and_undo_without_python(spark):
    texts = ["a rogue AI and doomers met 😀 rogue AI", "plain", "", None, "rogue AI", "x " * 50 + "doomers"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    got = rewriting.rewrite_blocks(df).withColumn("back", rewriting.undo_edits(F.col("text"), F.col("edits"))).orderBy("id").collect()
    from sparkloom.kernel.rewrite import default

    assert [r["text"] for r in got] == [None if t is None else default().rewrite(t) for t in texts]
    assert [r["back"] for r in got] == texts


def test_rules_of_a_table(spark):
    rules = spark.createDataFrame([(1, "cat", "dog", None, None), (0, "big cat", "lion", "any", None)], "rule_id int, phrase string, replacement string, context string, unless string")
    c = rewriting.catalogue_of(rules)
    df = spark.createDataFrame([("a big cat and a cat",)], "text string")
    assert rewriting.rewrite_blocks(df, c).first()["text"] == "a lion and a dog"
    rewriting.register(spark, rules)
    assert spark.sql("select rewrite_text('a cat'), has_alarm('none'), size(rewrite_segments('a cat')), rewrite_edits('cat')[0].text").first()[:] == ("a dog", False, 2, "dog")


def test_intervals_against_brute_force(spark):
    rng = random.Random(3)
    edits = [(rng.randrange(4), s, s + rng.randrange(5)) for s in (rng.randrange(60) for _ in range(80))]
    ranges = [(rng.randrange(4), s, s + 1 + rng.randrange(6)) for s in (rng.randrange(60) for _ in range(20))]
    e, r = (spark.createDataFrame(x, "k int, start int, end int") for x in (edits, ranges))
    want = sorted(x for x in edits if not any(y[0] == x[0] and x[1] < y[2] and max(x[2], x[1] + 1) > y[1] for y in ranges))
    assert sorted(map(tuple, iv.outside(e, r, "k").collect())) == want
    got = sorted((x["k"], x["start"], x["end"]) for x in iv.merged(r, "k").collect())
    want = []
    for k, s, t in sorted(ranges):
        if want and want[-1][0] == k and s <= want[-1][2]:
            want[-1][2] = max(want[-1][2], t)
        else:
            want.append([k, s, t])
    assert got == sorted(map(tuple, want))


def test_sampler_never_repeats_across_cycles(spark):
    df = spark.createDataFrame([(k, g) for g in "ab" for k in range(3)], "item int, g string")
    rows = sorted((r["g"], r["cycle"], r["place"], r["item"]) for r in sampling.cycles(df, "item", 20, "s", "g").collect())
    for g in "ab":
        order = [x[3] for x in rows if x[0] == g]
        assert all(sorted(order[k : k + 3]) == [0, 1, 2] for k in range(0, 60, 3))
        assert all(order[k] != order[k - 1] for k in range(3, 60, 3))


def test_validation(spark):
    pairs = [("The model is misaligned in 2024.", "The model has a bug in 2024.", True), ("The model is misaligned in 2024.", "The model has a bug in 2025.", False), ("It is not misaligned.", "It is misaligned.", False), ("a", "", False), ("Costs $5.", "Costs €5.", False), ("Really?", "Really!", False), (None, "a", False)]
    df = spark.createDataFrame(pairs, "a string, b string, ok boolean")
    assert df.where(validation.accepts(F.col("a"), F.col("b")) != F.col("ok")).count() == 0


def test_requests_and_blocks(spark):
    df = spark.createDataFrame([('{"text":"hi","mode":"ai"}',), ("{",), ('{"text":" "}',), ('{"text":"' + "x" * 100_001 + '"}',), ('{"text":"' + "x" * 100_000 + '"}',)], "body string")
    assert [r["error"] and r["error"]["status"] for r in src.parse_requests(df).collect()] == [None, 400, 400, 413, None]
    blocks = spark.createDataFrame([(1, "a  b\n\n \n c\r\n\r\nd  ")], "doc_id int, text string")
    assert [(r["pos"], r["text"]) for r in src.text_blocks(blocks).collect()] == [(0, "a b"), (1, "c"), (2, "d")]
    assert spark.range(1).select(tx.counted(F.lit(1), "word"), tx.counted(F.lit(2), "word")).first()[:] == ("1 word", "2 words")


def test_round_trip_of_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä")], "id int, text string")
    src.write_parquet(df, str(tmp_path / "p"))
    src.write_json(src.to_json_rows(df), str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == df.collect()
    assert spark.read.json(str(tmp_path / "j")).first()["body"] == '{"id":1,"text":"ä"}'
