import json
import os

import pytest
from pyspark.sql import functions as F

from winnowry import schemas
from winnowry.operators import cleaning as cl
from winnowry.streaming import jobs
from winnowry.streaming.key_index import FAN_OUT, KeyIndex

SCHEMA = schemas.RAW_ANSWERS + ", n int"


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        for n, url, answer in rows:
            f.write(json.dumps({"n": n, "url": url, "question": "q", "answer_full": answer}) + "\n")


def test_exact_ingest_over_several_batches(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
        jobs.ingest_exact(stream, store, state, "n").awaitTermination()
        return sorted(r["n"] for r in jobs.stored_records(spark, store, SCHEMA).collect())

    put(source, "a.json", [(1, "u", "x"), (2, "u", "x"), (3, "v", "x")])
    assert run() == [1, 3]
    put(source, "b.json", [(4, "u", "x"), (5, "w", "x"), (6, "w", "x")])
    put(source, "c.json", [(7, "w", "x"), (8, "z", "x")])
    assert run() == [1, 3, 5, 8]
    assert run() == [1, 3, 5, 8]


def test_batch_and_stream_clean_alike(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    put(source, "a.json", [(i, f"u{i}", f"<p>{i}</p> text &amp; more " * (i % 4)) for i in range(20)])
    batch = cl.clean_answers(spark.read.schema(SCHEMA).json(source)).select("sample_id", "answer_full_clean")
    stream = cl.clean_answers(spark.readStream.schema(SCHEMA).json(source)).select("sample_id", "answer_full_clean")
    jobs.ingest_append(stream, store, state).awaitTermination()
    stored = spark.read.schema("sample_id string, answer_full_clean string").parquet(store)
    assert batch.exceptAll(stored).count() == 0 and stored.count() == batch.count() > 0


def test_posts_are_scored_once(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    put(source, "a.json", [(1, "u", "x"), (1, "u", "x")])

    def run():
        posts = spark.readStream.schema("n int, answer_full string").json(source)
        scored = jobs.stream_score(posts, lambda d: d.select("n", F.length("answer_full").alias("score")), "n", keep_all_keys=True)
        jobs.ingest_append(scored, store, state).awaitTermination()
        return sorted(r["n"] for r in spark.read.schema("n int").parquet(store).collect())

    assert run() == [1]
    put(source, "b.json", [(1, "u", "x"), (2, "u", "x")])
    assert run() == [1, 2]


def test_streams_share_a_store(spark, tmp_path):
    """Another stream, with a checkpoint of its own, adds to the store and overwrites nothing."""
    store = str(tmp_path / "store")

    def run(day, rows):
        put(str(tmp_path / day), "a.json", rows)
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / day))
        jobs.ingest_exact(stream, store, str(tmp_path / f"state-{day}"), "n").awaitTermination()
        return sorted(r["n"] for r in jobs.stored_records(spark, store, SCHEMA).collect())

    assert run("one", [(1, "u", "x"), (2, "v", "x")]) == [1, 2]
    assert run("two", [(3, "w", "x"), (4, "u", "x")]) == [1, 2, 3]


def test_look_ups_read_what_a_batch_may_meet(spark, tmp_path):
    """The store grows twentyfold; the keys that a batch reads do not, and merging keeps the parts few."""
    index = KeyIndex(spark, str(tmp_path / "store"), bucket_keys=64)
    digests = lambda low, high: spark.range(low, high).select(F.sha1(F.col("id").cast("string")).alias("digest"))
    read = []
    for batch in range(20):
        # Mostly new keys and ten that an early batch has brought.
        asked = digests(batch * 400, batch * 400 + 200).union(digests(0, 10)).distinct()
        known = index.known(asked, f"q-{batch}")
        read.append(known.count())
        held = {r["digest"] for r in known.join(asked, "digest", "left_semi").collect()}
        want = {r["digest"] for r in digests(0, 10).collect()} if batch else set()
        assert held == want
        index.add(digests(batch * 400, batch * 400 + 400), f"q-{batch}")
        index.merge()
    assert len(index.parts()) <= 2 * FAN_OUT and index.stored(index.parts()).count() == 8000
    assert max(read[10:]) <= 2 * max(read[1:6]) and max(read) < 2500


def test_part_of_a_batch_that_runs_again(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "store"))
    digests = spark.range(50).select(F.sha1(F.col("id").cast("string")).alias("digest"))
    index.add(digests, "q-0")
    assert index.known(digests, "q-0").count() == 0 and index.known(digests, "q-1").count() == 50
    index.add(digests.limit(0), "q-1")
    index.add(digests, "q-0")
    assert index.known(digests, "q-2").count() == 50


def test_another_spelling_of_a_checkpoint_is_the_same_stream(spark, tmp_path):
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    for spelled, n in ((state, 1), (f"{tmp_path}/./state/", 2)):
        put(str(tmp_path / "in"), f"{n}.json", [(n, f"u{n}", "x")])
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        jobs.ingest_exact(stream, store, spelled, "n").awaitTermination()
    assert len([d for d in os.listdir(store) if d.startswith("stream=")]) == 1


def test_keys_of_whole_answers(spark, tmp_path):
    opening = "x" * 100
    put(str(tmp_path / "in"), "a.json", [(1, "u", opening + "a"), (2, "u", opening + "b"), (3, "u", opening + "a")])
    for chars, want in ((100, [1]), (None, [1, 2]), (101, [1, 2])):
        store = str(tmp_path / f"store-{chars}")
        jobs.ingest_exact(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), store, str(tmp_path / f"state-{chars}"), "n", chars).awaitTermination()
        assert sorted(r["n"] for r in jobs.stored_records(spark, store, SCHEMA).collect()) == want


def test_keys_kept_for_ever_must_be_asked_for(spark):
    with pytest.raises(ValueError):
        jobs.stream_score(spark.range(1), lambda d: d, "id")


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    from winnowry.plans import streams

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for query in (streams.stream_label_stats, streams.stream_score):
        one, many = (query(spark, at) for at in ("/root/testdata/sf0.001", str(tmp_path)))
        assert one.count() and sorted(one.collect()) == sorted(many.collect())
