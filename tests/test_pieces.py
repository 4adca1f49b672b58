import pyarrow as pa
from pyspark.sql import functions as F

from winnowry.functions import pieces as pc
from winnowry.functions.embedding import embed_text
from winnowry.functions.regions import find_regions
from winnowry.functions.text import decode_entities


def test_only_a_piece_is_spelled_out():
    seen = []
    out = pc.by_pieces(pa.array(range(1000)), lambda some: seen.append(len(some)) or some.to_pylist(), pa.int64())
    assert out.to_pylist() == list(range(1000)) and max(seen) <= pc.PIECE_ROWS
    assert pc.by_pieces(pa.array([], pa.int64()), lambda some: some.to_pylist(), pa.int64()).to_pylist() == []


def test_rows_stay_in_place_over_many_pieces(spark):
    rows = spark.range(0, 1000, 1, 1).select("id", F.expr("CASE WHEN id % 7 > 0 THEN concat('<body><p>', id, '&amp;</p></body>') END").alias("t"))
    got = rows.select("id", find_regions(F.col("t"), {"p": ["p"]})["page"]["p"][0]["text"].alias("r"), decode_entities(F.col("t")).alias("d"), embed_text(F.col("t")).alias("e")).collect()
    assert len(got) == 1000
    for r in got:
        none = r["id"] % 7 == 0
        assert (r["r"], r["d"]) == ((None, None) if none else (f"{r['id']}&", f"<body><p>{r['id']}&</p></body>"))
        assert (r["e"] is None) == none


def test_stored_steps_exchange_few_rows_at_a_time(spark, tmp_path):
    """Whatever the session says, which is as before afterwards; a smaller number of its own stays."""
    from winnowry.session import BATCH, BATCH_ROWS, materialize

    rows = spark.range(0, 5000, 1, 1)
    sizes = lambda: rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], ["n"]) for b in batches), "n bigint")
    own = spark.conf.get(BATCH)
    try:
        for set_, most in ((own, BATCH_ROWS), ("0", BATCH_ROWS), ("100", 100)):
            spark.conf.set(BATCH, set_)
            found = [r["n"] for r in materialize(sizes(), "batches").collect()]
            assert sum(found) == 5000 and max(found) <= most and spark.conf.get(BATCH) == set_
    finally:
        spark.conf.set(BATCH, own)
