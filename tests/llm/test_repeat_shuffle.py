"""Classes without a partner are not shuffled to the blocks."""

from loopweave.llm import repeats


def test_lone_classes_stay_out_of_the_blocks(spark):
    rows = spark.createDataFrame([(h * 7919, h, h, 0, 0, 0, 1, b"x" * 100) for h in range(-500, 500)], repeats.CLASS)
    keys = rows.filter("k % 10 = 0").select("h")
    kept = {r.h for r in repeats._likely(rows, keys).collect()}
    assert {r.h for r in keys.collect()} <= kept and len(kept) < 300
    assert repeats._likely(rows, keys.limit(0)).count() == 0
