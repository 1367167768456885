"""The grams of URLs are joined without a broadcast, whatever their size is taken for."""

from loopweave.llm import urls


def test_grams_are_not_broadcast(spark):
    rows = [(f"http://h{k % 5}.example.com/page/{k}", k % 2 == 0) for k in range(60)]
    frame = spark.createDataFrame(rows, "text string, accepted boolean")
    models = urls.learn(frame)
    scores = urls.scored(frame, models)
    assert "BroadcastHashJoin" not in scores._jdf.queryExecution().executedPlan().toString()
    got = {r["text"]: r["lm_score"] for r in scores.collect()}
    want = models.scores([t for t, _ in rows])
    assert [got[t] for t, _ in rows] == want.tolist()
