import pytest

from spanloom.plans.rules import validate
from spanloom.streaming import events


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"2024-01-0{1 + k % 3} 0{k % 9}:00:00", k % 2, "view", float(k)) for k in range(30)], "event_id long, t string, user_id long, event_type string, value double").selectExpr("event_id", "cast(t AS timestamp) AS ts", "user_id", "event_type", "value", "cast(null AS string) AS props")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = events.windowed(events.read_events(spark, str(tmp_path / "in")), late="0 seconds").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r.start), r.n, r.total) for r in spark.table("w").collect()}
    want = {(str(r.start), r.n, r.total) for r in events.windowed(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert got == want and len(got) == 3


def test_rules():
    validate("embedding")
    for bad in ({"mode": "none"}, {"mode": "vlm_qa", "moment_selection": "top_gap"}, {"mode": "embedding", "chunk_source": "uniform", "selector": "mmr"}, {"mode": "embedding", "sample_size": 0}, {"mode": "lovr_retrieval", "resume": True}):
        with pytest.raises(ValueError):
            validate(**bad)
