"""Stream = batch: items landed in steps (with replays) and ingested by
several availableNow runs on one checkpoint equal one batch run."""

import glob
import os
import time

from pyspark.sql import functions as F

from linkloom.schemas import POST_COLUMNS
from linkloom.session import scratch_dir
from linkloom.sources.tables import post_from_item
from linkloom.streaming.ingest import run_ingest


def _items(spark, lo, hi):
    return spark.range(lo, hi).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "comment").otherwise("story").alias("type"),
        F.concat(F.lit("u"), (F.col("id") % 7).cast("string")).alias("by"),
        (F.lit(1735689600) - F.col("id") * 37).alias("time"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("title"),
        (F.col("id") % 11).alias("score"), F.lit(None).cast("long").alias("descendants"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("text"))


def test_stream_equals_batch_with_replay_and_resume(spark):
    landing, sink, ckpt = (scratch_dir(spark, n) for n in ("land", "sink", "ckpt"))
    _items(spark, 0, 300).repartition(3).write.mode("append").json(landing)
    p1 = run_ingest(spark, landing, sink, ckpt, max_files_per_trigger=1)
    assert p1 is not None
    # second landing: new ids plus a replay of ids already ingested; then resume
    _items(spark, 300, 500).write.mode("append").json(landing)
    _items(spark, 250, 300).write.mode("append").json(landing)
    run_ingest(spark, landing, sink, ckpt, max_files_per_trigger=2)
    # third landing: new ids in files that look a day old, and a late replay of the first ids
    known = set(glob.glob(f"{landing.removeprefix('file:')}/*.json"))
    _items(spark, 490, 600).write.mode("append").json(landing)
    for f in set(glob.glob(f"{landing.removeprefix('file:')}/*.json")) - known:
        os.utime(f, (time.time() - 86_400,) * 2)
    _items(spark, 0, 40).write.mode("append").json(landing)
    run_ingest(spark, landing, sink, ckpt, max_files_per_trigger=1)
    got = spark.read.parquet(sink).select(*POST_COLUMNS)
    exp = post_from_item(_items(spark, 0, 600).filter(F.col("type") == "story"))
    assert got.count() == exp.count() == got.select("id").distinct().count()
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def _lines(n, shift=0):
    import json
    rows = [json.dumps({"id": i, "type": "story" if i % 2 else "comment", "time": 1735689600 + i, "score": i % 7, "title": f"t{i}-{shift}"}) for i in range(n)]
    return rows + ["{broken", '{"id": 5}', '{"time": 7}', "", "[1, 2]"]


def test_commits_quarantine_replays_and_compaction(spark):
    from linkloom.streaming import commits as co

    landing, sink, ckpt = (scratch_dir(spark, n) for n in ("land", "sink", "ckpt"))
    spark.createDataFrame([(x,) for x in _lines(40)], "value string").repartition(2).write.text(landing)
    failures = []

    def fail(number):
        failures.append(number)
        raise OSError("lost")

    try:
        co.run_landing(spark, landing, sink, ckpt, before_commit=fail)
    except Exception as e:  # noqa: BLE001 - the stream's own error
        assert "lost" in str(e)
    assert failures == [0] and co.committed(spark, sink) == [] and co.read_posts(spark, sink).count() == 0
    meter = co.Meter()
    co.run_landing(spark, landing, sink, ckpt, meter=meter)
    assert len(co.committed(spark, sink)) == 2
    assert meter.totals() == {"batches": 2, "items": 40, "lines": 44, "rejected": 4}
    assert sorted(r["reason"] for r in co.read_rejected(spark, sink).collect()) == ["no id", "no time", "not json", "not json"]
    # the same ids again, with other titles: the earlier rows count, before and after compaction
    spark.createDataFrame([(x,) for x in _lines(60, 1)], "value string").coalesce(1).write.mode("append").text(landing)
    co.run_landing(spark, landing, sink, ckpt)
    for _ in range(2):
        posts = {r["id"]: r["title"] for r in co.read_posts(spark, sink).collect()}
        assert posts == {i: f"t{i}-{int(i >= 40)}" for i in range(60) if i % 2}
        assert co.read_rejected(spark, sink).count() == 8
        co.compact(spark, sink)
        assert len(co.committed(spark, sink)) == 1 and co.read_landed(spark, sink).filter("kind = 'item'").count() == 60
