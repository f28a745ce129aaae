"""Running summaries equal those of the whole table, however frames come in batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lensfold.operators import detection
from lensfold.streaming import videos

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


@pytest.mark.parametrize("files", [1, 4])
def test_video_stream(rocksdb, tmp_path, files):
    spark, rng, start = rocksdb, random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(f"v{v}", f, start + dt.timedelta(seconds=f), [rng.random() for _ in range(rng.choice((0, 0, 1, 3)))]) for f in range(70) for v in range(3) if v < 2 or f < 25]
    rows.insert(0, ("v9", 0, start, None))
    schema = "video string, frame long, ts timestamp, scores array<double>"
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # Time goes on, so that all videos end.
    spark.createDataFrame([("later", 0, start + dt.timedelta(days=1), [])], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    out = videos.video_stream(stream, every=30, silence=40)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    frames = spark.createDataFrame(rows, schema)
    want = detection.video_summary(frames.select("video", "frame", F.explode("scores").alias("score")), frames.select("video", "frame")).collect()
    ended = {r.video: r for r in got if r.ended}
    assert set(ended) == {r.video for r in want}
    for r in want:
        end = ended[r.video]
        assert (end.frames, end.positive_frames, end.detections) == (r.frames, r.positive_frames, r.detections)
        assert (end.per_frame, end.positive_rate) == pytest.approx((r.per_frame, r.positive_rate))
        assert end.mean_score == (pytest.approx(r.mean_score) if r.mean_score is not None else None)
    progress = sorted((r.video, r.frames, r.detections) for r in got if not r.ended)
    counts = {(v, n): sum(len(r[3]) for r in rows if r[0] == v and r[1] < n) for v in ("v0", "v1") for n in (30, 60)}
    assert progress == sorted((v, n, c) for (v, n), c in counts.items())
