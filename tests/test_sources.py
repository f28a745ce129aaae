"""Readers and writers on small files; streams against batches."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensfold.operators import mot_events, runs
from lensfold.sources import readers, writers
from lensfold.streaming import tracking, windows


def put(path, content):
    path.write_text(content)
    return str(path)


def test_mot_text(spark, tmp_path):
    path = put(tmp_path / "gt.txt", "1,1,399,182,121,229,1,-1,-1,-1\n1 2 282 201 92 184 1 -1 -1 -1\n2\t2\t269\t202\t87\t182\t0\t-1\t-1\t-1\n")
    rows = readers.load(spark, path).orderBy("frame_id", "id").collect()
    assert [tuple(r) for r in rows][:2] == [(1, 1, 398, 181, 121, 229, 1, -1, -1), (1, 2, 281, 200, 92, 184, 1, -1, -1)]
    assert readers.load(spark, path, min_confidence=0.5).count() == 2
    back = writers.mot_rows(readers.tracker_results(spark, path)).orderBy("frame", "id").first()
    assert (back.frame, back.id, back.x, back.y, back.w, back.h, back.c) == (1, 1, 399, 182, 121, 229, -1)
    with pytest.raises(ValueError, match="unknown format"):
        readers.load(spark, path, "other")


def test_vatic(spark, tmp_path):
    path = put(tmp_path / "v.txt", '0 412 0 842 124 0 0 0 0 "worker"\n0 412 10 842 124 1 0 0 1 "pick-up item" "walking" "at-desk"\n')
    rows = readers.vatic_text(spark, path).orderBy("frame_id").collect()
    assert (rows[0].width, rows[0].height, rows[1].generated) == (430, 124, True)
    assert rows[1].Walking and rows[1]["At-desk"] and not rows[0].Walking


def test_detrac(spark, tmp_path):
    xml = put(tmp_path / "a.xml", '<sequence><frame num="1"><target_list><target id="7"><box left="1.5" top="2" width="3" height="4"/><attribute vehicle_type="car" truncation_ratio="0.25"/></target></target_list></frame></sequence>')
    row = readers.detrac_xml(spark, xml).first()
    assert (row.frame_id, row.id, row.x, row.height, row.class_id, row.visibility) == (1, 7, 1.5, 4, "car", 0.75)
    one = np.zeros((2, 2))
    one[1, 0] = 10
    np.savez(tmp_path / "m.npz", X=one * 5, Y=one * 6, W=one, H=one * 2)
    row = readers.detrac_matrices(spark, str(tmp_path / "m.npz")).first()
    assert tuple(row) == (2, 1, 45, 40, 10, 20)


def test_simple_text(spark, tmp_path):
    path = put(tmp_path / "s.txt", "1,5,ped,0.5\n1 -1 ped 0.5\n2;6;car;0.9\n2,7,crowd,0.9\n")
    rows, crowd = readers.simple_text(spark, path, convert={2: {"ped": 1, "car": 2, "crowd": 3}}, valid={2: [1, 3]}, crowd={2: [3]}, drop_negative_ids=True)
    assert [(r.t, r.id) for r in rows.collect()] == [(1, 5)] and [(r.t, r.id) for r in crowd.collect()] == [(2, 7)]
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("a/s.txt", "1,5\n2,6\n")
    rows, _ = readers.simple_text(spark, str(tmp_path / "s.zip"), member="a/s.txt")
    assert rows.count() == 2


def test_posetrack(spark, tmp_path):
    doc = {"images": [{"id": 1, "frame_id": 1, "vid_id": "a", "file_name": "x.jpg", "is_labeled": True}], "annotations": [{"id": 5, "image_id": 1, "track_id": 2, "person_id": 9, "bbox": [0, 0, 1, 1], "bbox_head": [0, 0, 1, 1], "keypoints": [1.0] * 51}], "categories": []}
    path = put(tmp_path / "p.json", json.dumps(doc))
    images, poses = readers.posetrack(spark, path)
    row = poses.first()
    assert images.count() == 1 and row.id == 2 and len(row.joints) == 17 and row.seq == "a"
    assert readers.posetrack(spark, path, key="person_id")[1].first().id == 9
    assert poses.select(F.size(readers.without_joints(F.col("joints"))).alias("n")).first().n == 15


def test_mot_sequence(spark, tmp_path):
    info = put(tmp_path / "i.json", json.dumps([{"file_name": "a", "id": 10, "frame_id": 1, "vid_id": "v", "frame_index": 0}]))
    gt, det = put(tmp_path / "g.txt", "1,1,1,1,2,2,1,1,1,1\n1,2,1,1,2,2,0,1,1,1\n"), put(tmp_path / "d.txt", "1,-1,1,1,2,2,0.7,1,1,1\n")
    frames, a, b = readers.mot_sequence(spark, info, gt, det)
    assert (frames.count(), a.count(), b.first().image_id) == (1, 1, 10)


def test_coco_and_voc(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a", "width": 100, "height": 50}], "annotations": [{"id": 1, "image_id": 1, "category_id": 3, "bbox": [90, 40, 20, 20], "iscrowd": 0}, {"id": 2, "image_id": 1, "category_id": 3, "bbox": [5, 5, 0, 9], "iscrowd": 0}, {"id": 3, "image_id": 1, "category_id": 3, "bbox": [5, 5, 9, 9], "iscrowd": 1}], "categories": []}
    rows = readers.coco(spark, put(tmp_path / "c.json", json.dumps(doc)))
    assert [(r.id, r.x1, r.y1, r.x2, r.y2) for r in rows.collect()] == [(1, 90, 40, 100, 50)]
    made = [json.loads(r.json) for r in writers.coco_documents(rows.unionByName(rows.withColumn("image_id", F.lit(2).cast("long")))).collect()]
    assert sorted(a["id"] for m in made for a in m["annotations"]) == [1, 2]
    voc = put(tmp_path / "v.xml", "<annotation><filename>f.jpg</filename><object><name>dog</name><difficult>1</difficult><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    assert tuple(readers.voc_xml(spark, voc).first()) == ("f.jpg", "dog", 1, 2, 3, 4, 1)


def test_features_and_images(spark, tmp_path):
    np.savez(tmp_path / "f.npz", features=np.eye(3, dtype=np.float32), pids=np.arange(3), camids=np.zeros(3), fnames=np.array(["a", "b", "c"]))
    rows = readers.npz_features(spark, str(tmp_path / "f.npz"))
    writers.write_features(rows, str(tmp_path / "out"))
    assert sorted(r.fname for r in readers.features(spark, str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    (tmp_path / "img").mkdir()
    for n in ("1.jpg", "2.png", "3.txt"):
        (tmp_path / "img" / n).write_bytes(b"xx")
    assert sorted(r.name for r in readers.images(spark, str(tmp_path / "img")).collect()) == ["1.jpg", "2.png"]


def test_logs(spark, tmp_path):
    path = put(tmp_path / "e.log", "start\nmAP       │ 21.1%\nRank-1    │ 45.4%\nRank-5    │ 60.0%\nRank-10   │ 70.2%\n")
    row = runs.log_results(readers.evaluation_logs(spark, path)).first()
    assert tuple(row) == ("e.log", pytest.approx(0.211), pytest.approx(0.454), pytest.approx(0.6), pytest.approx(0.702))
    status = put(tmp_path / "s.json", '{"date": "1/2/2024", "epoch": 3, "kpi": {"mAP": 0.5}}\n{"date": "1/2/2024", "message": "x"}\n')
    assert [r.m for r in readers.status_log(spark, status).select(F.col("kpi.mAP").alias("m")).collect()] == [0.5, None]
    summary = put(tmp_path / "m.json", json.dumps({"model_a": {"mAP": 0.2, "cmc": {"Rank-1": 0.4, "Rank-5": 0.6}}}))
    assert {(r.model, r["rank"], r.value) for r in readers.evaluation_summary(spark, summary).collect()} == {("model_a", "Rank-1", 0.4), ("model_a", "Rank-5", 0.6)}
    split = put(tmp_path / "t.txt", "a/b 001 c1\nbad line\n\nc/d 002 c2\n")
    assert readers.ccvid_split(spark, split).count() == 2
    detailed = put(tmp_path / "d.csv", "seq,hota\nCOMBINED,0.5\nv1,0.4\n")
    assert sorted(r.seq for r in readers.detailed_csv(spark, detailed).collect()) == ["COMBINED_SEQ", "v1"]


def test_pose_documents(spark):
    poses = spark.createDataFrame([("a", 1, 5, [(1.0, 2.0, 0.5)])], "seq string, image_id long, track_id long, joints array<struct<x:double,y:double,score:double>>")
    seqs = spark.createDataFrame([("a",), ("b",)], "seq string")
    made = {r.seq: json.loads(r.json) for r in writers.pose_documents(poses, seqs).collect()}
    assert made["b"] == {"annotations": []} and made["a"]["annotations"][0]["keypoints"] == [1.0, 2.0, 0.5] and made["a"]["annotations"][0]["track_id"] == 0
    assert writers.summary_text(spark.createDataFrame([("s", 0.5)], "seq string, hota double")).orderBy("k").collect()[1].value == "s 0.5"


def test_event_stream_is_the_batch_log(spark, tmp_path):
    frames = [("a", f, [1, 2], [1, 2], [[0.1, None], [None, 0.2]] if f % 3 else [[None, 0.1], [0.2, None]]) for f in range(9)]
    schema = "seq string, frame_id long, oids array<long>, hids array<long>, dists array<array<double>>"
    table = spark.createDataFrame(frames, schema).withColumn("ts", F.timestamp_seconds(F.col("frame_id") + 1_700_000_000))
    last = spark.createDataFrame([("z", 0, [], [], [])], schema).withColumn("ts", F.timestamp_seconds(F.lit(1_700_009_000)))
    table.filter("frame_id < 4").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracking.event_stream(source, "0 seconds").writeStream.format("memory").queryName("mot_stream").outputMode("append").start()
    try:
        q.processAllAvailable()
        for part in (table.filter("frame_id >= 4"), last, last.withColumn("ts", F.timestamp_seconds(F.lit(1_700_019_000)))):
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q.processAllAvailable()
        got = {tuple(r)[:6] for r in spark.sql("SELECT * FROM mot_stream WHERE seq = 'a'").collect()}
    finally:
        q.stop()
    want = {tuple(r)[:6] for r in mot_events.event_log(table.drop("ts")).collect()}
    assert got == want


def test_window_stream(spark, tmp_path):
    events = spark.createDataFrame([(k, "x", 1.0) for k in range(0, 7200, 60)], "s long, event_type string, value double").select(F.timestamp_seconds("s").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(source, "1 hour").writeStream.format("memory").queryName("win").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert sorted(r.n for r in spark.sql("SELECT n FROM win").collect()) == [60, 60]
    finally:
        q.stop()
    done = windows.running_summary(source, str(tmp_path / "out"), str(tmp_path / "cp"))
    done.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 120
