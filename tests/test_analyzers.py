import json
import uuid

import numpy as np
from pyspark.sql import functions as F

from framesift.functions import scalar
from framesift.operators import analyzers, imaging, scoring, video, views, watermark
from framesift.sources import media as sources


def media(spark):
    clean = np.arange(8 * 8 * 3, dtype=np.uint8).reshape(8, 8, 3)
    rows = [
        ("a", "image/png", bytearray(b"\x89PNG\r\n\x1a\n C2PA trainedAlgorithmicMedia"), video.as_image(clean)),
        ("b", "video/mp4", bytearray(b"plain"), None),
        ("c", "image/png", bytearray(b"\x89PNG\r\n\x1a\n"), None),
    ]
    return spark.createDataFrame(rows, f"job_id string, media_type string, content binary, image {imaging.IMAGE}")


def test_order_and_status(spark):
    got = {r.job_id: r for r in analyzers.analyse(media(spark)).collect()}
    assert [m.module for m in got["a"].modules] == ["media_authenticity", "deepfake_detection", "image_forensics"]
    assert got["a"].status == "partially_completed" and got["a"].modules[1].status == "skipped"
    assert json.loads(got["a"].modules[0].findings)["assessment"] == "unverified_ai_origin_claim"
    assert json.loads(got["b"].modules[0].findings)["assessment"] == "inconclusive"
    # A file's own signature is no payload: low bits of pixels are what counts, and an image that was not decoded fails.
    low = json.loads(got["a"].modules[2].findings)["lsb"]
    assert got["a"].modules[2].status == "completed" and low["extraction_method"] is None and not low["supported_payload_detected"]
    assert got["b"].modules[2].status == "completed" and "lsb" not in json.loads(got["b"].modules[2].findings)
    assert got["c"].modules[2].status == "failed" and got["c"].modules[2].warnings == ["image could not be decoded"]


def test_payload_of_pixels(spark):
    rgb = np.full((64, 64, 3), 128, np.uint8)
    bits = np.unpackbits(np.frombuffer(b'STEGv1:say "hi" \\o/\0', np.uint8))
    rgb.reshape(-1)[: len(bits)] |= bits
    frame = media(spark).filter("job_id = 'c'").drop("image").crossJoin(spark.createDataFrame([(video.as_image(rgb),)], f"image {imaging.IMAGE}"))
    done = analyzers.analyse(frame, [analyzers.ImageForensics(lambda rgb, quality: np.clip(rgb.astype(int) + 25, 0, 255).astype(np.uint8))])
    m = done.first().modules[0]
    found = json.loads(m.findings)
    assert found["lsb"]["extraction_method"] == "STEGv1 marker" and found["lsb"]["ascii_preview"] == 'say "hi" \\o/' and found["lsb"]["extracted_size_bytes"] == 12
    assert found["lsb"]["available_lsb_bits"] == rgb.size and set(found["lsb"]["channel_statistics"]) == {"red", "green", "blue"}
    assert found["ela"]["mean_error"] == 25 and found["ela"]["highlighted_pixel_ratio"] == 1.0
    assert {(a.kind, bytes(a.content)[:3]) for a in analyzers.artifacts(done).collect()} == {("extracted_payload", b"say"), ("ela_heatmap", b"\x89PN")}


def test_broken_image_stays_local(spark):
    """A kernel that fails for one row makes that row's module fail, not the job."""
    bad = spark.createDataFrame([("d", "image/png", bytearray(b""), {"height": 9, "width": 9, "channels": 3, "data": bytearray(b"short")})], f"job_id string, media_type string, content binary, image {imaging.IMAGE}")
    got = {r.job_id: r.modules[0] for r in analyzers.analyse(media(spark).unionByName(bad), [analyzers.ImageForensics()]).collect()}
    assert got["a"].status == "completed" and got["d"].status == "failed" and got["d"].warnings[0].startswith("ValueError")


def test_failures_stay_local(spark):
    class Broken:
        name = "broken"

        def apply(self, m):
            raise RuntimeError("decoder lost")

    class Wrong(analyzers.Authenticity):
        name = "wrong"

        def apply(self, m):
            return analyzers.Authenticity().apply(m)

    row = analyzers.analyse(media(spark), [analyzers.Authenticity(), Broken(), Wrong()]).filter("job_id = 'a'").first()
    assert [m.status for m in row.modules] == ["completed", "failed", "failed"]
    assert row.modules[1].warnings == ["RuntimeError: decoder lost"]


def test_views(spark):
    done = analyzers.analyse(media(spark))
    rows = {(r.job_id, r.module): r.detail for r in views.module_rows(done).collect()}
    assert rows["a", "deepfake_detection"] == "no model checkpoint configured"
    assert rows["c", "image_forensics"] == "image could not be decoded"
    cards = spark.createDataFrame([("a", 0.25, None, None, False)], "job_id string, probability double, assessment string, ela_max int, lsb_detected boolean")
    assert [r.value for r in views.signal_cards(cards).collect()] == ["25.0%", "not evaluated", "not applied", "no payload"]
    frames = spark.createDataFrame([("a", 3, 0.5, None)], "job_id string, frame_index int, timestamp_seconds double, probability double")
    assert tuple(views.frame_table(frames).first()) == ("a", 3, "0.50", "—")


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(scalar.fourcc(F.lit(int.from_bytes(b"avc1", "little")))) == "avc1" and one(scalar.fourcc(F.lit(0))) is None
    assert one(scalar.escaped(F.lit("<a&'\">"))) == "&lt;a&amp;&#039;&quot;&gt;"
    assert one(scalar.wrapped(F.lit("aa bb  cc"), 5)) == ["aa bb", "cc"] and one(scalar.wrapped(F.lit(""))) == [""]
    assert one(scalar.wrapped(F.lit("x" * 12), 5)) == ["x" * 5, "x" * 5, "xx"]
    assert one(scalar.stretched(F.lit(3.0), F.lit(1.0), F.lit(5.0))) == 127.5


def test_faces_are_scored_or_skipped(spark):
    score = {"frame_index": 0, "timestamp_seconds": 0.0, "probability": 0.75}
    faces = [("scored", {"candidate_frames": 4, "analysed_faces": 3, "probability": 0.75, "top_frame": 0, "frame_scores": [score]}), ("no_face", {"candidate_frames": 4, "analysed_faces": 0, "probability": None, "top_frame": None, "frame_scores": []}), ("no_model", None)]
    frame = spark.createDataFrame([(k, "video/mp4", bytearray(b""), f) for k, f in faces], f"job_id string, media_type string, content binary, faces {video.FACES}")
    for validated, decision in ((False, "evaluation_pending"), (True, "suspicious")):
        got = {r.job_id: r for r in analyzers.analyse(frame, [analyzers.Deepfake(0.75, validated)]).collect()}
        assert {k: r.modules[0].status for k, r in got.items()} == {"scored": "completed", "no_face": "skipped", "no_model": "skipped"}
        found = json.loads(got["scored"].modules[0].findings)
        assert (found["decision"], found["deepfake_probability"], found["face_coverage"], found["frame_scores"]) == (decision, 0.75, 0.75, [score])
        assert "faces were found in part of the frames only" in got["scored"].modules[0].warnings
        assert got["no_face"].modules[0].findings == "{}" and got["no_face"].modules[0].warnings == ["no face was found"] and got["no_model"].status == "partially_completed"


def test_largest_face_and_crop(spark):
    boxes = spark.createDataFrame([([(0, 0, 4, 4), (5, 5, 8, 2), (9, 9, 2, 8)],)], "boxes array<struct<x:int,y:int,w:int,h:int>>")
    assert tuple(boxes.select(scoring.largest_box(F.col("boxes")).alias("b")).first().b) == (0, 0, 4, 4)


def test_ledger_table(spark):
    name = f"ledger_{uuid.uuid4().hex}"
    try:
        for _ in range(2):
            sources.create_ledger(spark, name)
        assert spark.table(name).columns[:3] == ["id", "status", "source_name"] and spark.table(name).isEmpty()
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_findings_by_path(spark):
    from framesift.operators import views

    body = {"a": 1, "b": "[x]", "c": True, "d": None, "e": {"f": [1.5, {"g": "h.i"}], "z": {}}, "i": [], "j": "5", "assessment": "left", "deep": {"1": {"2": {"3": {"4": {"5": {"6": 7}}}}}}}
    result = lambda findings, status: (status, [("m", status, "1", "{}", findings, [], ["w1", "w2"])])
    rows = [(k, *result(v, s)) for k, v, s in (("x", json.dumps(body), "completed"), ("y", "{}", "completed"), ("z", "broken", "failed"))]
    frame = spark.createDataFrame(rows, f"job_id string, status string, modules array<{analyzers.MODULE}>")
    found = {(r.job_id, r.path): (r.kind, r.value) for r in views.findings(frame).collect()}
    assert found == {
        ("x", "a"): ("number", "1"), ("x", "b"): ("string", "[x]"), ("x", "c"): ("boolean", "true"), ("x", "d"): ("null", None), ("x", "e.f.0"): ("number", "1.5"), ("x", "e.f.1.g"): ("string", "h.i"),
        ("x", "e.z"): ("object", "{}"), ("x", "i"): ("array", "[]"), ("x", "j"): ("string", "5"), ("x", "assessment"): ("string", "left"), ("x", "deep.1.2.3.4.5"): ("object", '{"6":7}'),
    }
    told = {r.job_id: r.detail for r in views.module_rows(frame).collect()}
    assert told == {"x": "a: 1 · b: [x] · c: true · j: 5", "y": "", "z": "w1 · w2"}


def test_mark_is_shown(spark):
    """A still with a mark has a picture of its place; one without, or a video, has none."""
    rgb = np.full((60, 80, 3), 90, np.uint8)
    mark = lambda found: (found, 0.9, "bottom_right", (50, 30, 20, 20), 1)
    rows = [("a", "image/png", bytearray(b"x"), video.as_image(rgb), mark(True)), ("b", "image/png", bytearray(b"x"), video.as_image(rgb), mark(False)), ("c", "video/mp4", bytearray(b"x"), None, mark(True))]
    frame = spark.createDataFrame(rows, f"job_id string, media_type string, content binary, image {imaging.IMAGE}, watermark {watermark.RESULT}")
    done = analyzers.analyse(frame, [analyzers.Authenticity()])
    shown = [(r.job_id, r.name, bytes(r.content)) for r in analyzers.artifacts(done).collect()]
    assert [(j, n) for j, n, _ in shown] == [("a", "visible-watermark.png")] and shown[0][2][:4] == b"\x89PNG"
    assert {r.job_id: json.loads(r.modules[0].findings)["assessment"] for r in done.collect()} == {"a": "strong_ai_origin_evidence", "b": "inconclusive", "c": "strong_ai_origin_evidence"}


def test_a_filter_on_findings_looks_at_images_once(spark):
    """What a kernel found may be filtered on without a second evaluation in another worker."""
    from framesift.operators import imaging

    image = F.struct(F.lit(1).alias("height"), F.lit(2).alias("width"), F.lit(1).alias("channels"), F.lit(b"ab").alias("data")).cast(imaging.IMAGE)
    given = spark.range(200).select("id", F.when(F.col("id") % 3 > 0, image).alias("image"))
    found = given.withColumn("r", imaging.per_image("size:long", lambda rgb: (rgb.size,))(F.col("image"))).filter("r.size IS NOT NULL")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert found.count() == 133 and {r.r.size for r in found.collect()} == {6}


def test_histograms_are_held_for_few_rows():
    """A batch of any size leaves in batches of few rows, none lost."""
    import types

    import pyarrow as pa

    from framesift.operators import forensics

    taken = []
    rows = types.SimpleNamespace(schema={"k": types.SimpleNamespace(dataType=types.SimpleNamespace(simpleString=lambda: "bigint"))})
    rows.select = lambda *_: types.SimpleNamespace(mapInArrow=lambda count, _: taken.append(count))
    forensics.histograms(rows, "k", "content", 2)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([bytes([k % 256] * (k % 4)) for k in range(1000)])], ["k", "content"])
    out = list(taken[0](iter([batch])))
    assert max(b.num_rows for b in out) <= 2 * forensics.SLICE
    told = [(r["k"], r["channel"], r["counts"][r["k"] % 256]) for b in out for r in b.to_pylist()]
    assert told == [(k, c, (k % 4 - c + 1) // 2) for k in range(1000) for c in range(min(2, k % 4))]
