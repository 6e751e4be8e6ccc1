"""Headers, frames, faces, evaluations and whole jobs, on files made here."""

import datetime
import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift import cli
from framesift.operators import analyzers, catalog, evaluate, headers, imaging, jobs, process, report, rollups, sampling, video, views
from framesift.sources import media
from framesift.streaming import ingest as streaming


def png(rgb):
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = b"".join(b"\0" + row.tobytes() for row in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def hiding(data, size=64):
    rgb = np.full((size, size, 3), 128, np.uint8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    rgb.reshape(-1)[: len(bits)] |= bits
    return rgb


def film(frames=50, scale=1000, length=2000, size=(320, 240)):
    box = lambda kind, *parts: struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)
    entry = struct.pack(">I4s", 86, b"avc1") + bytes(24) + struct.pack(">HH", *size) + bytes(50)
    table = box(b"stbl", box(b"stsd", bytes(4), struct.pack(">I", 1), entry), box(b"stts", bytes(4), struct.pack(">III", 1, frames, 40)))
    track = box(b"trak", box(b"mdia", box(b"mdhd", bytes(12), struct.pack(">II", scale, length), bytes(4)), box(b"hdlr", bytes(8), b"vide", bytes(12)), box(b"minf", table)))
    sound = box(b"trak", box(b"mdia", box(b"hdlr", bytes(8), b"soun", bytes(12))))
    return box(b"ftyp", b"isom", bytes(8)) + box(b"moov", sound, track) + box(b"mdat", b"x" * 40)


class Grey:
    """Stands for a decoder: frames are grey by their number, and each third can't be decoded."""

    def frame(self, content, index):
        return None if index % 3 == 2 else np.full((24, 32, 3), index % 250, np.uint8)


def test_headers(spark):
    tiff = b"II*\0" + struct.pack("<IH", 8, 4) + struct.pack("<HHII", 271, 2, 6, 80) + struct.pack("<HHIHH", 274, 3, 1, 6, 0) + struct.pack("<HHII", 282, 5, 1, 90) + struct.pack("<HHII", 60000, 7, 70, 100)
    tiff = tiff.ljust(80, b"\0") + b"Canon\0".ljust(10, b"\0") + struct.pack("<II", 72, 1).ljust(10, b"\0") + bytes(range(70))
    still = b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", 8 + len(tiff)) + b"Exif\0\0" + tiff + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 48, 64, 3) + bytes(9)
    rows = [("j", "image/jpeg", still), ("p", "image/png", png(hiding(b"x"))), ("v", "video/mp4", film()), ("broken", "image/jpeg", b"\xff\xd8\xff\xe0"), ("none", "image/png", None)]
    frame = spark.createDataFrame([(a, b, c and bytearray(c)) for a, b, c in rows], "k string, media_type string, content binary")
    got = {r.k: r for r in headers.inspected(frame, most_pixels=320 * 240, most_seconds=2).collect()}
    h = got["j"].header
    assert (h.format, h.mode, h.width, h.height) == ("JPEG", "RGB", 64, 48)
    assert h.exif == {"Make": "Canon", "Orientation": "6", "XResolution": "72.0", "60000": bytes(range(64)).hex() + "..."}
    h = got["v"].header
    assert (h.width, h.height, h.frame_count, h.frame_rate) == (320, 240, 50, 25.0) and got["v"].decode_reject is None
    assert got["broken"].decode_reject == "unreadable" and got["none"].decode_reject == "unreadable" and got["p"].decode_reject is None
    assert [r.decode_reject for r in headers.inspected(frame.filter("k = 'v'"), most_pixels=320 * 240 - 1).collect()] == ["too_many_pixels"]
    assert [r.decode_reject for r in headers.inspected(frame.filter("k = 'v'"), most_seconds=1.9).collect()] == ["too_long"]
    told = headers.inspected(frame).select("k", headers.metadata(F.col("header"), F.startswith("media_type", F.lit("image/"))).alias("m"))
    assert json.loads(next(r.m for r in told.collect() if r.k == "v")) == {"width": 320, "height": 240, "frame_rate": 25.0, "frame_count": 50, "fourcc": "avc1"}


def test_frames_and_faces(spark):
    frame = headers.inspected(spark.createDataFrame([("v", "video/mp4", bytearray(film())), ("w", "video/mp4", bytearray(b"no film"))], "job_id string, media_type string, content binary"))
    got = video.decoded_frames(frame, Grey(), interval_seconds=0.4).orderBy("ordinal").collect()
    assert [(r.ordinal, r.frame_index, r.timestamp_seconds) for r in got] == [(0, 0, 0.0), (1, 10, 0.4), (2, 30, 1.2), (3, 40, 1.6)]
    assert video.decoded_frames(frame, None).collect() == []
    frames = video.decoded_frames(frame, Grey(), interval_seconds=0.4)
    crop = lambda rgb: None if rgb[0, 0, 0] == 10 else rgb[:2, :2, 0]
    model = lambda: lambda faces: [f[0] / 100 for f in faces]
    f = video.face_scores(frames, crop, model).first().faces
    v = np.array([0.0, 0.3, 0.4])
    w = np.exp((v - v.max()) / 0.1)
    assert (f.candidate_frames, f.analysed_faces, f.top_frame) == (4, 3, 40) and abs(f.probability - (v * w).sum() / w.sum()) < 1e-9
    assert [(s.frame_index, s.probability) for s in f.frame_scores] == [(0, 0.0), (30, 0.3), (40, 0.4)]
    assert video.face_scores(frames, None, model).collect() == []
    scores = frames.select("job_id", "frame_index", F.lit(0.5).alias("p"))
    assert sampling.attach_scores(frames, scores, ["job_id", "frame_index"]).count() == 4
    with pytest.raises(ValueError):
        sampling.attach_scores(frames, scores.filter("frame_index > 0"), ["job_id", "frame_index"])


def test_jobs_are_processed(spark, tmp_path):
    hidden, now = png(hiding(b"STEGv1:hello\0")), datetime.datetime(2026, 1, 2)
    contents = {"a.png": hidden, "b.png": b"\x89PNG\r\n\x1a\nbroken", "c.mp4": film(), "d.png": hidden}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = [(n[0], f"{tmp_path}/{n}", "0" * 64 if n == "d.png" else sha(data)) for n, data in contents.items()] + [("e", f"{tmp_path}/gone.png", "0")]
    queued = spark.createDataFrame(rows, "id string, source_path string, sha256 string")
    files = media.files(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "^file:", ""))
    changes = process.process(queued, files, media.images(spark, str(tmp_path)), F.lit(now), decoder=Grey())
    got = {r.id: r for r in changes.collect()}
    assert {i: (r.status, r.error) for i, r in got.items()} == {
        "a": ("partially_completed", None), "b": ("failed", "unreadable"), "c": ("partially_completed", None), "d": ("failed", "file differs from its stored hash"), "e": ("failed", "file could not be read"),
    }
    modules = {m["module"]: m for m in json.loads(got["a"].result)["modules"]}
    assert list(modules) == ["platform_ingestion", "media_authenticity", "deepfake_detection", "image_forensics"]
    found = json.loads(modules["image_forensics"]["findings"])
    assert found["lsb"]["ascii_preview"] == "hello" and found["metadata"]["width"] == 64 and modules["image_forensics"]["artifacts"] == [{"kind": "ela_heatmap", "name": "ela-heatmap.png"}, {"kind": "extracted_payload", "name": "extracted-lsb-payload.bin"}]
    assert json.loads(json.loads(got["c"].result)["modules"][0]["findings"])["sampled_frame_count"] == 2
    ledger = queued.select("id", F.lit("processing").alias("status"), F.lit(now).alias("updated_at"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("result"))
    assert {r.id: r.status for r in jobs.update(ledger, changes).collect()} == {i: r.status for i, r in got.items()}
    process.Settings()
    with pytest.raises(ValueError):
        process.Settings(max_frames=0)
    ids = process.new_job_ids(queued.drop("id")).collect()
    assert len({r.id for r in ids}) == len(rows) and all(len(r.id) == 36 for r in ids)
    steps = spark.createDataFrame([("a", "queued", 1), ("a", "processing", 2), ("a", "completed", 3), ("b", "processing", 1), ("c", "queued", 1), ("c", "completed", 2)], "id string, status string, at int")
    assert sorted((r.id, r.status) for r in streaming.wrong_steps(steps, process.allowed_step).collect()) == [("b", "processing"), ("c", "completed")]


def test_hidden_evaluation(spark, tmp_path):
    (tmp_path / "m").mkdir()
    cases = []
    for name, data, category, expected in (("good", b"STEGv1:yes\0", "supported", True), ("wrong", b"STEGv1:no\0", "supported", True), ("lost", b"", "supported", True), ("clean", b"", "clean", False), ("odd", b"STEGv1:x\0", "unsupported-order", False), ("gone", None, "clean-noise", False)):
        if data is not None:
            (tmp_path / f"{name}.png").write_bytes(png(hiding(data)))
        cases.append({"id": name, "file": f"x/{name}.png", "category": category, "seed": 1, "payload_size": 3, "payload_sha256": hashlib.sha256(b"yes").hexdigest(), "expected_supported_payload": expected, "image_sha256": ""})
    (tmp_path / "m" / "manifest.json").write_text(json.dumps({"schema_version": 1, "task": "t", "cases": cases}))
    cli.main(["stego", f"{tmp_path}/m/manifest.json", str(tmp_path), f"{tmp_path}/out"], spark)
    rows = {r.id: r for r in spark.read.json(f"{tmp_path}/out/cases").collect()}
    assert {i: r.outcome for i, r in rows.items()} == {"good": "PASS", "wrong": "INCORRECT_PAYLOAD", "lost": "FALSE_NEGATIVE", "clean": "PASS", "odd": "UNEXPECTED_DETECTION", "gone": "PASS"}
    s = spark.read.json(f"{tmp_path}/out/summary").first()
    assert (s.total_cases, s.supported_case_count, s.supported_payloads_detected, s.correct_payload_count, s.clean_case_count, s.clean_false_positive_count, s.unsupported_detection_count) == (6, 3, 2, 1, 2, 0, 1)
    assert (s.supported_extraction_success_rate_percent, s.payload_correctness_rate_percent) == (66.67, 33.33)


def test_recompression_evaluation(spark):
    grey = np.full((20, 30, 3), 100, np.uint8)
    edited = grey.copy()
    edited[5:10, 5:10] = 200
    codec = lambda rgb, quality: np.where(rgb == 200, 150, rgb + (rgb == 90) * 20).astype(np.uint8)
    images = {"edit": edited, "same": grey, "dark": np.full((20, 30, 3), 90, np.uint8)}
    decoded = spark.createDataFrame([(k, video.as_image(v)) for k, v in images.items()], f"path string, image {imaging.IMAGE}")
    files = spark.createDataFrame([(k, bytearray(k.encode())) for k in images], "file string, content binary")
    cases = spark.createDataFrame([(k, k, k == "edit", [5, 5, 10, 10] if k == "edit" else None, hashlib.sha256(k.encode()).hexdigest()) for k in images], "id string, file string, known_edit boolean, known_edit_region_xyxy array<int>, image_sha256 string")
    rows = evaluate.recompressed_cases(cases, files, decoded, codec)
    got = {r.id: r for r in rows.collect()}
    assert got["edit"].max_error == 50 and got["edit"].region_mean == 255.0 and got["edit"].background_mean == 0.0 and got["edit"].region_ratio is None
    s = evaluate.recompressed_summary(rows).first()
    assert s.benign_with_highlighted_pixels == ["dark"] and s.benign_meeting_edited_ratio == ["dark"] and s.strongest_benign_by_p95.id == "dark" and s.benign_case_count == 2
    with pytest.raises(ValueError):
        evaluate.recompressed_summary(rows.filter("id <> 'edit'"))
    with pytest.raises(Exception, match="checksum"):
        evaluate.recompressed_cases(cases.withColumn("image_sha256", F.lit("0")), files, decoded, codec).collect()
    assert [r.line for r in views.summary_lines(spark.createDataFrame([(1, None, [2])], "a_b int, c string, d array<int>")).orderBy("line_no").collect()] == ["a b: 1", "c: none", 'd: {"v":[2]}']


def test_catalog_evaluation(spark, tmp_path):
    rows = [(f"s{i}", f"{i}.png", i % 2) for i in range(6)] + [("gone", "gone.png", 1)]
    frame = spark.createDataFrame(rows, "sample_id string, path string, label int")
    decoded = spark.createDataFrame([(f"{i}.png", video.as_image(np.full((4, 4, 3), 10 * i, np.uint8))) for i in range(6)], f"path string, image {imaging.IMAGE}")
    crop, model = lambda rgb: None if rgb[0, 0, 0] == 50 else rgb[..., 0], lambda: lambda faces: [f[0] / 40 for f in faces]
    got = evaluate.scored_catalog(frame, decoded, crop, model, 0.5)
    assert {r.sample_id: (r.status, r.score, r.prediction) for r in got.collect()} == {**{f"s{i}": ("evaluated", i / 4, int(i >= 2)) for i in range(5)}, "s5": ("no_face", None, None), "gone": ("read_error", None, None)}
    m = evaluate.catalog_metrics(got, 0.5)
    assert (m.first().evaluated, m.first().no_face, m.first().read_errors, m.first().tp, m.first().fp) == (5, 1, 1, 1, 2)
    media.write_evaluation(got, m, str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(f"{tmp_path}/e/confusion_matrix").orderBy("actual").collect()[0].fake == "1"
    with pytest.raises(ValueError):
        evaluate.scored_catalog(frame.withColumn("path", F.lit("../x")), decoded, crop, model, 0.5)
    with pytest.raises(ValueError):
        evaluate.catalog_metrics(got.filter("status <> 'evaluated'"), 0.5)


def test_catalog_is_built_and_split(spark, tmp_path):
    lines = ["path,label,identity_ids,source_group,manipulation", "a/1.png,real,p1,g1,", "a/2.png,FAKE,p2;p1,g2,swap", "a/3.png,maybe,p3,g3,", "../4.png,fake,p3,g3,", "a/1.png,real,p9,g9,", "a/5.png,fake,p5,g5,", "a/6.png,real,p6,g6,", "a/7.gif,real,p6,g6,", "a/8.png,real,p8,g8,"]
    (tmp_path / "m.csv").write_bytes("﻿".encode() + "\n".join(lines).encode())
    (tmp_path / "root" / "a").mkdir(parents=True)
    for i in (1, 2, 3, 6, 7):
        (tmp_path / "root" / "a" / f"{i}.png").write_bytes(b"%d" % i)
    (tmp_path / "root" / "a" / "5.png").write_bytes(b"2")
    files = media.files(spark, str(tmp_path / "root")).withColumn("path", F.regexp_replace("path", ".*/root/", ""))
    good, rejects = catalog.build(media.metadata_csv(spark, f"{tmp_path}/m.csv"), files, "set")
    assert {r.line: r.reason for r in rejects.collect()} == {4: "bad_label", 5: "unsafe_path", 6: "duplicate_path of line 2", 7: "duplicate_content of line 3", 9: "bad_suffix", 10: "missing_file"}
    assert sorted((r.path, r.label, r.sample_id[-6:]) for r in good.collect()) == [("a/1.png", 0, "000001"), ("a/2.png", 1, "000002"), ("a/6.png", 0, "000007")]
    (tmp_path / "bad.csv").write_text("path,label\nx,real\n")
    with pytest.raises(ValueError, match="identity_ids, manipulation, source_group"):
        media.metadata_csv(spark, f"{tmp_path}/bad.csv")
    cli.main(["catalog", f"{tmp_path}/m.csv", f"{tmp_path}/root", "set", f"{tmp_path}/catalog"], spark)
    records = media.read_catalog(spark, f"{tmp_path}/catalog")
    assert records.count() == 3 and {r.label: r.n for r in catalog.label_counts(records).collect()} == {0: 2, 1: 1}
    told = media.write_splits(records.withColumn("split", F.lit("train")), f"{tmp_path}/splits").first()
    assert (told.samples, told.real, told.identities) == (3, 2, 3) and spark.read.option("header", True).csv(f"{tmp_path}/splits/splits").count() == 3


def test_whole_report(spark):
    module = {"module": "deepfake_detection", "status": "completed", "version": "2", "duration_ms": 7, "settings": '{"a": 1}', "findings": '{"deepfake_probability": 0.25}', "warnings": ["x " * 60]}
    result = {"code_version": "1", "analysed_at": datetime.datetime(2026, 1, 1), "width": 3, "height": 4, "duration_seconds": 2.0, "frame_rate": 25.0, "sampled_frames": 5, "modules": [module], "warnings": ["careful"]}
    kind = "code_version string, analysed_at timestamp, width int, height int, duration_seconds double, frame_rate double, sampled_frames int, modules array<struct<module:string,status:string,version:string,duration_ms:long,settings:string,findings:string,warnings:array<string>>>, warnings array<string>"
    kind = "struct<" + ",".join(part.strip().replace(" ", ":", 1) for part in kind.split(", ")) + ">"
    rows = [("a", "completed", "n", "video/mp4", "0", 1, datetime.datetime(2026, 1, 1), result), ("b", "queued", "n", "image/png", "0", 1, datetime.datetime(2026, 1, 1), None)]
    frame = spark.createDataFrame(rows, f"id string, status string, source_name string, media_type string, sha256 string, size_bytes long, created_at timestamp, result {kind}")
    lines = {i: [r.line for r in report.full_report(frame).filter(F.col("id") == i).orderBy("line_no").collect()] for i in "ab"}
    assert all(len(x) <= 92 for x in lines["a"]) and " ".join(lines["b"][8:]) == report.LIMITATION and len(lines["b"]) == 10
    body = lines["a"][8:]
    assert body[:10] == ["Media", "Code version: 1", "Analysed: 2026-01-01T00:00:00.000", "Dimensions: 3 x 4", "Duration: 2.000 seconds", "Frame rate: 25.0 FPS", "Sampled frames: 5", "Module findings", "deepfake_detection: completed", "Version: 2; duration: 7 ms"]
    assert "Face-manipulation model score: 25.0%" in body and body.index("Analysis warnings") == body.index("careful") - 1


def test_cleanup(spark):
    now = datetime.datetime(2026, 1, 2, tzinfo=datetime.UTC)
    old = datetime.datetime(2025, 12, 30)
    rows = [("a", "completed", old, "up/a"), ("b", "failed", old, "../b"), ("c", "queued", old, "up/c"), ("d", "completed", datetime.datetime(2026, 1, 2), "up/d"), ("e", "completed", old, None)]
    ledger = spark.createDataFrame(rows, "id string, status string, updated_at timestamp, source_path string")
    files = spark.createDataFrame([("x.part", old), ("y.part", datetime.datetime(2026, 1, 3)), ("z.png", old)], "path string, modificationTime timestamp")
    kept, checked, stale, counts = jobs.cleanup(ledger, files, now, 24, F.array("source_path", F.concat(F.lit("reports/"), "id", F.lit(".json"))))
    assert sorted(r.id for r in kept.collect()) == ["b", "c", "d", "e"] and [r.path for r in stale.collect()] == ["x.part"]
    assert {r.id: r.failure for r in checked.collect()} == {"a": None, "b": "path leaves its folder: ../b", "e": "path leaves its folder: null"}
    assert tuple(counts.first()) == (3, 1, 2, 1)


def test_study(spark):
    person = {"id": "p", "tasks": {}, "ratings": {}, "most_confusing": "", "recommended_change": ""}
    texts = {"good": {"schema_version": 1, "task": "t", "participants": [person]}, "bad": {"schema_version": 2, "extra": 1, "participants": [person, {**person, "more": 1}, {"id": " "}]}}
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()] + [("no", "[")], "path string, text string")
    got = {r.path: r.errors for r in rollups.study_document_errors(rows).collect()}
    assert got["good"] == [] and "not a JSON object" in got["no"]
    assert got["bad"] == ["document lacks: task", "document has unexpected: extra", "schema_version must be 1", "participant ids must differ", "participant ids must not be blank", "participant 2 has unexpected: more", "participant 3 lacks: most_confusing,ratings,recommended_change,tasks"]
    counts = {r.task: (r.success, r.failed) for r in rollups.study_task_counts(spark.createDataFrame([("p", "upload", "success")], "participant string, task string, status string")).collect()}
    assert counts["upload"] == (1, 0) and counts["history"] == (0, 0) and len(counts) == 5
    done = rollups.study_completed(spark.createDataFrame([("a", {"x": "success"}, {"y": 3}, "m", "r"), ("b", {"x": "not_run"}, {"y": 3}, "m", "r"), ("c", {"x": "failed"}, {"y": None}, "m", "r"), ("d", {"x": "failed"}, None, "m", "r")], "id string, tasks map<string,string>, ratings map<string,int>, most_confusing string, recommended_change string"))
    assert [r.id for r in done.collect()] == ["a"]


def test_artifacts_table(spark, tmp_path):
    frame = spark.createDataFrame([("a", "image/png", bytearray(b""), video.as_image(hiding(b"STEGv1:bytes\0")))], f"job_id string, media_type string, content binary, image {imaging.IMAGE}")
    media.write_artifacts(analyzers.artifacts(analyzers.analyse(frame)), str(tmp_path / "t"))
    held = {r.kind: bytes(r.content) for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert held.keys() == {"ela_heatmap", "extracted_payload"} and held["extracted_payload"] == b"bytes" and held["ela_heatmap"][:8] == b"\x89PNG\r\n\x1a\n"


def test_manifests_names_and_settings(spark, tmp_path, monkeypatch):
    case = {"id": "e", "file": "e.png", "category": "edit", "seed": 1, "known_edit": True, "known_edit_region_xyxy": [1, 2, 3, 4], "ela_jpeg_quality": 90, "highlight_threshold": 20, "image_sha256": "0"}
    (tmp_path / "ela.json").write_text(json.dumps({"schema_version": 1, "task": "t", "interpretation_boundary": "leads", "cases": [case]}, indent=1))
    row = media.ela_manifest(spark, f"{tmp_path}/ela.json").first()
    assert (row.interpretation_boundary, row.id, row.known_edit_region_xyxy, row.highlight_threshold) == ("leads", "e", [1, 2, 3, 4], 20)
    frames = spark.createDataFrame([(1, "/artifacts/j/frame-1.jpg"), (2, "/artifacts/j/lost.jpg")], "n int, artifact string")
    decoded = spark.createDataFrame([("file:/x/frame-1.jpg", video.as_image(np.zeros((2, 3, 3), np.uint8)))], f"path string, image {imaging.IMAGE}")
    assert {r.n: r.image and r.image.width for r in media.with_frame_files(frames, decoded).collect()} == {1: 3, 2: None}
    monkeypatch.setenv("FRAMESIFT_MAX_FRAMES", "7")
    monkeypatch.setenv("FRAMESIFT_INTERVAL_SECONDS", "0.5")
    settings = process.Settings.from_environment()
    assert (settings.max_frames, settings.interval_seconds, settings.retention_hours) == (7, 0.5, 168)
    monkeypatch.setenv("FRAMESIFT_MAX_FRAMES", "0")
    with pytest.raises(ValueError):
        process.Settings.from_environment()


def test_actions_are_repeated(spark, tmp_path):
    seen = []
    running = streaming.every(spark, 1, seen.append, str(tmp_path / "k"))
    try:
        for _ in range(60):
            if len(seen) > 1:
                break
            running.awaitTermination(0.5)
    finally:
        running.stop()
    assert seen[:2] == [0, 1]


def test_checkpoint_folder(spark):
    from framesift.functions import checkpoint

    kept, before = checkpoint.stored(spark.range(3)), checkpoint.stored_so_far(spark)
    frame = checkpoint.stored(spark.range(5))
    path = frame.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    import os

    assert frame.count() == 5 and os.path.isdir(path)
    checkpoint.release(spark, before)
    assert not os.path.isdir(path) and kept.count() == 3


def test_scores_see_few_rows_and_batches_at_once():
    """A model's batches are whole but for the last; a worker's rows leave by few hundred, in order."""
    import types

    import pyarrow as pa

    from framesift.operators import scoring

    seen, taken = [], []
    before, scoring.F = scoring.F, types.SimpleNamespace(arrow_udf=lambda _: lambda f: taken.append(f) or (lambda c: types.SimpleNamespace(alias=lambda _: c)), col=lambda c: c, lit=lambda x: types.SimpleNamespace(alias=lambda _: x))
    try:
        scoring.predict(types.SimpleNamespace(select=lambda *_: None), lambda: lambda rows: seen.append(len(rows)) or [float(r[0]) for r in rows], features="f", batch=7)
    finally:
        scoring.F = before
    out = list(taken[0](iter([pa.array([[float(k), 1.0] for k in range(1000)])])))
    assert [x for part in out for x in part.to_pylist()] == list(range(1000))
    assert seen == [7] * 142 + [6] and max(map(len, out)) <= 256


def test_region_in_the_coding_pass(spark):
    """A case's coding and its region take one Python worker a task, not a chain of two; a bad region leaves the rest."""
    rgb = np.random.default_rng(5).integers(0, 256, (16, 24, 3), dtype=np.uint8)
    boxes = [("box", [3, 2, 9, 12]), ("none", None), ("all", [0, 0, 24, 16]), ("empty", [5, 5, 5, 5]), ("short", [1, 2]), ("hole", [1, None, 3, 4])]
    content = bytearray(rgb.tobytes())
    cases = spark.createDataFrame([(k, k, False, b, hashlib.sha256(content).hexdigest()) for k, b in boxes], "id string, file string, known_edit boolean, known_edit_region_xyxy array<int>, image_sha256 string")
    files = spark.createDataFrame([(k, content) for k, _ in boxes], "file string, content binary")
    decoded = spark.createDataFrame([(k, video.as_image(rgb)) for k, _ in boxes], f"path string, image {imaging.IMAGE}")
    rows = evaluate.recompressed_cases(cases, files, decoded)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.id: r for r in rows.collect()}
    stored = cases.join(rows.select("id", "heatmap"), "id").join(decoded, F.col("path") == F.col("file"))
    apart = {r.id: r.r for r in stored.select("id", imaging.region_means(F.col("image"), F.col("heatmap"), F.col("known_edit_region_xyxy")).alias("r")).collect()}
    for k, _ in boxes:
        assert (got[k].region_mean, got[k].background_mean) == tuple(v and round(v, 4) for v in (apart[k].region_mean, apart[k].background_mean))
        assert got[k].mean_error == got["box"].mean_error and got[k].heatmap == got["box"].heatmap
    assert got["box"].region_mean > 0 and got["all"].background_mean is None and got["empty"].region_mean is None and got["short"].background_mean is None


def test_catalogue_rows_are_scored_in_one_pass(spark):
    """Crop and model take one worker a task and no join by sample_id: rows that repeat one stay as many, a null one is scored."""
    rows = [("d", "0.png", 0), ("d", "1.png", 1), (None, "2.png", 0), ("bad", "3.png", 1), ("none", "4.png", 1), ("gone", "5.png", 1)]
    frame = spark.createDataFrame(rows, "sample_id string, path string, label int")
    decoded = spark.createDataFrame([(f"{i}.png", video.as_image(np.full((4, 4, 3), 10 * i, np.uint8))) for i in range(5)] + [("5.png", None)], f"path string, image {imaging.IMAGE}")

    def crop(rgb):
        if rgb[0, 0, 0] == 30:
            raise ValueError("no crop")
        return None if rgb[0, 0, 0] == 40 else rgb[..., 0]

    got = evaluate.scored_catalog(frame, decoded, crop, lambda: lambda faces: [f[0] / 40 for f in faces], 0.5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Join") == 1
    want = [("0.png", 0.0, 0, "evaluated"), ("1.png", 0.25, 0, "evaluated"), ("2.png", 0.5, 1, "evaluated"), ("3.png", None, None, "no_face"), ("4.png", None, None, "no_face"), ("5.png", None, None, "read_error")]
    assert sorted((r.path, r.score, r.prediction, r.status) for r in got.collect()) == want
    none = evaluate.scored_catalog(frame, decoded, crop, None, 0.5).filter("score IS NOT NULL")
    assert none.isEmpty()


def test_evaluation_files_score_each_face_once(spark, monkeypatch):
    """Predictions and metrics are of one run of the model."""
    from framesift.plans import results

    scored, model = spark.sparkContext.accumulator(0), results._model

    def counting():
        run = model()
        return lambda batch: scored.add(len(batch)) or run(batch)

    monkeypatch.setattr(results, "_model", counting)
    rows = results.evaluation_files(spark, "/root/testdata/sf0.001")
    assert scored.value == rows.filter("status = 'evaluated'").count() > 0
