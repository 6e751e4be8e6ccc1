import datetime
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.functions import graph, pixels
from framesift.operators import catalog, forensics, headers, imaging, ingest, jobs, metrics, report, rollups, sampling, scoring, video, watermark
from framesift.sources import media
from framesift.streaming import ingest as streaming


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("head", "kind"),
    [("FFD8FFE0", "image/jpeg"), ("89504E470D0A1A0A00", "image/png"), ("000000186674797069736F6D", "video/mp4"), ("00000014667479707174202000", "video/quicktime"), ("00", None), ("", None)],
)
def test_magic_bytes(spark, head, kind):
    assert one(spark, ingest.media_type(F.unhex(F.lit(head)))) == kind


def test_names_and_paths(spark):
    names = {"a/b.png": "b.png", "..": "unnamed", "": "unnamed", "x/.": "x", "dir/": "dir", "a/..": "unnamed"}
    for name, safe in names.items():
        assert one(spark, ingest.safe_name(F.lit(name))) == safe
    for path, inside in {"a/../b": True, "a/../../b": False, "/a": False, "C:/a": False, "./a": True, "../a": False}.items():
        assert one(spark, ingest.stays_inside(F.lit(path))) is inside


def test_sampling_golden(spark):
    videos = spark.createDataFrame([(1, 20, 10.0)], "v long, total long, fps double")
    rows = sampling.sampled_frames(videos, interval_seconds=0.5, most=3).orderBy("ordinal").collect()
    assert [(r.frame_index, r.timestamp_seconds) for r in rows] == [(0, 0.0), (10, 1.0), (19, 1.9)]
    assert all(r.capped for r in rows)
    assert one(spark, sampling.even_indices(F.lit(300)))[-1] == 299
    assert one(spark, sampling.even_indices(F.lit(1))) == [0]


def test_softmax_score(spark):
    frames = spark.createDataFrame([(1, 0.1), (1, 0.2), (1, 0.9), (2, 2.0)], "v long, s double")
    got = {r.v: r.video_score for r in scoring.video_scores(frames, "v", "s").collect()}
    v = np.array([0.1, 0.2, 0.9])
    w = np.exp((v - v.max()) / 0.1)
    assert abs(got[1] - (v * w).sum() / w.sum()) < 1e-12
    assert 0.85 < got[1] < 0.91 and got[2] == 1.0


def test_metrics_golden(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.6), (1, 0.9)], "label int, score double")
    r = metrics.evaluate(rows, 0.5).first()
    assert (r.tp, r.tn, r.fp, r.fn, r.accuracy, r.f1, r.roc_auc) == (2, 2, 0, 0, 1.0, 1.0, 1.0)
    tie = spark.createDataFrame([(0, 0.5), (1, 0.5)], "label int, score double")
    assert metrics.roc_auc(tie).first()["roc_auc"] == 0.5
    assert metrics.roc_auc(rows.filter("label = 1")).first()["roc_auc"] is None
    with pytest.raises(ValueError):
        metrics.evaluate(rows.filter("score > 2"), 0.5)
    with pytest.raises(ValueError):
        metrics.evaluate(rows, 1.01)


def test_payload_layouts(spark):
    def found(data):
        p = spark.createDataFrame([(bytearray(data),)], "s binary").select(forensics.payload(F.col("s")).alias("p")).first()["p"]
        return p.method, p.payload and bytes(p.payload)

    assert found(b"STEGv1:review\0rest") == ("STEGv1 marker", b"review")
    assert found(b"STEGv1:\0rest") == ("STEGv1 marker", None)
    assert found(b"\0\0\0\5hello!!!") == ("32-bit length prefix (text-like payload)", b"hello")
    assert found(b"\0\0\0\4%PDFxxxx")[0] == "32-bit length prefix (PDF)"
    assert found(b"MZ\xff\xff\xff\xff\xff\xff")[0] == "Windows executable signature at LSB stream start"
    assert found(b"\xff" * 80) == (None, None)
    assert found(b"x" * 58 + b"STEGv1:late\0") == (None, None)


def test_provenance(spark):
    def scan(text):
        return spark.createDataFrame([(bytearray(text.encode()),)], "c binary").select(forensics.provenance(F.col("c")).alias("p")).first()["p"]

    p = scan("prefix C2PA manifest Created by Google Generative AI Gemini trainedAlgorithmicMedia suffix")
    assert p.c2pa_markers == ["c2pa"] and p.providers == ["Google Gemini", "Google Generative AI"] and p.ai_claims and not p.signature_verified
    assert not scan("C2PA camera provenance manifest").ai_claims
    assert not scan("photographer added visible watermark").ai_claims


def test_provenance_scan_reads_whole_texts(spark, tmp_path):
    """A marker of the text itself is found wherever it stands."""
    from framesift.plans.catalogue import QUERIES

    rows = [(4 + 7 * i, "x" * a + " made with Midjourney " + "y" * (3000 - a)) for i, a in enumerate((0, 700, 1500, 2200, 3000, 1000))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.providers for r in QUERIES["provenance_scan"](spark, str(tmp_path)).collect()}
    assert got == {d: "Midjourney" for d, _ in rows}


def test_jobs(spark):
    now = datetime.datetime(2026, 9, 11, 12)
    rows = [("ab12", "completed", "Clip.MOV", now, now, None, "r"), ("ab34", "failed", "Image.PNG", now, now - datetime.timedelta(hours=2), "e", None), ("zz", "processing", "x", now, now - datetime.timedelta(days=2), None, None)]
    j = spark.createDataFrame(rows, "id string, status string, source_name string, created_at timestamp, updated_at timestamp, error string, result string")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(jobs.search(j, " CLIP ")) == ["ab12"] and ids(jobs.search(j, "AB", "failed")) == ["ab34"] and ids(jobs.search(j, "clip", "failed")) == []
    assert ids(jobs.expired(j, F.lit(now - datetime.timedelta(hours=1)))) == ["ab34"]
    changed = jobs.update(j, spark.createDataFrame([("ab12", "failed", now, None, None)], "id string, status string, updated_at timestamp, error string, result string"))
    r = changed.filter("id = 'ab12'").first()
    assert (r.status, r.error, r.result) == ("failed", None, "r")
    with pytest.raises(KeyError):
        jobs.require(j, "none")
    with pytest.raises(ValueError):
        jobs.cutoff(now, 1)
    t = jobs.Throttle(60)
    assert [t.due(0), t.due(30), t.due(61)] == [True, False, True]


def test_retention_plan_holds_no_list(spark):
    """Expired ids are rows; their digest is that of the sorted list, over many blocks, one or none."""
    now = datetime.datetime(2026, 9, 11, 12)
    j = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 7 == 0, "queued").otherwise("failed").alias("status"), F.lit(now).alias("updated_at"))
    plan = jobs.retention_plan(j, F.lit(now + datetime.timedelta(hours=1)), F.col("id").cast("long") % 10 != 0)
    want = sorted(str(i) for i in range(3000) if i % 7 and i % 10)
    assert plan.columns == ["id", "safe"] and sorted(r.id for r in plan.filter("safe").collect()) == want
    expired = sum(1 for i in range(3000) if i % 7)
    assert tuple(jobs.retention_counts(plan).first()) == (expired, len(want), expired - len(want))
    for ids, size in ((want, 50), (want, 1 << 20), (want[:5] * 9 + ["é", "z" * 200], 10), ([], 10)):
        rows = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id string").repartition(3)
        assert [r.sha256 for r in jobs.ids_sha256(rows, size).collect()] == [hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()]


def test_components_and_splits(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "d"), (6, "d"), (7, "e")], "key long, constraint string")
    got = {r.key: r.component for r in catalog.components(rows).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    sizes = [(1, 2, 1), (4, 1, 0), (5, 1, 1), (7, 0, 1)]
    assert catalog.assign_splits(sizes) == catalog.assign_splits(sizes[::-1])
    assert set(catalog.assign_splits(sizes).values()) == set(catalog.SPLITS)
    for bad in ((0.5, 0.5, 0.1), (1.0, 0.0, 0.0)):
        with pytest.raises(ValueError):
            catalog.assign_splits(sizes, bad)
    with pytest.raises(ValueError):
        catalog.assign_splits(sizes[:2])


def test_split_by_size_classes(spark, monkeypatch):
    """Each component gets one split, shares hold in size and labels, and no component is a row on the driver."""
    size = lambda i: 60 if i < 3 else 1 + i % 4
    rows = [(i, (i + j) % 2) for i in range(900) for j in range(size(i))]
    records = spark.createDataFrame(rows, "component long, label int")
    most, made = [], spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: most.append(len(data)) or made(data, *a, **b))
    got = catalog.split_components(records, bucket_size=50)
    monkeypatch.undo()
    assert most and max(most) < 20
    split = dict(got.collect())
    assert len(split) == got.count() == 900
    # Here each size has one class, so the counts are those of the rule that takes components one by one.
    sizes = [(i, sum((i + j) % 2 == 0 for j in range(size(i))), sum((i + j) % 2 for j in range(size(i)))) for i in range(900)]
    told = catalog.assign_splits(sizes)
    for name in catalog.SPLITS:
        assert Counter((r, f) for i, r, f in sizes if split[i] == name) == Counter((r, f) for i, r, f in sizes if told[i] == name)
    assert dict(catalog.split_components(records.repartition(7), bucket_size=50).collect()) == split
    many = [(1, 0, 10**9), (0, 1, 10**9), (500, 400, 3)]
    assert {(r, f, sum(q)) for r, f, *q in catalog.split_quotas(many)} == set(many)
    with pytest.raises(ValueError):
        catalog.split_quotas([(1, 0, 2)])


def test_split_covers_all_records(spark):
    """Every order is in the component that union-find gives it, and each component in one split."""
    from framesift.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    head = {}

    def top(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for k, c in orders:
        for i in (c, c + 1) if k % 70 == 0 else (c,):
            head[top(("c", i))] = top(("k", k))
    least = {}
    for k, _ in orders:
        least[top(("k", k))] = min(k, least.get(top(("k", k)), k))
    want = {k: least[top(("k", k))] for k, _ in orders}
    assert {r.key: r.component for r in QUERIES["components_all"](spark, sf).collect()} == want
    got = QUERIES["split_assign"](spark, sf).collect()
    assert len(got) == len(orders) and {r.key: r.component for r in got} == want
    assert len({(r.component, r.split) for r in got}) == len(set(want.values())) and {r.split for r in got} == set(catalog.SPLITS)


def test_components_link_only_records_of_several_constraints(spark, monkeypatch):
    """Rounds see one link a constraint of a record that holds several; records of one constraint link nothing."""
    seen = []
    monkeypatch.setattr(catalog, "connected_components", lambda links: seen.append(links.filter("a <> b").count()) or graph.connected_components(links))
    rows = [(k, f"c{k % 40}") for k in range(400)] + [(7, "c8"), (8, "c9"), (39, "c0"), (39, "c1"), (500, None), (501, "alone")]
    got = dict(catalog.components(spark.createDataFrame(rows, "key long, constraint string")).collect())
    head = {r: r for r in range(40)} | {8: 7, 9: 7, 39: 0, 1: 0}
    assert got == {k: head[k % 40] for k in range(400)} | {500: 500, 501: 501}
    assert seen == [3]


def test_long_chain_is_one_component(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    from framesift.functions.graph import connected_components

    assert {r.component for r in connected_components(links).collect()} == {0}
    assert connected_components(links.limit(0)).count() == 0


def test_pixels_keyed_and_statistics():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (32, 32, 3), dtype=np.uint8)
    data = b"STEGv1:" + b"binary\0payload\xff" + b"\0"
    flat = rgb.reshape(-1)
    at = np.random.default_rng(812).permutation(flat.size)[: 8 * len(data)]
    flat[at] = flat[at] & 0xFE | np.unpackbits(np.frombuffer(data, np.uint8))
    assert pixels.keyed_payload(rgb, 812, 15) == b"binary\0payload\xff"
    with pytest.raises(ValueError):
        pixels.keyed_payload(rgb, 813, 15)
    with pytest.raises(ValueError):
        pixels.keyed_payload(rgb[:4, :4], 812, 128)
    assert pixels.lsb_statistics(np.full((4, 4, 3), 128, np.uint8)) == [(0.0, 1.0)] * 3


def test_pixels_maps(spark):
    rgb = np.zeros((40, 50, 3), np.uint8)
    rgb[10:30, 10:30] = (220, 30, 30)
    assert pixels.error_summary(pixels.error_levels(rgb, rgb)) == (0.0, 0.0, 0, 0.0)
    again = np.where(rgb > 0, rgb - 20, rgb)
    assert pixels.error_summary(pixels.error_levels(rgb, again)) == (4.0, 20.0, 20, 0.2) and pixels.heatmap(rgb, again).max() == 255
    assert pixels.residual_maps(rgb).shape == (9, 40, 50)
    assert np.isfinite(pixels.spectrum_maps(pixels.residual_maps(rgb))).all()
    w = pixels.constrained(np.random.default_rng(0).normal(size=(2, 5, 5)))
    assert np.allclose(w[:, 2, 2], -1) and np.allclose(w.sum(axis=(1, 2)), 0)
    plane = np.arange(12.0).reshape(3, 4)
    assert np.array_equal(pixels.resized(plane, 3, 4), plane) and np.allclose(pixels.resized(plane, 6, 8).mean(), plane.mean())
    frame = spark.createDataFrame([("x", video.as_image(rgb)), ("y", None)], f"k string, image {imaging.IMAGE}")
    i = F.col("image")
    got = {r.k: r for r in frame.select("k", imaging.residuals(i).alias("r"), imaging.spectra(i).alias("s"), imaging.prediction_errors(i, np.ones((2, 5, 5))).alias("p"), imaging.keyed_payload(i, F.lit(1), F.lit(9)).alias("h")).collect()}
    assert len(got["x"].r.levels) == 9 and len(got["x"].r.map) == 2000 and len(got["x"].s.levels) == 18 and len(got["x"].p.levels) == 6
    assert got["x"].h.error.startswith("ValueError") and got["x"].h.payload is None and got["y"].r is None


def frame_with(star, rng, size=34, at=(283, 563)):
    g = np.tile(np.linspace(40, 90, 640), (360, 1)) + rng.integers(0, 12, (360, 640))
    if star:
        y, x = at
        g[y : y + size, x : x + size] = np.maximum(g[y : y + size, x : x + size], pixels.star_template(size))
    return video.as_image(np.repeat(g.astype(np.uint8)[..., None], 3, axis=2))


def test_visible_marks(spark):
    """The best match over all corners and sizes, told by a plain loop; only the bottom right one is a mark."""
    rng = np.random.default_rng(0)
    rows = [("marked", i, frame_with(True, rng)) for i in range(4)] + [("plain", i, frame_with(False, rng)) for i in range(4)]
    rows += [("elsewhere", i, frame_with(True, rng, at=(20, 20))) for i in range(3)] + [("one", 0, frame_with(True, rng)), ("lost", 0, None)]
    frames = spark.createDataFrame(rows, f"job_id string, frame_index long, image {imaging.IMAGE}")
    got = {r.job_id: r.watermark for r in watermark.visible_marks(frames).collect()}
    assert got["marked"].found and got["marked"].location == "bottom_right" and got["marked"].score >= 0.6 and got["marked"].box.x > 416 and got["marked"].frames == 4
    assert not got["plain"].found and got["plain"].box is None
    assert not got["elsewhere"].found and got["elsewhere"].score >= 0.6 and got["elsewhere"].location is None
    assert got["one"].found == (got["one"].score >= 0.88) and "lost" not in got
    best = {r.job_id: r for r in watermark.best_match(watermark.evidence(watermark.chosen(frames))).collect()}
    assert best["elsewhere"].corner == "top_left" and abs(best["elsewhere"].box.x - 20) <= 4
    maps = watermark.evidence(watermark.chosen(frames)).filter("job_id = 'marked'").first()
    plane = np.frombuffer(maps["map"], np.uint8).reshape(maps.height, maps.width).astype(float)
    scores = [pixels.correlation(plane[int(h * b0) : int(h * b1), int(w * a0) : int(w * a1)], pixels.star_template(n)).max() for h, w in [plane.shape] for a0, b0, a1, b1 in watermark.CORNERS.values() for n in range(18, 60) if n in {max(18, round(27 * s)) for s in watermark.SCALES}]
    assert abs(max(scores) - best["marked"].score) < 1e-9


def test_at_most_twelve_frames(spark):
    rows = [("j", i) for i in range(300)] + [("k", i) for i in range(5)]
    got = watermark.chosen(spark.createDataFrame(rows, "job_id string, frame_index long")).collect()
    assert sorted(r.frame_index for r in got if r.job_id == "j") == [int(i * 299 / 11) for i in range(12)] and sum(r.job_id == "k" for r in got) == 5


def test_image_source_round_trip(spark, tmp_path):
    import struct
    import zlib

    rgb = np.full((64, 64, 3), 128, np.uint8)
    bits = np.unpackbits(np.frombuffer(b"STEGv1:review-one-secret\0", np.uint8))
    rgb.reshape(-1)[: len(bits)] |= bits
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = b"".join(b"\0" + row.tobytes() for row in rgb)
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 64, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    (tmp_path / "b.png").write_bytes(b"broken")
    decoded = media.images(spark, str(tmp_path))
    assert {r.path[-5:]: (r.reject_reason, r.image is None) for r in decoded.collect()} == {"a.png": (None, False), "b.png": ("unreadable", True)}
    signals = media.image_signals(decoded).collect()
    assert len(signals) == 1 and signals[0].signals.bits == rgb.size
    header = media.files(spark, str(tmp_path)).select(headers.header(F.col("content"), F.lit("image/png")).alias("h")).orderBy("h.format").collect()
    assert (header[1].h.format, header[1].h.mode, header[1].h.width) == ("PNG", "RGB", 64) and header[0].h.parser_warning
    assert signals[0].hidden.method == "STEGv1 marker" and bytes(signals[0].hidden.payload) == b"review-one-secret"
    kinds = {r.path[-5:]: (r.media_type, r.reject_reason) for r in media.catalogued(spark, str(tmp_path)).collect()}
    assert kinds == {"a.png": ("image/png", None), "b.png": (None, "unsupported_type")}


def test_catalog_round_trip_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "a.jpg", 0, ["p1", "p2"], "g", "d", "unspecified", "x")], "sample_id string, path string, label int, identity_ids array<string>, source_group string, dataset string, manipulation string, sha256 string")
    media.write_catalog(rows, str(tmp_path / "c"))
    assert media.read_catalog(spark, str(tmp_path / "c")).first() == rows.first()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.bin").write_bytes(b"\xff\xd8\xff\xe0")
    seen = []
    q = streaming.run_available(streaming.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "k"), lambda df, _: seen.extend(df.select("media_type").collect()))
    q.awaitTermination(60)
    assert [r.media_type for r in seen] == ["image/jpeg"]


def test_views(spark):
    assert one(spark, rollups.percentage(F.lit(1), F.lit(0))) == 0.0
    frame = spark.createDataFrame([("j", None)], "id string, error string")
    assert '"error":null' in report.json_report(frame, "leads only").first()["report"]
    assert one(spark, report.headline(F.lit("inconclusive"), F.lit(0.5), F.lit("completed"))) == "Model score 50.0%"
    box = F.struct(F.lit(10).alias("x"), F.lit(10).alias("y"), F.lit(20).alias("w"), F.lit(10).alias("h"))
    assert tuple(one(spark, scoring.crop_box(box, F.lit(30), F.lit(30)))) == (5, 0, 30, 30)
