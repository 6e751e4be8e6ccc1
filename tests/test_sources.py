"""Manifests by record against Python's reader; the status machine against a plain one, over restarts and expiry."""

import csv
import datetime as dt
import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framesift.operators.process import STEPS
from framesift.sources import checkpoint, manifest, media
from framesift.streaming import machine


@pytest.fixture
def split(spark):
    """Files are read in blocks of 150 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_manifest_records(spark, split, tmp_path):
    rng = random.Random(1)
    bits = ["a", "b c", '"', '""', ",", "\n", "\r\n", "é", "", "x" * 30, " lead", "trail ", "\\", "\t", "\n\n"]
    want = {}
    for k in range(3):
        order, at = rng.sample(["path", "label", "note"], 3), tmp_path / f"{k}.csv"
        with at.open("w", newline="", encoding="utf-8-sig" if k == 1 else "utf-8") as f:
            w = csv.writer(f, lineterminator="\r\n" if k == 2 else "\n")
            w.writerow([*order, "extra"])
            for _ in range(30):
                if rng.random() < 0.1:
                    f.write("\n")
                w.writerow(["".join(rng.choices(bits, k=rng.randint(0, 5))) for _ in range(4)])
        with at.open(newline="", encoding="utf-8-sig") as f:
            want[f"{k}.csv"] = [(n, r["path"], r["label"], r["note"]) for n, r in enumerate(csv.DictReader(f), start=2)]
    found = {}
    for r in manifest.csv_records(spark, str(tmp_path), ["path", "label", "note"]).collect():
        found.setdefault(os.path.basename(r.file), []).append((r.line, r.path, r.label, r.note))
    assert {k: sorted(v) for k, v in found.items()} == want
    with pytest.raises(ValueError, match="missing columns: other"):
        manifest.csv_records(spark, str(tmp_path), ["path", "other"])


def test_manifest_edges(spark, split, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf\n\na,b\n1\n2,3,4\n\n\n\"x\ny\"\"\",5")
    (tmp_path / "b.csv").write_text("b,a\n")
    (tmp_path / "c.csv").write_text("")
    rows = manifest.csv_records(spark, str(tmp_path), ["a", "b"]).collect()
    assert sorted((r.line, r.a, r.b) for r in rows) == [(2, "1", ""), (3, "2", "3"), (4, 'x\ny"', "5")]
    typed = media.csv_rows(spark, str(tmp_path / "a.csv"), "b int, a string")
    assert sorted((r.line, r.a, r.b) for r in typed.collect()) == [(2, "1", None), (3, "2", 3), (4, 'x\ny"', 5)]


def moment(seconds):
    return dt.datetime(2026, 1, 1) + dt.timedelta(seconds=seconds)


def plain_machine(batches):
    """Outcomes of batches of (id, status, seconds), one entry after the other."""
    now, out = {}, []
    for batch in batches:
        for name, status, at in sorted(batch, key=lambda e: (e[0], e[2], e[1])):
            before, since = now.get(name, (None, None))
            said = "accepted" if (status == "queued" if before is None else at >= since and status in STEPS.get(before, ())) else "forbidden" if before is None else "late" if at < since else "repeated" if status == before else "forbidden"
            if said == "accepted":
                now[name] = status, at
            out.append((name, status, moment(at), said))
    return sorted(out)


def run(spark, folder, name, retention=None, lateness="1000 days"):
    stream = spark.readStream.schema("id string, status string, at timestamp").parquet(f"{folder}/in")
    told = machine.checked_steps(stream, retention_seconds=retention, lateness=lateness)
    told.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.schema(machine.OUT).parquet(f"{folder}/{name}").collect()))


@pytest.fixture
def stateful(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, machine.PROVIDER)
    yield
    spark.conf.set(key, before)


def put(spark, folder, rows):
    spark.createDataFrame([(i, s, moment(t)) for i, s, t in rows], "id string, status string, at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_status_machine_over_restarts(spark, stateful, tmp_path):
    """A stream that is stopped and taken up again tells what one run over the same batches tells."""
    rng = random.Random(4)
    statuses = ["queued", "processing", "completed", "partially_completed", "failed", "lost"]
    batches = [[(f"j{rng.randrange(6)}", rng.choice(statuses), t + rng.randrange(-9, 9) + 20) for t in range(k * 40, k * 40 + 40)] for k in range(2)]
    for k in range(2):
        put(spark, tmp_path, batches[k])
        found = run(spark, tmp_path, "restarted")
        assert found == plain_machine(batches[: k + 1])
    assert run(spark, tmp_path, "restarted") == found  # nothing new, nothing told again
    assert {r[3] for r in found} >= {"accepted", "repeated", "forbidden"}


def test_finished_jobs_expire(spark, stateful, tmp_path):
    put(spark, tmp_path, [("a", "queued", 0), ("a", "processing", 1), ("a", "completed", 4), ("b", "queued", 2)])
    assert "expired" not in {r[3] for r in run(spark, tmp_path, "out", 10, "0 seconds")}
    put(spark, tmp_path, [("b", "processing", 100)])
    found = run(spark, tmp_path, "out", 10, "0 seconds")
    assert [r for r in found if r[3] == "expired"] == [("a", "completed", moment(4), "expired")]
    put(spark, tmp_path, [("a", "queued", 101), ("b", "failed", 102), (None, "queued", 103), ("c", None, 104)])
    found = run(spark, tmp_path, "out", 10, "0 seconds")
    assert ("a", "queued", moment(101), "accepted") in found and ("b", "failed", moment(102), "accepted") in found
    assert len(found) == 8


def test_state_is_fetched_once_a_part():
    """Calls of the state store grow with the parts, not with the jobs; a part's jobs expire each at their own time."""
    calls = []

    class Held:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.held, self.timers = Held(), set()

        def getValueState(self, *_):  # noqa: N802
            return self.held

        def registerTimer(self, at):  # noqa: N802
            self.timers.add(at)

    class Fired:
        def __init__(self, at):
            self.getExpiryTimeInMs = lambda: at

    handle, part = Handle(), machine.StatusMachine(10)
    part.init(handle)
    entries = [(f"j{k}", s, (k * 10 + i) * 1_000_000) for k in range(500) for i, s in enumerate(("queued", "processing", "failed"))]
    frames = [pd.DataFrame(entries[i::2], columns=["id", "status", "micros"]) for i in range(2)]
    (told,) = part.handleInputRows((0,), iter(frames), None)
    assert len(told) == 1500 and set(told["outcome"]) == {"accepted"} and calls == ["get", "update"]
    assert handle.timers == {(k * 10 + 2 + 10) * 1000 for k in range(500)}
    (gone,) = part.handleExpiredTimer((0,), None, Fired(22_000))
    assert gone.to_numpy().tolist() == [["j0", "failed", 2_000_000, "expired"], ["j1", "failed", 12_000_000, "expired"]]
    assert len(handle.held.value[0]) == 498 and list(part.handleExpiredTimer((0,), None, Fired(22_000))) == []


def container(tensors, metadata=None):
    """name -> array as a container."""
    body, header = b"", {"__metadata__": metadata} if metadata else {}
    names = {"float32": "F32", "float64": "F64", "int64": "I64", "uint8": "U8", "float16": "F16"}
    for name, x in tensors.items():
        header[name] = {"dtype": names[str(x.dtype)], "shape": list(x.shape), "data_offsets": [len(body), len(body) + x.nbytes]}
        body += x.tobytes()
    text = json.dumps(header).encode()
    return len(text).to_bytes(8, "little") + text + body


def test_checkpoints(spark, tmp_path):
    rng = np.random.default_rng(1)
    weights = {"module.classifier.w": rng.normal(size=(3, 2)).astype(np.float32), "module._orig_mod.classifier.b": np.array([0.5, -1.0]), "freq_conv.k": rng.integers(0, 9, (2, 1, 4)), "scalar": np.array(7, np.uint8), "empty": np.zeros((0, 5), np.float16)}
    (tmp_path / "m.safetensors").write_bytes(container(weights, {"temperature": "1.5"}))
    found = checkpoint.read(spark, str(tmp_path))
    clean = {k.removeprefix("module.").removeprefix("_orig_mod."): v for k, v in weights.items()}
    got = checkpoint.arrays(found)
    assert got.keys() == clean.keys() and all(np.array_equal(got[k], v) and got[k].dtype == v.dtype for k, v in clean.items())
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    assert checkpoint.containers(files).first().metadata == {"temperature": "1.5"}
    own = spark.createDataFrame([(k, list(v.shape)) for k, v in clean.items()] + [("head.x", [1])], "name string, shape array<long>")
    checkpoint.check(found, own, ("classifier", "freq_conv"))
    assert {r.name: r.status for r in checkpoint.compared(found, own.filter("name <> 'scalar'")).collect()} == {**dict.fromkeys(clean, "ok"), "scalar": "unexpected", "head.x": "missing"}
    for expected, critical, what in ((own, ("head",), "head.x missing"), (own.withColumn("shape", F.array(F.lit(9))), (), "classifier.b differs")):
        with pytest.raises(ValueError, match=what):
            checkpoint.check(found, expected, critical)
    with pytest.raises(ValueError, match="may be sent"):
        checkpoint.arrays(found, 10)

    built = spark.sparkContext.accumulator(0)

    def build(held):
        built.add(1)
        return lambda batch: [float(np.array(x) @ held["classifier.w"] @ held["classifier.b"]) for x in batch]

    frames = spark.createDataFrame([(i, [float(i), 1.0, -2.0]) for i in range(9)], "id int, x array<double>").repartition(3)
    rows = checkpoint.score(frames, found, build, features="x").collect()
    assert all(abs(r.probability - float(np.array(r.x) @ clean["classifier.w"] @ clean["classifier.b"])) < 1e-9 for r in rows) and 1 <= built.value <= 3


def test_broken_checkpoints(spark):
    good = container({"a": np.arange(4.0)})
    wrong = json.dumps({"a": {"dtype": "F64", "shape": [5], "data_offsets": [0, 32]}, "b": {"dtype": "Q7", "shape": [1], "data_offsets": [0, 8]}, "c": {"dtype": "U8", "shape": [9], "data_offsets": [30, 39]}, "d": 5}).encode()
    files = {"good": good, "cut": good[:-1], "text": b"not a container", "short": b"abc", "none": None, "empty": b"", "json": (9).to_bytes(8, "little") + b"\xff not json", "long": b"\xff" * 40, "wrong": len(wrong).to_bytes(8, "little") + wrong + bytes(32)}
    frame = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "path string, content binary")
    told = {(r.path, r.key): r.problem for r in checkpoint.tensors(frame).collect()}
    assert told.pop(("good", "a")) is None and told.pop(("cut", "a")) == "range and shape differ"
    assert {k[1]: v for k, v in told.items() if k[0] == "wrong"} == {"a": "range and shape differ", "b": "unknown dtype", "c": "range and shape differ", "d": "unknown dtype"}
    assert {k[0] for k, v in told.items() if k[1] is None and v} == {"text", "short", "none", "empty", "json", "long"}
    with pytest.raises(ValueError, match="broken"):
        checkpoint.check(checkpoint.tensors(frame.filter("path = 'cut'")), spark.createDataFrame([("a", [4])], "name string, shape array<long>"), ())
    with pytest.raises(ValueError, match="no tensors"):
        checkpoint.check(checkpoint.tensors(frame.limit(0)), spark.createDataFrame([("a", [4])], "name string, shape array<long>"), ())
