"""Hand-offs: found again, built anew when anything differs, committed once, collected when unused."""

import json
import os
import shutil
import subprocess
import sys
import time

import pytest

from churnlens.plans import handoff as H

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", {shared!r}).config("spark.ui.enabled", "false").getOrCreate()
from churnlens.plans import handoff as H
got = H.write_once(spark, {inputs!r}, "numbers", lambda: spark.range({n}).toDF("n"), {{"p": 1}})
import json
print("GOT", json.dumps([got.built, got.marker["attempt"], got.marker["rows"], got.read(spark).count(), got.folder]))
"""


@pytest.fixture
def inputs(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.parquet").write_text("x")
    return str(folder)


@pytest.fixture
def shared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "shared_root", lambda s: str(tmp_path / "shared"))
    return tmp_path / "shared"


def _driver(tmp_path, inputs, n):
    code = RUN.format(root=ROOT, shared=str(tmp_path / "store"), inputs=inputs, n=n)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True).stdout
    return json.loads(out.split("GOT ")[1].splitlines()[0])


def test_a_restarted_driver_reads_the_first_ones_table(tmp_path, inputs):
    first, second = _driver(tmp_path, inputs, 7), _driver(tmp_path, inputs, 9)
    assert first[0] and not second[0]
    assert first[1:] == second[1:] and second[3] == 7  # the second builder's rows were never made
    assert os.listdir(f"{first[4]}/refs") == []  # both let go at their end


def test_key_follows_inputs_parameters_and_code(spark, inputs, monkeypatch):
    key = lambda **p: H.stage_key(spark, inputs, "s", p)
    one = key(a=1)
    assert one == key(a=1) != key(a=2) and one != H.stage_key(spark, inputs, "t", {"a": 1})
    os.utime(f"{inputs}/a.parquet", (1, 1))
    two = key(a=1)
    (open(f"{inputs}/b.parquet", "w")).close()
    assert len({one, two, key(a=1)}) == 3
    three = key(a=1)
    monkeypatch.setattr(H, "code_version", lambda: "other")
    assert key(a=1) != three


def test_an_attempt_without_a_marker_is_not_read(spark, shared, inputs):
    def lost():
        raise KeyError("driver lost")
    with pytest.raises(KeyError):
        H.write_once(spark, inputs, "s", lost)
    folder = f"{shared}/stages/s-{H.stage_key(spark, inputs, 's')}"
    spark.range(99).write.parquet(f"{folder}/attempt-dead")
    got = H.write_once(spark, inputs, "s", lambda: spark.range(3))
    assert got.built and got.read(spark).count() == 3 == got.marker["rows"]
    assert H.write_once(spark, inputs, "s", lost).built is False


def test_the_first_marker_counts(spark, shared, inputs):
    def build():  # another driver commits while this one builds
        inner = H.write_once(spark, inputs, "s", lambda: spark.range(5))
        assert inner.built
        return spark.range(8)
    got = H.write_once(spark, inputs, "s", build)
    assert not got.built and got.read(spark).count() == 5
    assert len([f for f in os.listdir(got.folder) if f.startswith("attempt-")]) == 1


def test_collect_deletes_what_nobody_refers_to(spark, shared, inputs):
    used = H.write_once(spark, inputs, "used", lambda: spark.range(1))
    free = H.write_once(spark, inputs, "free", lambda: spark.range(1))
    shutil.rmtree(f"{free.folder}/refs")
    stale = H.write_once(spark, inputs, "stale", lambda: spark.range(1))
    old = time.time() - 100
    for f in os.listdir(f"{stale.folder}/refs"):
        os.utime(f"{stale.folder}/refs/{f}", (old, old))
    os.makedirs(f"{shared}/stages/dead-1/attempt-1")
    os.utime(f"{shared}/stages/dead-1/attempt-1", (old, old))
    os.makedirs(f"{shared}/stages/young-1/attempt-1")
    gone = H.collect(spark, max_age=50)
    assert sorted(g.split("-")[0] for g in gone) == ["dead", "free", "stale"]
    assert used.read(spark).count() == 1 and sorted(n.split("-")[0] for n in os.listdir(f"{shared}/stages")) == ["used", "young"]
    H.release(spark)
    assert [g.split("-")[0] for g in H.collect(spark, max_age=50)] == ["used"]
