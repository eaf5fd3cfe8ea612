"""Versions of collections: what fails leaves the version before, readers keep theirs, deltas are merged."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tokenguard.sources import collection as C

SCHEMA = "id long, vector array<double>, text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(i), 1.0], t) for i, t in rows], SCHEMA)


def texts(df):
    return {r["id"]: r["text"] for r in df.collect()}


def test_versions(spark, tmp_path):
    path = str(tmp_path / "c")
    assert C.manifest(spark, path) is None and C.read(spark, path) is None
    with pytest.raises(FileNotFoundError):
        C.merge(frame(spark, [(1, "x")]), path)
    assert C.replace(frame(spark, [(i, f"t{i}") for i in range(10)]), path, 2) == 10
    first = C.read(spark, path)
    assert C.merge(frame(spark, [(3, "new"), (20, "more")]), path, removed=spark.createDataFrame([(5,), (5,), (99,)], "id long")) == 4
    want = {i: f"t{i}" for i in range(10) if i != 5} | {3: "new", 20: "more"}
    assert texts(C.read(spark, path)) == want and C.manifest(spark, path)["row_count"] == len(want)
    C.merge(frame(spark, [(5, "back"), (3, "newer")]), path)
    want |= {5: "back", 3: "newer"}
    assert texts(C.read(spark, path)) == want
    assert texts(first) == texts(C.read(spark, path, 1)) == {i: f"t{i}" for i in range(10)}  # who reads a version keeps it
    assert C.compact(spark, path) == len(want)
    now = C.manifest(spark, path)
    assert now["sequence"] == 4 and now["deltas"] == [] and now["row_count"] == len(want) and texts(C.read(spark, path)) == want
    assert len(C.vacuum(spark, path)) == 3 and texts(C.read(spark, path)) == want and C.read(spark, path, 1) is None


def test_failed_writes_leave_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    C.replace(frame(spark, [(1, "a")]), path, 2)
    with pytest.raises(PySparkException):
        C.replace(frame(spark, [(2, "b")]).unionByName(spark.createDataFrame([(3, [1.0], "c")], SCHEMA)), path, 2)
    with pytest.raises(C.PersonalData, match=r"6 of 9 rows.*\(1, 'mail a1@b\.cc'\).*\(5, ") as e:
        C.replace(frame(spark, [(i, f"mail a{i}@b.cc" if i % 4 else "clean") for i in range(9)]), path, 2, gate="text")
    assert "(7," not in str(e.value)  # the first five are shown
    with monkeypatch.context() as m:
        m.setattr(C, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            C.replace(frame(spark, [(4, "d")]), path, 2)
    assert texts(C.read(spark, path)) == {1: "a"}
    assert C.replace(frame(spark, [(5, "e")]), path, 2, gate="text") == 1 and C.manifest(spark, path)["sequence"] > 1
    assert texts(C.read(spark, path)) == {5: "e"}
    C.vacuum(spark, path)
    assert len(list((tmp_path / "c" / "data").iterdir())) == 1


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    C.replace(frame(spark, [(1, "a")]), path, 2)
    monkeypatch.setattr(C, "numbers", lambda *a: [])  # the second has listed the folder before the first wrote its claim
    with pytest.raises(FileExistsError):
        C.replace(frame(spark, [(2, "b")]), path, 2)


def test_rows_are_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = frame(spark, [(i, "t") for i in range(100)]).mapInArrow(count, SCHEMA)
    assert C.replace(rows, str(tmp_path / "c"), 2, gate="text") == 100 and seen.value == 100
