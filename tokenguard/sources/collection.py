"""Versioned vector collections: data folders, delta folders, and a manifest for each version.

A version is published by one rename of its manifest, after its rows are written; what fails before leaves the version before.
Rows are never changed in place, so readers go on with the version that they have opened. A delta holds changed and removed
rows and is merged when the collection is read; `compact` writes the merged rows as a version without deltas, `vacuum` deletes
folders that no kept version names. Of two writers of one version the second fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tokenguard.functions import text as T

MANIFEST = "sequence long, dim int, metric string, row_count long, data array<string>, deltas array<string>"
REMOVED = "_removed"
SHOWN = 5  # rows that are shown when personal data is found


class PersonalData(ValueError):
    """Rows with personal data were refused."""


def files_of(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The versions that have a manifest (json) or were begun (claim), in order."""
    folder, files = files_of(spark, f"{path}/manifest")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.partition(".")[0]) for n in names if n.endswith(f".{kind}"))


def manifest(spark: SparkSession, path: str, sequence: int | None = None) -> dict | None:
    """What a version holds, the latest by default; None if there is none."""
    known = numbers(spark, path, "json")
    if not known or sequence is not None and sequence not in known:
        return None
    row = spark.read.schema(MANIFEST).json(f"{path}/manifest/{known[-1] if sequence is None else sequence}.json").first()
    return row.asDict()


def claim(spark: SparkSession, path: str) -> int:
    """The number of a new version, which no other writer gets."""
    sequence = max([0, *numbers(spark, path, "json"), *numbers(spark, path, "claim")]) + 1
    made, files = files_of(spark, f"{path}/manifest/{sequence}.claim")
    files.mkdirs(made.getParent())
    if not files.createNewFile(made):
        raise FileExistsError(f"version {sequence} of {path} is being written")
    return sequence


def publish(spark: SparkSession, path: str, sequence: int, dim: int, metric: str, rows: int, data: Sequence[str], deltas: Sequence[str]) -> None:
    content = json.dumps({"sequence": sequence, "dim": dim, "metric": metric, "row_count": rows, "data": list(data), "deltas": list(deltas)})
    draft, files = files_of(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(content.encode()))
    out.close()
    if not files.rename(draft, files_of(spark, f"{path}/manifest/{sequence}.json")[0]):
        raise OSError(f"version {sequence} of {path} can't be published")


def staged(rows: DataFrame, path: str, dim: int, key: str, gate: str | None) -> tuple[str, int]:
    """Write rows into a folder of their own, which no version names yet; the folder and the number of rows, which are counted
    as they are written, like rows with personal data in the column `gate`. Where there are any, the first are shown, the
    folder is deleted, and the write is refused. So is one with a vector of another length."""
    spark, name, seen = rows.sparkSession, uuid.uuid4().hex, Observation()
    removed = F.col(REMOVED) if REMOVED in rows.columns else F.lit(False)
    fits = F.when(removed | (F.size("vector") == dim), F.lit(True)).otherwise(F.raise_error(F.lit("a vector has another dimension")).cast("boolean"))
    counts = [F.count(F.lit(1)).alias("rows")] + ([F.count_if(T.leaks_pii(F.col(gate))).alias("leaks")] if gate else [])
    folder, files = files_of(spark, f"{path}/data/{name}")
    try:
        rows.where(fits).observe(seen, *counts).write.parquet(f"{path}/data/{name}")
        found = seen.get
        if found.get("leaks"):
            shown = [tuple(r) for r in spark.read.parquet(f"{path}/data/{name}").where(T.leaks_pii(F.col(gate))).select(key, gate).orderBy(key).limit(SHOWN).collect()]
            raise PersonalData(f"{found['leaks']} of {found['rows']} rows hold personal data, the first: {shown}")
    except BaseException:
        files.delete(folder, True)
        raise
    return name, found["rows"]


def replace(rows: DataFrame, path: str, dim: int, metric: str = "COSINE", key: str = "id", gate: str | None = None) -> int:
    """A new version with these rows (key, vector, ...) alone; their number."""
    spark = rows.sparkSession
    sequence = claim(spark, path)
    name, n = staged(rows, path, dim, key, gate)
    publish(spark, path, sequence, dim, metric, n, [name], [])
    return n


def merge(rows: DataFrame, path: str, removed: DataFrame | None = None, key: str = "id", gate: str | None = None) -> int:
    """A new version in which these rows stand in place of those with the same keys, and the keys of `removed` have gone. Only
    the changes are written. Returns the number of changes; keys must be different among them."""
    spark, now = rows.sparkSession, manifest(rows.sparkSession, path)
    if now is None:
        raise FileNotFoundError(f"there is no collection in {path}")
    changes = rows.withColumn(REMOVED, F.lit(False))
    if removed is not None:
        changes = changes.unionByName(removed.select(key).distinct().withColumn(REMOVED, F.lit(True)), allowMissingColumns=True)
    sequence = claim(spark, path)
    name, n = staged(changes, path, now["dim"], key, gate)
    if manifest(spark, path)["sequence"] != now["sequence"]:
        raise FileExistsError(f"{path} has got another version meanwhile")
    total = merged(spark, path, now["data"], [*now["deltas"], name], key).count()
    publish(spark, path, sequence, now["dim"], now["metric"], total, now["data"], [*now["deltas"], name])
    return n


def merged(spark: SparkSession, path: str, data: Sequence[str], deltas: Sequence[str], key: str) -> DataFrame:
    """The rows of data folders and deltas, later ones first: a row counts unless a later delta has its key."""
    rows = spark.read.parquet(*[f"{path}/data/{d}" for d in data])
    for d in deltas:
        delta = spark.read.parquet(f"{path}/data/{d}")
        rows = rows.join(delta.select(key), key, "left_anti").unionByName(delta.where(~F.col(REMOVED)).drop(REMOVED), allowMissingColumns=True)
    return rows


def read(spark: SparkSession, path: str, sequence: int | None = None, key: str = "id") -> DataFrame | None:
    """The rows of a version, the latest by default; None if there is none."""
    found = manifest(spark, path, sequence)
    return None if found is None else merged(spark, path, found["data"], found["deltas"], key)


def compact(spark: SparkSession, path: str, key: str = "id") -> int:
    """A new version with the same rows and no deltas; their number."""
    now = manifest(spark, path)
    return replace(merged(spark, path, now["data"], now["deltas"], key), path, now["dim"], now["metric"], key)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete the manifests but the last `keep`, and the folders that none of those names; the folders' names. No write may be
    under way."""
    known = numbers(spark, path, "json")
    for sequence in known[: len(known) - keep]:
        gone, files = files_of(spark, f"{path}/manifest/{sequence}.json")
        files.delete(gone, False)
    named = {d for s in known[len(known) - keep :] for m in [manifest(spark, path, s)] for d in (*m["data"], *m["deltas"])}
    folder, files = files_of(spark, f"{path}/data")
    old = [s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName() not in named]
    for name in old:
        files.delete(files_of(spark, f"{path}/data/{name}")[0], True)
    return old
