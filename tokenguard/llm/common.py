"""Small helpers shared by the operators: tables, Arrow slices, label splits."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenguard.sources.shared import materialize  # noqa: F401  (the operators take it from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """Let Spark cut what it sends to Python by bytes and not by rows alone, unless the session has a limit of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) == "67108864b":  # Spark's default
        spark.conf.set(name, most)


#: What an operator keeps in a Python worker between its tasks, by its name. Spark hands workers on to other operators.
KEPT: dict[str, dict] = {}


def give_back() -> None:
    """Let the allocators of this Python worker return what they hold free. Workers outlive their tasks, so what one step
    leaves there would count beside the next step's memory, also while only the JVM works."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text_column: str, max_bytes: int = 1 << 20, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about max_bytes of text (one row at least). What other operators than the owner
    have kept in this worker is let go first, and with an owner also what they have left free."""
    for other in KEPT.keys() - {owner}:
        del KEPT[other]
    if owner:
        give_back()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text_column))
        sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def bounded_sample(df: DataFrame, key: str, per_key: int, most_keys: int = 500) -> DataFrame:
    """About per_key rows for each value of key, the same in every run: those whose id's hash falls under a share that
    the counts give (all rows where there are no more). Rows with a null key or doc_id are left out; more than most_keys
    values are refused. Nothing is shuffled but the counts."""
    df = df.where(F.col(key).isNotNull() & F.col("doc_id").isNotNull())
    counts = df.groupBy(key).count().orderBy(key).limit(most_keys + 1).collect()
    if len(counts) > most_keys:
        raise ValueError(f"{key} has more than {most_keys} values")
    turn = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    within = F.lit(False)
    for row in counts:
        within = within | ((F.col(key) == F.lit(row[key])) & (turn < F.lit(min(1 << 30, (per_key << 30) // row["count"]))))
    return df.where(within)


SAMPLE_BYTES = 48 << 20  # of the texts of a labelled sample, about, at most


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_label: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label) of about per_label documents for each label 0 and 1, fewer if their texts have more than about
    most_bytes; a text with more than an eighth of that is left out. A document that has both labels, or rows with other
    labels, are left out as well. The labels picked are few whatever the corpus, so they are broadcast."""
    one = labels.where(F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("other")).where("label = other").drop("other")
    picked = bounded_sample(one, "label", per_label)
    found = materialize(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes // 8))
    size = found.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return found if size <= most_bytes else found.where(F.pmod(F.xxhash64("doc_id", F.lit(18)), F.lit(1 << 30)) < F.lit((most_bytes << 30) // size))
