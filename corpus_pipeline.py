"""A training corpus in five stages: language ID, near-duplicate removal, secret scans, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. Rows are compared with nothing outside the docs they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenguard.llm import bpe, language, mixing, ngram_join, secrets
from tokenguard.llm.common import materialize, table

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a text or without any letter go; nulls in lang become the predicted language, labels stay. Where no
    document has a label nothing can be learned: the others then stay as they are."""
    columns = docs.columns
    languages, log_probs = language.fit(docs)
    if not languages:
        return docs.where(language.has_letter(F.col("text")))
    found = language.predict(docs, languages, log_probs, keep=columns).where(F.col("lang_pred") != language.UNDETERMINED)
    return found.select(F.col("kept").withField("lang", F.coalesce("kept.lang", "lang_pred")).alias("kept")).select("kept.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id; rows without an id stay.

    Rows that repeat an id and a text are one document: they stay or go together."""
    copies = ngram_join.join(docs).where("doc_id <> component_id").select("doc_id", "text_key").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("kept"), "doc_id", F.xxhash64("text").alias("text_key"))
    return keyed.join(copies, ["doc_id", "text_key"], "left_anti").select("kept.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become [SECRET]; n_chars follows the text."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("doc_key")  # ids may repeat
    found = materialize(secrets.scan(docs.select(key.alias("doc_id"), "text")))
    pieces = found.groupBy(F.col("doc_id").alias("doc_key")).agg(F.array_sort(F.collect_set("piece")).alias("pieces"))
    met = docs.select(F.struct(*docs.columns).alias("kept"), key).join(pieces, "doc_key", "left")
    text = secrets.redact(F.col("kept.text"), F.col("pieces"))
    clean = met.withColumn("text", F.when(F.col("pieces").isNotNull(), text))
    changed = F.col("kept").withField("text", F.col("text")).withField("n_chars", F.length("text").cast("long"))
    return clean.select(F.when(F.col("pieces").isNull(), F.col("kept")).otherwise(changed).alias("kept")).select("kept.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document is repeated as often as the mix takes it, so some go."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the token ids and of the text they decode to, for each row."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
