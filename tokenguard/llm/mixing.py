"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is due target / source size copies on average. The whole part is certain; for the fraction,
documents are ranked by random odds divided by their inclusion odds, and taken from the front until the words taken are
as near to the source's target as whole documents come. The cut sets the level of all inclusion odds of a source; they
differ between its documents by a factor (by default one that falls with the size). The random numbers are digests of the
ids, so reruns agree.

The cut is found through sums over ranges of the rank (a number below 1), two levels and then single ranks, so no task
orders a whole source. Sources differ in nothing but their name; null is a source of its own, ordered last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenguard.llm.common import materialize, table

DIGITS = 256  # ranges at each of the two levels above single documents
SALTS = 64
LEVEL = 16.0  # ratios of about this size get a rank of a half


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_col: str, text: str) -> Column:
    """A number in (0, 1) from the MD5 digest of the id as text; of the text where there is no id."""
    seed = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(seed), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(no_source, source_key, source_size, target): weights go to the sources in code point order, repeating.

    Targets share `share` of all sizes; those above `most` times their source's size stop there, and the rest is shared
    anew. Sorted by size limit per weight, a source stops at its limit iff an equal share of what smaller ones leave
    exceeds it. One row per source goes through one task."""
    by_source = sizes.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy().orderBy("no_source", "source_key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    w = by_source.withColumn("weight", weight).withColumn("most", most * F.col("source_size"))
    everything = Window.partitionBy()
    line = Window.partitionBy().orderBy(F.col("most") / F.col("weight"), "no_source", "source_key")
    w = w.withColumns({
        "wanted": share * F.sum("source_size").over(everything),
        "before": F.coalesce(F.sum("most").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weights": F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)),
    })
    w = w.withColumn("level", (F.col("wanted") - F.col("before")) / F.col("weights"))
    w = w.withColumn("full", F.col("most") <= F.col("weight") * F.col("level"))
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return w.select("no_source", "source_key", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * level).alias("target"))


def sized(docs: DataFrame, propensity: Column | None = None) -> DataFrame:
    """docs with what mixing needs of a row: no_source and source_key, size, and the rank (below 1) in Pareto order."""
    size = word_count(F.col("text"))
    u = uniform("doc_id", "text")
    odds = size_odds if propensity is None else lambda ratio, _: ratio / F.greatest(F.coalesce(propensity.cast("double"), F.lit(1.0)), F.lit(1e-9))
    ratio = odds(u / (1 - u), size)
    return docs.withColumns({"no_source": F.col("source").isNull(), "source_key": F.coalesce("source", F.lit("")), "size": size, "rank": ratio / (LEVEL + ratio)})


def size_odds(ratio: Column, size: Column) -> Column:
    """Random odds divided by inclusion odds, which fall with the square root of the size: what a repeated document costs
    in words that could have been different ones grows with its size, so short ones are repeated more often."""
    return ratio * F.sqrt(F.greatest(size, F.lit(1)).cast("double"))


KEY = ["no_source", "source_key"]


def salted(df: DataFrame) -> DataFrame:
    """A copy of the few rows per source for each salt, so that a large source meets them in many tasks."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def plan(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(no_source, source_key, source_size, target, sure, range, cut) of each source, from (no_source, source_key, size,
    rank): sure whole copies of every document, and one more of those in ranges of the rank before `range`, or in it with a
    rank up to `cut`."""
    first, second = places()
    sizes = sizes.withColumns({"first": first, "second": second, "salt": F.pmod(F.hash("rank"), F.lit(SALTS))})
    wanted = targets(sizes, weights, share, most).withColumn("sure", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    wanted = materialize(wanted.withColumn("rest", F.col("target") - F.col("sure") * F.col("source_size")))

    def crossing(sums: DataFrame, digit: str, start: Column) -> DataFrame:
        """Per source the range in which the running sum passes `rest`, with the sum before it."""
        upto = start + F.sum("words").over(Window.partitionBy(*KEY).orderBy(digit))
        return sums.withColumn("upto", upto).where((F.col("upto") - F.col("words") <= F.col("rest")) & (F.col("upto") > F.col("rest"))).select(*KEY, "rest", digit, (F.col("upto") - F.col("words")).alias("start"))

    words = F.sum("size").alias("words")
    cut1 = materialize(crossing(sizes.groupBy(*KEY, "first").agg(words).join(wanted.select(*KEY, "rest"), KEY), "first", F.lit(0)))
    near = sizes.join(salted(cut1), [*KEY, "salt", "first"])
    cut2 = materialize(crossing(near.groupBy(*KEY, "rest", "start", "first", "second").agg(words), "second", F.col("start")).join(cut1.select(*KEY, "first"), KEY))
    # in the last range rank by rank: equal ranks are taken together, if their middle is not past the rest
    edge = sizes.join(salted(cut2), [*KEY, "salt", "first", "second"]).groupBy(*KEY, "rest", "start", "rank").agg(words)
    upto = F.col("start") + F.sum("words").over(Window.partitionBy(*KEY).orderBy("rank"))
    cut = edge.withColumn("upto", upto).where(F.col("upto") - F.col("words") / 2 <= F.col("rest")).groupBy(*KEY).agg(F.max("rank").alias("cut"))
    cuts = cut2.select(*KEY, (F.col("first") * DIGITS + F.col("second")).alias("range")).join(cut, KEY, "left")
    return materialize(wanted.drop("rest").join(cuts, KEY, "left"))


def places() -> tuple[Column, Column]:
    """Range of a rank at two levels."""
    first = F.floor(F.col("rank") * DIGITS)
    return first, F.floor(F.col("rank") * DIGITS * DIGITS) - first * DIGITS


def draw(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """sizes (see sized) with source_size, target and copies. Its rows stay where they are if the plan is small enough to be
    broadcast, which Spark decides by its size."""
    rows = sizes.withColumn("salt", F.pmod(F.hash("rank"), F.lit(SALTS))).join(salted(planned), [*KEY, "salt"]).drop("salt")
    first, second = places()
    extra = F.coalesce((first * DIGITS + second < F.col("range")) | ((first * DIGITS + second == F.col("range")) & (F.col("rank") <= F.col("cut"))), F.lit(False))
    return rows.withColumn("copies", F.col("sure") + extra.cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, propensity: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, text, source).

    taken is a whole number of copies times size. propensity names a positive column that multiplies a document's
    inclusion odds; without it they fall with the square root of its size. Null text has size 0 and takes nothing; a null
    source is a source. A row without doc_id draws by its text. Rows that share doc_id and size share their rank and are
    taken or left together. Columns with names of its own are left out; an empty table gives an empty result."""
    rows = docs.select("doc_id", "text", "source", *([F.col(propensity).alias("_odds")] if propensity else []))
    sizes = materialize(sized(rows, F.col("_odds") if propensity else None).select("doc_id", *KEY, "size", "rank"))
    drawn = draw(sizes, plan(sizes, weights, share, most))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs with each row as often as the mix takes it (see mix). Documents without words go."""
    columns = docs.columns
    held = docs.select(F.struct(*columns).alias("held"), "doc_id", "text", "source")
    planned = plan(materialize(sized(held).select(*KEY, "size", "rank")), weights, share, most)
    drawn = draw(sized(held), planned).where("copies > 0 AND size > 0")
    return drawn.select("held", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("held.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text ' || coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
odds AS (SELECT *, u / (1 - u) * sqrt(greatest(size, 1)::DOUBLE) AS ratio FROM sizes),
by_source AS (SELECT no_source, source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY ALL),
weighted AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY no_source, source)) - 1) % 3 + 1]::DOUBLE AS weight, 2::DOUBLE * source_size AS most FROM by_source),
line AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS wanted,
    coalesce(sum(most) OVER (ORDER BY most / weight, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
    sum(weight) OVER (ORDER BY most / weight, no_source, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM weighted),
levels AS (SELECT *, (wanted - before) / weights AS level, most <= weight * ((wanted - before) / weights) AS is_full FROM line),
plan AS (
  SELECT no_source, source, source_size, CASE WHEN is_full THEN most ELSE weight * (SELECT arg_min(level, most / weight) FROM levels WHERE NOT is_full) END AS target
  FROM levels),
plan2 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS sure FROM plan),
ranked AS (
  SELECT doc_id, size, source_size, target, sure, sum(size) OVER (PARTITION BY no_source, source, ratio) AS ties,
    sum(size) OVER (PARTITION BY no_source, source ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM odds JOIN plan2 USING (no_source, source))
SELECT doc_id, size, source_size, target, ((sure + CASE WHEN upto - ties / 2 <= target - sure * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM ranked
"""
