"""How filters of a corpus interact: what each removes in every order in which they can be applied.

Documents become cells (part, mask, counts), where the mask's bits say which filters a document fails; there are at most
2^k cells a part for k filters, whatever the corpus. Cells are unpivoted against the steps of all orders. Running bit-ors
over a cell's steps tell what has failed before, conditional sums give the counts of a step, and totals over a filter's rows
add up what it removes in all orders.

Defined results: null texts count as empty ones; null parts as the empty string. A row without a doc_id has no labels, is
identical to no smaller id's text, and makes no other row a copy. Rows that repeat a doc_id are documents each; those of the
smallest id stay together. A document that has several labels is good (toxic) if one of them says so. An empty table gives no
rows. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenguard.llm.common import table

WHITE = " \t\n\x0b\f\r"
MOST_FILTERS = 7  # orders and steps are unpivoted in place: 7! orders of 7 steps for each cell
COPY = "E"


def rules() -> tuple[dict[str, Column], dict[str, Column]]:
    """What filters look at, as columns of `text`; and whether a text fails: too few words, too few different ones, too many
    capitals, a sign of markup."""
    text, trimmed = F.col("text"), F.btrim("text", F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    seen = {"words": F.transform(F.array(words), lambda ws: F.struct(F.size(ws).alias("all"), F.size(F.array_distinct(ws)).alias("different")))[0]}
    return seen, {
        "A": F.col("words.all") < 100,
        "B": 100 * F.col("words.different") < 80 * F.col("words.all"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masked(docs: DataFrame, seen: dict[str, Column], filters: dict[str, Column], part: str) -> DataFrame:
    """(doc_id, part, mask, digest) of each document; bit i of the mask is the i-th filter's. filters look at `text` and what
    is seen of it."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")).withColumns(seen)
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())]
    return rows.select("doc_id", "part", sum(bits, F.lit(0)).alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def cells(docs: DataFrame, labels: DataFrame, seen: dict[str, Column], filters: dict[str, Column], part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail, the last of which is identity to a smaller id's
    text. Equal texts meet as sums for each label and part, so a text with a third of all copies is a few rows a task."""
    copy = 1 << len(filters)
    rows = masked(docs, seen, filters, part)
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    once = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    alike = once.groupBy("digest", "part", "mask", zero("good"), zero("toxic")).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"))
    least = F.min("first").over(Window.partitionBy("digest"))  # a row for each part and label of a text
    copies = F.col("n") - F.when(F.col("first") == least, F.col("at_first")).otherwise(0)
    split = alike.withColumn("copies", copies).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + copy).alias("mask"), F.col("copies").alias("n")))).alias("c")).select("part", "c.mask", "c.n", "good", "toxic")
    nameless = rows.where("doc_id IS NULL").select("part", "mask", F.lit(1).cast("long").alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return split.where("n > 0").unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(cells: DataFrame, filters: str) -> DataFrame:
    """For each part, order of the filters (a letter each) and step: documents kept, removed, redundant (failing, removed
    before), unique_fails (failing this filter alone), good_lost, toxic_lost, and shapley: removed by the step's filter over
    all orders and steps."""
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters can be audited")
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(filters)])
    steps = F.sequence(F.lit(1), F.lit(len(filters)))
    rows = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(steps).alias("step"))
    rows = rows.withColumn("filter", F.substring(F.col("filter_order"), F.col("step"), F.lit(1))).withColumn("bit", F.element_at(F.array(*[F.lit(1 << i) for i in range(len(filters))]), F.instr(F.lit(filters), F.col("filter"))))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("fails", F.col("mask").bitwiseAND(F.col("bit"))).withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    here, now = F.col("fails") != 0, F.col("earlier") == 0
    total = lambda when, what, name: F.sum(F.when(when, F.col(what)).otherwise(0)).alias(name)
    out = rows.groupBy("part", "filter_order", "step", "filter").agg(
        total(now & ~here, "n", "kept"), total(now & here, "n", "removed"), total(~now & here, "n", "redundant"), total(F.col("mask") == F.col("bit"), "n", "unique_fails"),
        total(now & here, "good", "good_lost"), total(now & here, "toxic", "toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    seen, filters = rules()
    return interactions(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), seen, filters), "".join(filters) + COPY)


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic, {{'A': a, 'B': b, 'C': c, 'D': d, 'E': e}} AS fails FROM f GROUP BY part, a, b, c, d, e),
o AS (SELECT unnest([{", ".join(f"'{''.join(p)}'" for p in itertools.permutations("ABCDE"))}]) AS filter_order),
s AS (SELECT m.*, filter_order, step, substr(filter_order, step, 1) AS filter,
  list_transform(string_split(filter_order, ''), lambda k: CASE k WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END) AS hits FROM m, o, range(1, 6) r(step)),
t AS (SELECT *, hits[step] AS here, len(list_filter(hits[1:step - 1], lambda x: x)) > 0 AS gone, len(list_filter(hits, lambda x: x)) AS failed FROM s),
g AS (SELECT part, filter_order, step::INTEGER AS step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT here), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND here), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND here), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (here AND failed = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND here), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND here), 0)::BIGINT AS toxic_lost FROM t GROUP BY part, filter_order, step, filter)
SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM g
"""
