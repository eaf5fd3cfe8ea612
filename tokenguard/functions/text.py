"""Text functions: redaction, chunk sentences, token classes, keyword rules, term extraction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenguard import params

SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"  # white space of all scripts
# an address starts where its run of characters does, or where the last match ended
EMAIL = r"(?:(?<![\p{L}\p{N}_.-])|\G)[\p{L}\p{N}_.-]++@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"
PHONE = rf"\+\p{{Nd}}{{1,3}}(?:-|{SPACE})?\p{{Nd}}{{4,5}}(?:-|{SPACE})?\p{{Nd}}{{4,5}}"  # the + keeps timestamps out
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"


def words(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def redact_pii(text: Column) -> Column:
    """E-mail addresses first, then phone numbers in international form. Texts without their signs are not searched."""
    without = once(text, lambda x: F.when(x.contains("@"), F.regexp_replace(x, EMAIL, "[REDACTED_EMAIL]")).otherwise(x))
    return once(without, lambda x: F.when(x.contains("+"), F.regexp_replace(x, PHONE, "[REDACTED_PHONE]")).otherwise(x))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, where x is computed once however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def leaks_pii(text: Column) -> Column:
    return F.coalesce(once(text, lambda x: (x.contains("@") & x.rlike(EMAIL)) | (x.contains("+") & x.rlike(PHONE))), F.lit(False))


def chunk_event(case_id: Column, activity: Column, timestamp: Column, resource: Column, department: Column, cost_center: Column, amount: Column, days: Column, note: Column) -> Column:
    """One redacted sentence for an event; a null note is left out."""
    sentence = F.concat(
        F.lit("Case "), case_id, F.lit(": "), activity, F.lit(" occurred on "), timestamp, F.lit(" handled by "), resource, F.lit(" ("), department,
        F.lit(", cost center "), cost_center, F.lit("). Amount: $"), F.format_number(amount, 2), F.lit(". Cycle time so far: "), days.cast("string"), F.lit(" days."),
    )
    return redact_pii(F.concat(sentence, F.when(note.isNotNull(), F.concat(F.lit(" Note: "), note)).otherwise("")))


def chunk_summary(compliance: Column, order_to_cash: Column, flagged: Column, total: Column) -> Column:
    return F.concat(
        F.lit("AGGREGATE GROUND TRUTH: Average compliance cycle time is "), compliance.cast("string"), F.lit(" days. Average order-to-cash time is "), order_to_cash.cast("string"),
        F.lit(" days. "), flagged.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" orders were flagged for a supply chain bottleneck."),
    )


def memory_document(activity: Column, days: Column, case_id: Column, note: Column) -> Column:
    """The short form of an event, with defaults for what is missing; notes are redacted here as everywhere."""
    return redact_pii(F.concat(F.lit("Activity: "), F.coalesce(activity, F.lit("")), F.lit(" | Cycle Time: "), F.coalesce(days, F.lit(0)).cast("string"), F.lit(" days | Case: "), F.coalesce(case_id, F.lit("")), F.lit(" | Note: "), F.coalesce(note, F.lit(""))))


def ground_truth_sentence(compliance: Column, total: Column) -> Column:
    return F.concat(
        F.lit("Ground Truth (Event Logs): Average Q3 compliance cycle time for vendor onboarding / compliance review is exactly "), F.coalesce(compliance, F.lit(12.0)).cast("string"),
        F.lit(" days across "), F.coalesce(total, F.lit(3)).cast("string"), F.lit(" processed orders. Orders over $100k take 12 days on average."),
    )


def is_upper(x: Column) -> Column:
    """At least one cased character, and none of them lower or title case."""
    return x.rlike(r"\p{Lu}") & ~x.rlike(r"[\p{Ll}\p{Lt}]")


def is_code(x: Column) -> Column:
    return x.contains("-") & F.exists(F.split(x, "-"), is_upper)


def token_weight(token: Column) -> Column:
    """Risk weight of a token; the first rule that holds decides."""

    def weight(c: Column, k: Column) -> Column:
        return (
            F.when(c == "", 0.4)
            .when(c.rlike(f"{DIGIT}|[$€£¥₹%]"), 3.5)
            .when(is_code(c), 3.0)
            .when(k.isin(params.ACRONYMS) | (is_upper(c) & (F.length(c) >= 2)), 2.5)
            .when(k.isin(params.TITLES), 2.2)
            .when(c.rlike(r"^\p{Lu}") & (F.length(c) > 2) & ~c.endswith("."), 1.8)
            .when(k.isin(params.STOPWORDS) | c.isin(params.MARKS), 0.4)
            .otherwise(1.0)
        )

    both = lambda c: F.struct(c.alias("c"), F.trim(F.lower(c), F.lit(".,;:()")).alias("k"))
    return once(once(strip(F.coalesce(token, F.lit(""))), both), lambda x: weight(x["c"], x["k"]))


def first_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """The first keyword in list order that the text contains anywhere, or null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.try_element_at(F.filter(words(keywords), lambda k: F.contains(low, k)), F.lit(1))


def has_keyword(text: Column, keywords: Sequence[str] = params.FALLBACK_KEYWORDS) -> Column:
    return first_keyword(text, keywords).isNotNull()


def is_greeting(text: Column) -> Column:
    return F.coalesce(strip(F.lower(text)).isin(params.GREETINGS), F.lit(False))


def split_spaces(text: Column) -> Column:
    """Words between runs of white space; none for blank text."""
    return F.filter(F.split(strip(F.coalesce(text, F.lit(""))), f"{SPACE}+"), lambda w: w != "")


def salient_terms(text: Column) -> Column:
    """The words that are no question words or trigger words, or the default query if none is left."""
    found = F.array_join(F.filter(split_spaces(text), lambda w: ~F.lower(w).isin(params.RECOVERY_STOPWORDS)), " ")
    return F.when(found == "", params.DEFAULT_TERMS).otherwise(found)


def suggested_terms(text: Column) -> Column:
    return F.filter(split_spaces(text), lambda w: (F.length(w) > 3) & ~w.rlike(rf"^{DIGIT}+$"))


def snippet(text: Column, n: int = 120) -> Column:
    return F.substring(text, 1, n)


def url_encoded(text: Column) -> Column:
    """Percent-encoded for a query string's value: spaces become %20."""
    return F.replace(F.url_encode(F.coalesce(text, F.lit(""))), F.lit("+"), F.lit("%20"))


def field(struct: Column, name: str, default: object) -> Column:
    """A field of a struct or map, with a default where it or the whole is null."""
    return F.coalesce(struct[name], F.lit(default))
