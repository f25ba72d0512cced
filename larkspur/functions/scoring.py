"""Ranking scores as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sales_bonus(sold: F.Column) -> F.Column:
    return F.when(sold > 100, 20).when(sold > 50, 15).when(sold > 10, 10).when(sold > 0, 5).otherwise(0)


def age_bonus(date_add: F.Column, as_of: F.Column) -> F.Column:
    days = F.timestamp_diff("SECOND", date_add, as_of) / 86400.0
    return F.when(days <= 7, 15).when(days <= 30, 10).otherwise(0)


def with_relevance(found: DataFrame, as_of: F.Column | None = None, full: bool = True, to: str = "relevance") -> DataFrame:
    """Adds the tiered score of name, brand, reference, short_desc and stock for the lower-case
    ``query``, its ``words`` and their ``spellings`` (an array of forms for each word). ``full``
    also counts description, sold and date_add. The hits are columns of their own first, so each
    is computed once and the formula stays small."""
    of = lambda text: F.size(F.filter("spellings", lambda forms: F.exists(forms, lambda v: F.contains(F.col(text), v))))
    plain = lambda text: F.size(F.filter("words", lambda w: F.contains(F.col(text), w)))
    columns = found.columns
    lower = found.select("*", F.lower("name").alias("_n"), F.lower("brand").alias("_b"), F.lower("reference").alias("_r"), F.lower("short_desc").alias("_s"), F.lower("description" if full else F.lit("")).alias("_d"))
    hits = lower.select("*", of("_n").alias("_hn"), of("_b").alias("_hb"), of("_r").alias("_hr"), plain("_s").alias("_hs"), plain("_d").alias("_hd"), F.size("words").alias("_w"))
    query, n, name_hits = F.col("query"), F.col("_w"), F.col("_hn")
    whole = F.contains(F.col("_n"), query)
    prefix = F.when(F.startswith(F.col("_n"), query), 100).otherwise(0)
    ratio = name_hits / n
    all_words = 1000 + F.when(whole, 300 + prefix).otherwise(0) + 10 * F.col("_hb") + 10 * F.col("_hr")
    part = 40 * name_hits + 30 * F.col("_hb") + 35 * F.col("_hr") + F.when(ratio >= 0.75, 100).when(ratio >= 0.5, 50).otherwise(0) + 5 * F.col("_hs")
    part = part * F.when((n > 1) & (ratio < 0.5), F.lit(0.3)).otherwise(F.lit(1.0))
    base = (
        F.when((n > 0) & (name_hits == n), all_words.cast("double"))
        .when(whole, (800 + prefix).cast("double"))
        .when(F.contains(F.col("_b"), query), F.lit(700.0))
        .when(F.contains(F.col("_r"), query), F.lit(750.0))
        .otherwise(part.cast("double"))
    ) + 3 * F.col("_hd")
    if full:
        base = base + sales_bonus(F.coalesce("sold", F.lit(0))) + age_bonus(F.col("date_add"), as_of)
    based = hits.withColumn("_base", base)
    sold_out = F.round((F.col("_base") * 0.7).cast("decimal(20,6)"), 0).cast("double")
    return based.select(*columns, F.when(F.col("stock") <= 0, sold_out).otherwise(F.col("_base")).alias(to))


def linguistic(query: F.Column, words: F.Column, sold: F.Column, rating: F.Column, fuzzy: F.Column | None = None) -> F.Column:
    """Additive score of the columns name, reference and brand for the raw query."""
    name, ref, brand = F.lower("name"), F.lower("reference"), F.lower("brand")
    query = F.lower(query)
    score = F.when(F.contains(name, query), F.lit(100.0) + F.when(F.startswith(name, query), 50).otherwise(0)).otherwise(F.lit(0.0))
    of = lambda test, points: F.aggregate(words, F.lit(0), lambda acc, w: acc + F.when(test(w), points).otherwise(0))
    score = score + of(lambda w: F.contains(name, w), 20) + of(lambda w: F.startswith(name, w), 10)
    score = score + of(lambda w: F.contains(ref, w), 30) + of(lambda w: F.contains(brand, w), 15)
    score = score + F.least(F.lit(20.0), F.coalesce(sold, F.lit(0)) / 10) + F.when(rating >= 4, 10).otherwise(0)
    return score + F.coalesce(fuzzy, F.lit(0.0)) if fuzzy is not None else score


def fuzzy_similarity(words: F.Column, others: F.Column, threshold: int = 3) -> F.Column:
    """Sum of (1 - d / longest) * 10 over pairs of words of three characters or more whose edit
    distance d is within the threshold and a third of the longest."""

    def pair(w: F.Column):
        def add(acc: F.Column, o: F.Column) -> F.Column:
            longest = F.greatest(F.length(w), F.length(o))
            d = F.levenshtein(w, o)
            close = (F.length(w) >= 3) & (F.length(o) >= 3) & (d <= F.least(F.lit(threshold), F.floor(longest / 3).cast("int")))
            return acc + F.when(close, (1 - d / longest) * 10).otherwise(0.0)

        return add

    return F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.aggregate(others, F.lit(0.0), pair(w)))
