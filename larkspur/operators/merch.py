"""Boost rules, banners, synonyms and the result cache as functions from frames to frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import in_schedule, keyword_fires

POSITIONS = ["top", "middle", "bottom", "sidebar"]
# The first synonyms of a new shop.
SEED_SYNONYMS = [
    ("smartphone", "cellulare, telefono, mobile, phone"),
    ("pc", "computer, portatile, laptop, notebook"),
    ("tv", "televisore, televisione, schermo"),
    ("scarpe", "calzature, sneakers, stivali"),
    ("maglietta", "t-shirt, maglia, top"),
    ("pantaloni", "jeans, pants, trousers"),
    ("borsa", "borsetta, bag, zaino"),
    ("orologio", "watch, smartwatch"),
    ("cuffie", "auricolari, headphones, earbuds"),
    ("economico", "cheap, low cost, offerta, scontato"),
]


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def toggle(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    marks = chosen.select(*keys).distinct().withColumn("__hit", F.lit(True))
    hit = rows.join(marks, keys, "left")
    return hit.withColumn("active", F.when(F.col("__hit"), ~F.col("active")).otherwise(F.col("active"))).select(*rows.columns)


def boost_problems(rules: DataFrame, known: DataFrame) -> DataFrame:
    """(id_product, problem) of rules that may not be saved: value out of 0.1 to 100, or a rule exists."""
    kept = known.select("id_product", "id_shop").distinct().withColumn("__known", F.lit(True))
    checked = rules.join(kept, ["id_product", "id_shop"], "left")
    bad = F.when(~F.col("boost_value").between(0.1, 100), "range").when(F.col("__known"), "duplicate")
    return checked.select("id_product", bad.alias("problem")).where("problem is not null")


def banners_for(banners: DataFrame, words: list[str], as_of: F.Column, min_word_length: int = 2) -> DataFrame:
    """Active banners in their schedule whose keywords a word meets; by position, newest first."""
    own = banners.where("active").where(in_schedule(as_of))
    own = own.where(keyword_fires(F.col("keywords"), F.array(*[F.lit(w) for w in words]), min_word_length))
    place = F.array_position(F.array(*[F.lit(p) for p in POSITIONS]), F.col("position"))
    return own.withColumn("place", place.cast("int")).orderBy("place", F.desc("date_add"), "id")


def banner_list(banners: DataFrame, width: int = 10_000) -> DataFrame:
    """(id, position, place): an admin's list of all banners, numbered by position, then id. They are numbered
    within stretches of ``width`` ids, and only the stretches' counts are added up in one place."""
    by = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in POSITIONS]), F.col("position")), F.lit(0))
    own = banners.select("id", "position", by.alias("__by"), F.coalesce(F.floor(F.col("id") / width), F.lit(-1)).alias("__stretch"))
    counts = own.groupBy("__by", "__stretch").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy().orderBy("__by", "__stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__by", "__stretch", F.coalesce(before, F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__by", "__stretch").orderBy("id"))
    return own.join(starts, ["__by", "__stretch"]).select("id", "position", (F.col("__start") + within).cast("int").alias("place"))


def cache_key(query: F.Column, *more: F.Column) -> F.Column:
    return F.md5(F.concat_ws("|", F.lower(F.trim(query)), *more))


def cache_get(cache: DataFrame, keys: DataFrame, as_of: F.Column, seconds: int = 300) -> DataFrame:
    fresh = cache.where(F.col("created_at") >= as_of - F.expr(f"interval {seconds} seconds"))
    return keys.join(fresh, "cache_key")


def cache_put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries with results replace those of their key."""
    return upsert(cache, entries.where("n_results > 0").drop("n_results"), ["cache_key"])


def cache_expire(cache: DataFrame, as_of: F.Column, seconds: int = 600) -> DataFrame:
    return cache.where(F.col("created_at") >= as_of - F.expr(f"interval {seconds} seconds"))


def cache_invalidate(cache: DataFrame, prefix: str | None = None) -> DataFrame:
    """Without a prefix every entry goes."""
    return cache.where(F.lit(False)) if prefix is None else cache.where(~F.startswith("cache_key", F.lit(prefix)))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("result_data")), F.lit(0)).cast("bigint").alias("n_bytes"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def response(rows: DataFrame) -> DataFrame:
    """JSON text of each row with nulls written out."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body"))
