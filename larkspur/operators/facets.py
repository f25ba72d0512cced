"""Facets over the catalogue or over the products that a query's words find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def brand_facet(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("id_brand", "brand").agg(F.countDistinct("id_product").alias("n_products")).where("n_products > 0")


def category_facet(catalog: DataFrame, links: DataFrame) -> DataFrame:
    own = links.where("id_category > 2").join(catalog.select("id_product"), "id_product", "left_semi")
    return own.groupBy("id_category").agg(F.countDistinct("id_product").alias("n_products"))


def price_range(catalog: DataFrame, tax_percent: float = 22.0) -> DataFrame:
    """Lowest price rounded down, highest rounded up and taxed, cut to a whole number."""
    low, high = F.floor(F.min("price")).cast("bigint"), F.ceil(F.max("price"))
    return catalog.agg(low.alias("price_min"), (high * (1 + tax_percent / 100)).cast("bigint").alias("price_max"))


def main_tax_rate(rates: DataFrame, default: float = 22.0) -> DataFrame:
    """The active rate with most rules (then the higher), else the highest active, else the default."""
    active = rates.where("active")
    most = active.where("rule_count > 0").agg(F.max_by("rate", F.struct("rule_count", "rate")).alias("a"))
    highest = active.agg(F.max("rate").alias("b"))
    return most.crossJoin(highest).select(F.coalesce("a", "b", F.lit(default)).alias("rate"))


def tax_rates(taxes: DataFrame, rules: DataFrame, groups: DataFrame, country: int) -> DataFrame:
    """(rate, rule_count, active) of every tax: how many rules of active groups apply it in a country."""
    own = rules.where(F.col("id_country") == country).join(groups.where("active").select("id_group"), "id_group")
    counts = own.groupBy("id_tax").agg(F.count("*").alias("rule_count"))
    return taxes.join(counts, "id_tax", "left").select("rate", F.coalesce("rule_count", F.lit(0)).alias("rule_count"), "active")


def matched(catalog: DataFrame, words: list[str]) -> DataFrame:
    """Products with any of the words (two characters or more) in the name."""
    test = F.lit(False)
    for w in words:
        if len(w) >= 2:
            test = test | F.contains(F.lower("name"), F.lit(w.lower()))
    return catalog.where(test)


def query_brand_facet(catalog: DataFrame, words: list[str], limit: int = 10) -> DataFrame:
    found = matched(catalog, words).groupBy("id_brand", "brand").agg(F.count("*").alias("n_products"))
    return found.orderBy(F.desc("n_products"), "brand").limit(limit)


def query_category_facet(catalog: DataFrame, words: list[str], limit: int = 10) -> DataFrame:
    found = matched(catalog, words).groupBy("id_category", "category").agg(F.count("*").alias("n_products"))
    return found.orderBy(F.desc("n_products"), "category").limit(limit)


def query_price_range(catalog: DataFrame, words: list[str]) -> DataFrame:
    return matched(catalog, words).agg(F.min("price").alias("price_min"), F.max("price").alias("price_max"))


def query_attribute_facet(catalog: DataFrame, attributes: DataFrame, words: list[str]) -> DataFrame:
    own = attributes.join(matched(catalog, words).select("id_product"), "id_product", "left_semi")
    return own.groupBy("id_group", "group_name", "value").agg(F.countDistinct("id_product").alias("n_products"))


def nested_attribute_facet(counts: DataFrame) -> DataFrame:
    """One row a group with its values as an array, most products first."""
    item = F.struct((-F.col("n_products")).alias("k"), "value", "n_products")
    packed = counts.groupBy("id_group", "group_name").agg(F.sort_array(F.collect_list(item)).alias("v"))
    return packed.select("id_group", "group_name", F.transform("v", lambda x: F.struct(x["value"].alias("value"), x["n_products"].alias("n_products"))).alias("values"))


def ratings(reviews: DataFrame) -> DataFrame:
    """Average grade and number of validated reviews, per product."""
    return reviews.where("validated").groupBy("id_product").agg(F.avg("grade").alias("rating"), F.count("*").alias("n_reviews"))


def bestsellers(catalog: DataFrame, sales: DataFrame, limit: int = 12) -> DataFrame:
    found = catalog.select("id_product", "name", "price").join(sales.where("sold > 0"), "id_product")
    return found.orderBy(F.desc("sold"), "name", "id_product").limit(limit)


def bestsellers_or_recent(catalog: DataFrame, sales: DataFrame, limit: int = 12) -> DataFrame:
    """Bestsellers, or the newest products where there is none: one plan, gated by a count."""
    best = bestsellers(catalog, sales, limit).select("id_product", "name")
    none = best.agg((F.count("*") == 0).alias("none"))
    recent = recent_products(catalog, limit).select("id_product", "name").join(F.broadcast(none), F.col("none")).drop("none")
    return best.unionByName(recent)


def recent_products(catalog: DataFrame, limit: int = 24) -> DataFrame:
    return catalog.select("id_product", "name", "date_add").orderBy(F.desc("date_add"), "id_product").limit(limit)

