"""Answers put together from several frames: facet bundles and the search envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import facets


def _long(df: DataFrame, facet: str, key: str, n: str) -> DataFrame:
    return df.select(F.lit(facet).alias("facet"), F.col(key).cast("string").alias("key"), F.col(n).cast("bigint").alias("n"))


def facet_bundle(catalog: DataFrame, links: DataFrame) -> DataFrame:
    """Brand and category counts and the price range of the whole catalogue as (facet, key, n)."""
    prices = facets.price_range(catalog)
    return (
        _long(facets.brand_facet(catalog), "brand", "brand", "n_products")
        .unionByName(_long(facets.category_facet(catalog, links), "category", "id_category", "n_products"))
        .unionByName(_long(prices.withColumn("k", F.lit("min")), "price", "k", "price_min"))
        .unionByName(_long(prices.withColumn("k", F.lit("max")), "price", "k", "price_max"))
    )


def query_facet_bundle(catalog: DataFrame, attributes: DataFrame, words: list[str]) -> DataFrame:
    """The same of the products that the words find, with attributes; filters do not narrow it."""
    own = facets.query_attribute_facet(catalog, attributes, words).withColumn("key", F.concat_ws(":", "group_name", "value"))
    return (
        _long(facets.query_brand_facet(catalog, words), "brand", "brand", "n_products")
        .unionByName(_long(facets.query_category_facet(catalog, words), "category", "category", "n_products"))
        .unionByName(_long(own, "attribute", "key", "n_products"))
    )


def search_envelope(page: DataFrame, categories: DataFrame, banners: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One row of JSON: the page's products in order, and what a first page has beside them. All
    parts are bounded by their limits (50 products, 5 categories, 5 suggestions)."""

    def packed(df: DataFrame, name: str, order: str) -> DataFrame:
        item = F.struct(F.col(order).alias("k"), F.struct(*[c for c in df.columns if c != "query_id"]).alias("v"))
        return df.agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"]).alias(name))

    parts = packed(page, "products", "rank").crossJoin(packed(categories, "categories", "id_category"))  # one row each
    parts = parts.crossJoin(packed(banners, "banners", "place")).crossJoin(packed(suggestions, "did_you_mean", "step"))
    return parts.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body"))


def recommendations(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Display columns of recommended products."""
    shown = catalog.select("id_product", "brand", "price_incl", "stock")
    price = F.round(F.col("price_incl").cast("decimal(20,6)"), 2).cast("double").alias("price_shown")
    return rows.join(shown, "id_product").select("id_product", "name", "brand", price, (F.col("stock") > 0).alias("in_stock"))
