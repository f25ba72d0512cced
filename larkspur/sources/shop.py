"""Shop frames over the star-schema tables: one lazy DataFrame each, narrow columns only.

``as_of`` values are constants of the data set; nothing here reads the clock."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CATALOG_AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
TAX_RATE = 1.22
#: Category codes start at 3: 1 and 2 are the root and home categories.
CATEGORIES = {"ECONOMY": 3, "LARGE": 4, "MEDIUM": 5, "PROMO": 6, "SMALL": 7, "STANDARD": 8}
KINDS = {"view": "search", "error": "no_results", "click": "click", "purchase": "conversion"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(value: str) -> F.Column:
    return F.expr(f"timestamp_ntz'{value}'")


def _lookup(mapping: dict, key: F.Column) -> F.Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def products(spark: SparkSession, sf_dir: str, id_lang: int = 1, id_shop: int = 1) -> DataFrame:
    """All products of a shop with their texts in a language, inactive ones included. Shop 1 has every
    product, shop 2 those with an even key; language 2 writes names in capitals."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    name = F.col("p_name") if id_lang == 1 else F.upper("p_name")
    rows = part if id_shop == 1 else part.where("p_partkey % 2 = 0")
    return rows.select(
        key.alias("id_product"),
        name.alias("name"),
        F.col("p_brand").alias("brand"),
        F.substring("p_brand", 7, 10).cast("bigint").alias("id_brand"),
        F.col("p_type").alias("category"),
        _lookup(CATEGORIES, F.col("p_type")).cast("bigint").alias("id_category"),
        F.concat(F.lit("REF-"), F.lpad(key.cast("string"), 6, "0")).alias("reference"),
        F.lpad(key.cast("string"), 13, "0").alias("ean13"),
        F.concat(F.lit("7"), F.lpad(key.cast("string"), 11, "0")).alias("upc"),
        F.lower("p_type").alias("short_desc"),
        F.concat_ws(" ", F.lower("p_type"), F.lit("size"), F.col("p_size").cast("string"), F.col("p_name")).alias("description"),
        F.when(key % 50 == 0, "seasonal,gift").when(key % 75 == 0, "outlet").otherwise("").alias("tags"),
        F.col("p_size").cast("bigint").alias("size"),
        F.col("p_retailprice").alias("price"),
        (F.col("p_retailprice") * TAX_RATE).alias("price_incl"),
        (F.col("p_retailprice") * TAX_RATE * F.when(key % 4 == 0, 1.25).otherwise(1.0)).alias("price_old_incl"),
        (key % 7).alias("stock"),
        F.when(key % 11 == 0, "catalog").when(key % 11 == 1, "search").otherwise("both").alias("visibility"),
        (key % 97 != 0).alias("active"),
        F.expr(f"timestamp_ntz'{CATALOG_AS_OF}' - make_dt_interval(cast(p_partkey % 60 as int))").alias("date_add"),
    )


def catalog(spark: SparkSession, sf_dir: str, id_lang: int = 1, id_shop: int = 1) -> DataFrame:
    """The active products of a shop in a language: the frame that all searches share."""
    return products(spark, sf_dir, id_lang, id_shop).where("active").drop("active")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_product, id_image, cover): none for every third product, of the others the second is the cover."""
    part = table(spark, sf_dir, "part").where("p_partkey % 3 > 0")
    rows = part.select(F.col("p_partkey").alias("id_product"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    return rows.select("id_product", (F.col("id_product") * 10 + F.col("k")).alias("id_image"), (F.col("k") == 2).alias("cover"))


def with_cover(products: DataFrame, images: DataFrame) -> DataFrame:
    """Adds id_image, the cover image with the smallest id, or null."""
    covers = images.where("cover").groupBy("id_product").agg(F.min("id_image").alias("id_image"))
    return products.join(covers, "id_product", "left")


def stock_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_product, id_shop, quantity): a row for each shop."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id_product"))
    both = part.select("id_product", F.explode(F.array(F.lit(1), F.lit(2))).alias("id_shop"))
    return both.select("id_product", "id_shop", F.when(F.col("id_shop") == 1, F.col("id_product") % 7 - 2).otherwise(F.col("id_product") % 5 - 3).alias("quantity"))


def taxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(taxes, rules, groups): a tax a region, a rule a nation, three groups of rules."""
    rate = _lookup({0: 4.0, 1: 22.0, 2: 10.0, 3: 5.0, 4: 20.0}, F.col("r_regionkey"))
    tax = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id_tax"), rate.alias("rate"), (F.col("r_regionkey") != 3).alias("active"))
    rule = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("id_tax"), (F.col("n_nationkey") % 3).alias("id_group"), (F.col("n_nationkey") % 2).alias("id_country"))
    group = rule.select("id_group").distinct().select("id_group", (F.col("id_group") != 2).alias("active"))
    return tax, rule, group


def category_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product-to-category pairs: the default category, and a second one for every third product."""
    base = catalog(spark, sf_dir).select("id_product", "id_category")
    second = base.where("id_product % 3 = 0").select("id_product", ((F.col("id_category") - 2) % 6 + 3).alias("id_category"))
    return base.unionByName(second)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("id_order"),
        F.col("l_partkey").alias("id_product"),
        ((F.col("l_quantity").cast("bigint") % 5) * (F.col("l_partkey") % 5)).alias("quantity"),
        F.col("l_extendedprice").cast("decimal(20,6)").alias("line_total"),
    )


def order_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id_order"),
        F.col("o_custkey").alias("id_customer"),
        F.col("o_orderstatus").isin("F", "O").alias("valid"),
        F.col("o_orderdate").alias("date_add"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_product, sold) over valid orders."""
    valid = order_heads(spark, sf_dir).where("valid").select("id_order")
    return order_lines(spark, sf_dir).join(valid, "id_order").groupBy("id_product").agg(F.sum("quantity").alias("sold"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = catalog(spark, sf_dir)
    size = base.select("id_product", F.lit(1).cast("bigint").alias("id_group"), F.lit("size").alias("group_name"), F.col("size").cast("string").alias("value"))
    tone = base.select("id_product", F.lit(2).cast("bigint").alias("id_group"), F.lit("tone").alias("group_name"), F.substring_index("name", " ", 1).alias("value"))
    return size.unionByName(tone)


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, no_results, click and conversion events; other kinds are dropped."""
    ev = table(spark, sf_dir, "events").withColumn("kind", _lookup(KINDS, F.col("event_type"))).where("kind is not null")
    return ev.select(
        "event_id",
        "kind",
        F.concat(F.lit("q"), F.get_json_object("props", "$.k")).alias("query"),
        F.concat(F.lit("ss_"), F.col("user_id").cast("string")).alias("session_id"),
        (F.col("user_id") % 3 + 1).alias("id_shop"),
        (F.col("user_id") % 2 + 1).alias("id_lang"),
        F.when(F.col("kind") == "search", F.floor("value").cast("bigint") % 50).otherwise(F.lit(0).cast("bigint")).alias("results_count"),
        (F.col("event_id") % 200).alias("id_product"),
        (F.col("event_id") % 24).alias("position"),
        F.col("value").cast("decimal(10,2)").alias("amount"),
        "ts",
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").where("event_type = 'view'")
    return ev.select((F.col("event_id") % 200).alias("id_product"), (F.col("event_id") % 5 + 1).alias("grade"), (F.col("event_id") % 4 != 0).alias("validated"))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Stated rows as a local relation: the planner knows their size, and no job reads them."""
    kind = T.StructType.fromDDL(schema)
    records = [dict(zip(kind.names, row, strict=True)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, to_arrow_schema(kind)), kind)
