"""Suggestions in stages and did-you-mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .postings import matching, term_keys, text_keys
from .search import is_few


def totals(stats: DataFrame) -> DataFrame:
    """(query, n, results) over all shops."""
    return stats.groupBy("query").agg(F.sum("search_count").alias("n"), F.max("results_count").alias("results"))


def popular(stats: DataFrame, text: str, limit: int = 5, least: int = 2) -> DataFrame:
    own = totals(stats).where((F.col("results") > 0) & (F.col("n") >= least) & F.startswith(F.lower("query"), F.lit(text.lower())))
    return own.orderBy(F.desc("n"), "query").limit(limit).select("query", "n")


def related(stats: DataFrame, text: str, limit: int = 8, least: int = 2) -> DataFrame:
    own = totals(stats).where((F.col("results") > 0) & (F.col("n") >= least) & F.contains(F.lower("query"), F.lit(text.lower())))
    return own.orderBy(F.desc("n"), "query").limit(limit).select("query", "n")


def product_names(catalog: DataFrame, text: str, limit: int = 5, words: int = 3) -> DataFrame:
    """First words of names that start with the text."""
    own = catalog.where(F.startswith(F.lower("name"), F.lit(text.lower()))).select(F.substring_index("name", " ", words).alias("query")).distinct()
    return own.orderBy("query").limit(limit)


def brands(catalog: DataFrame, text: str, limit: int = 3) -> DataFrame:
    own = catalog.where(F.startswith(F.lower("brand"), F.lit(text.lower()))).select(F.col("brand").alias("query")).distinct()
    return own.orderBy("query").limit(limit)


#: Stages of suggestions: the rows that each brings along at most, and with how many rows it is closed.
POPULAR, RELATED, PRODUCT, BRAND = range(1, 5)
POOLS = {POPULAR: 5, RELATED: 13, PRODUCT: 5, BRAND: 3}
STAGES = {POPULAR: "popular", RELATED: "related", PRODUCT: "product", BRAND: "brand"}
_FULL, _FEW = 8, 5


def _pools(stats: DataFrame, catalog: DataFrame, texts: DataFrame, least: int, few: bool) -> DataFrame:
    """(query_id, step, place, query): what each stage may take, in its order. Either table is read once."""
    asked = texts.select("query_id", F.lower("text").alias("__text"))
    needs = F.array(term_keys(F.col("__text")))
    keyed = lambda name: lambda df: df.withColumn("__keys", text_keys(F.col(name)))
    said = totals(stats).where((F.col("results") > 0) & (F.col("n") >= least)).withColumn("__low", F.lower("query"))
    said = matching(said, asked, lambda q: F.contains(F.col("__low"), q["__text"]), needs, keyed("__low"), few, id_col="query")
    starts = F.startswith("__low", F.col("__text"))
    place = lambda *by: F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc("n"), "query"))
    said = said.withColumn("starts", starts).withColumn("p", place("starts")).withColumn("r", place())
    of = lambda test, step, at: F.when(test & (F.col(at) <= POOLS[step]), F.struct(F.lit(step).alias("step"), F.col(at).alias("place")))
    said = said.select("query_id", "query", F.explode(F.array_compact(F.array(of(F.col("starts"), POPULAR, "p"), of(F.lit(True), RELATED, "r")))).alias("x")).select("query_id", "x.*", "query")

    names = catalog.select("id_product", "name", "brand", F.lower("name").alias("__name"), F.lower("brand").alias("__brand")).withColumn("__both", F.concat_ws("\n", "__name", "__brand"))
    test = lambda text: (F.startswith(F.col("__name"), text), F.startswith(F.col("__brand"), text))
    names = matching(names, asked, lambda q: test(q["__text"])[0] | test(q["__text"])[1], needs, keyed("__both"), few)
    by_name, by_brand = test(F.col("__text"))
    one = lambda hit, step, query: F.when(hit, F.struct(F.lit(step).alias("step"), query.alias("query")))
    both = F.array_compact(F.array(one(by_name, PRODUCT, F.substring_index("name", " ", 3)), one(by_brand, BRAND, F.col("brand"))))
    names = names.select("query_id", F.explode(both).alias("x")).select("query_id", "x.*").distinct()
    names = names.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "step").orderBy("query")))
    within = F.col("place") <= F.when(F.col("step") == PRODUCT, POOLS[PRODUCT]).otherwise(POOLS[BRAND])
    return said.unionByName(names.where(within))


def staged_for(stats: DataFrame, catalog: DataFrame, texts: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, query, stage, step) for ``texts`` (query_id, text), a few or many: popular queries that
    start with the text (5); related ones that hold it, up to eight in all; names of products where
    there are under five, up to five; brands (3) where there are under eight. No stage repeats a term of
    those before, whatever its case. The stages' rows, at most 26 a text, meet in one array and are
    folded there: either table is read once, whatever the number of texts. An empty text suits everything
    (where texts are few)."""
    rows = _pools(stats, catalog, texts, least, is_few(texts)).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("step", "place", "query"))).alias("rows"))

    def of(step: int) -> F.Column:
        return F.transform(F.filter("rows", lambda r: r["step"] == step), lambda r: F.struct(r["query"].alias("query"), F.lit(step).alias("step")))

    def fresh(pool: F.Column) -> F.Column:
        return F.filter(pool, lambda r: ~F.array_contains(F.col("known"), F.lower(r["query"])))

    def room(below: int) -> F.Column:
        return F.greatest(F.lit(below) - F.size("done"), F.lit(0))

    def then(df: DataFrame, more: F.Column) -> DataFrame:
        df = df.withColumn("done", F.concat("done", more))
        return df.withColumn("known", F.transform("done", lambda r: F.lower(r["query"])))

    own = then(rows.withColumn("done", F.slice(of(POPULAR), 1, 0)), of(POPULAR))
    own = then(own, F.slice(fresh(of(RELATED)), F.lit(1), room(_FULL)))
    own = then(own, fresh(F.slice(of(PRODUCT), F.lit(1), room(_FEW))))
    own = then(own, F.when(F.size("done") < _FULL, fresh(of(BRAND))).otherwise(F.slice("done", 1, 0)))
    named = F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair))
    return own.select("query_id", F.explode("done").alias("x")).select("query_id", "x.query", F.element_at(named, F.col("x.step")).alias("stage"), "x.step")


def staged(stats: DataFrame, catalog: DataFrame, text: str) -> DataFrame:
    """``staged_for`` one text: (query, stage, step)."""
    one = catalog.sparkSession.range(1).select(F.lit(1).alias("query_id"), F.lit(text).alias("text"))
    return staged_for(stats, catalog, one).drop("query_id")


def did_you_mean_popular(stats: DataFrame, text: str, limit: int = 3, pool: int = 200, least: int = 3) -> DataFrame:
    """Well-known queries within three tenths of the length (count - 10 d) or in containment (count)."""
    t = F.lit(text.lower())
    own = totals(stats).where((F.col("results") > 0) & (F.col("n") >= least)).orderBy(F.desc("n"), "query").limit(pool)
    d, longest = F.levenshtein(F.lower("query"), t), F.greatest(F.length("query"), F.length(t))
    near = F.when((d > 0) & (d <= F.ceil(longest * F.lit(0.3))), F.col("n") - 10 * d)
    inside = F.when((F.lower("query") != t) & (F.contains(F.lower("query"), t) | F.contains(t, F.lower("query"))), F.col("n"))
    rows = own.select("query", F.coalesce(F.greatest(near, inside), F.lit(None)).cast("bigint").alias("score")).where("score is not null")
    return rows.orderBy(F.desc("score"), "query").limit(limit)


def did_you_mean_product(catalog: DataFrame, text: str, limit: int = 2) -> DataFrame:
    """First words of names that hold a word of three characters or more."""
    test = F.lit(False)
    for w in text.lower().split(" "):
        if len(w) >= 3:
            test = test | F.contains(F.lower("name"), F.lit(w))
    own = catalog.where(test).select(F.lower(F.substring_index("name", " ", 3)).alias("query")).where(F.length("query") >= 4).distinct()
    return own.where(F.col("query") != text.lower()).orderBy("query").limit(limit)


def did_you_mean_brand(catalog: DataFrame, text: str, limit: int = 2) -> DataFrame:
    """Brands that hold the text; where there is none, brands at distance 1 or 2."""
    t = F.lit(text.lower())
    pool = catalog.select(F.col("brand").alias("query")).distinct()
    holds = pool.where(F.contains(F.lower("query"), t) & (F.lower("query") != t)).withColumn("d", F.lit(0))
    none = holds.agg((F.count("*") == 0).alias("none"))
    near = pool.withColumn("d", F.levenshtein(F.lower("query"), t)).where(F.col("d").between(1, 2))
    near = near.join(F.broadcast(none), F.col("none")).drop("none")
    return holds.unionByName(near).orderBy("d", "query").limit(limit)


def did_you_mean(stats: DataFrame, catalog: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """Popular, product, brand, each term once, without the query itself."""
    one = did_you_mean_popular(stats, text).select("query", F.lit(1).alias("step"))
    two = did_you_mean_product(catalog, text).select("query", F.lit(2).alias("step"))
    three = did_you_mean_brand(catalog, text).select(F.lower("query").alias("query"), F.lit(3).alias("step"))
    rows = one.unionByName(two).unionByName(three).where(F.col("query") != text.lower()).groupBy("query").agg(F.min("step").alias("step"))
    return rows.orderBy("step", "query").limit(limit)


def spelled_alike(stats: DataFrame, text: str, limit: int = 3, least: int = 5) -> DataFrame:
    """Frequent queries within a quarter of the length: nearest, then most frequent."""
    t = F.lit(text.lower())
    d, longest = F.levenshtein(F.lower("query"), t), F.greatest(F.length("query"), F.length(t))
    own = totals(stats).where(F.col("n") > least).withColumn("d", d).where((F.col("d") > 0) & (F.col("d") <= F.ceil(longest / 4)))
    return own.orderBy("d", F.desc("n"), "query").limit(limit).select("query", "d", "n")


def match_span(query: F.Column, text: str) -> tuple[F.Column, F.Column]:
    """(start from 1 or 0, matched part) of the first case-insensitive occurrence."""
    at = F.instr(F.lower(query), F.lit(text.lower()))
    return at, F.when(at > 0, F.substring(query, at, F.lit(len(text)))).otherwise("")
