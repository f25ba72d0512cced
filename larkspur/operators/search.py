"""Product search: retrieval, filters, fuzzy fallback, merge, boosts, paging.

Works on a table of queries (query_id, query) at once, a few or many. Products are found by keys
of their texts (``postings``): an equi-join with posting lists, or one scan for a few queries; what
comes back is verified. What is derived for stated queries, a row a query or word, is broadcast if the
planner's own estimate of their size allows it (else the join is left to Spark). Everything is one
lazy plan, and no job runs while it is put together. Every cap applies per query through a rank
window, with id_product as the last tie-breaker."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import fuzzy_similarity, linguistic, with_relevance
from ..functions.text import consonants, expand_words, normalize, query_words, spellings, stem, without_stop_words
from .postings import Index, matching, misspelt, ordered_keys, scan, sound_key, term_keys, text_keys, with_deletions, with_ordered_keys, within

CANDIDATES, FUZZY_CANDIDATES, RESULTS, FUZZY_BELOW, RECENT = 300, 200, 200, 5, 20
#: Stated tables are broadcast up to this estimate of their size; where there is none, up to so many rows.
STATED_BYTES, STATED_ROWS = 1 << 20, 10_000
#: Up to this estimate of the queries' size the catalogue is scanned once for all their keys.
FEW_BYTES, FEW_ROWS = 1 << 13, 200
FIELDS = ("name", "short_desc", "description", "reference", "brand")


@dataclass(frozen=True)
class Filters:
    categories: tuple[int, ...] = ()
    brands: tuple[int, ...] = ()
    price_min: float | None = None
    price_max: float | None = None
    in_stock: bool = False
    attributes: dict = field(default_factory=dict)  # group id -> values

    @staticmethod
    def parse(params: dict[str, str]) -> Filters:
        """From request parameters: id lists are comma-separated, prices only if numeric."""
        ids = lambda key: tuple(int(x) for x in params.get(key, "").split(",") if x.strip().lstrip("-").isdigit())

        def number(key: str) -> float | None:
            try:
                return float(params[key])
            except (KeyError, ValueError):
                return None

        return Filters(ids("category"), ids("brand"), number("price_min"), number("price_max"), params.get("in_stock", "") in ("1", "true", "on"))

    def active(self) -> int:
        """Categories and brands each count, a price range and the stock flag once."""
        return len(self.categories) + len(self.brands) + (self.price_min is not None or self.price_max is not None) + self.in_stock


def estimated_bytes(df: DataFrame) -> int | None:
    """The planner's estimate of a table's size, which takes no job; none for rows that come through an RDD."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 62 else None


def is_stated(df: DataFrame, most: int = STATED_BYTES, rows: int = STATED_ROWS) -> bool:
    """Whether a table is small: by the planner's estimate. Where there is none, rows are counted, up to
    the bound."""
    size = estimated_bytes(df)
    return df.limit(rows + 1).count() <= rows if size is None else size <= most


def is_few(df: DataFrame) -> bool:
    return is_stated(df, FEW_BYTES, FEW_ROWS)


def hinted(df: DataFrame, stated: bool) -> DataFrame:
    """``df`` (as many rows as a stated table, or a few for each) for broadcast, if that table is small."""
    return F.broadcast(df) if stated else df


def with_words(queries: DataFrame, brands: DataFrame | None = None, phonetic: bool = True, few: bool | None = None) -> DataFrame:
    """Adds words, spellings and terms (words with their variations) to (query_id, query); queries
    under two characters are dropped. With ``brands`` (name, lower case) the terms also hold the brands
    that a word of four characters or more resembles. Queries that have these columns already stay."""
    if "terms" in queries.columns:
        return queries
    known = queries.where(F.length(F.trim("query")) >= 2).withColumn("query", F.lower(F.trim("query")))
    known = known.withColumn("words", query_words(F.col("query"))).where(F.size("words") > 0)
    known = known.withColumn("spellings", spellings(F.col("words"))).withColumn("terms", expand_words(F.col("words")))
    if brands is None:
        return known
    stated = is_stated(queries)
    words = known.select("query_id", F.explode(F.array_distinct("words")).alias("word")).where(F.length("word") >= 4)
    found = misspelt(words, brands, phonetic, is_few(queries) if few is None else few)
    found = found.groupBy("query_id").agg(F.sort_array(F.collect_set("name")).alias("__brands"))
    both = known.join(hinted(found, stated), "query_id", "left")
    none = F.array().cast("array<string>")
    return both.withColumn("terms", F.array_distinct(F.concat("terms", F.coalesce("__brands", none)))).drop("__brands")


def brand_names(catalog: DataFrame) -> DataFrame:
    """The vocabulary of brand corrections: brands that have active products."""
    return catalog.where("brand <> ''").select(F.lower("brand").alias("name")).distinct()


def top(df: DataFrame, n: int, *order, by: str = "query_id") -> DataFrame:
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def folded(catalog: DataFrame, **groups: tuple[str, ...]) -> DataFrame:
    """Adds, before any join, a lower-case text for each group of fields: one look-up finds a term
    in all of them, and no row is folded twice. Terms hold no line break, so none spans two fields."""
    return catalog.select("*", *(F.lower(F.concat_ws("\n", *fields)).alias(f"__{name}") for name, fields in groups.items()))


def any_in(terms: F.Column, text: str) -> F.Column:
    """Whether some term is in the folded text (literal, accents count)."""
    return F.exists(terms, lambda w: F.contains(F.col(text), w))


def _any(tests: list[F.Column]) -> F.Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _keyed(own: DataFrame) -> DataFrame:
    return own.withColumn("__keys", text_keys(F.col("__all")))


def search_index(catalog: DataFrame) -> Index:
    """The index for ``candidates`` and ``exact_words``; ``write`` it to look queries up again and again."""
    return Index.build(_keyed(folded(catalog, all=FIELDS)))


def candidates(catalog: DataFrame, queries: DataFrame, limit: int = CANDIDATES, few: bool | None = None, index: Index | None = None) -> DataFrame:
    """Products with a term in any of five fields, per query: more terms in the name first. ``index``: of
    the catalogue or of more products."""
    asked = with_words(queries)
    own = folded(catalog, all=FIELDS, name=("name",))
    found = matching(own, asked, lambda q: any_in(q["terms"], "__all"), F.transform("terms", term_keys), _keyed, is_few(queries) if few is None else few, index)
    found = found.withColumn("name_match_count", F.size(F.filter("terms", lambda w: F.contains(F.col("__name"), w)))).drop("__all", "__name")
    return top(found, limit, F.desc("name_match_count"), "name", "id_product")


def scored(found: DataFrame, as_of: F.Column, full: bool = True) -> DataFrame:
    return with_relevance(found, as_of, full)


def exact_words(catalog: DataFrame, queries: DataFrame, index: Index | None = None) -> DataFrame:
    """Products where every word is in some field."""
    asked = with_words(queries)
    every = lambda q: F.forall(q["words"], lambda w: F.contains(F.col("__all"), w))
    needs = F.array(F.flatten(F.transform("words", term_keys)))
    return matching(folded(catalog, all=FIELDS), asked, every, needs, _keyed, is_few(queries), index).drop("__all")


def exact_code(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """First product whose reference, ean13 or upc equals a query that looks like a code: four characters or
    more of letters, digits, - and _, and a digit, - or _ among them or all upper case. All columns of
    the catalogue, and relevance."""
    code = F.regexp_replace("query", r"\s", "")
    gate = (F.length("code") >= 4) & F.col("code").rlike("^[A-Za-z0-9_-]+$") & (F.col("code").rlike("[0-9_-]") | (F.col("code") == F.upper("code")))
    asked = queries.select("query_id", code.alias("code")).where(gate).select("query_id", F.upper("code").alias("__code"))
    codes = catalog.withColumn("__code", F.explode(F.array_distinct(F.transform(F.array("reference", "ean13", "upc"), F.upper))))
    found = codes.join(hinted(asked, is_stated(queries)), "__code").drop("__code")
    return top(found, 1, "id_product").withColumn("relevance", F.lit(150.0))


def _fuzzy_texts(catalog: DataFrame, phonetic: bool) -> DataFrame:
    own = folded(catalog, name=("name",), text=("description",), brand=("brand",))
    return own.withColumn("__s1", F.soundex("name")).withColumn("__s2", F.soundex("brand")) if phonetic else own


def _fuzzy_keyed(own: DataFrame) -> DataFrame:
    """Adds __keys: of parts, ordered letters and, where there are any, sounds."""
    sounds = [c for c in ("__s1", "__s2") if c in own.columns]
    own = with_ordered_keys(own, ["__name", "__text", "__brand"], "__ordered")
    keys = [text_keys(F.concat_ws("\n", "__name", "__text", "__brand")), F.col("__ordered"), *([F.transform(F.array(*sounds), sound_key)] * bool(sounds))]
    return own.withColumn("__keys", F.array_distinct(F.concat(*keys))).drop("__ordered")


def fuzzy_index(catalog: DataFrame) -> Index:
    """The index for ``fuzzy_candidates``."""
    return Index.build(_fuzzy_keyed(_fuzzy_texts(catalog, True)))


def fuzzy_candidates(
    catalog: DataFrame, queries: DataFrame, limit: int = FUZZY_CANDIDATES, phonetic: bool = True, few: bool | None = None, index: Index | None = None,
) -> DataFrame:
    """Products that resemble a word of three characters or more: its sound, its letters in
    order, the word without its first or last letter, or its consonants in order. With an index, letters are
    walked only in products that have the rarest ordered pair of them."""
    letters = lambda word: F.filter(F.split(word, ""), lambda c: c != "")
    long = lambda w, part: F.when(F.length(w) > 3, part)

    def probe(w: F.Column) -> F.Column:
        head, tail = F.substring(w, F.lit(1), F.length(w) - 1), F.substring(w, F.lit(2), F.length(w))
        sound = F.soundex(w) if phonetic else F.lit(None).cast("string")
        parts = {"letters": letters(w), "skeleton": letters(consonants(w)), "head": long(w, head), "tail": long(w, tail), "sound": sound}
        return F.struct(*(c.alias(name) for name, c in parts.items()))

    words = F.array_distinct(F.filter(F.split("query", " "), lambda w: F.length(w) >= 3))
    asked = with_words(queries).withColumn("probes", F.transform(words, probe))
    name, text, brand = F.col("__name"), F.col("__text"), F.col("__brand")

    def alike(p: F.Column) -> F.Column:
        part = _any([F.contains(f, p["tail"]) for f in (name, text, brand)] + [F.contains(f, p["head"]) for f in (name, brand)])
        tests = [F.coalesce(part, F.lit(False))]
        if phonetic:
            tests.append((F.col("__s1") == p["sound"]) | (F.col("__s2") == p["sound"]))
        tests += [in_order(p["letters"], f) for f in (name, text, brand)]
        return _any(tests + [(F.size(p["skeleton"]) >= 3) & in_order(p["skeleton"], f) for f in (name, text, brand)])

    def keys(p: F.Column) -> F.Column:
        order = F.when(F.size(p["skeleton"]) >= 3, p["skeleton"]).otherwise(p["letters"])  # the skeleton's order is part of the letters'
        return F.array(term_keys(p["head"]), term_keys(p["tail"]), ordered_keys(order), *([F.array(sound_key(p["sound"]))] * phonetic))

    found = matching(
        _fuzzy_texts(catalog, phonetic), asked, lambda q: F.exists(q["probes"], alike), F.flatten(F.transform("probes", keys)), _fuzzy_keyed,
        is_few(queries) if few is None else few, index,
    )
    return top(found.drop("probes", "__s1", "__s2", "__name", "__text", "__brand"), limit, "name", "id_product")


def in_order(letters: F.Column, text: F.Column) -> F.Column:
    """Whether the letters stand in the text in this order: a walk by locate, since a LIKE whose
    pattern is a column compiles a pattern for each row."""

    def step(at: F.Column, letter: F.Column) -> F.Column:
        then = F.call_function("locate", letter, text, at + 1)
        return F.when(at < 0, F.lit(-1)).when(then > 0, then).otherwise(F.lit(-1))

    return F.aggregate(letters, F.lit(0), step) >= 0


def in_stock(found: DataFrame, stock: DataFrame | None = None, how: str = "product", id_shop: int = 1) -> DataFrame:
    """Products in stock by one of three readings: ``product``, the quantity of the product itself;
    ``shop``, the sum over the stock rows (id_product, id_shop, quantity) of a shop; ``any``, some stock row."""
    if how == "product":
        return found.where("stock > 0")
    if how == "shop":
        own = stock.where(F.col("id_shop") == id_shop).groupBy("id_product").agg(F.sum("quantity").alias("q")).where("q > 0")
    else:
        own = stock.where("quantity > 0").select("id_product").distinct()
    return found.join(own.select("id_product"), "id_product", "left_semi")


def base_price(found: DataFrame, price_min: float | None = None, price_max: float | None = None) -> DataFrame:
    """The linguistic profile's price filter: on the price without tax, where 0 is no bound."""
    if price_min:
        found = found.where(F.col("price") >= price_min)
    return found.where(F.col("price") <= price_max) if price_max else found


def searchable(catalog: DataFrame) -> DataFrame:
    """Products that searches may show."""
    return catalog.where(F.col("visibility").isin("both", "search"))


def membership_filters(found: DataFrame, filters: Filters, links: DataFrame | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """The filters that narrow the catalogue itself: categories, brands, stock, attributes."""
    if filters.categories and links is not None:
        found = found.join(links.where(F.col("id_category").isin(*filters.categories)).select("id_product").distinct(), "id_product", "left_semi")
    if filters.brands:
        found = found.where(F.col("id_brand").isin(*filters.brands))
    if filters.in_stock:
        found = in_stock(found)
    for group, values in filters.attributes.items():
        own = attributes.where((F.col("id_group") == group) & F.col("value").isin(*values)).select("id_product").distinct()
        found = found.join(own, "id_product", "left_semi")
    return found


def price_filter(found: DataFrame, filters: Filters) -> DataFrame:
    if filters.price_min is not None:
        found = found.where(F.col("price_incl") >= filters.price_min)
    return found.where(F.col("price_incl") <= filters.price_max) if filters.price_max is not None else found


def apply_filters(found: DataFrame, filters: Filters, links: DataFrame | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """Conjunction of the filters that are set; membership tests are semi-joins."""
    return price_filter(membership_filters(found, filters, links, attributes), filters)


def merge(primary: DataFrame, secondary: DataFrame, penalty: float = 0.7) -> DataFrame:
    """Primary rows, then secondary rows of other products with their score times the penalty."""
    fresh = secondary.join(primary.select("query_id", "id_product"), ["query_id", "id_product"], "left_anti")
    return primary.unionByName(fresh.withColumn("relevance", F.col("relevance") * penalty), allowMissingColumns=True)


def in_schedule(as_of: F.Column) -> F.Column:
    return (F.col("date_start").isNull() | (F.col("date_start") <= as_of)) & (F.col("date_end").isNull() | (F.col("date_end") >= as_of))


def keyword_fires(keywords: F.Column, words: F.Column, min_length: int = 2) -> F.Column:
    """No keywords, or a keyword and a word of which one holds the other."""
    own = F.filter(F.transform(F.split(F.lower(F.coalesce(keywords, F.lit(""))), ","), lambda k: F.trim(k)), lambda k: F.length(k) >= F.greatest(F.lit(1), F.lit(min_length)))
    usable = F.filter(words, lambda w: F.length(w) >= min_length)
    return (F.trim(F.coalesce(keywords, F.lit(""))) == "") | F.exists(own, lambda k: F.exists(usable, lambda w: F.contains(k, w) | F.contains(w, k)))


def boost_rules(boosts: DataFrame, as_of: F.Column, respect_schedule: bool = True) -> DataFrame:
    rules = boosts.where("active")
    return rules.where(in_schedule(as_of)) if respect_schedule else rules


def fired(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, query, words, spellings, id_product, boost): rules that a query fires."""
    asked = with_words(queries).select("query_id", "query", "words", "spellings")
    own = rules.select("id_product", F.col("boost_value").cast("double").alias("boost"), "keywords")
    return asked.join(hinted(own, is_stated(rules)), keyword_fires(F.col("keywords"), F.col("words"))).drop("keywords")


def boosted(found: DataFrame, queries: DataFrame, rules: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Adds boost (1 without a rule) and injected; with a catalogue, products of fired rules that
    were not found come in with their score plus 50, for queries that found anything. ``found`` is
    read once: the rules' products are scored first and meet it in one outer join."""
    hits = fired(queries, rules)
    stated = is_stated(queries) and is_stated(rules)
    if catalog is None:
        out = found.join(hinted(hits.select("query_id", "id_product", "boost"), stated), ["query_id", "id_product"], "left")
        return out.withColumn("boost", F.coalesce("boost", F.lit(1.0))).withColumn("injected", F.lit(False))
    extra = scored(catalog.join(hinted(hits, stated), "id_product"), F.lit(None), full=False)
    own = [c for c in found.columns if c not in ("query_id", "id_product")]
    extra = extra.select("query_id", "id_product", "boost", (F.col("relevance") + 50).alias("__relevance"), *(F.col(c).alias(f"__{c}") for c in own if c in extra.columns and c != "relevance"))
    both = found.withColumn("__found", F.lit(1)).join(extra, ["query_id", "id_product"], "full_outer")
    both = both.withColumn("injected", F.col("__found").isNull()).withColumn("__any", F.max("__found").over(Window.partitionBy("query_id")))
    both = both.where("__any = 1")
    added = set(extra.columns)
    filled = [F.coalesce(c, f"__{c}").alias(c) if f"__{c}" in added else F.col(c) for c in own]
    return both.select("query_id", "id_product", *filled, F.coalesce("boost", F.lit(1.0)).alias("boost"), "injected")


def final_order(found: DataFrame, limit: int = RESULTS) -> DataFrame:
    final = found.withColumn("final", F.col("relevance") * F.col("boost"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("final"), "name", "id_product")
    return final.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= limit)


def search(
    catalog: DataFrame, queries: DataFrame, boosts: DataFrame, as_of: F.Column, filters: Filters | None = None,
    links: DataFrame | None = None, phonetic: bool = True, inject: bool = True, attributes: DataFrame | None = None,
    index: Index | None = None, fuzzy: Index | None = None,
) -> DataFrame:
    """The whole storefront search as one lazy plan. A query that is a code of a product that passes the
    filters gives just that one; ``*`` gives the newest products. Else candidates among the products that
    pass the category, brand, stock and attribute filters, the price filter (with tax) on the best 300,
    fuzzy rows where under five are left, boosts, injections, final order. ``catalog`` has a ``sold`` column;
    ``index`` and ``fuzzy``: stored indexes of it (``search_index``, ``fuzzy_index``)."""
    filters = filters or Filters()
    stated, few = is_stated(queries), is_few(queries)
    narrowed = membership_filters(catalog, filters, links, attributes)
    keep = ["query_id", "id_product", "name", "relevance"]
    codes = apply_filters(exact_code(catalog, queries), filters, links, attributes).select(*keep)
    asked = with_words(queries, brand_names(catalog), phonetic, few).join(hinted(codes.select("query_id"), stated), "query_id", "left_anti")
    organic = price_filter(scored(candidates(narrowed, asked, few=few, index=index), as_of), filters).select(*keep)
    counts = organic.groupBy("query_id").agg(F.count("*").alias("n"))
    short = asked.join(hinted(counts, stated), "query_id", "left").where(F.coalesce("n", F.lit(0)) < FUZZY_BELOW).drop("n")
    near = price_filter(scored(fuzzy_candidates(narrowed, short, phonetic=phonetic, few=few, index=fuzzy), as_of, full=False), filters).select(*keep)
    both = organic.withColumn("__step", F.lit(1)).unionByName(near.withColumn("__step", F.lit(2)))
    # as ``merge``, by a rank: organic rows first
    first = F.row_number().over(Window.partitionBy("query_id", "id_product").orderBy("__step"))
    both = both.withColumn("__first", first).where("__first = 1")
    both = both.select("query_id", "id_product", "name", F.when(F.col("__step") == 1, F.col("relevance")).otherwise(F.col("relevance") * 0.7).alias("relevance"))
    ranked = final_order(boosted(both, queries, boost_rules(boosts, as_of), catalog if inject else None))
    columns = [*keep, "boost", "injected", "final", "rank"]
    newest = recent(catalog, queries, stated)
    plain = codes.unionByName(newest.drop("rank")).withColumn("boost", F.lit(1.0)).withColumn("injected", F.lit(False)).withColumn("final", F.col("relevance"))
    plain = plain.join(hinted(newest.select("query_id", "id_product", "rank"), stated), ["query_id", "id_product"], "left").withColumn("rank", F.coalesce("rank", F.lit(1)))
    return ranked.select(*columns).unionByName(plain.select(*columns))


def recent(catalog: DataFrame, queries: DataFrame, stated: bool, limit: int = RECENT) -> DataFrame:
    """The newest products, for queries that are just ``*``."""
    stars = queries.where(F.trim("query") == "*").select("query_id")
    newest = catalog.select("id_product", "name", "date_add").orderBy(F.desc("date_add"), "id_product").limit(limit)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("date_add"), "id_product"))
    return newest.join(hinted(stars, stated)).select("query_id", "id_product", "name", F.lit(0.0).alias("relevance"), rank.alias("rank"))


def page(ranked: DataFrame, offset: int, limit: int = 24) -> DataFrame:
    """Rows of one page with has_more; the limit is held between 10 and 50."""
    limit = max(10, min(50, limit))
    total = Window.partitionBy("query_id")
    own = ranked.withColumn("has_more", F.count("*").over(total) > offset + limit)
    return own.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def accumulated(ranked: DataFrame, pages: int, limit: int = 24) -> DataFrame:
    """Rows of the first pages, as a reader who scrolls has loaded them."""
    return ranked.where(F.col("rank") <= pages * max(10, min(50, limit)))


SORTS = {
    "price_asc": lambda: [F.asc("price"), F.asc("id_product")],
    "price_desc": lambda: [F.desc("price"), F.asc("id_product")],
    "name_asc": lambda: [F.asc(F.collate("name", "UNICODE")), F.asc("id_product")],
    "name_desc": lambda: [F.desc(F.collate("name", "UNICODE")), F.asc("id_product")],
    "relevance": lambda: [F.asc("rank")],
}


def user_sort(rows: DataFrame, how: str) -> DataFrame:
    """Adds place: the order that a user picks over loaded rows, per query."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*SORTS[how]())))


def linguistic_terms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, query, words, stems, synonyms): normalised words without stop words, their
    stems, and synonyms in both directions."""
    base = queries.withColumn("words", without_stop_words(F.filter(F.split(normalize(F.col("query")), " "), lambda w: w != "")))
    base = base.withColumn("stems", F.transform("words", stem))
    pairs = synonyms.where("active").select(F.lower("word").alias("word"), F.explode(F.transform(F.split("synonyms", ","), lambda s: F.trim(s))).alias("other"))
    both = pairs.unionByName(pairs.select(F.lower("other").alias("word"), F.col("word").alias("other"))).distinct()
    hits = base.select("query_id", F.explode(F.array_distinct("words")).alias("word")).join(both, "word")
    found = hits.where("other <> ''").groupBy("query_id").agg(F.sort_array(F.collect_set("other")).alias("synonyms"))
    none = F.array().cast("array<string>")
    return base.join(found, "query_id", "left").withColumn("synonyms", F.coalesce("synonyms", none))


def linguistic_search(catalog: DataFrame, queries: DataFrame, synonyms: DataFrame, boosts: DataFrame | None = None, as_of: F.Column | None = None, limit: int = 20, fuzzy: bool = True) -> DataFrame:
    """The linguistic profile over searchable products: words in six fields (name, short text, reference,
    ean13, brand, tags), stems in two, synonyms in two, additive scores, fuzzy rows where under ``limit``
    were found, boosts by exact keywords (a rule without any never fires). ``catalog`` has sold and rating."""
    terms, stated, few = linguistic_terms(queries, synonyms), is_stated(queries), is_few(queries)
    catalog = searchable(catalog)
    stems = lambda q: F.filter(q["stems"], lambda s: F.length(s) >= 2)
    others = lambda q: F.transform(q["synonyms"], lambda s: F.lower(s))
    hit = lambda q: any_in(q["words"], "__all") | any_in(stems(q), "__short") | any_in(others(q), "__short")
    own = folded(catalog, all=("name", "short_desc", "reference", "ean13", "brand", "tags"), short=("name", "short_desc"))
    needs = F.transform(F.concat("words", stems({"stems": F.col("stems")}), others({"synonyms": F.col("synonyms")})), term_keys)
    found = matching(own, terms, hit, needs, _keyed, few).drop("__all", "__short")
    raw = query_words(F.col("query"))
    found = found.withColumn("score", linguistic(F.col("query"), raw, F.col("sold"), F.col("rating")))
    found = top(found, limit * 3, F.desc("score"), "name", "id_product")
    if fuzzy:
        counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
        short = terms.join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < limit).drop("n")
        near = fuzzy_rows(catalog, short, few=few)
        near = near.withColumn("score", linguistic(F.col("query"), query_words(F.col("query")), F.col("sold"), F.col("rating"), F.col("fuzzy_score")))
        fresh = near.join(found.select("query_id", "id_product"), ["query_id", "id_product"], "left_anti")
        found = found.unionByName(fresh.drop("fuzzy_score"), allowMissingColumns=True)
    found = found.withColumn("boost", F.lit(1.0))
    if boosts is not None:
        own = boost_rules(boosts, as_of).select("id_product", F.col("boost_value").cast("double").alias("b"), F.transform(F.split(F.lower(F.coalesce("keywords", F.lit(""))), ","), lambda k: F.trim(k)).alias("k"))
        found = found.join(hinted(own, is_stated(boosts)), "id_product", "left")
        fires = F.arrays_overlap("k", "words")
        found = found.withColumn("boost", F.when(fires, F.col("b")).otherwise(1.0)).withColumn("boost", F.coalesce("boost", F.lit(1.0))).drop("b", "k")
    final = found.withColumn("final", F.col("score") * F.col("boost"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "name", "id_product"))
    return final.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "id_product", "name", "score", "boost", "final", "rank")


def fuzzy_rows(catalog: DataFrame, terms: DataFrame, threshold: int = 3, scope: int = 1000, limit: int = 200, few: bool | None = None) -> DataFrame:
    """Products by the similarity of their name's words to the query's, over the first ``scope``
    products by id. Words are compared up to a distance of three."""
    if threshold > 3:
        raise ValueError("a threshold of three at most")
    pool = catalog.orderBy("id_product").limit(scope)
    names = F.split(F.lower("name"), " ")
    if is_few(terms) if few is None else few:
        # lengths further apart than the threshold can't be within it: most pairs go by this
        near = scan(pool, terms, lambda q: F.exists(q["words"], lambda w: F.exists(names, lambda o: F.abs(F.length(w) - F.length(o)) <= threshold)))
    else:  # words meet by what is left of both after deletions
        most = F.least(F.lit(threshold), F.floor((F.length("word") + threshold) / 3).cast("int"))
        long = lambda words: F.explode(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))).alias("word")
        keyed = lambda df: with_deletions(df, "word", most, "__keys").drop("word")
        pairs = within(keyed(terms.select("query_id", long(F.col("words")))), keyed(pool.select("id_product", long(names))))
        near = pool.join(pairs, "id_product").join(terms, "query_id")
    near = near.withColumn("fuzzy_score", fuzzy_similarity(F.col("words"), F.split(F.lower("name"), " "), threshold)).where("fuzzy_score > 0")
    return top(near, limit, F.desc("fuzzy_score"), "id_product")


def category_search(categories: DataFrame, text: str, limit: int = 5) -> DataFrame:
    return categories.where((F.col("id_category") > 2) & F.contains(F.lower("category"), F.lit(text.lower()))).orderBy("category", "id_category").limit(limit)


def admin_lookup(products: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Products by part of name, reference or brand, or by id; inactive ones too, behind the active."""
    t = F.lit(text.lower())
    number = int(text) if text.isdigit() else 0
    hit = F.contains(F.lower("name"), t) | F.contains(F.lower("reference"), t) | F.contains(F.lower("brand"), t) | (F.col("id_product") == number)
    label = F.concat("name", F.lit(" ("), "reference", F.lit(")"))
    return products.where(hit).orderBy(F.desc("active"), "name", "id_product").limit(limit).select("id_product", label.alias("label"), "brand", "active")


def formatted(rows: DataFrame, bestsellers: DataFrame, attributes: DataFrame) -> DataFrame:
    """Display columns: prices (the old one only where it is higher, with the discount), a short
    description without tags, stock, sales, bestseller and variant flags, image, boost and injected
    (where ``rows`` have them). Rows without a name or price are left out."""
    from ..functions.text import strip_tags

    best = bestsellers.select("id_product", F.lit(True).alias("is_bestseller"))
    variants = attributes.select("id_product", F.lit(True).alias("has_attributes")).distinct()
    own = rows.where("name is not null and price_incl is not null").join(best, "id_product", "left").join(variants, "id_product", "left")
    money = lambda c: F.round(c.cast("decimal(20,6)"), 2).cast("double")
    or_else = lambda c, default: F.coalesce(F.col(c), default) if c in rows.columns else default
    percent, _ = discount(F.col("price_old_incl"), F.col("price_incl"))
    lower = F.col("price_old_incl") > F.col("price_incl")
    return own.select(
        "id_product", "name", "brand", "category", "reference", money(F.col("price_incl")).alias("price_shown"),
        F.when(lower, money(F.col("price_old_incl"))).otherwise(0.0).alias("price_old"), percent.cast("int").alias("discount_percent"),
        F.substring(strip_tags(F.col("description")), 1, 100).alias("excerpt"), (F.col("stock") > 0).alias("in_stock"), F.col("stock").alias("quantity"),
        or_else("sold", F.lit(0).cast("bigint")).alias("total_sold"), F.coalesce("is_bestseller", F.lit(False)).alias("is_bestseller"),
        F.coalesce("has_attributes", F.lit(False)).alias("has_attributes"), or_else("id_image", F.lit(0).cast("bigint")).alias("id_image"),
        or_else("boost", F.lit(1.0)).alias("boost"), or_else("injected", F.lit(False)).alias("injected"),
    )


def discount(old: F.Column, new: F.Column) -> tuple[F.Column, F.Column]:
    """(percent, savings): whole percent and two decimals; 0 where nothing is saved."""
    old, new = old.cast("decimal(20,6)"), new.cast("decimal(20,6)")
    less = old > new
    percent = F.round((1 - new / old) * 100, 0).cast("int")
    return F.when(less, percent).otherwise(0), F.when(less, F.round(old - new, 2).cast("double")).otherwise(0.0)


def device(width: F.Column) -> F.Column:
    return F.when(width < 768, "mobile").when(width < 1024, "tablet").otherwise("desktop")
