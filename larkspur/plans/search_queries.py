"""Search, text, facet and merchandising queries with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import baskets, envelope, facets, merch, postings, search, suggest
from ..sources import shop
from .views import any_sql, score_sql, soundex_sql, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = shop.CATALOG_AS_OF


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def asked(spark, *texts: str):
    return shop.literal(spark, [(i + 1, t) for i, t in enumerate(texts)], "query_id bigint, query string")


def sold_catalog(spark, sf):
    return shop.catalog(spark, sf).join(shop.sales(spark, sf), "id_product", "left")


def boosts(spark):
    """Always on, by keyword, inactive, expired and not yet started rules."""
    rows = [
        (1, 5, 2.00, "", True, None, None), (2, 12, 1.50, "widget,gear", True, None, None), (3, 20, 5.00, "", False, None, None),
        (4, 33, 3.00, "", True, "2000-01-01 00:00:00", "2000-02-01 00:00:00"), (5, 40, 3.00, "", True, "2002-01-01 00:00:00", None),
    ]
    df = shop.literal(spark, rows, "id bigint, id_product bigint, boost_value double, keywords string, active boolean, s string, e string")
    return df.select("id", "id_product", F.col("boost_value").cast("decimal(5,2)").alias("boost_value"), "keywords", "active", F.col("s").cast("timestamp_ntz").alias("date_start"), F.col("e").cast("timestamp_ntz").alias("date_end"))


# Word forms spelt out for the oracles, from the same fixed values.
def _unit_forms(word: str) -> list[str]:
    number, unit = re.fullmatch(r"([0-9]*)(.*)", word).groups()
    if not number or unit not in {"", *X.UNITS}:
        return []
    return [number + form for form in (unit, " " + unit, *X.UNIT_FORMS.get(unit, []))] if unit else [number]


def _terms(words: list[str]) -> list[str]:
    out = []
    for w in words:
        out += [w, *(w[: -len(e)] + o for e, others in X.ENDINGS if len(w) >= 3 and w.endswith(e) for o in others), *_unit_forms(w)]
    return list(dict.fromkeys(out))


_FIELDS = ("name", "short_desc", "description", "reference", "brand")
_VOWELS = "[aeiouàèéìòù]"


def _resembles_sql(word: str, name: str, phonetic: bool) -> str:
    """Whether a name (an expression) may be what the word means."""
    d, ln, bare = f"levenshtein({name}, '{word}')", f"length({name})", re.sub(_VOWELS, "", word)
    longest = f"greatest({ln}, {len(word)})"
    same = f"({len(bare)} >= 4 AND regexp_replace({name}, '{_VOWELS}', '', 'g') = '{bare}')"
    inside = f"({len(word)} >= 5 AND {ln} >= 5 AND (contains({name}, '{word}') OR contains('{word}', {name})))"
    affix = f"least(4, least({ln}, {len(word)}) - 1)"
    ends = f"({affix} >= 3 AND (left({name}, {affix}) = left('{word}', {affix}) OR right({name}, {affix}) = right('{word}', {affix})) AND {d} <= {longest} * 0.4)"
    sound = f" OR {soundex_sql(name)} = {soundex_sql(chr(39) + word + chr(39))}" if phonetic and len(word) >= 4 else ""
    return f"(abs({ln} - {len(word)}) <= {longest} * 0.5 AND {name} <> '{word}' AND ({d} BETWEEN 1 AND {3 if len(word) >= 8 else 2 if len(word) >= 5 else 1} OR {same} OR {inside} OR {ends}{sound}))"


def _candidates_sql(q: str, where: str = "true", corrected: bool = False, phonetic: bool = True) -> str:
    """The best 300 products with a term in some field; with ``corrected`` also the brands that words resemble."""
    words = [w for w in q.split(" ") if len(w) >= 2]
    terms = _terms(words)
    long = [w for w in words if len(w) >= 4] if corrected else []
    name_hits = " + ".join(f"CAST(contains(lower(name), '{t}') AS INTEGER)" for t in terms)
    hit = " OR ".join(any_sql(f"lower({f})", terms) for f in _FIELDS)
    if long:
        brands = f"SELECT DISTINCT lower(brand) AS b FROM catalog WHERE lower(brand) NOT IN ({', '.join(repr(t) for t in terms)}) AND ({' OR '.join(_resembles_sql(w, 'lower(brand)', phonetic) for w in long)})"
        name_hits += f" + (SELECT count(*) FROM ({brands}) WHERE contains(lower(c.name), b))"
        hit += f" OR EXISTS (SELECT 1 FROM ({brands}) WHERE " + " OR ".join(f"contains(lower(c.{f}), b)" for f in _FIELDS) + ")"
    forms = [[w, *_unit_forms(w)] for w in words]
    return f"""SELECT c.*, s.sold, {name_hits} AS name_match_count, {score_sql(q, words, spellings=forms)} AS relevance FROM catalog c LEFT JOIN sales s USING (id_product)
  WHERE ({hit}) AND {where} ORDER BY name_match_count DESC, name, id_product LIMIT 300"""


def _fuzzy_sql(q: str, phonetic: bool = True, where: str = "true") -> str:
    """The first 200 products by name that resemble a word of three characters or more."""
    tests = []
    for w in dict.fromkeys(x for x in q.split(" ") if len(x) >= 3):
        like = lambda letters: [f"lower({f}) LIKE '%{'%'.join(letters)}%'" for f in ("name", "description", "brand")]
        if len(w) > 3:
            tests += [f"contains(lower({f}), '{w[1:]}')" for f in ("name", "description", "brand")] + [f"contains(lower({f}), '{w[:-1]}')" for f in ("name", "brand")]
        tests += like(w)
        if len(re.sub(_VOWELS, "", w)) >= 3:
            tests += like(re.sub(_VOWELS, "", w))
        if phonetic:
            tests += [f"{soundex_sql(f)} = {soundex_sql(chr(39) + w + chr(39))}" for f in ("name", "brand")]
    return f"SELECT * FROM catalog WHERE ({' OR '.join(tests) or 'false'}) AND {where} ORDER BY name, id_product LIMIT 200"


def _search_sql(k: int, text: str, where: str = "true", price: str = "true", code_where: str | None = None) -> str:
    """The whole search for one query: narrowing filters, the price filter, and both for codes."""
    code, q = re.sub(r"\s", "", text), text.strip().lower()
    words = [w for w in q.split(" ") if len(w) >= 2]
    columns = "id_product, name, relevance, boost, injected, final, CAST(row_number() OVER (ORDER BY final DESC, name, id_product) AS INTEGER) AS rank"
    is_code = len(code) >= 4 and re.fullmatch("[A-Za-z0-9_-]+", code) and (re.search("[0-9_-]", code) or code == code.upper())
    found = f"SELECT * FROM (SELECT * FROM catalog WHERE upper('{code}') IN (upper(reference), upper(ean13), upper(upc)) ORDER BY id_product LIMIT 1) WHERE {where} AND {price}" if is_code else "SELECT * FROM catalog WHERE false"
    one = f"SELECT {k} AS query_id, id_product, name, CAST(150 AS DOUBLE) AS relevance, CAST(1 AS DOUBLE) AS boost, false AS injected, CAST(150 AS DOUBLE) AS final, CAST(1 AS INTEGER) AS rank FROM ({found})"
    if text.strip() == "*":
        return f"SELECT {k} AS query_id, id_product, name, CAST(0 AS DOUBLE) AS relevance, CAST(1 AS DOUBLE) AS boost, false AS injected, CAST(0 AS DOUBLE) AS final, CAST(row_number() OVER (ORDER BY date_add DESC, id_product) AS INTEGER) AS rank FROM catalog ORDER BY date_add DESC, id_product LIMIT 20"
    if len(q) < 2 or not words:
        return one
    hits = [(5, 2.0)] + [(12, 1.5)] * any(a in b or b in a for a in ("widget", "gear") for b in words)
    rules = ", ".join(f"(CAST({p} AS BIGINT), CAST({b} AS DOUBLE))" for p, b in hits)
    forms = [[w, *_unit_forms(w)] for w in words]
    return f"""SELECT * FROM (WITH organic AS (SELECT id_product, name, relevance FROM ({_candidates_sql(q, where, True)}) WHERE {price}),
    fuzzy AS (SELECT id_product, name, {score_sql(q, words, False, forms)} * CAST(0.7 AS DOUBLE) AS relevance FROM ({_fuzzy_sql(q, True, where)})
      WHERE {price} AND (SELECT count(*) FROM organic) < 5 AND id_product NOT IN (SELECT id_product FROM organic)),
    found AS (SELECT * FROM organic UNION ALL SELECT * FROM fuzzy), rules AS (SELECT * FROM (VALUES {rules}) AS r(id_product, boost)),
    ranked AS (SELECT f.*, coalesce(boost, 1) AS boost, false AS injected FROM found f LEFT JOIN rules USING (id_product)
      UNION ALL SELECT c.id_product, c.name, {score_sql(q, words, False, forms)} + 50, boost, true FROM rules JOIN catalog c USING (id_product) WHERE id_product NOT IN (SELECT id_product FROM found) AND (SELECT count(*) FROM found) > 0)
    SELECT {k} AS query_id, {columns} FROM (SELECT *, relevance * boost AS final FROM ranked) QUALIFY rank <= 200) WHERE NOT EXISTS ({found}) UNION ALL {one}"""


def _scored(spark, sf, *texts):
    return search.scored(search.candidates(sold_catalog(spark, sf), asked(spark, *texts)), shop.ntz(AS_OF))


@query("search_scored", with_views(f"SELECT 1 AS query_id, id_product, name, relevance FROM ({_candidates_sql('cold widget')}) UNION ALL SELECT 2, id_product, name, relevance FROM ({_candidates_sql('widget cold small')})", "catalog", "sales"))
def search_scored(spark, sf):
    return _scored(spark, sf, "cold widget", "widget cold small").select(F.col("query_id").cast("int").alias("query_id"), "id_product", "name", "relevance")


@query("search_ranked", with_views(f"SELECT id_product, name, relevance, CAST(row_number() OVER (ORDER BY relevance DESC, name, id_product) AS INTEGER) AS rank FROM ({_candidates_sql('cold widget')}) QUALIFY rank <= 200", "catalog", "sales"))
def search_ranked(spark, sf):
    found = _scored(spark, sf, "cold widget").withColumn("boost", F.lit(1.0))
    return search.final_order(found).select("id_product", "name", "relevance", "rank")


@query("boosted_rank", with_views(f"""SELECT id_product, relevance, coalesce(boost, 1.0) AS boost, relevance * coalesce(boost, 1.0) AS final,
  CAST(row_number() OVER (ORDER BY relevance * coalesce(boost, 1.0) DESC, name, id_product) AS INTEGER) AS rank
  FROM ({_candidates_sql('cold widget')}) LEFT JOIN (VALUES (5, CAST(2.0 AS DOUBLE)), (12, CAST(1.5 AS DOUBLE))) AS b(id_product, boost) USING (id_product) QUALIFY rank <= 200""", "catalog", "sales"))  # fmt: skip
def boosted_rank(spark, sf):
    rules = search.boost_rules(boosts(spark), shop.ntz(AS_OF))
    found = search.boosted(_scored(spark, sf, "cold widget"), asked(spark, "cold widget"), rules)
    return search.final_order(found).select("id_product", "relevance", "boost", "final", "rank")


@query("boost_injection", with_views(f"""SELECT b.id_product, {score_sql('red gear', ['red', 'gear'], False)} + 50 AS relevance, b.boost
  FROM (VALUES (CAST(5 AS BIGINT), CAST(2.0 AS DOUBLE)), (12, CAST(1.5 AS DOUBLE))) AS b(id_product, boost) JOIN catalog c ON c.id_product = b.id_product
  WHERE b.id_product NOT IN (SELECT id_product FROM ({_candidates_sql('red gear')}))""", "catalog", "sales"))  # fmt: skip
def boost_injection(spark, sf):
    rules = search.boost_rules(boosts(spark), shop.ntz(AS_OF))
    found = search.boosted(_scored(spark, sf, "red gear"), asked(spark, "red gear"), rules, sold_catalog(spark, sf))
    return found.where("injected").select("id_product", "relevance", "boost")


_RULES = """SELECT id_product AS id, id_product, (id_product % 1100) / 10.0 AS boost_value, CASE WHEN id_product % 5 > 0 THEN split_part(name, ' ', 1) || ', ' || split_part(name, ' ', 2) ELSE '' END AS keywords, id_product % 4 > 0 AS active,
  CASE WHEN id_product % 3 > 0 THEN date_add END AS date_start, CASE WHEN id_product % 7 > 0 THEN date_add + to_days(CAST(id_product % 45 AS INTEGER)) END AS date_end FROM catalog"""


def shop_rules(spark, sf):
    """A boost rule for each product: keywords, schedules with and without ends, some inactive."""
    key = F.col("id_product")
    words = F.concat(F.substring_index("name", " ", 1), F.lit(", "), F.substring_index("name", " ", -1))
    return shop.catalog(spark, sf).select(
        key.alias("id"), "id_product", (key % 1100 / 10.0).alias("boost_value"), F.when(key % 5 > 0, words).otherwise("").alias("keywords"), (key % 4 > 0).alias("active"),
        F.when(key % 3 > 0, F.col("date_add")).alias("date_start"), F.when(key % 7 > 0, F.col("date_add") + F.expr("make_dt_interval(cast(id_product % 45 as int))")).alias("date_end"),
    )


_OPEN = f"(date_start IS NULL OR date_start <= TIMESTAMP '{AS_OF}') AND (date_end IS NULL OR date_end >= TIMESTAMP '{AS_OF}')"


@query("boost_rules_active", with_views(f"SELECT id, id_product FROM ({_RULES}) WHERE active AND {_OPEN}", "catalog"))
def boost_rules_active(spark, sf):
    return search.boost_rules(shop_rules(spark, sf), shop.ntz(AS_OF)).select("id", "id_product")


@query("boost_rules_ignoring_schedule", with_views(f"SELECT id FROM ({_RULES}) WHERE active", "catalog"))
def boost_rules_ignoring_schedule(spark, sf):
    return search.boost_rules(shop_rules(spark, sf), shop.ntz(AS_OF), respect_schedule=False).select("id")


@query("fuzzy_candidates", with_views(f"SELECT id_product, name FROM ({_fuzzy_sql('colde widgit', False)})", "catalog"))
def fuzzy_candidates(spark, sf):
    return search.fuzzy_candidates(shop.catalog(spark, sf), asked(spark, "colde widgit"), phonetic=False).select("id_product", "name")


@query("fuzzy_phonetic", with_views(f"SELECT CAST(1 AS BIGINT) AS query_id, id_product, name FROM ({_fuzzy_sql('kold wijet')})", "catalog"))
def fuzzy_phonetic(spark, sf):
    return search.fuzzy_candidates(shop.catalog(spark, sf), asked(spark, "kold wijet"), phonetic=True).select("query_id", "id_product", "name")


@query("merge_penalised", with_views(f"""SELECT id_product, relevance FROM ({_candidates_sql('cold widget')}) UNION ALL
  SELECT id_product, relevance * CAST(0.7 AS DOUBLE) FROM ({_candidates_sql('red gear')}) WHERE id_product NOT IN (SELECT id_product FROM ({_candidates_sql('cold widget')}))""", "catalog", "sales"))  # fmt: skip
def merge_penalised(spark, sf):
    one, two = _scored(spark, sf, "cold widget"), _scored(spark, sf, "red gear")
    return search.merge(one, two).select("id_product", "relevance")


@query("merge_unpenalised", with_views(f"""SELECT id_product, relevance FROM ({_candidates_sql('cold widget')}) UNION ALL
  SELECT id_product, relevance FROM ({_candidates_sql('red gear')}) WHERE id_product NOT IN (SELECT id_product FROM ({_candidates_sql('cold widget')}))""", "catalog", "sales"))  # fmt: skip
def merge_unpenalised(spark, sf):
    one, two = _scored(spark, sf, "cold widget"), _scored(spark, sf, "red gear")
    return search.merge(one, two, penalty=1.0).select("id_product", "relevance")


@query("exact_words", with_views("SELECT id_product FROM catalog WHERE " + " AND ".join("(" + " OR ".join(f"contains(lower({f}), '{w}')" for f in ("name", "short_desc", "description", "reference", "brand")) + ")" for w in ("cold", "widget", "promo")), "catalog"))
def exact_words(spark, sf):
    return search.exact_words(shop.catalog(spark, sf), asked(spark, "cold widget promo")).select("id_product")


@query("exact_code", with_views("SELECT CAST(1 AS BIGINT) AS query_id, id_product, name, CAST(150.0 AS DOUBLE) AS relevance FROM catalog WHERE reference = 'REF-000042' UNION ALL SELECT 4, id_product, name, 150.0 FROM catalog WHERE ean13 = '0000000000007' UNION ALL SELECT 5, id_product, name, 150.0 FROM catalog WHERE upc = '700000000011'", "catalog"))
def exact_code(spark, sf):
    found = search.exact_code(shop.catalog(spark, sf), asked(spark, "REF-000042", "cold widget", "abc", "0000000000007", "7000 0000 0011", "REF-000097"))
    return found.select("query_id", "id_product", "name", "relevance")


SEARCHES = ["cold widget", "small", "widget cold", "colde widgit", "Brand#13", "REF-000042", "zzzz", "a", "red", "brnd#1 ring", "*", "cold 350g", "widgete"]


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


@query("full_search", with_views(_union([_search_sql(k + 1, t) for k, t in enumerate(SEARCHES)]), "catalog", "sales"))
def full_search(spark, sf):
    """The flagship: all branches of the storefront search for a table of queries."""
    found = search.search(sold_catalog(spark, sf), asked(spark, *SEARCHES), boosts(spark), shop.ntz(AS_OF), links=shop.category_links(spark, sf))
    return found.withColumn("query_id", F.col("query_id").cast("int"))


FILTERED = ["cold widget", "REF-000042", "REF-000043", "red", "colde"]
_NARROW = "id_brand IN (1, 13, 21) AND stock > 0 AND id_product IN (SELECT id_product FROM links WHERE id_category IN (3, 5, 7)) AND id_product IN (SELECT id_product FROM attrs WHERE id_group = 2 AND value IN ('cold', 'red', 'hot'))"


@query("full_search_filtered", with_views(_union([_search_sql(k + 1, t, _NARROW, "price_incl BETWEEN 1100 AND 1900") for k, t in enumerate(FILTERED)]), "catalog", "sales", "links", "attrs"))
def full_search_filtered(spark, sf):
    """Filters stand before the cap of 300, the price filter behind it; a code that they drop is searched as words."""
    filters = search.Filters((3, 5, 7), (1, 13, 21), 1100, 1900, True, {2: ("cold", "red", "hot")})
    found = search.search(sold_catalog(spark, sf), asked(spark, *FILTERED), boosts(spark), shop.ntz(AS_OF), filters, shop.category_links(spark, sf), attributes=shop.attributes(spark, sf))
    return found.withColumn("query_id", F.col("query_id").cast("int"))


@query("search_corrected", with_views(f"SELECT id_product, name, CAST(name_match_count AS INTEGER) AS name_match_count, relevance FROM ({_candidates_sql('brnd#21 ring', corrected=True)})", "catalog", "sales"))
def search_corrected(spark, sf):
    """A misspelt brand finds the brands that it resembles."""
    cat = sold_catalog(spark, sf)
    queries = asked(spark, "brnd#21 ring")
    few = search.is_few(queries)  # with their words they are a join, of whose size the planner knows nothing
    words = search.with_words(queries, search.brand_names(cat), few=few)
    return search.scored(search.candidates(cat, words, few=few), shop.ntz(AS_OF)).select("id_product", "name", "name_match_count", "relevance")


_CODES = "SELECT DISTINCT substr(reference, 7) AS query FROM catalog"


@query("search_many", with_views(f"""SELECT query, id_product FROM (SELECT q.query, c.id_product, row_number() OVER (PARTITION BY q.query ORDER BY CAST(contains(lower(c.name), q.query) AS INTEGER) DESC, c.name, c.id_product) AS place
  FROM ({_CODES}) q JOIN catalog c ON contains(lower(c.name), q.query) OR contains(lower(c.short_desc), q.query) OR contains(lower(c.description), q.query) OR contains(lower(c.reference), q.query) OR contains(lower(c.brand), q.query)) WHERE place <= 300""", "catalog"))  # fmt: skip
def search_many(spark, sf):
    """A query for each product, the end of its reference, all at once: by the index."""
    cat = shop.catalog(spark, sf)
    codes = cat.select(F.substring("reference", 7, 10).alias("query")).distinct().withColumn("query_id", F.col("query"))
    return search.candidates(cat, codes, few=False).select("query", "id_product")


_TYPED = "SELECT DISTINCT lower(substr(brand, 1, CAST(id_product % 7 AS INTEGER)) || substr(brand, CAST(id_product % 7 AS INTEGER) + 2)) AS word FROM catalog"


def _resembles_columns(word: str, name: str, phonetic: bool = True) -> str:
    """``_resembles_sql`` for words that are a column."""
    bare = lambda t: f"regexp_replace({t}, '{_VOWELS}', '', 'g')"
    lw, ln, d = f"length({word})", f"length({name})", f"levenshtein({word}, {name})"
    affix = f"least(4, least({lw}, {ln}) - 1)"
    return f"""abs({lw} - {ln}) <= greatest({lw}, {ln}) * 0.5 AND {word} <> {name} AND ({d} BETWEEN 1 AND CASE WHEN {lw} >= 8 THEN 3 WHEN {lw} >= 5 THEN 2 ELSE 1 END
    OR ({bare(word)} = {bare(name)} AND length({bare(word)}) >= 4) OR ({lw} >= 5 AND {ln} >= 5 AND (contains({word}, {name}) OR contains({name}, {word})))
    OR ({affix} >= 3 AND (left({word}, {affix}) = left({name}, {affix}) OR right({word}, {affix}) = right({name}, {affix})) AND {d} <= greatest({lw}, {ln}) * 0.4)
    OR ({str(phonetic).lower()} AND {lw} >= 4 AND {soundex_sql(word)} = {soundex_sql(name)}))"""


@query("brand_corrections_many", with_views(f"SELECT word, name FROM ({_TYPED}) w JOIN (SELECT DISTINCT lower(brand) AS name FROM catalog) n ON {_resembles_columns('word', 'name')}", "catalog"))
def brand_corrections_many(spark, sf):
    """Every brand with a letter left out, one place after another: by deletion neighbourhoods."""
    cat = shop.catalog(spark, sf)
    return postings.misspelt(typed_brands(cat), search.brand_names(cat)).select("word", "name")


def typed_brands(cat):
    at = (F.col("id_product") % 7).cast("int")
    typed = cat.select(F.lower(F.concat(F.left("brand", at), F.substring(F.col("brand"), at + 2, F.length("brand")))).alias("word")).distinct()
    return typed.select(F.lit(1).alias("query_id"), "word")


def _filter(name: str, condition: str, filters: search.Filters, *views: str):
    @query(name, with_views(f"SELECT id_product FROM catalog WHERE {condition}", "catalog", *views))
    def run(spark, sf):
        return search.apply_filters(shop.catalog(spark, sf), filters, shop.category_links(spark, sf), shop.attributes(spark, sf)).select("id_product")


_filter("filter_category", "id_product IN (SELECT id_product FROM links WHERE id_category IN (3, 7))", search.Filters(categories=(3, 7)), "links")
_filter("filter_brand", "id_brand IN (1, 13)", search.Filters(brands=(1, 13)))
_filter("filter_price", "price_incl >= 1100 AND price_incl <= 1150.5", search.Filters(price_min=1100, price_max=1150.5))
_filter("filter_stock", "stock > 0", search.Filters(in_stock=True))
_filter(
    "filter_attributes",
    "id_product IN (SELECT id_product FROM attrs WHERE id_group = 1 AND value IN ('5', '11')) AND id_product IN (SELECT id_product FROM attrs WHERE id_group = 2 AND value IN ('red', 'blue', 'cold'))",
    search.Filters(attributes={1: ("5", "11"), 2: ("red", "blue", "cold")}),
    "attrs",
)
_filter("filter_all", "id_brand = 1 AND stock > 0 AND price_incl <= 1500 AND id_product IN (SELECT id_product FROM links WHERE id_category = 4)", search.Filters.parse({"category": "4,x", "brand": "1", "price_max": "1500", "price_min": "no", "in_stock": "1"}), "links")


@query("filter_base_price", with_views("SELECT id_product FROM catalog WHERE price <= 950.5", "catalog"))
def filter_base_price(spark, sf):
    return search.base_price(shop.catalog(spark, sf), 0, 950.5).select("id_product")


@query("filter_stock_variants", with_views("""SELECT 'product' AS how, id_product FROM catalog WHERE stock > 0
  UNION ALL SELECT 'shop', id_product FROM catalog WHERE id_product IN (SELECT id_product FROM stock WHERE id_shop = 2 GROUP BY 1 HAVING sum(quantity) > 0)
  UNION ALL SELECT 'any', id_product FROM catalog WHERE EXISTS (SELECT 1 FROM stock WHERE stock.id_product = catalog.id_product AND quantity > 0)""", "catalog", "stock"))  # fmt: skip
def filter_stock_variants(spark, sf):
    cat, rows = shop.catalog(spark, sf), shop.stock_rows(spark, sf)
    parts = [search.in_stock(cat, rows, how, 2).select(F.lit(how).alias("how"), "id_product") for how in ("product", "shop", "any")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("filter_visibility", with_views("SELECT id_product FROM catalog WHERE visibility IN ('both', 'search')", "catalog"))
def filter_visibility(spark, sf):
    return search.searchable(shop.catalog(spark, sf)).select("id_product")


@query("catalog_scoped", with_views("SELECT id_product, upper(name) AS name, brand, price FROM products WHERE active AND id_product % 2 = 0", "products"))
def catalog_scoped(spark, sf):
    return shop.catalog(spark, sf, id_lang=2, id_shop=2).select("id_product", "name", "brand", "price")


@query("cover_images", with_views("SELECT id_product, id_image FROM catalog LEFT JOIN (SELECT id_product, min(id_image) AS id_image FROM images WHERE cover GROUP BY 1) USING (id_product)", "catalog", "images"))
def cover_images(spark, sf):
    return shop.with_cover(shop.catalog(spark, sf), shop.images(spark, sf)).select("id_product", "id_image")


@query("filter_default_category", with_views("SELECT id_product FROM catalog WHERE id_category IN (5, 6)", "catalog"))
def filter_default_category(spark, sf):
    return shop.catalog(spark, sf).where(F.col("id_category").isin(5, 6)).select("id_product")


@query("page_window", with_views(f"""SELECT id_product, CAST(r AS INTEGER) AS rank, n > 48 AS has_more FROM (SELECT *, row_number() OVER (ORDER BY relevance DESC, name, id_product) AS r FROM ({_candidates_sql('cold widget')}))
  CROSS JOIN (SELECT least(count(*), 200) AS n FROM ({_candidates_sql('cold widget')})) WHERE r > 24 AND r <= 48""", "catalog", "sales"))  # fmt: skip
def page_window(spark, sf):
    found = search.final_order(_scored(spark, sf, "cold widget").withColumn("boost", F.lit(1.0)))
    return search.page(found, 24, 24).select("id_product", "rank", "has_more")


for _how, _order in {"price_asc": "price, id_product", "price_desc": "price DESC, id_product", "name_asc": "name, id_product", "name_desc": "name DESC, id_product"}.items():

    @query(f"sort_{_how}", with_views(f"SELECT id_product, CAST(row_number() OVER (ORDER BY {_order}) AS INTEGER) AS place FROM ({_candidates_sql('cold widget')})", "catalog", "sales"))
    def user_sort(spark, sf, how=_how):
        return search.user_sort(_scored(spark, sf, "cold widget"), how).select("id_product", "place")


@query("category_search", with_views("SELECT DISTINCT id_category, category FROM catalog WHERE contains(lower(category), 'm') ORDER BY category LIMIT 5", "catalog"))
def category_search(spark, sf):
    return search.category_search(shop.catalog(spark, sf).select("id_category", "category").distinct(), "M")


@query("admin_lookup", with_views("SELECT id_product, name || ' (' || reference || ')' AS label, brand, active FROM products WHERE contains(lower(name), '97') OR contains(lower(reference), '97') OR contains(lower(brand), '97') OR id_product = 97 ORDER BY active DESC, name, id_product LIMIT 50", "products"))
def admin_lookup(spark, sf):
    return search.admin_lookup(shop.products(spark, sf), "97")


@query("formatted", with_views("""SELECT id_product, name, brand, category, reference, CAST(round(CAST(price_incl AS DECIMAL(20, 6)), 2) AS DOUBLE) AS price_shown,
  CASE WHEN price_old_incl > price_incl THEN CAST(round(CAST(price_old_incl AS DECIMAL(20, 6)), 2) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS price_old,
  CAST(CASE WHEN price_old_incl > price_incl THEN 20 ELSE 0 END AS INTEGER) AS discount_percent, substr(description, 1, 100) AS excerpt, stock > 0 AS in_stock, stock AS quantity, coalesce(sold, 0) AS total_sold,
  id_product IN (SELECT id_product FROM catalog JOIN sales USING (id_product) WHERE sold > 0 ORDER BY sold DESC, name, id_product LIMIT 20) AS is_bestseller,
  id_product IN (SELECT id_product FROM attrs WHERE value = '11') AS has_attributes, coalesce(id_image, 0) AS id_image, CASE WHEN id_product = 5 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS boost, false AS injected
  FROM catalog LEFT JOIN sales USING (id_product) LEFT JOIN (SELECT id_product, min(id_image) AS id_image FROM images WHERE cover GROUP BY 1) USING (id_product)""", "catalog", "sales", "images", "attrs"))  # fmt: skip
def formatted(spark, sf):
    cat = shop.with_cover(sold_catalog(spark, sf), shop.images(spark, sf)).withColumn("boost", F.when(F.col("id_product") == 5, 2.0).otherwise(1.0))
    variants = shop.attributes(spark, sf).where("value = '11'")
    return search.formatted(cat, facets.bestsellers(shop.catalog(spark, sf), shop.sales(spark, sf), 20), variants)


@query("discounts", with_views("SELECT id_product, CAST(CASE WHEN id_product % 4 = 0 THEN 25 ELSE 0 END AS INTEGER) AS percent, CASE WHEN id_product % 4 = 0 THEN CAST(round(CAST(price AS DECIMAL(20, 6)) - CAST(price * CAST(0.75 AS DOUBLE) AS DECIMAL(20, 6)), 2) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS savings FROM catalog", "catalog"))
def discounts(spark, sf):
    now = F.when(F.col("id_product") % 4 == 0, F.col("price") * 0.75).otherwise(F.col("price"))
    percent, savings = search.discount(F.col("price"), now)
    return shop.catalog(spark, sf).select("id_product", percent.cast("int").alias("percent"), savings.alias("savings"))


@query("highlighted", with_views("SELECT DISTINCT name, regexp_replace(regexp_replace(name, '(cold)', '<mark>\\1</mark>', 'gi'), '(ring)', '<mark>\\1</mark>', 'gi') AS html FROM catalog", "catalog"))
def highlighted(spark, sf):
    names = shop.catalog(spark, sf).select("name").distinct()
    return names.select("name", X.highlight(F.col("name"), ["cold", "x", "ring"]).alias("html"))


@query("device_buckets", "SELECT CASE WHEN user_id * 20 < 768 THEN 'mobile' WHEN user_id * 20 < 1024 THEN 'tablet' ELSE 'desktop' END AS device, count(*) AS n FROM events GROUP BY 1")
def device_buckets(spark, sf):
    return shop.table(spark, sf, "events").groupBy(search.device(F.col("user_id") * 20).alias("device")).agg(F.count("*").alias("n"))


# text
_LETTERS = "[a-zàèéìòù0-9]+"
_WORDS = f"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_LETTERS}')) AS word FROM documents"
_SIZED = "SELECT DISTINCT CAST(size AS VARCHAR) || CASE id_product % 9 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' WHEN 2 THEN 'l' WHEN 3 THEN 'caps' WHEN 4 THEN 'tabs' WHEN 5 THEN '' WHEN 6 THEN 'x' WHEN 7 THEN 'gr' ELSE 'compresse' END AS word FROM catalog"


def words_used(spark, sf):
    """The distinct words of all documents."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({_LETTERS})"))
    return shop.table(spark, sf, "documents").select(F.explode(words).alias("word")).distinct()


def sized_words(spark, sf):
    """Sizes of products with a unit, as they are typed."""
    unit = F.element_at(F.array(*map(F.lit, ["g", "ml", "l", "caps", "tabs", "", "x", "gr", "compresse"])), (F.col("id_product") % 9 + 1).cast("int"))
    return shop.catalog(spark, sf).select(F.concat(F.col("size").cast("string"), unit).alias("word")).distinct()


def _variations_sql(words: str) -> str:
    cases = ["word"]
    for ending, others in X.ENDINGS:
        cases += [f"CASE WHEN length(word) >= 3 AND word LIKE '%{ending}' THEN left(word, length(word) - {len(ending)}) || '{o}' END" for o in others]
    return "SELECT DISTINCT word, form FROM (SELECT word, unnest([" + ", ".join(cases) + f"]) AS form FROM ({words})) WHERE form IS NOT NULL"


def _unit_variations_sql(words: str) -> str:
    parts = [f"SELECT word, unnest([n || u, n || ' ' || u]) AS form FROM u WHERE u IN ({', '.join(map(repr, X.UNITS))})", "SELECT word, n FROM u WHERE u = ''"]
    parts += [f"SELECT word, n || unnest([{', '.join(map(repr, forms))}]) FROM u WHERE u = '{unit}'" for unit, forms in X.UNIT_FORMS.items()]
    return f"WITH u AS (SELECT word, regexp_extract(word, '^([0-9]+)([a-z]*)$', 1) AS n, regexp_extract(word, '^([0-9]+)([a-z]*)$', 2) AS u FROM ({words}) WHERE regexp_matches(word, '^[0-9]+[a-z]*$')) SELECT DISTINCT word, form FROM ({' UNION ALL '.join(parts)})"


@query("word_variations", _variations_sql(_WORDS))
def word_variations(spark, sf):
    return words_used(spark, sf).select("word", F.explode(X.word_variations(F.col("word"))).alias("form"))


@query("unit_variations", with_views(f"SELECT * FROM ({_unit_variations_sql(_SIZED)})", "catalog"))
def unit_variations(spark, sf):
    return sized_words(spark, sf).select("word", F.explode(X.unit_variations(F.col("word"))).alias("form"))


_STOPS = ", ".join(map(repr, X.STOP_WORDS))


@query("stop_words", f"""SELECT doc_id, len(CASE WHEN len(kept) > 0 THEN kept ELSE words END) AS n, md5(array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE words END, ' ')) AS digest FROM (
  SELECT *, list_filter(words, lambda w: w NOT IN ({_STOPS}) AND length(w) > 1) AS kept FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_LETTERS}') AS words FROM documents))""")  # fmt: skip
def stop_words(spark, sf):
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"({_LETTERS})"))
    own = shop.table(spark, sf, "documents").select("doc_id", words.alias("words")).select("doc_id", X.without_stop_words(F.col("words")).alias("kept"))
    return own.select("doc_id", F.size("kept").cast("long").alias("n"), F.md5(F.array_join("kept", " ")).alias("digest"))


_STEM = " ".join(f"WHEN ends_with(word, '{e}') AND length(word) > {len(e) + 2} THEN left(word, length(word) - {len(e)})" for e in X.STEM_ENDINGS)


@query("stems", f"SELECT word, CASE WHEN length(word) <= 3 THEN word {_STEM} ELSE word END AS stem FROM ({_WORDS})")
def stems(spark, sf):
    return words_used(spark, sf).select("word", X.stem(F.col("word")).alias("stem"))


@query("normalized", "SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, '[^\\p{L}\\p{N}\\s]', ' ', 'g')), '\\s+', ' ', 'g')) AS clean FROM documents")
def normalized(spark, sf):
    return shop.table(spark, sf, "documents").select("doc_id", X.normalize(F.col("text")).alias("clean"))


@query("consonants", with_views("SELECT DISTINCT name, regexp_replace(lower(name), '[aeiouàèéìòù]', '', 'g') AS skeleton FROM catalog", "catalog"))
def consonants(spark, sf):
    return shop.catalog(spark, sf).select("name", X.consonants(F.col("name")).alias("skeleton")).distinct()


@query("brand_corrections", with_views(f"SELECT word, name FROM ({_TYPED}) w JOIN (SELECT DISTINCT lower(brand) AS name FROM catalog) n ON {_resembles_columns('word', 'name', False)}", "catalog"))
def brand_corrections(spark, sf):
    """As ``brand_corrections_many`` without sounds, each word held against each brand in one scan."""
    cat = shop.catalog(spark, sf)
    return postings.misspelt(typed_brands(cat), search.brand_names(cat), phonetic=False, few=True).select("word", "name")


_ASKED = "SELECT DISTINCT lower(name) || ' ' || word AS query FROM (SELECT name, size, id_product, CAST(size AS VARCHAR) || CASE id_product % 9 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' WHEN 2 THEN 'l' WHEN 3 THEN 'caps' WHEN 4 THEN 'tabs' WHEN 5 THEN '' WHEN 6 THEN 'x' WHEN 7 THEN 'gr' ELSE 'compresse' END AS word FROM catalog)"


@query("expand_words", with_views(f"""SELECT DISTINCT query, form AS term FROM (SELECT query, word FROM (SELECT query, unnest(string_split(query, ' ')) AS word FROM ({_ASKED})) WHERE length(word) >= 2) q
  JOIN (SELECT * FROM ({_variations_sql(f"SELECT DISTINCT unnest(string_split(query, ' ')) AS word FROM ({_ASKED})")}) UNION ALL SELECT * FROM ({_unit_variations_sql(f"SELECT DISTINCT unnest(string_split(query, ' ')) AS word FROM ({_ASKED})")})) f USING (word)""", "catalog"))  # fmt: skip
def expand_words(spark, sf):
    """Queries of a name and a size: all forms of all their words."""
    unit = F.element_at(F.array(*map(F.lit, ["g", "ml", "l", "caps", "tabs", "", "x", "gr", "compresse"])), (F.col("id_product") % 9 + 1).cast("int"))
    queries = shop.catalog(spark, sf).select(F.concat(F.lower("name"), F.lit(" "), F.col("size").cast("string"), unit).alias("query")).distinct()
    return queries.select("query", F.explode(X.expand_words(X.query_words(F.col("query")))).alias("term"))


@query("phonetic_sounds", with_views(f"SELECT DISTINCT word, {soundex_sql('word')} AS sound FROM (SELECT unnest(string_split(name || ' ' || brand, ' ')) AS word FROM catalog)", "catalog"))
def phonetic_sounds(spark, sf):
    words = shop.catalog(spark, sf).select(F.explode(F.split(F.concat_ws(" ", "name", "brand"), " ")).alias("word")).distinct()
    return words.select("word", F.soundex("word").alias("sound"))


def _metaphone_sql(word: str) -> str:
    """Letters with their neighbours, as text functions of the word and a place."""
    s = f"(CASE WHEN regexp_matches({word}, '^(KN|GN|PN|AE|WR|WH)') THEN CASE left({word}, 2) WHEN 'AE' THEN 'E' WHEN 'WR' THEN 'R' WHEN 'WH' THEN 'W' ELSE 'N' END || substr({word}, 3) WHEN starts_with({word}, 'X') THEN 'S' || substr({word}, 2) ELSE {word} END)"
    c, d, e, b = f"substr({s}, i, 1)", f"substr({s}, i + 1, 1)", f"substr({s}, i + 2, 1)", f"CASE WHEN i > 1 THEN substr({s}, i - 1, 1) ELSE '' END"
    two, soft, vowel = f"substr({s}, i + 1, 2)", f"{d} IN ('I', 'E', 'Y')", f"{d} IN ('A', 'E', 'I', 'O', 'U')"
    return f"""array_to_string(list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN {c} = ({b}) AND {c} <> 'C' THEN '' WHEN {c} IN ('A', 'E', 'I', 'O', 'U') THEN CASE WHEN i = 1 THEN {c} ELSE '' END ELSE CASE {c}
    WHEN 'B' THEN CASE WHEN ({b}) = 'M' AND {d} = '' THEN '' ELSE 'B' END WHEN 'C' THEN CASE WHEN {two} = 'IA' OR {d} = 'H' THEN 'X' WHEN {soft} THEN 'S' ELSE 'K' END
    WHEN 'D' THEN CASE WHEN {two} IN ('GE', 'GY', 'GI') THEN 'J' ELSE 'T' END
    WHEN 'G' THEN CASE WHEN {d} = 'H' AND {e} NOT IN ('A', 'E', 'I', 'O', 'U', '') OR {two} = 'N' THEN '' WHEN {soft} AND ({b}) <> 'G' THEN 'J' ELSE 'K' END
    WHEN 'H' THEN CASE WHEN {vowel} AND ({b}) NOT IN ('C', 'S', 'P', 'T', 'G') THEN 'H' ELSE '' END WHEN 'K' THEN CASE WHEN ({b}) = 'C' THEN '' ELSE 'K' END WHEN 'P' THEN CASE WHEN {d} = 'H' THEN 'F' ELSE 'P' END
    WHEN 'Q' THEN 'K' WHEN 'S' THEN CASE WHEN {d} = 'H' OR {two} IN ('IO', 'IA') THEN 'X' ELSE 'S' END WHEN 'T' THEN CASE WHEN {two} IN ('IA', 'IO') THEN 'X' WHEN {d} = 'H' THEN '0' WHEN {two} = 'CH' THEN '' ELSE 'T' END
    WHEN 'V' THEN 'F' WHEN 'W' THEN CASE WHEN {vowel} THEN 'W' ELSE '' END WHEN 'Y' THEN CASE WHEN {vowel} THEN 'Y' ELSE '' END WHEN 'X' THEN 'KS' WHEN 'Z' THEN 'S' ELSE {c} END END), '')"""


@query("phonetic_keys", with_views(f"SELECT word, {soundex_sql('word')} AS sound, {_metaphone_sql('w')} AS metaphone FROM (SELECT DISTINCT word, regexp_replace(upper(word), '[^A-Z]', '', 'g') AS w FROM (SELECT unnest(string_split(name, ' ')) AS word FROM catalog))", "catalog"))
def phonetic_keys(spark, sf):
    names = shop.catalog(spark, sf).select(F.explode(F.split("name", " ")).alias("word")).distinct()
    return names.select("word", F.soundex("word").alias("sound"), X.metaphone(F.col("word")).alias("metaphone"))


# facets
@query("brand_facet", with_views("SELECT id_brand, brand, count(DISTINCT id_product) AS n_products FROM catalog GROUP BY 1, 2", "catalog"))
def brand_facet(spark, sf):
    return facets.brand_facet(shop.catalog(spark, sf))


@query("category_facet", with_views("SELECT id_category, count(DISTINCT id_product) AS n_products FROM links WHERE id_category > 2 GROUP BY 1", "links"))
def category_facet(spark, sf):
    return facets.category_facet(shop.catalog(spark, sf), shop.category_links(spark, sf))


@query("price_range", with_views("SELECT CAST(floor(min(price)) AS BIGINT) AS price_min, CAST(trunc(ceil(max(price)) * (1 + CAST(22.0 AS DOUBLE) / 100)) AS BIGINT) AS price_max FROM catalog", "catalog"))
def price_range(spark, sf):
    return facets.price_range(shop.catalog(spark, sf))


_RATES = "CASE r_regionkey WHEN 0 THEN 4 WHEN 1 THEN 22 WHEN 2 THEN 10 WHEN 3 THEN 5 ELSE 20 END"


@query("main_tax_rate", f"""SELECT CAST(rate AS DOUBLE) AS rate FROM (SELECT r_regionkey, {_RATES} AS rate FROM region WHERE r_regionkey <> 3)
  JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 1 AND n_nationkey % 3 <> 2 GROUP BY r_regionkey, rate ORDER BY count(*) DESC, rate DESC LIMIT 1""")  # fmt: skip
def main_tax_rate(spark, sf):
    return facets.main_tax_rate(facets.tax_rates(*shop.taxes(spark, sf), country=1))


@query("tax_rates", f"SELECT CAST({_RATES} AS DOUBLE) AS rate, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 2 = 0 AND n_nationkey % 3 <> 2) AS rule_count, r_regionkey <> 3 AS active FROM region")
def tax_rates(spark, sf):
    return facets.tax_rates(*shop.taxes(spark, sf), country=0)


@query("query_brand_facet", with_views("SELECT id_brand, brand, count(*) AS n_products FROM catalog WHERE contains(lower(name), 'cold') OR contains(lower(name), 'ring') GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 10", "catalog"))
def query_brand_facet(spark, sf):
    return facets.query_brand_facet(shop.catalog(spark, sf), ["cold", "ring", "x"])


@query("query_category_facet", with_views("SELECT id_category, category, count(*) AS n_products FROM catalog WHERE contains(lower(name), 'cold') GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 10", "catalog"))
def query_category_facet(spark, sf):
    return facets.query_category_facet(shop.catalog(spark, sf), ["cold"])


@query("query_price_range", with_views("SELECT min(price) AS price_min, max(price) AS price_max FROM catalog WHERE contains(lower(name), 'cold')", "catalog"))
def query_price_range(spark, sf):
    return facets.query_price_range(shop.catalog(spark, sf), ["cold"])


@query("query_attribute_facet", with_views("SELECT id_group, group_name, value, count(DISTINCT id_product) AS n_products FROM attrs WHERE id_product IN (SELECT id_product FROM catalog WHERE contains(lower(name), 'widget')) GROUP BY 1, 2, 3", "attrs"))
def query_attribute_facet(spark, sf):
    return facets.query_attribute_facet(shop.catalog(spark, sf), shop.attributes(spark, sf), ["widget"])


@query("bestsellers", with_views("SELECT id_product, name, price, sold FROM catalog JOIN sales USING (id_product) WHERE sold > 0 ORDER BY sold DESC, name, id_product LIMIT 12", "catalog", "sales"))
def bestsellers(spark, sf):
    return facets.bestsellers(shop.catalog(spark, sf), shop.sales(spark, sf))


@query("bestseller_ids", with_views("SELECT id_product, sold FROM sales WHERE sold > 0 ORDER BY sold DESC, id_product LIMIT 20", "sales"))
def bestseller_ids(spark, sf):
    return shop.sales(spark, sf).where("sold > 0").orderBy(F.desc("sold"), "id_product").limit(20)


@query("bestsellers_or_recent", with_views("SELECT id_product, name FROM catalog JOIN sales USING (id_product) WHERE sold > 0 ORDER BY sold DESC, name, id_product LIMIT 12", "catalog", "sales"))
def bestsellers_or_recent(spark, sf):
    return facets.bestsellers_or_recent(shop.catalog(spark, sf), shop.sales(spark, sf))


@query("recent_products", with_views("SELECT id_product, name, date_add FROM catalog ORDER BY date_add DESC, id_product LIMIT 24", "catalog"))
def recent_products(spark, sf):
    return facets.recent_products(shop.catalog(spark, sf))


@query("ratings", with_views("SELECT id_product, avg(grade) AS rating, count(*) AS n_reviews FROM reviews WHERE validated GROUP BY 1", "reviews"))
def ratings(spark, sf):
    return facets.ratings(shop.reviews(spark, sf))


# linguistic profile
def synonyms(spark):
    rows = [("widget", "gear, ring ,bolt", True), ("cold", "chilly", False), ("bolt", "screw", True)]
    return shop.literal(spark, rows, "word string, synonyms string, active boolean")


_PAIRS = "SELECT split_part(name, ' ', 1) AS word, string_agg(DISTINCT split_part(name, ' ', 2), ' , ') AS synonyms, min(size) % 3 > 0 AS active FROM catalog GROUP BY 1"


@query("synonym_terms", with_views(f"""SELECT * FROM (WITH p AS (SELECT word, trim(unnest(string_split(synonyms, ','))) AS other FROM ({_PAIRS}) WHERE active), b AS (SELECT word, other FROM p UNION SELECT other, word FROM p)
  SELECT DISTINCT query, other FROM (SELECT DISTINCT 'the ' || name || '!' AS query, unnest(string_split(name, ' ')) AS word FROM catalog) JOIN b USING (word))""", "catalog"))  # fmt: skip
def synonym_terms(spark, sf):
    """Tones of products and what comes in them as synonyms, for a query of each name: both directions."""
    cat = shop.catalog(spark, sf)
    known = cat.groupBy(F.substring_index("name", " ", 1).alias("word")).agg(F.array_join(F.collect_set(F.substring_index("name", " ", -1)), " , ").alias("synonyms"), (F.min("size") % 3 > 0).alias("active"))
    queries = cat.select(F.concat(F.lit("the "), "name", F.lit("!")).alias("query")).distinct().withColumn("query_id", F.col("query"))
    found = search.linguistic_terms(queries, known)
    return found.select("query", F.explode("synonyms").alias("other"))


_VISIBLE = "SELECT * FROM catalog LEFT JOIN sales USING (id_product) LEFT JOIN (SELECT id_product, avg(grade) AS rating FROM reviews WHERE validated GROUP BY 1) USING (id_product) WHERE visibility IN ('both', 'search')"


def _ling_score_sql(q: str) -> str:
    nm, rf, br = "lower(name)", "lower(reference)", "lower(brand)"
    parts = [f"CASE WHEN contains({nm}, '{q}') THEN 100 + CASE WHEN starts_with({nm}, '{q}') THEN 50 ELSE 0 END ELSE 0 END"]
    for w in (x for x in q.split(" ") if len(x) >= 2):
        parts.append(f"20 * CAST(contains({nm}, '{w}') AS INTEGER) + 10 * CAST(starts_with({nm}, '{w}') AS INTEGER) + 30 * CAST(contains({rf}, '{w}') AS INTEGER) + 15 * CAST(contains({br}, '{w}') AS INTEGER)")
    return " + ".join(parts) + " + least(CAST(20 AS DOUBLE), coalesce(sold, 0) / CAST(10 AS DOUBLE)) + CASE WHEN rating >= 4 THEN 10 ELSE 0 END"


def _ling_sql(k: int, q: str, words: list[str], stems: list[str], synonyms: list[str], boost: float = 1.0) -> str:
    """One query of the linguistic profile; its words, stems and synonyms are written out. ``boost``: of product 12."""
    hit = " OR ".join([any_sql(f"lower({f})", words) for f in ("name", "short_desc", "reference", "ean13", "brand", "tags")] + [any_sql(f"lower({f})", stems + synonyms) for f in ("name", "short_desc")])
    near = " + ".join(f"CASE WHEN length('{w}') >= 3 AND length(o) >= 3 AND levenshtein('{w}', o) <= least(3, floor(greatest({len(w)}, length(o)) / 3)) THEN (1 - levenshtein('{w}', o) / CAST(greatest({len(w)}, length(o)) AS DOUBLE)) * 10 ELSE 0 END" for w in words)
    pool = f"SELECT id_product, name, unnest(string_split(lower(name), ' ')) AS o FROM (SELECT * FROM ({_VISIBLE}) ORDER BY id_product LIMIT 1000)"
    return f"""SELECT * FROM (WITH visible AS ({_VISIBLE}), found AS (SELECT id_product, name, CAST({_ling_score_sql(q)} AS DOUBLE) AS score FROM visible WHERE {hit} ORDER BY score DESC, name, id_product LIMIT 60),
    near AS (SELECT id_product, sum({near}) AS f FROM ({pool}) GROUP BY 1 HAVING sum({near}) > 0 ORDER BY 2 DESC, 1 LIMIT 200),
    merged AS (SELECT * FROM found UNION ALL SELECT id_product, name, CAST({_ling_score_sql(q)} AS DOUBLE) + f FROM visible JOIN near USING (id_product) WHERE id_product NOT IN (SELECT id_product FROM found) AND (SELECT count(*) FROM found) < 20)
    SELECT {k} AS query_id, id_product, name, score, CASE WHEN id_product = 12 THEN CAST({boost} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS boost, score * CASE WHEN id_product = 12 THEN CAST({boost} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS final,
      CAST(row_number() OVER (ORDER BY score * CASE WHEN id_product = 12 THEN CAST({boost} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END DESC, name, id_product) AS INTEGER) AS rank FROM merged QUALIFY rank <= 20)"""


def rated_catalog(spark, sf):
    return sold_catalog(spark, sf).join(facets.ratings(shop.reviews(spark, sf)), "id_product", "left")


@query("linguistic_search", with_views(f"SELECT id_product, score FROM ({_ling_sql(1, 'cold widget', ['cold', 'widget'], ['cold', 'widg'], ['gear', 'ring', 'bolt'])})", "catalog", "sales", "reviews"))
def linguistic_search(spark, sf):
    return search.linguistic_search(rated_catalog(spark, sf), asked(spark, "cold widget"), synonyms(spark)).select("id_product", "score")


@query("linguistic_full", with_views(_union([
    _ling_sql(1, "cold widget", ["cold", "widget"], ["cold", "widg"], ["gear", "ring", "bolt"], 1.5), _ling_sql(2, "the widgit", ["widgit"], ["widgit"], []),
    _ling_sql(3, "bolt", ["bolt"], ["bolt"], ["screw", "widget"]), _ling_sql(4, "zzzz", ["zzzz"], ["zzzz"], []), _ling_sql(5, "outlet gift", ["outlet", "gift"], ["outlet", "gift"], []),
]), "catalog", "sales", "reviews"))
def linguistic_full(spark, sf):
    texts = asked(spark, "cold widget", "the widgit", "bolt", "zzzz", "outlet gift")
    found = search.linguistic_search(rated_catalog(spark, sf), texts, synonyms(spark), boosts(spark), shop.ntz(AS_OF))
    return found.withColumn("query_id", F.col("query_id").cast("int"))


@query("fuzzy_similarity", with_views("""SELECT id_product, sum(CASE WHEN levenshtein(w, o) <= least(3, floor(greatest(length(w), length(o)) / 3)) AND length(o) >= 3 THEN (1 - levenshtein(w, o) / CAST(greatest(length(w), length(o)) AS DOUBLE)) * 10 ELSE 0 END) AS fuzzy_score
  FROM (SELECT id_product, name, unnest(string_split(lower(name), ' ')) AS o FROM (SELECT * FROM catalog ORDER BY id_product LIMIT 1000)), (VALUES ('widgit')) AS q(w) GROUP BY id_product
  HAVING fuzzy_score > 0 ORDER BY fuzzy_score DESC, id_product LIMIT 200""", "catalog"))  # fmt: skip
def fuzzy_similarity(spark, sf):
    terms = search.linguistic_terms(asked(spark, "widgit"), synonyms(spark))
    return search.fuzzy_rows(shop.catalog(spark, sf), terms).select("id_product", "fuzzy_score")


# merchandising
def banners(spark):
    rows = [
        (1, "always", "", "top", True, None, None, "2001-01-01 00:00:00"), (2, "cold", "cold, ice", "middle", True, None, None, "2001-02-01 00:00:00"),
        (3, "old", "", "bottom", True, "2000-01-01 00:00:00", "2000-02-01 00:00:00", "2000-01-01 00:00:00"), (4, "off", "", "sidebar", False, None, None, "2001-01-01 00:00:00"),
        (5, "later", "", "top", True, None, None, "2001-03-01 00:00:00"), (6, "other", "gear", "bottom", True, None, None, "2001-03-01 00:00:00"),
    ]
    df = shop.literal(spark, rows, "id bigint, name string, keywords string, position string, active boolean, s string, e string, d string")
    ts = lambda c, to: F.col(c).cast("timestamp_ntz").alias(to)
    return df.select("id", "name", "keywords", "position", "active", ts("s", "date_start"), ts("e", "date_end"), ts("d", "date_add"))


_BANNERS = """SELECT c_custkey AS id, c_name AS name, lower(c_mktsegment) || ', b' || c_custkey % 10 AS keywords, ['top', 'middle', 'bottom', 'sidebar'][c_custkey % 4 + 1] AS position, c_custkey % 5 > 0 AS active,
  CASE WHEN c_custkey % 3 > 0 THEN TIMESTAMP '2001-08-02' - to_days(CAST(c_custkey % 20 - 5 AS INTEGER)) END AS date_start, CASE WHEN c_custkey % 7 > 0 THEN TIMESTAMP '2001-08-02' + to_days(CAST(c_custkey % 30 - 10 AS INTEGER)) END AS date_end,
  TIMESTAMP '2001-01-01' + to_days(CAST(c_custkey % 100 AS INTEGER)) AS date_add FROM customer"""


def shop_banners(spark, sf):
    """A banner for each customer: keywords by segment, a position, a schedule."""
    key = F.col("c_custkey")
    day = lambda start, days: F.expr(f"timestamp_ntz'{start} 00:00:00' + make_dt_interval(cast({days} as int))")
    return shop.table(spark, sf, "customer").select(
        key.alias("id"), F.col("c_name").alias("name"), F.concat(F.lower("c_mktsegment"), F.lit(", b"), key % 10).alias("keywords"),
        F.element_at(F.array(*map(F.lit, merch.POSITIONS)), (key % 4 + 1).cast("int")).alias("position"), (key % 5 > 0).alias("active"),
        F.when(key % 3 > 0, day("2001-08-02", "5 - c_custkey % 20")).alias("date_start"), F.when(key % 7 > 0, day("2001-08-02", "c_custkey % 30 - 10")).alias("date_end"), day("2001-01-01", "c_custkey % 100").alias("date_add"),
    )


def _banners_sql(word: str, least: int) -> str:
    parts = f"list_filter(list_transform(string_split(keywords, ','), lambda k: trim(k)), lambda k: length(k) >= {least})"
    return f"SELECT * FROM ({_BANNERS}) WHERE active AND {_OPEN} AND len(list_filter({parts}, lambda k: contains(k, '{word}') OR contains('{word}', k))) > 0"


@query("banners_for_query", with_views(f"SELECT id, position FROM ({_banners_sql('building', 2)})"))
def banners_for_query(spark, sf):
    return merch.banners_for(shop_banners(spark, sf), ["building", "x"], shop.ntz(AS_OF)).select("id", "position")


@query("banner_positions", with_views(f"SELECT id FROM ({_banners_sql('b7', 1)}) WHERE position = 'middle'"))
def banner_positions(spark, sf):
    return merch.banners_for(shop_banners(spark, sf), ["b7"], shop.ntz(AS_OF), 1).where("position = 'middle'").select("id")


@query("boost_validation", with_views(f"""SELECT id_product, problem FROM (SELECT id_product, CASE WHEN boost_value < 0.1 OR boost_value > 100 THEN 'range' WHEN id_product % 3 = 0 THEN 'duplicate' END AS problem FROM ({_RULES})) WHERE problem IS NOT NULL""", "catalog"))
def boost_validation(spark, sf):
    """New rules of one shop against those that it has."""
    rules = shop_rules(spark, sf).withColumn("id_shop", F.lit(1))
    return merch.boost_problems(rules, rules.where("id_product % 3 = 0"))


@query("boost_list", with_views("SELECT b.id, c.name, b.v AS boost_value FROM (VALUES (CAST(1 AS BIGINT), 5, CAST(2.0 AS DOUBLE)), (2, 12, 1.5), (3, 20, 5.0), (4, 33, 3.0), (5, 40, 3.0)) AS b(id, p, v) LEFT JOIN catalog c ON c.id_product = b.p", "catalog"))
def boost_list(spark, sf):
    rows = boosts(spark).join(shop.catalog(spark, sf).select("id_product", "name"), "id_product", "left")
    return rows.orderBy(F.desc("boost_value"), "id").select("id", "name", F.col("boost_value").cast("double").alias("boost_value"))


@query("seed_synonyms", f"SELECT count(*) AS added, count(*) + (SELECT count(*) FROM ({_WORDS})) AS n FROM (VALUES {', '.join(f'({word!r})' for word, _ in merch.SEED_SYNONYMS)}) AS v(word) WHERE word NOT IN ({_WORDS})")
def seed_synonyms(spark, sf):
    """The first synonyms come into a table that has all words of the documents already."""
    old = words_used(spark, sf).select("word", F.lit("").alias("synonyms"))
    out = merch.insert_missing(old, shop.literal(spark, merch.SEED_SYNONYMS, "word string, synonyms string"), ["word"])
    new = F.count(F.when(F.col("synonyms") != "", 1))
    return out.agg(new.alias("added"), F.count("*").alias("n"))


def cache(spark, sf):
    rows = shop.behaviour(spark, sf).where("kind = 'search'").groupBy("query").agg(F.max("ts").alias("created_at"), F.count("*").alias("n"))
    return rows.select(merch.cache_key(F.col("query")).alias("cache_key"), F.to_json(F.struct("n")).alias("result_data"), "created_at")


_CACHE = "SELECT md5(query) AS cache_key, '{\"n\":' || count(*) || '}' AS result_data, max(ts) AS created_at FROM behaviour WHERE kind = 'search' GROUP BY query"


@query("cache_invalidated", with_views(f"SELECT cache_key FROM ({_CACHE}) WHERE NOT starts_with(cache_key, 'a')", "behaviour"))
def cache_invalidated(spark, sf):
    return merch.cache_invalidate(cache(spark, sf), "a").select("cache_key")


@query("cache_put", with_views(f"SELECT cache_key, CASE WHEN ascii(cache_key) % 2 = 0 THEN 'new' ELSE result_data END AS result_data FROM ({_CACHE})", "behaviour"))
def cache_put(spark, sf):
    """Later answers with results replace those of their key; empty ones are not kept."""
    held = cache(spark, sf)
    n = F.when(F.ascii("cache_key") % 2 == 0, 3).otherwise(0)
    later = held.select("cache_key", F.lit("new").alias("result_data"), "created_at", n.alias("n_results"))
    return merch.cache_put(held, later).select("cache_key", "result_data")


@query("cache_lookup", with_views(f"SELECT * FROM ({_CACHE}) WHERE cache_key IN (md5('q5'), md5('q50')) AND created_at >= TIMESTAMP '2024-01-31' - INTERVAL 1000000 SECONDS", "behaviour"))
def cache_lookup(spark, sf):
    keys = shop.literal(spark, [(" Q5 ",), ("q50",), ("none",)], "query string").select(merch.cache_key(F.col("query")).alias("cache_key"))
    return merch.cache_get(cache(spark, sf), keys, shop.ntz(shop.EVENTS_AS_OF), 1_000_000)


@query("cache_expiry", with_views(f"SELECT count(*) AS n FROM ({_CACHE}) WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 172800 SECONDS", "behaviour"))
def cache_expiry(spark, sf):
    return merch.cache_expire(cache(spark, sf), shop.ntz(shop.EVENTS_AS_OF), 172_800).agg(F.count("*").alias("n"))


@query("cache_stats", with_views(f"SELECT count(*) AS n, CAST(sum(strlen(result_data)) AS BIGINT) AS n_bytes, min(created_at) AS oldest, max(created_at) AS newest FROM ({_CACHE})", "behaviour"))
def cache_stats(spark, sf):
    return merch.cache_stats(cache(spark, sf))


@query("json_response", with_views("SELECT '{\"id_product\":' || id_product || ',\"name\":\"' || name || '\",\"sold\":' || coalesce(CAST(sold AS VARCHAR), 'null') || '}' AS body FROM catalog LEFT JOIN sales USING (id_product)", "catalog", "sales"))
def json_response(spark, sf):
    return merch.response(sold_catalog(spark, sf).select("id_product", "name", "sold"))


# bundles and envelopes
@query("facet_bundle", with_views("""SELECT 'brand' AS facet, brand AS key, count(DISTINCT id_product) AS n FROM catalog GROUP BY 2
  UNION ALL SELECT 'category', CAST(id_category AS VARCHAR), count(DISTINCT id_product) FROM links WHERE id_category > 2 GROUP BY 2
  UNION ALL SELECT 'price', 'min', CAST(floor(min(price)) AS BIGINT) FROM catalog UNION ALL SELECT 'price', 'max', CAST(trunc(ceil(max(price)) * (1 + CAST(22.0 AS DOUBLE) / 100)) AS BIGINT) FROM catalog""", "catalog", "links"))  # fmt: skip
def facet_bundle(spark, sf):
    return envelope.facet_bundle(shop.catalog(spark, sf), shop.category_links(spark, sf))


@query("query_facet_bundle", with_views("""SELECT * FROM (SELECT 'brand' AS facet, brand AS key, count(*) AS n FROM catalog WHERE contains(lower(name), 'bolt') GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
  UNION ALL SELECT 'category', category, count(*) FROM catalog WHERE contains(lower(name), 'bolt') GROUP BY 2
  UNION ALL SELECT 'attribute', group_name || ':' || value, count(DISTINCT id_product) FROM attrs WHERE id_product IN (SELECT id_product FROM catalog WHERE contains(lower(name), 'bolt')) GROUP BY 2""", "catalog", "attrs"))  # fmt: skip
def query_facet_bundle(spark, sf):
    return envelope.query_facet_bundle(shop.catalog(spark, sf), shop.attributes(spark, sf), ["bolt"])


@query("nested_attribute_facet", with_views("SELECT id_group, group_name, CAST(count(*) AS INTEGER) AS n_values, CAST(max(n) AS BIGINT) AS most FROM (SELECT id_group, group_name, value, count(DISTINCT id_product) AS n FROM attrs GROUP BY 1, 2, 3) GROUP BY 1, 2", "attrs"))
def nested_attribute_facet(spark, sf):
    counts = shop.attributes(spark, sf).groupBy("id_group", "group_name", "value").agg(F.countDistinct("id_product").alias("n_products"))
    nested = facets.nested_attribute_facet(counts)
    return nested.select("id_group", "group_name", F.size("values").alias("n_values"), F.col("values")[0]["n_products"].alias("most"))


@query("bestsellers_with_invalid_orders", with_views("SELECT l.id_product, CAST(sum(quantity) AS BIGINT) AS sold FROM lines l LEFT JOIN orders o ON o_orderkey = id_order AND o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING sum(quantity) > 0 ORDER BY 2 DESC, 1 LIMIT 20", "lines"))
def bestsellers_with_invalid_orders(spark, sf):
    """The compatible variant of the badge: the validity test stands in the outer join, so the
    lines of invalid orders count as well."""
    heads = shop.order_heads(spark, sf).where("valid").select("id_order", "valid")
    sold = shop.order_lines(spark, sf).join(heads, "id_order", "left").groupBy("id_product").agg(F.sum("quantity").alias("sold"))
    return sold.where("sold > 0").orderBy(F.desc("sold"), "id_product").limit(20)


@query("no_results_page", with_views("SELECT id_product, name FROM catalog JOIN sales USING (id_product) WHERE sold > 0 ORDER BY sold DESC, name, id_product LIMIT 8", "catalog", "sales"))
def no_results_page(spark, sf):
    return facets.bestsellers_or_recent(shop.catalog(spark, sf), shop.sales(spark, sf), 8)


@query("pages_accumulated", with_views(f"SELECT id_product, CAST(row_number() OVER (ORDER BY relevance DESC, name, id_product) AS INTEGER) AS rank FROM ({_candidates_sql('cold widget')}) QUALIFY rank <= 72", "catalog", "sales"))
def pages_accumulated(spark, sf):
    found = search.final_order(_scored(spark, sf, "cold widget").withColumn("boost", F.lit(1.0)))
    return search.accumulated(found, 3, 24).select("id_product", "rank")


@query("recommendation_cards", with_views("SELECT id_product, name, brand, CAST(round(CAST(price_incl AS DECIMAL(20, 6)), 2) AS DOUBLE) AS price_shown, stock > 0 AS in_stock FROM catalog WHERE id_product <> 10 AND id_category = (SELECT id_category FROM catalog WHERE id_product = 10) ORDER BY md5(CAST(id_product AS VARCHAR)), id_product LIMIT 8", "catalog"))
def recommendation_cards(spark, sf):
    cat = shop.catalog(spark, sf)
    return envelope.recommendations(baskets.same_category(cat, 10), cat)


@query("banner_list", f"SELECT id, position, CAST(row_number() OVER (ORDER BY CASE position WHEN 'top' THEN 1 WHEN 'middle' THEN 2 WHEN 'bottom' THEN 3 ELSE 4 END, id) AS INTEGER) AS place FROM ({_BANNERS})")
def banner_list(spark, sf):
    """An admin's list: every banner, by position, then id."""
    return merch.banner_list(shop_banners(spark, sf))


@query("search_envelope", with_views(f"""SELECT CAST(to_json({{
  'products': (SELECT list({{'rank': rank, 'id_product': id_product, 'name': name, 'relevance': relevance, 'has_more': n > 24}} ORDER BY rank) FROM
    (SELECT *, count(*) OVER () AS n FROM (SELECT *, CAST(row_number() OVER (ORDER BY relevance DESC, name, id_product) AS INTEGER) AS rank FROM ({_candidates_sql('cold widget')}) QUALIFY rank <= 200)) WHERE rank <= 24),
  'categories': (SELECT list({{'id_category': id_category, 'category': category}} ORDER BY id_category) FROM (SELECT DISTINCT id_category, category FROM catalog WHERE contains(lower(category), 'm') ORDER BY category LIMIT 5)),
  'banners': [{{'place': 1, 'id': 1, 'name': 'always'}}, {{'place': 1, 'id': 5, 'name': 'later'}}, {{'place': 2, 'id': 2, 'name': 'cold'}}],
  'did_you_mean': (SELECT list({{'query': q, 'step': q}} ORDER BY q) FROM (SELECT DISTINCT lower(array_to_string(string_split(name, ' ')[1:3], ' ')) AS q FROM catalog WHERE (contains(lower(name), 'cold') OR contains(lower(name), 'widget')) AND q <> 'cold widget' AND length(q) >= 4 ORDER BY 1 LIMIT 2))
  }}) AS VARCHAR) AS body""", "catalog", "sales"))
def search_envelope(spark, sf):
    cat = shop.catalog(spark, sf)
    ranked = search.final_order(_scored(spark, sf, "cold widget").withColumn("boost", F.lit(1.0)))
    page = search.page(ranked, 0, 24).select("rank", "id_product", "name", "relevance", "has_more")
    categories = search.category_search(cat.select("id_category", "category").distinct(), "m")
    shown = merch.banners_for(banners(spark), ["cold", "widget"], shop.ntz(AS_OF)).select("place", "id", "name")
    words = suggest.did_you_mean_product(cat, "cold widget").withColumn("step", F.col("query"))
    return envelope.search_envelope(page, categories, shown, words)
