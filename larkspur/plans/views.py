"""SQL (DuckDB) views for the oracles: the shop frames written a second time, independently."""

from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {
    "products": (
        [],
        """SELECT p_partkey AS id_product, p_name AS name, p_brand AS brand, CAST(substr(p_brand, 7) AS BIGINT) AS id_brand, p_type AS category,
  CAST(CASE p_type WHEN 'ECONOMY' THEN 3 WHEN 'LARGE' THEN 4 WHEN 'MEDIUM' THEN 5 WHEN 'PROMO' THEN 6 WHEN 'SMALL' THEN 7 WHEN 'STANDARD' THEN 8 END AS BIGINT) AS id_category,
  'REF-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS reference, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS ean13, '7' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS upc,
  lower(p_type) AS short_desc, lower(p_type) || ' size ' || p_size || ' ' || p_name AS description, CAST(p_size AS BIGINT) AS size,
  CASE WHEN p_partkey % 50 = 0 THEN 'seasonal,gift' WHEN p_partkey % 75 = 0 THEN 'outlet' ELSE '' END AS tags,
  p_retailprice AS price, p_retailprice * CAST(1.22 AS DOUBLE) AS price_incl, p_retailprice * CAST(1.22 AS DOUBLE) * CASE WHEN p_partkey % 4 = 0 THEN CAST(1.25 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS price_old_incl,
  p_partkey % 7 AS stock, CASE WHEN p_partkey % 11 = 0 THEN 'catalog' WHEN p_partkey % 11 = 1 THEN 'search' ELSE 'both' END AS visibility, p_partkey % 97 <> 0 AS active,
  TIMESTAMP '2001-08-02 00:00:00' - to_days(CAST(p_partkey % 60 AS INTEGER)) AS date_add FROM part""",
    ),
    "catalog": (["products"], "SELECT * FROM products WHERE active"),
    "images": ([], "SELECT p_partkey AS id_product, p_partkey * 10 + k AS id_image, k = 2 AS cover FROM part, unnest([1, 2, 3]) AS u(k) WHERE p_partkey % 3 > 0"),
    "stock": ([], "SELECT p_partkey AS id_product, k AS id_shop, CASE WHEN k = 1 THEN p_partkey % 7 - 2 ELSE p_partkey % 5 - 3 END AS quantity FROM part, unnest([1, 2]) AS u(k)"),
    "links": (
        ["catalog"],
        "SELECT id_product, id_category FROM catalog UNION ALL SELECT id_product, (id_category - 2) % 6 + 3 FROM catalog WHERE id_product % 3 = 0",
    ),
    "lines": ([], "SELECT l_orderkey AS id_order, l_partkey AS id_product, (CAST(trunc(l_quantity) AS BIGINT) % 5) * (l_partkey % 5) AS quantity FROM lineitem"),
    "sales": (
        ["lines"],
        "SELECT id_product, CAST(sum(quantity) AS BIGINT) AS sold FROM lines JOIN orders ON o_orderkey = id_order WHERE o_orderstatus IN ('F', 'O') GROUP BY id_product",
    ),
    "attrs": (
        ["catalog"],
        "SELECT id_product, CAST(1 AS BIGINT) AS id_group, 'size' AS group_name, CAST(size AS VARCHAR) AS value FROM catalog"
        " UNION ALL SELECT id_product, 2, 'tone', split_part(name, ' ', 1) FROM catalog",
    ),
    "behaviour": (
        [],
        """SELECT event_id, CASE event_type WHEN 'view' THEN 'search' WHEN 'error' THEN 'no_results' WHEN 'click' THEN 'click' ELSE 'conversion' END AS kind,
  'q' || json_extract_string(props, '$.k') AS query, 'ss_' || user_id AS session_id, user_id % 3 + 1 AS id_shop, user_id % 2 + 1 AS id_lang,
  CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) % 50 ELSE 0 END AS results_count, event_id % 200 AS id_product, event_id % 24 AS position,
  CAST(value AS DECIMAL(10, 2)) AS amount, ts FROM events WHERE event_type IN ('view', 'error', 'click', 'purchase')""",
    ),
    "stats": (
        ["behaviour"],
        """SELECT query, id_shop, count(*) AS search_count, arg_max(results_count, (ts, event_id)) AS results_count, max(ts) AS last_search, min(ts) AS date_add
  FROM behaviour WHERE kind IN ('search', 'no_results') GROUP BY query, id_shop""",
    ),
    "totals": (["stats"], "SELECT query, CAST(sum(search_count) AS BIGINT) AS n, max(results_count) AS results FROM stats GROUP BY query"),
    "clicks": (["behaviour"], "SELECT * FROM behaviour WHERE kind = 'click'"),
    "conv": (["behaviour"], "SELECT *, event_id AS id_order FROM behaviour WHERE kind = 'conversion'"),
    "reviews": ([], "SELECT event_id % 200 AS id_product, event_id % 5 + 1 AS grade, event_id % 4 <> 0 AS validated FROM events WHERE event_type = 'view'"),
    "pairs": (
        [],
        """SELECT a.l_partkey AS a, b.l_partkey AS b, count(DISTINCT a.l_orderkey) AS n_orders FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
  JOIN orders ON o_orderkey = a.l_orderkey WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 3650 DAYS
  GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) >= 2 ORDER BY n_orders DESC, a, b LIMIT 10000""",
    ),
    "edges": (
        ["pairs"],
        """SELECT s AS id_source, t AS id_target, CAST(round(CAST(n_orders AS DECIMAL(20, 10)) / (SELECT max(n_orders) FROM pairs), 4) AS DECIMAL(5, 4)) AS score, n_orders
  FROM (SELECT a AS s, b AS t, n_orders FROM pairs UNION ALL SELECT b, a, n_orders FROM pairs)""",
    ),
}


def with_views(body: str, *names: str) -> str:
    """``body`` after the views it names and those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    heads = [f"{name} AS ({VIEWS[name][1]})" for name in order]
    return "WITH " + ",\n".join(heads) + "\n" + body if heads else body


def any_sql(text: str, forms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{f}')" for f in forms) + ")" if forms else "false"


def soundex_sql(text: str) -> str:
    """Soundex: H and W are passed over, vowels and other characters separate equal digits."""
    first = f"upper(substr({text}, 1, 1))"
    digits = f"translate({first}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202') || translate(regexp_replace(upper(substr({text}, 2)), '[^A-Z]', 'A', 'g'), 'ABCDEFGIJKLMNOPQRSTUVXYZHW', '012301202245501262301202')"
    for d in "123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN regexp_matches({first}, '^[A-Z]') THEN {first} || rpad(substr(replace(substr({digits}, 2), '0', ''), 1, 3), 3, '0') ELSE {text} END"


def score_sql(query: str, words: list[str], full: bool = True, spellings: list[list[str]] | None = None) -> str:
    """The tiered relevance of the columns of ``catalog`` (and sold) for a lower-case query. Name, brand
    and reference count the ``spellings`` of each word (by default the word), the texts the word."""
    forms = spellings or [[w] for w in words]
    plain = lambda text: " + ".join(f"CAST(contains({text}, '{w}') AS INTEGER)" for w in words)
    found = lambda text: " + ".join(f"CAST({any_sql(text, f)} AS INTEGER)" for f in forms)
    nm, br, rf, sh, ds = (f"lower({c})" for c in ("name", "brand", "reference", "short_desc", "description"))
    n = len(words)
    prefix = f"CASE WHEN starts_with({nm}, '{query}') THEN 100 ELSE 0 END"
    hits, brand_hits, ref_hits = f"({found(nm)})", f"({found(br)})", f"({found(rf)})"
    low = "0.3" if n > 1 else "1.0"
    base = f"""CASE WHEN {hits} = {n} THEN 1000 + CASE WHEN contains({nm}, '{query}') THEN 300 + {prefix} ELSE 0 END + 10 * {brand_hits} + 10 * {ref_hits}
    WHEN contains({nm}, '{query}') THEN 800 + {prefix} WHEN contains({br}, '{query}') THEN 700 WHEN contains({rf}, '{query}') THEN 750
    ELSE (40 * {hits} + 30 * {brand_hits} + 35 * {ref_hits} + CASE WHEN {hits} >= 0.75 * {n} THEN 100 WHEN {hits} >= 0.5 * {n} THEN 50 ELSE 0 END + 5 * ({plain(sh)}))
      * CASE WHEN {hits} < 0.5 * {n} THEN CAST({low} AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END END"""
    if full:
        base = f"""({base}) + 3 * ({plain(ds)}) + CASE WHEN coalesce(sold, 0) > 100 THEN 20 WHEN coalesce(sold, 0) > 50 THEN 15 WHEN coalesce(sold, 0) > 10 THEN 10 WHEN coalesce(sold, 0) > 0 THEN 5 ELSE 0 END
    + CASE WHEN id_product % 60 <= 7 THEN 15 WHEN id_product % 60 <= 30 THEN 10 ELSE 0 END"""
    return f"CAST(CASE WHEN stock <= 0 THEN round(CAST(({base}) * CAST(0.7 AS DOUBLE) AS DECIMAL(20, 6)), 0) ELSE ({base}) END AS DOUBLE)"
