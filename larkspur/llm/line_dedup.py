"""Line dedup by a log-template tree, in DataFrame operations only.

The tree has a fixed depth: the number of tokens, then the leading tokens. Tokens with a digit
are variable from the start (``<*>``). In the leaves that enough documents reach, the other
fields are generalised by vote: a token that fewer than ``min_docs`` documents have at its place
is variable too, unless the line then keeps less than ``least_constant`` of its tokens, in which
case it stays as it is, digits included: rows of a table recur only where their numbers do. Lines with the same result share a template. A template in at least
``min_docs`` documents recurs: its lines are dropped from every document but the first
(smallest doc_id), so nothing is lost that the corpus holds only in copies.

Texts are parsed once and never moved: from then on lines and tokens are 64-bit hashes. Each
document counts a line once, before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, free_name, join_counted, row_key, stored, table

MIN_DOCS = 5
MIN_TOKENS = 3
LEADING = 3
LEAST_CONSTANT = 0.6
ANY = "<*>"


def _lines(text: F.Column) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _masked(raw: F.Column) -> F.Column:
    return F.split(F.trim(F.when(raw.rlike("[0-9]"), F.regexp_replace(raw, r"\S*[0-9]\S*", ANY)).otherwise(raw)), r"\s+")


def _parsed(docs: DataFrame, min_tokens: int) -> DataFrame:
    """(row, doc_id, at, leaf, line, own, tokens) of every line of enough tokens, all hashes: line of
    the tokens, own of the tokens before digits were masked (null without digits)."""
    # The key first: beside the generator it would be taken, and the text carried, for every line. All of
    # a line in one pass: a filter on tokens made below it would have them made twice.
    own = lambda raw: F.when(raw.rlike("[0-9]"), F.xxhash64(F.split(F.trim(raw), r"\s+")))
    cut = docs.select(row_key().alias("row"), "doc_id", F.transform(_lines(F.col("text")), lambda raw: F.struct(_masked(raw).alias("tokens"), own(raw).alias("own"))).alias("lines"))
    lines = cut.select("row", "doc_id", F.posexplode_outer("lines").alias("at", "x")).select("row", "doc_id", "at", "x.tokens", "x.own").where(F.size("tokens") >= min_tokens)
    leaf = F.xxhash64(F.size("tokens"), *(F.get("tokens", F.lit(i)) for i in range(LEADING)))
    hashed = F.transform("tokens", lambda t: F.xxhash64(t))
    return lines.select("row", "doc_id", "at", leaf.alias("leaf"), F.xxhash64("tokens").alias("line"), "own", hashed.alias("tokens"))


def _tree(docs: DataFrame, min_docs: int, least_constant: float, min_tokens: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences, recurring, known). Occurrences: row, doc_id, at, template of every line in a
    leaf that recurs. Recurring: template, n_docs, first_doc, n_rows, masked. Known: for each
    line of these leaves masked (hash of its pattern), constant (which tokens are) and a place of it."""
    parsed = stored(_parsed(docs, min_tokens))  # as Parquet: smaller than a checkpoint
    reached = parsed.select("row", "leaf").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    leaves = broadcast_if_small(checkpoint(reached.select("leaf")))
    within = parsed.join(leaves, "leaf", "left_semi")
    once = within.groupBy("row", "leaf", "line").agg(F.count("*").alias("k"), F.min("at").alias("at"))
    counted = once.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.sum("k").alias("n_rows"), F.min(F.struct("row", "at")).alias("place"))
    one = within.groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"))  # equal in all rows of a line
    lines = checkpoint(counted.join(one, ["leaf", "line"]))
    fields = lines.select("leaf", "line", "n", F.posexplode("tokens").alias("place", "token"))
    votes = fields.groupBy("leaf", "place", "token").agg(F.sum("n").alias("votes"))
    anything = F.xxhash64(F.lit(ANY))
    constant = (F.col("votes") >= min_docs) & (F.col("token") != anything)
    voted = fields.join(votes, ["leaf", "place", "token"]).groupBy("leaf", "line").agg(
        F.sort_array(F.collect_list(F.struct("place", constant.alias("constant"), F.col("token").alias("own")))).alias("f"),
        F.avg(constant.cast("int")).alias("share"),
    )
    voted_tokens = F.transform("f", lambda x: F.when(x["constant"], x["own"]).otherwise(anything))
    kept = F.when(F.col("share") >= least_constant, voted_tokens).otherwise(F.col("f.own"))
    # a line that keeps too little is a template of its own tokens, not of the masked ones
    literal = (F.col("share") < least_constant) & F.exists("f", lambda x: x["own"] == anything)
    shown = F.when(F.col("share") >= least_constant, F.col("f.constant"))
    known = lines.join(voted, ["leaf", "line"]).select(
        F.xxhash64("leaf", "line").alias("key"), "n_rows", "place", F.xxhash64(kept).alias("masked"), literal.alias("literal"), shown.alias("constant")
    )
    known = checkpoint(known)
    seen = within.select("row", "doc_id", "at", F.xxhash64("leaf", "line").alias("key"), "own")
    template = F.when(F.col("literal"), F.xxhash64("masked", "own")).otherwise(F.col("masked"))
    joined = join_counted(seen, known.select("key", "n_rows", "masked", "literal"), "key", "n_rows")
    occurrences = stored(joined.select("row", "doc_id", "at", template.alias("template"), "masked"))
    docs_of = occurrences.groupBy("template", "row").agg(F.min("doc_id").alias("doc_id"), F.min("masked").alias("masked"), F.count("*").alias("n"))
    by_template = docs_of.groupBy("template").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.min("masked").alias("masked"), F.sum("n").alias("n_rows"))
    return occurrences.drop("masked"), checkpoint(by_template.where(F.col("n_docs") >= min_docs)), known


def templates(docs: DataFrame, min_docs: int = MIN_DOCS, least_constant: float = LEAST_CONSTANT, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The templates in ``min_docs`` documents or more: template, tokens (``<*>`` for variable ones),
    n_docs, first_doc, n_rows. The tokens are read from one line of each."""
    _, recurring, known = _tree(docs, min_docs, least_constant, min_tokens)
    one = known.groupBy("masked").agg(F.min(F.struct("place", "constant")).alias("one")).select("masked", "one.place.row", "one.place.at", "one.constant")
    wanted = checkpoint(recurring.join(one, "masked"))
    lines = docs.select(row_key().alias("row"), "text").dropDuplicates(["row"]).join(broadcast_if_small(wanted, 100_000), "row")
    lines = lines.select("template", "n_docs", "first_doc", "n_rows", "constant", _masked(F.get(_lines(F.col("text")), F.col("at"))).alias("own"))
    tokens = F.when(F.col("constant").isNull(), F.col("own")).otherwise(F.zip_with("own", "constant", lambda t, c: F.when(c, t).otherwise(ANY)))
    return lines.select("template", tokens.alias("tokens"), "n_docs", "first_doc", "n_rows")


def _cut(docs: DataFrame, min_docs: int, least_constant: float, min_tokens: int) -> DataFrame:
    """All rows and columns of ``docs``, the text without recurring lines, and behind them the numbers
    of its lines and of those dropped."""
    occurrences, recurring, _ = _tree(docs, min_docs, least_constant, min_tokens)
    hits = join_counted(occurrences, recurring.select("template", "first_doc", "n_rows"), "template", "n_rows")
    gone = hits.where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    places = gone.groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("at"))
    # one byte a line up to the last that goes, so that each line is looked up at once
    marks = F.transform("at", lambda a, k: F.concat(F.repeat(F.lit("0"), a - F.coalesce(F.get("at", k - 1), F.lit(-1)) - 1), F.lit("1")))
    row, mark, n_lines, n_dropped = (free_name(docs, f"__{c}") for c in ("row", "gone", "n_lines", "n_dropped"))
    places = places.select(F.col("row").alias(row), F.encode(F.array_join(marks, ""), "US-ASCII").alias(mark), F.size("at").alias(n_dropped))
    joined = docs.withColumn(row, row_key()).join(places, row, "left")
    rest = F.filter(_lines(F.col("text")), lambda _, i: F.substring(mark, i + 1, F.lit(1)) != F.lit(b"1"))
    text = F.when(F.col("text").isNull() | F.col(mark).isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text"))))
    own = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*own, lines.alias(n_lines), F.coalesce(n_dropped, F.lit(0)).alias(n_dropped))


def without_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, least_constant: float = LEAST_CONSTANT, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """As ``drop_recurring_lines``, with just the columns of ``docs``."""
    return _cut(docs, min_docs, least_constant, min_tokens).select(*(f"`{c}`" for c in docs.columns))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, least_constant: float = LEAST_CONSTANT, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Every row of ``docs`` with its text without recurring lines, all its columns, and
    n_lines, n_dropped int.

    A null text stays null (no lines); an empty text is one empty line and stays. Lines of fewer
    than ``min_tokens`` tokens stay (1: all lines are looked at). Texts may have any number of
    lines: the work grows with the lines. Repeated rows count as one document and are treated
    alike; rows that share the smallest doc_id of a template all keep its lines. A null doc_id is
    never the first document unless all ids are null. An empty table gives no rows; columns of the
    added names are replaced."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    cut = _cut(docs.select(*(f"`{c}`" for c in names)), min_docs, least_constant, min_tokens)
    return cut.withColumnsRenamed(dict(zip(cut.columns[-2:], ("n_lines", "n_dropped"), strict=True)))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


_SQL = r"""
WITH cut AS (
  SELECT doc_id, g.k AS pos, string_split(coalesce(text, ''), chr(10))[g.k + 1] AS raw
  FROM documents, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS g(k)
), toks AS (
  SELECT doc_id, pos, string_split_regex(trim(regexp_replace(raw, '\S*[0-9]\S*', '<*>', 'g'), ' '), '\s+') AS tokens,
    CASE WHEN regexp_matches(raw, '[0-9]') THEN string_split_regex(trim(raw, ' '), '\s+') END AS own FROM cut
), parsed AS (
  SELECT doc_id, pos, tokens, own, {'n': len(tokens), 'a': tokens[1], 'b': tokens[2], 'c': tokens[3]} AS leaf FROM toks WHERE len(tokens) >= 3
), leaves AS (
  SELECT leaf FROM parsed GROUP BY leaf HAVING count(DISTINCT doc_id) >= 5
), within AS (
  SELECT p.* FROM parsed p SEMI JOIN leaves l ON p.leaf = l.leaf
), lines AS (
  SELECT leaf, tokens, count(DISTINCT doc_id) AS n FROM within GROUP BY leaf, tokens
), fields AS (
  SELECT leaf, tokens, n, g.place, tokens[g.place] AS token FROM lines, unnest(range(1, len(tokens) + 1)) AS g(place)
), votes AS (
  SELECT leaf, place, token, sum(n) AS votes FROM fields GROUP BY ALL
), voted AS (
  SELECT f.leaf, f.tokens, list(CASE WHEN v.votes >= 5 AND f.token <> '<*>' THEN f.token ELSE '<*>' END ORDER BY f.place) AS pattern,
    avg(CASE WHEN v.votes >= 5 AND f.token <> '<*>' THEN 1.0 ELSE 0.0 END) AS share
  FROM fields f JOIN votes v ON f.leaf = v.leaf AND f.place = v.place AND f.token = v.token GROUP BY f.leaf, f.tokens
), known AS (
  SELECT tokens, CASE WHEN share >= 0.6 THEN pattern ELSE tokens END AS pattern, share < 0.6 AND list_contains(tokens, '<*>') AS literal FROM voted
), occ AS (
  SELECT w.doc_id, w.pos, {'pattern': k.pattern, 'own': CASE WHEN k.literal THEN w.own END} AS template FROM within w JOIN known k ON w.tokens = k.tokens
), recurring AS (
  SELECT template, min(doc_id) AS first_doc FROM occ GROUP BY template HAVING count(DISTINCT doc_id) >= 5
), gone AS (
  SELECT DISTINCT o.doc_id, o.pos FROM occ o JOIN recurring r ON o.template = r.template WHERE o.doc_id <> r.first_doc
)
SELECT c.doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(g.pos) AS INTEGER) AS n_dropped,
  md5(coalesce(string_agg(c.raw, chr(10) ORDER BY c.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_md5
FROM cut c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.pos = g.pos GROUP BY c.doc_id
"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES = {"op4_line_dedup": _SQL}
