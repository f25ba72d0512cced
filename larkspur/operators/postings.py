"""Inverted index over the texts of a table: key -> rows, so that retrieval is an equi-join.

Keys are letters, pairs and triples of neighbouring letters (for terms that a text holds), ordered
pairs of letters (for words whose letters a text has in order, with others between) and sounds. A
query names, for each way to match, keys that such a row has; it is looked up by the rarest of them
and what comes back is verified, so keys decide the work and never the result. Posting lists are
dealt to SALT places, so one as long as the table is no single task.

A few stated queries need no index: they become one array, and the table is scanned once, with no
shuffle and no row made for a pair that doesn't match."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import consonants, resembles

#: Places of a posting list.
SALT = 16


def _none() -> F.Column:
    return F.array().cast("array<string>")


def _stretches(text: F.Column, size: str) -> F.Column:
    """The stretch of so many letters that begins at each letter of a text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def text_keys(text: F.Column) -> F.Column:
    """The keys under which a text is found by terms: its letters, neighbouring pairs and triples."""
    text = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.concat(_stretches(text, "3"), _stretches(text, "2"), _stretches(text, "1")))


def term_keys(term: F.Column) -> F.Column:
    """Keys of every text that holds the term: its triples, or a shorter term itself."""
    return F.when(F.length(term) >= 3, F.array_distinct(_stretches(term, "3"))).when(F.length(term) > 0, F.array(term)).otherwise(_none())


def letters_of(text: F.Column) -> F.Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


def _with_ordered(df: DataFrame, text: str, to: str) -> DataFrame:
    chars, marks = f"{to}_chars", f"{to}_marks"
    df = df.withColumn(chars, letters_of(F.col(text)))
    first = lambda a: F.array_position(F.col(chars), a)
    last = lambda a: F.size(chars) + 1 - F.array_position(F.reverse(F.col(chars)), a)
    own = F.filter(F.array_distinct(chars), lambda a: a != " ")
    df = df.withColumn(marks, F.transform(own, lambda a: F.struct(a.alias("a"), first(a).alias("first"), last(a).alias("last"))))
    after = lambda m: F.transform(F.filter(marks, lambda o: o["last"] > m["first"]), lambda o: F.concat(F.lit(">"), m["a"], o["a"]))
    return df.withColumn(to, F.flatten(F.transform(marks, after))).drop(chars, marks)


def with_ordered_keys(df: DataFrame, texts: list[str], to: str) -> DataFrame:
    """Adds the ordered pairs of letters of some text columns: (a, b) where the first a stands before
    the last b of one text. Blanks don't count."""
    names = [f"{to}{k}" for k in range(len(texts))]
    for text, name in zip(texts, names, strict=True):
        df = _with_ordered(df, text, name)
    return df.withColumn(to, F.array_distinct(F.concat(*names))).drop(*names)


def ordered_keys(letters: F.Column) -> F.Column:
    """Keys of every text that has these letters in order."""
    later = F.transform(letters, lambda a, i: F.transform(F.slice(letters, i + 2, F.size(letters)), lambda b: F.concat(F.lit(">"), a, b)))
    return F.array_distinct(F.flatten(later))


def sound_key(sound: F.Column) -> F.Column:
    """The key of a sound; null stays null."""
    return F.concat(F.lit("~"), sound)


@dataclass
class Index:
    """postings (key, id) and counts (key, n), made within a plan or read from a folder."""

    postings: DataFrame
    counts: DataFrame
    id_col: str = "id_product"

    @staticmethod
    def build(keyed: DataFrame, id_col: str = "id_product") -> Index:
        """From a row for each id with its __keys."""
        # an outer generator: no filter is inferred from it, which would work the keys out again
        postings = keyed.select(id_col, "__keys").select(id_col, F.explode_outer("__keys").alias("key")).where("key is not null")
        return Index(postings, postings.groupBy("key").agg(F.count("*").alias("n")), id_col)

    def write(self, folder: str) -> Index:
        """Stored in the order of the keys, so that a look-up reads only the parts that may hold its keys."""
        for name, df in (("postings", self.postings), ("counts", self.counts)):
            df.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{folder}/{name}")
        return Index.read(self.postings.sparkSession, folder, self.id_col)

    @staticmethod
    def read(spark: SparkSession, folder: str, id_col: str = "id_product") -> Index:
        return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/counts"), id_col)


def look_up(index: Index, probes: DataFrame, few: bool = False) -> DataFrame:
    """Distinct (query_id, id) for ``probes`` (query_id, needs): rows that have the rarest key of some
    entry of needs, an array of arrays of keys. An entry with a key that no row has finds nothing. The
    planner takes an exploded table for no larger than what it came from, so the sides are named here: a
    few probes are broadcast, else both sides are shuffled; the posting lists never go through the driver."""
    each = probes.select("query_id", F.posexplode("needs").alias("probe", "keys")).select("query_id", "probe", F.explode("keys").alias("key"))
    counted = each.join(index.counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("query_id", "probe").agg(F.min(F.struct("n", "key")).alias("least")).where("least.n > 0")
    chosen = rarest.select("query_id", F.col("least.key").alias("key")).distinct()
    dealt = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    lists = index.postings.withColumn("salt", F.pmod(F.xxhash64(index.id_col), F.lit(SALT)).cast("int"))
    dealt = F.broadcast(dealt) if few else dealt.hint("merge")
    return lists.join(dealt, ["key", "salt"]).select("query_id", index.id_col).distinct()


Test = Callable[[F.Column], F.Column]


def scan(table: DataFrame, asked: DataFrame, test: Test) -> DataFrame:
    """Rows of ``table`` with each of a few ``asked`` rows that passes the test, a formula of a struct of
    its columns: one pass, with the queries as an array that is worked out once."""
    array = asked.agg(F.collect_list(F.struct(*asked.columns))).scalar()
    # an outer generator: no filter is inferred from it, which would test all rows again
    met = table.withColumn("__asked", array).withColumn("__asked", F.explode_outer(F.filter("__asked", test)))
    return met.where("__asked is not null").select(*table.columns, "__asked.*")


def matching(table: DataFrame, asked: DataFrame, test: Test, needs: F.Column, keyed: Callable[[DataFrame], DataFrame], few: bool, index: Index | None = None, id_col: str = "id_product") -> DataFrame:
    """Rows of ``table`` with each row of ``asked`` (of one query_id each) that passes the test: by a scan
    for few, else by the index (made from ``keyed``, which adds __keys, where none is given). ``needs``:
    the keys of each way to match."""
    if few and index is None:
        return scan(table, asked, test)
    index = index or Index.build(keyed(table), id_col)
    sized = lambda df: df if few else df.hint("merge")
    met = table.join(sized(look_up(index, asked.select("query_id", needs.alias("needs")), few)), index.id_col)
    met = met.join(sized(asked.select("query_id", F.struct(*asked.columns).alias("__asked"))), "query_id").where(test(F.col("__asked")))
    return met.select(*table.columns, "__asked.*")


# Misspellings: keys by which two words meet if they may be close.

#: Up to this length a word's neighbourhood is spelt out; longer ones meet by blocks.
SPELT = 20


def _without_one(word: F.Column) -> F.Column:
    cut = lambda i: F.concat(F.left(word, i - 1), F.substring(word, i + 1, F.length(word)))
    return F.when(F.length(word) > 0, F.transform(F.sequence(F.lit(1), F.length(word)), cut)).otherwise(_none())


def with_deletions(df: DataFrame, word: str, most: F.Column, to: str) -> DataFrame:
    """Adds what is left of a word without up to ``most`` (0 to 3) of its letters, for words up to SPELT
    letters: two words within an edit distance d share such a rest of at most d deletions each.

    Longer words meet by blocks: cut into four, one block at least stands unchanged in a word within
    distance 3, whose length differs by 3 at most; keys are the word's own four blocks and all
    stretches of the lengths that the other's blocks may have."""
    levels = [f"{to}_{k}" for k in range(4)]
    spelt = F.length(word) <= SPELT + 3
    df = df.withColumn(levels[0], F.when(spelt, F.array(word)).otherwise(_none()))
    for k in (1, 2, 3):
        more = F.flatten(F.transform(levels[k - 1], _without_one))
        df = df.withColumn(levels[k], F.when(most >= k, F.array_distinct(more)).otherwise(_none()))
    size = F.length(word)
    lengths = F.array_distinct(F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda d: F.floor((size + d) / 4).cast("int")))
    stretches = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.concat(F.lit("#"), F.substring(F.col(word), i, n)))))
    blocks = F.when(size > SPELT - 3, F.array_distinct(stretches)).otherwise(_none())
    return df.withColumn(to, F.concat(F.array_distinct(F.concat(*levels)), blocks)).drop(*levels)


def within(left: DataFrame, right: DataFrame, keys: str = "__keys") -> DataFrame:
    """Distinct pairs of rows of two tables that share a key; the ``keys`` columns go. Both sides are shuffled
    (see ``look_up``)."""
    one = left.select("*", F.explode_outer(keys).alias("__key")).drop(keys)
    two = right.select("*", F.explode_outer(keys).alias("__key")).drop(keys)
    return one.join(two.hint("merge"), "__key").drop("__key").distinct()


def misspelt(words: DataFrame, names: DataFrame, phonetic: bool = True, few: bool = False) -> DataFrame:
    """Rows of ``words`` (query_id, word) with each name (``names``: distinct, lower case) that ``resembles``
    the word. A few words are held against each name in one scan; many meet the names by a rest
    after deletions, by consonants, by sound, by their first or last three letters, or since one holds
    the other."""
    if few:
        return scan(names, words, lambda q: resembles(q["word"], F.col("name"), phonetic))
    tagged = lambda tag, key: F.concat(F.lit(tag), key)
    only = lambda test, key: F.when(test, F.array(key)).otherwise(_none())
    triples = lambda text, tag: F.transform(_stretches(text, "3"), lambda g: tagged(tag, g))

    def keyed(df: DataFrame, column: str, most: F.Column, first: str, every: str) -> DataFrame:
        text, size = F.col(column), F.length(column)
        skeleton = consonants(text)
        keys = [only(F.length(skeleton) >= 4, tagged("c ", skeleton)), only(size >= 4, tagged("p ", F.left(text, F.lit(3)))), only(size >= 4, tagged("e ", F.right(text, F.lit(3))))]
        keys += [only(F.lit(phonetic), tagged("~", F.soundex(text))), only(size >= 5, tagged(first, F.left(text, F.lit(3)))), F.when(size >= 5, triples(text, every)).otherwise(_none())]
        df = with_deletions(df, column, most, "__rests")
        return df.withColumn("__keys", F.array_distinct(F.concat("__rests", *keys))).drop("__rests")

    size = F.length("word")
    asked = keyed(words, "word", F.when(size >= 8, 3).when(size >= 5, 2).otherwise(1), "i ", "o ")
    size = F.length("name")
    known = keyed(names, "name", F.when(size >= 5, 3).when(size >= 3, 2).otherwise(1), "o ", "i ")
    return within(asked, known).where(resembles(F.col("word"), F.col("name"), phonetic))
