from compare import rows_of, rows_of_sql
from texts import empty, odd, odd_rows, with_clashes

from larkspur.llm.line_dedup import ORACLES, drop_recurring_lines, op4_line_dedup, templates, without_recurring_lines


def test_matches_sql(spark, sf, duck):
    assert rows_of(op4_line_dedup(spark, sf)) == rows_of_sql(duck, ORACLES["op4_line_dedup"])


def test_variable_fields(spark):
    rows = [(i, f"own text number {chr(97 + i)} stays here\nprinted by user{i} on page {i}\nsigned by the clerk {'abcdefgh'[i] * 4} of this town") for i in range(7)]
    rows += [(50, "one two three four"), (51, "one two three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text.split("\n") for r in drop_recurring_lines(docs).collect()}
    assert len(kept[0]) == 3  # the first document keeps its lines
    assert all(len(kept[i]) == 0 or kept[i] == [""] or len(kept[i]) == 1 for i in range(1, 7))
    assert kept[50] == kept[51] == ["one two three four"]
    found = {tuple(r.tokens) for r in templates(docs).collect()}
    assert ("printed", "by", "<*>", "on", "page", "<*>") in found


def test_hot_line(spark):
    rows = [(i, f"the very same line everywhere\nunique words {'x' * (i % 50)} {i}q some other {'yz' * (i // 50)}") for i in range(300)]
    kept = drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("text like '%very same line%'").collect()
    assert [r.doc_id for r in kept] == [0]


def test_odd_rows(spark):
    out = drop_recurring_lines(with_clashes(odd(spark)))
    rows = out.collect()
    assert len(rows) == len(odd_rows()) and [r for r in rows if r.doc_id == 1][0].text is None
    assert [r for r in rows if r.doc_id == 2][0].text == "" and [r for r in rows if r.doc_id == 10][0].text == "a\n\n\nb\n"
    assert drop_recurring_lines(empty(spark)).count() == 0


def test_numeric_tables_stay(spark):
    rows = [(i, f"{i} {i * 7} {i * 13}\nTotal: {i + 1} {i + 2} {i + 3}\n1 2 3 4\nprinted by user{i} on page {i} again") for i in range(8)]
    kept = {r.doc_id: r.text.split("\n") for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept[0] == rows[0][1].split("\n")
    assert all(kept[i] == rows[i][1].split("\n")[:2] for i in range(1, 8))


def test_short_lines(spark):
    docs = spark.createDataFrame([(i, f"Menu\nown{chr(97 + i)} words here\nLog in") for i in range(6)], "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in drop_recurring_lines(docs).collect())
    kept = {r.doc_id: r.text for r in drop_recurring_lines(docs, min_tokens=1).collect()}
    assert kept[0].startswith("Menu") and all(kept[i] == f"own{chr(97 + i)} words here" for i in range(1, 6))


def test_clashing_names_and_many_lines(spark):
    from pyspark.sql import functions as F

    many = "\n".join(f"the very same line everywhere\n{'ab' * (k % 7)} {k}" for k in range(100_000))
    docs = spark.createDataFrame([(i, "the very same line everywhere\nfirst") for i in range(5)] + [(9, many)], "doc_id long, text string").withColumn("n_lines", F.lit("mine"))
    kept = {r.doc_id: r for r in without_recurring_lines(docs).collect()}
    assert {r.n_lines for r in kept.values()} == {"mine"} and kept[0].text.startswith("the very")
    assert kept[9].text == "\n".join(x for x in many.split("\n") if x != "the very same line everywhere")
    assert drop_recurring_lines(docs).where("doc_id = 9").first().n_dropped == 100_000
