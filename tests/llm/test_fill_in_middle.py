import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from texts import empty, odd, odd_rows, with_clashes

from larkspur.llm.fill_in_middle import cut, ranked, restored, token_ends, transform

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain(text, key):
    """The rule read off the contract, token by token."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é漢🙂 \t\n\r\v\f\x1c\x85 <PSM>"), max_size=80), st.integers(0, 500))
def test_any_text(text, key):
    assert cut(text, str(key), 42, 50, 80, ("<P>", "<S>", "<M>")) == plain(text, key)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**300 - 1))
def test_ranks(bits):
    at = [k + 1 for k, b in enumerate(f"{bits:0300b}") if b == "1"]
    assert ranked(bits, 300, list(range(1, len(at) + 1))) == at


def test_ends():
    assert f"{token_ends(b'ab  c d ')!s}" == str(0b01001011) and token_ends(b"") == 0 and token_ends(b"   ") == 1


def test_corpus_and_way_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = transform(docs).withColumn("again", restored()).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.text, r.doc_id)
        assert r.again == (r.text or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_markers_and_overlaps(spark):
    texts = ["a <P> b c", "x <S", "S> <M y z", "< P> <", "<<S" * 30, "<P" * 40 + " q"]
    rows = [(k, t) for t in texts for k in range(40)]
    out = transform(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("again", restored()).collect()
    assert all(r.again == r.text for r in out)
    assert {r.form for r in out if "<P>" in r.text} == {"plain"} and {r.form for r in out if "<P>" not in r.text} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    docs = with_clashes(odd(spark)).withColumns({"n": F.lit("clash"), "output": F.lit(1), "__own": F.lit(2)})
    out = transform(docs)
    rows = out.withColumn("again", restored()).collect()
    assert len(rows) == len(odd_rows()) and all(r.again == (r.text or "") and r["__own"] == 2 and r.row == "clash" for r in rows)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.text, "" if r.doc_id is None else r.doc_id)
    assert transform(empty(spark)).collect() == []


def test_very_long_text(spark):
    text = "wörter und\tzeilen\n" * 300_000
    docs = spark.createDataFrame([(k, text) for k in range(3)], "doc_id long, text string")
    rows = transform(docs, rate=100).select("doc_id", "n", F.sha2(restored(), 256).alias("back")).collect()
    assert {r.back for r in rows} == {hashlib.sha256(text.encode()).hexdigest()} and {r.n for r in rows} == {900_001}
