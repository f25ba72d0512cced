import corpus_pipeline
import pytest
from test_decontamination import brute
from texts import empty, odd, with_clashes

from larkspur.llm.bpe import WordBpe, default_vocabulary


@pytest.fixture(scope="module")
def bench_dir(sf):
    return sf


def test_stages_against_plain_versions(spark, sf, duck):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, before = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, sf).collect(), docs.schema)
        assert after.columns == docs.columns
        kept[name] = before, after
        before = after
    # quality: labelled good documents of any fold stay
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    left = {r.doc_id for r in kept["quality"][1].collect()}
    assert len(good & left) >= 0.97 * len(good)
    # line dedup drops lines, no documents
    own, cut = ({r.doc_id: r.text for r in df.collect()} for df in kept["line_dedup"])
    assert own.keys() == cut.keys() and all(set(cut[d].split("\n")) <= {*own[d].split("\n"), ""} for d in own)
    # near dedup: the smallest id of each component of texts whose sets of five words are similar from 0.8 on
    own, cut = ({r.doc_id: r.text for r in df.collect()} for df in kept["near_dedup"])
    sets = {}
    for d, text in own.items():
        words = (text or "").encode().lower().split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    parent = {d: d for d in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in own:
        for b in own:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert cut.keys() == {find(d) for d in own} and len(cut) < len(own)
    # decontamination
    own, cut = ({r.doc_id: r.text for r in df.collect()} for df in kept["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    some = sorted(own)[:60]
    bad = {d for d, _ in brute([(d, own[d][:4000]) for d in some if len(own[d]) <= 4000], items)}
    assert bad == {d for d in some if len(own[d]) <= 4000} - cut.keys()
    # ids
    bpe = WordBpe(default_vocabulary())
    rows = corpus_pipeline.STAGES[-1][1](spark, before, sf).collect()
    assert {r.doc_id: list(r.token_ids) for r in rows} == {d: bpe.ids(t) for d, t in cut.items()}


def test_odd_rows(spark, sf):
    for rows in (with_clashes(odd(spark)), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf)
            assert out.count() <= rows.count()
            assert name == "bpe" or out.columns == rows.columns


def test_stages_compose_without_writing(spark, sf):
    """All stages put together lazily, and two results of a stage held at once, can be read."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, second = corpus_pipeline.quality(spark, docs, sf), corpus_pipeline.quality(spark, docs.limit(50), sf)
    out = docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf)
    written = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in written.collect())
    assert first.count() > second.count() > 0


def test_columns_of_any_name_keep_their_values(spark, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, with_clashes(odd(spark)), sf).collect()
        assert {r[c] for r in rows for c in ("row", "__row", "__doc", "__gone", "__cut", "__cell", "__text", "__n_lines", "size")} <= {"clash"}, name
