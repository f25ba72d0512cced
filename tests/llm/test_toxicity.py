import random

from pyspark.sql import functions as F
from texts import empty, odd, odd_rows, with_clashes

from larkspur.llm.toxicity import NEGATION_REACH, PATTERNS, TARGET_REACH, Grammar, Transducer, match, op3_toxicity, pattern_weight, score, within

LABELS = "doc_id long, quality int, toxic int"


def plain(clause):
    """The marks of each terminal, looked up word by word."""
    out = []
    for i, kind in enumerate(clause):
        if kind not in "IH":
            out.append((kind, 0.0))
            continue
        marks = "t" * ("T" in clause[max(0, i - TARGET_REACH) : i + TARGET_REACH + 1])
        marks += "n" * ("N" in clause[max(0, i - NEGATION_REACH) : i]) + "r" * ("R" in clause[:i])
        out.append((kind + marks, pattern_weight(kind + marks)))
    return out


def test_composed_machine_against_plain_version():
    rng = random.Random(1)
    for _ in range(3000):
        clause = [rng.choice("IHTNR....") for _ in range(rng.randint(0, 14))]
        assert match(clause) == plain(clause)


def test_compose():
    rng = random.Random(2)
    one, two = within("N", "n", 2), within("R", "r", None)
    both = one.compose(two)
    swap = Transducer(0, {(0, s): (0, "T" if s == "." else s, 0.5) for s in {x for _, x in one.steps}})
    for _ in range(300):
        clause = [rng.choice("IHTNR.") for _ in range(8)]
        assert [s for s, _ in both.run(clause)] == [s for s, _ in two.run([s for s, _ in one.run(clause)])]
        assert [w for _, w in swap.compose(swap).run(clause)] == [0.25] * 8


def test_clauses():
    g = Grammar({"idiot": 4.0, "~lowei": 3.0, "kill": 2.0})
    of = lambda t: {p: v for p, v in zip([*PATTERNS, "best"], g.values(t), strict=True) if v}
    assert of("an idiot here") == {"I": 4, "best": 4 * pattern_weight("I")} and of("you idiot") == {"It": 4, "best": 6}
    assert of("not an idiot").keys() == {"In", "best"} and of("he said you will not kill").keys() == {"Htnr", "best"}
    assert of("you. here is one word more than that, idiot").keys() == {"I", "best"}  # the target is in another clause
    assert of("you\u3002 idiot\uff01 I kill you").keys() == {"I", "Ht", "best"}
    assert of("loweischaft") == {"I": 3, "best": 3 * pattern_weight("I")} and not of("clean words for you") and not of(None) and not of("")


def test_long_lines(monkeypatch):
    from larkspur.llm import toxicity

    g = Grammar({"idiot": 4.0})
    text = ("you are an idiot. said nobody, and not here; " * 400 + "\n") * 3
    whole = g.values(text)
    monkeypatch.setattr(toxicity, "_SLICE", 100)
    assert g.values(text) == whole


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right / len(rows) > 0.97
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.85


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, None, None), (None, 1, 1), (7, 0, 1), (7, 0, 0)], LABELS)
    rows = score(with_clashes(odd(spark)), labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert score(empty(spark), labels).count() == 0
    bare = score(odd(spark), labels.where(F.lit(False))).collect()
    assert len(bare) == len(odd_rows())
