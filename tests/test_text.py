import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("word", "forms"),
    [
        ("barretta", {"barretta", "barrette"}),
        ("pacchi", {"pacchi", "paccho", "pacche", "pacco"}),
        ("azioni", {"azioni", "aziono", "azione"}),
        ("amica", {"amica", "amice", "amiche"}),
        ("ab", {"ab"}),
    ],
)
def test_word_variations(spark, word, forms):
    found = one(spark, X.word_variations(F.lit(word)))
    assert set(found) == forms and found[0] == word


@pytest.mark.parametrize(
    ("word", "forms"),
    [("350g", {"350g", "350 g", "350gr", "350 gr"}), ("2l", {"2l", "2 l", "2lt", "2 lt"}), ("350", {"350"}), ("350x", set()), ("60TAB", {"60tab", "60 tab", "60tabs", "60 tabs", "60 compresse"})],
)
def test_unit_variations(spark, word, forms):
    assert set(one(spark, X.unit_variations(F.lit(word)))) == forms


def test_brand_typos(spark):
    near = lambda a, b: one(spark, X.resembles(F.lit(a), F.lit(b)))
    assert near("etocsport", "ethicsport") and not near("zzzzz", "ethicsport") and not near("scitec", "scitec")


def test_stop_words_keep_all_when_none_is_left(spark):
    words = F.array(F.lit("the"), F.lit("in"))
    assert one(spark, X.without_stop_words(words)) == ["the", "in"]


def test_subsequence(spark):
    assert one(spark, X.subsequence_pattern(F.lit("eth"))) == "%e%t%h%"
    assert one(spark, X.consonants(F.lit("Perché"))) == "prch"


def test_highlight_escapes(spark):
    assert one(spark, X.highlight(F.lit("<Cold> ring"), ["cold"])) == "&lt;<mark>Cold</mark>&gt; ring"


def plain_metaphone(word):
    """Letter by letter, with skips."""
    if word is None:
        return None
    s = "".join(c for c in word.upper() if "A" <= c <= "Z")
    for start, to in (("KN", "N"), ("GN", "N"), ("PN", "N"), ("AE", "E"), ("WR", "R"), ("X", "S"), ("WH", "W")):
        if s.startswith(start):
            s = to + s[len(start) :]
            break
    out, i = "", 0
    while i < len(s):
        c, after, before = s[i], s[i + 1 : i + 2], s[i - 1 : i] if i else ""
        if c == before and c != "C":
            i += 1
            continue
        if c in "AEIOU":
            out += c if i == 0 else ""
        elif c == "B":
            out += "" if before == "M" and not after else "B"
        elif c == "C":
            if s[i : i + 3] == "CIA" or after == "H":
                out += "X"
                i += after == "H"
            else:
                out += "S" if after and after in "IEY" else "K"
        elif c == "D":
            out += "J" if after == "G" and s[i + 2 : i + 3] in ("E", "Y", "I") else "T"
        elif c == "G":
            if after == "H" and s[i + 2 : i + 3] not in ("A", "E", "I", "O", "U", ""):
                pass
            elif after == "N" and i + 2 >= len(s):
                pass
            else:
                out += "J" if after and after in "IEY" and before != "G" else "K"
        elif c == "H":
            out += "H" if after and after in "AEIOU" and before not in tuple("CSPTG") else ""
        elif c == "K":
            out += "" if before == "C" else "K"
        elif c == "P":
            out += "F" if after == "H" else "P"
            i += after == "H"
        elif c == "Q":
            out += "K"
        elif c == "S":
            if after == "H" or s[i : i + 3] in ("SIO", "SIA"):
                out += "X"
                i += after == "H"
            else:
                out += "S"
        elif c == "T":
            if s[i : i + 3] in ("TIA", "TIO"):
                out += "X"
            elif after == "H":
                out += "0"
                i += 1
            elif s[i : i + 3] != "TCH":
                out += "T"
        elif c == "V":
            out += "F"
        elif c in "WY":
            out += c if after and after in "AEIOU" else ""
        elif c == "X":
            out += "KS"
        elif c == "Z":
            out += "S"
        else:
            out += c
        i += 1
    return out


def test_metaphone(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ABCDEGHIKNOPSTUWXYZ'é9 ") for _ in range(rng.randint(0, 8))) for _ in range(3000)] + ["Knight", "night", "phone", "wrist", "sign", "match", "Xena", "", None]
    found = {r.w: r.m for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", X.metaphone(F.col("w")).alias("m")).collect()}
    assert found == {w: plain_metaphone(w) for w in words}
    assert found["Knight"] == found["night"] and found["phone"] == "FN"
