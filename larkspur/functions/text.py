"""Text functions as column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import functions as F

# Plural and gender endings, each with what may stand in its place.
ENDINGS = [
    ("i", ["o", "e"]),
    ("e", ["a", "o"]),
    ("he", ["a", "ia"]),
    ("ie", ["ia"]),
    ("chi", ["co"]),
    ("ghi", ["go"]),
    ("ni", ["ne", "no"]),
    ("zi", ["za", "zo"]),
    ("o", ["i"]),
    ("a", ["e"]),
    ("ia", ["ie"]),
    ("ca", ["che"]),
    ("ga", ["ghe"]),
    ("e", ["i"]),
    ("co", ["chi"]),
    ("go", ["ghi"]),
]
# Units that may follow a number.
UNITS = "g gr kg mg ml l cl oz lb caps cps tab tabs compresse bustine porzioni".split()
# Forms that these units have beside their own.
UNIT_FORMS = {
    "g": ["g", " g", "gr", " gr"],
    "gr": ["g", " g", "gr", " gr"],
    "l": ["lt", " lt"],
    "caps": ["caps", " caps", "cps", " cps", " capsule"],
    "cps": ["caps", " caps", "cps", " cps", " capsule"],
    "tab": ["tab", " tab", "tabs", " tabs", " compresse"],
    "tabs": ["tab", " tab", "tabs", " tabs", " compresse"],
}
# Stop words.
STOP_WORDS = (
    "il lo la i gli le un uno una di a da in con su per tra fra e o ma se che chi cui non "
    "più quale quanto quanti quanta quante quello questa questi queste questo come dove quando perché anche "
    "the a an and or but in on at to for"
).split()
# Stem endings, tried in this order.
STEM_ENDINGS = (
    "issimo issima issimi issime amente mente ibile abile azione izione uzione atore atrice enza anza aggio eria ismo ista "
    "etto etta etti ette ino ina ini ine one ona oni are ere ire ato ito uto ando endo ante ente zione ità tà ezza "
    "oso osa osi ose ivo iva ivi ive ale ali ile ili sione i e a o"
).split()
VOWELS = "aeiouàèéìòù"


def query_words(query: F.Column, least: int = 2) -> F.Column:
    """Lower-case words of at least ``least`` characters; repeats stay."""
    return F.filter(F.split(F.lower(query), " "), lambda w: F.length(w) >= least)


def word_variations(word: F.Column) -> F.Column:
    """The word, then what every matching ending gives; words under three characters pass."""
    forms = [word]
    for ending, others in ENDINGS:
        stem = F.substring(word, F.lit(1), F.length(word) - len(ending))
        forms += [F.when((F.length(word) >= 3) & word.endswith(ending), F.concat(stem, F.lit(o))) for o in others]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def unit_variations(word: F.Column) -> F.Column:
    """Spellings of a number with a unit; a bare number is its own; else none."""
    pattern = "(?i)^([0-9]+)(" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")$"
    number, unit = F.regexp_extract(word, pattern, 1), F.lower(F.regexp_extract(word, pattern, 2))
    forms = [F.concat(number, unit), F.concat(number, F.lit(" "), unit)]
    for own, others in UNIT_FORMS.items():
        forms += [F.when(unit == own, F.concat(number, F.lit(o))) for o in others]
    none = F.array().cast("array<string>")
    return F.when(number != "", F.array_distinct(F.array_compact(F.array(*forms)))).when(word.rlike("^[0-9]+$"), F.array(word)).otherwise(none)


def expand_words(words: F.Column, corrections: F.Column | None = None) -> F.Column:
    """All variations of all words in order, without repeats, then corrections."""
    own = F.flatten(F.transform(words, lambda w: F.concat(word_variations(w), unit_variations(w))))
    return F.array_distinct(own if corrections is None else F.concat(own, corrections))


def spellings(words: F.Column) -> F.Column:
    """For each word the forms that count as it: itself and the other spellings of its unit."""
    return F.transform(words, lambda w: F.concat(F.array(w), unit_variations(w)))


def normalize(query: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(query, r"[^\p{L}\p{N}\s]", " ")), r"\s+", " "))


def without_stop_words(words: F.Column) -> F.Column:
    """Words that are no stop word and longer than one character; the words as they are if none is left."""
    kept = F.filter(words, lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 1))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def stem(word: F.Column) -> F.Column:
    """Drops the first ending of the list that leaves more than two characters."""
    out = F.when(F.length(word) <= 3, word)
    for ending in STEM_ENDINGS:
        out = out.when(word.endswith(ending) & (F.length(word) > len(ending) + 2), F.substring(word, F.lit(1), F.length(word) - len(ending)))
    return out.otherwise(word)


def consonants(word: F.Column) -> F.Column:
    return F.regexp_replace(F.lower(word), f"[{VOWELS}]", "")


def subsequence_pattern(word: F.Column) -> F.Column:
    """LIKE pattern of the word's characters in order with anything between."""
    return F.concat(F.lit("%"), F.array_join(F.filter(F.split(word, ""), lambda c: c != ""), "%"), F.lit("%"))


def resembles(word: F.Column, name: F.Column, phonetic: bool = True) -> F.Column:
    """Whether a word may be a misspelling of a name (both lower case): edit distance by length,
    equal consonants, sound, containment, or a shared start or end with a small distance."""
    lw, ln = F.length(word), F.length(name)
    longest = F.greatest(lw, ln)
    distance = F.levenshtein(word, name)
    limit = F.when(lw >= 8, 3).when(lw >= 5, 2).otherwise(1)
    skeleton = (consonants(word) == consonants(name)) & (F.length(consonants(word)) >= 4)
    inside = (lw >= 5) & (ln >= 5) & (F.contains(name, word) | F.contains(word, name))
    affix = F.least(F.lit(4), F.least(lw, ln) - 1)
    ends = (affix >= 3) & ((F.left(word, affix) == F.left(name, affix)) | (F.right(word, affix) == F.right(name, affix))) & (distance <= longest * 0.4)
    hit = distance.between(1, limit) | skeleton | inside | ends
    if phonetic:
        hit = hit | ((F.soundex(word) == F.soundex(name)) & (lw >= 4))
    return (F.abs(lw - ln) <= longest * 0.5) & (word != name) & hit


def strip_tags(html: F.Column) -> F.Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def highlight(text: F.Column, words: list[str]) -> F.Column:
    """Marks words of two characters or more, one after the other, after HTML escaping."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for word in words:
        if len(word) >= 2:
            quoted = "".join("\\" + c if not c.isalnum() else c for c in word)
            out = F.regexp_replace(out, f"(?i)({quoted})", "<mark>$1</mark>")
    return out


#: What a word's beginning is read as.
BEGINNINGS = {"KN": "N", "GN": "N", "PN": "N", "AE": "E", "WR": "R", "X": "S", "WH": "W"}


def metaphone(word: F.Column) -> F.Column:
    """Phonetic key: consonant classes, vowels only at the start. Each letter is read with its neighbours
    alone (an H behind C, P, S or T is silent by its own rule), so a word is one pass."""
    letters = F.regexp_replace(F.upper(word), "[^A-Z]", "")
    start = letters
    for begin, to in reversed(BEGINNINGS.items()):
        start = F.when(letters.startswith(begin), F.concat(F.lit(to), F.substring(letters, F.lit(len(begin) + 1), F.length(letters)))).otherwise(start)
    # beside each letter: the one before and the two behind
    own = F.split(start, "")
    none = F.lit("")
    behind = lambda by: F.slice(own, F.lit(by + 1), F.greatest(F.size(own) - by, F.lit(0)))
    near = F.zip_with(F.zip_with(own, behind(1), lambda c, d: F.struct(c.alias("c"), F.coalesce(d, none).alias("d"))), behind(2), lambda x, e: F.struct(x["c"].alias("c"), x["d"].alias("d"), F.coalesce(e, none).alias("e")))
    near = F.zip_with(near, F.concat(F.array(none), own), lambda x, b: F.struct(F.coalesce(x["c"], none).alias("c"), x["d"].alias("d"), x["e"].alias("e"), b.alias("b")))
    return F.when(word.isNotNull(), F.array_join(F.transform(near, lambda x, i: _sound(x["c"], x["d"], x["e"], x["b"], i)), ""))


def _sound(c: F.Column, after: F.Column, then: F.Column, before: F.Column, at: F.Column) -> F.Column:
    """What a letter sounds like between its neighbours ('' beyond the word)."""
    vowel = after.isin(*"AEIOU")
    soft = after.isin(*"IEY")
    pair = F.concat(after, then)
    if_ = lambda test, yes, no: F.when(test, F.lit(yes)).otherwise(F.lit(no) if isinstance(no, str) else no)
    silent_g = ((after == "H") & ~then.isin(*"AEIOU", "")) | ((after == "N") & (then == ""))
    sounds = {
        "B": if_((before == "M") & (after == ""), "", "B"),
        "C": if_((pair == "IA") | (after == "H"), "X", if_(soft, "S", "K")),
        "D": if_((after == "G") & then.isin(*"EYI"), "J", "T"),
        "G": if_(silent_g, "", if_(soft & (before != "G"), "J", "K")),
        "H": if_(vowel & ~before.isin(*"CSPTG"), "H", ""),
        "K": if_(before == "C", "", "K"),
        "P": if_(after == "H", "F", "P"),
        "Q": F.lit("K"),
        "S": if_((after == "H") | pair.isin("IO", "IA"), "X", "S"),
        "T": if_(pair.isin("IA", "IO"), "X", if_(after == "H", "0", if_(pair == "CH", "", "T"))),
        "V": F.lit("F"),
        "W": if_(vowel, "W", ""),
        "Y": if_(vowel, "Y", ""),
        "X": F.lit("KS"),
        "Z": F.lit("S"),
    }
    out = F.when((c == before) & (c != "C"), F.lit("")).when(c.isin(*"AEIOU"), F.when(at == 0, c).otherwise(F.lit("")))
    for letter, sound in sounds.items():
        out = out.when(c == letter, sound)
    return out.otherwise(c)
