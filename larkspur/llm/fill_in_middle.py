"""Fill-in-the-middle: texts are cut at two token boundaries and put together anew for infilling.

A token is a run of other characters with the white space before it; white space at the end of a
text is one more. Boundaries are found on whole texts at once, as bits of big integers:
``bytes.translate`` turns the UTF-8 bytes into a mask of their class (white space is one byte
each, so cuts never fall inside a character), one shift and two Boolean operations leave a bit
where a token ends, ``bit_count`` gives their number, and the boundaries of given ranks are found
by halving: the count of the upper half says which half holds a rank.

Every choice depends on a digest of the seed and the document's id, so a rerun or a lost executor
gives the same rows, and no row needs another."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, small_batches, table

SEED = 42
#: Of 100 documents so many are cut; of 100 of those so many have the suffix first.
RATE, SUFFIX_FIRST = 50, 80
MARKERS = ("<P>", "<S>", "<M>")
_SPACE = b"\t\n\v\f\r "
_CLASSES = bytes(ord("0") if b in _SPACE else ord("1") for b in range(256))
FIELDS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def token_ends(raw: bytes) -> int:
    """An integer of len(raw) bits, the highest for the first byte: 1 where a token ends."""
    if not raw:
        return 0
    inside = int(raw.translate(_CLASSES), 2)
    return inside & ~(inside << 1) | (raw[-1] in _SPACE)


def ranked(bits: int, width: int, ranks: list[int]) -> list[int]:
    """Places (from 1, highest bit first) of the set bits with these ascending ranks (from 1)."""
    if not ranks or width == 1:
        return [1] * len(ranks)
    low = width // 2
    high = bits >> low
    n = high.bit_count()
    above, below = [k for k in ranks if k <= n], [k - n for k in ranks if k > n]
    rest = ranked(bits & ((1 << low) - 1), low, below) if below else []
    return ranked(high, width - low, above) + [width - low + place for place in rest]


def cut(text: str, key: str, seed: int, rate: int, suffix_first: int, markers: tuple[str, str, str]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    raw = text.encode()
    ends = token_ends(raw)
    n = ends.bit_count()
    h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(f"{seed}:{key}".encode()).digest()[:16])
    if not text or any(m in text for m in markers) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    places = dict(zip((k := sorted({first, second} - {0})), ranked(ends, len(raw), k), strict=True)) | {0: 0}
    prefix, middle, suffix = raw[: places[first]].decode(), raw[places[first] : places[second]].decode(), raw[places[second] :].decode()
    p, s, m = markers
    form = "spm" if h4 % 100 < suffix_first else "psm"
    output = f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"
    return n, form, len(prefix), len(middle), output


def _udf(*how) -> Callable[..., F.Column]:
    @F.arrow_udf(f"struct<{', '.join(f'{name}: {kind}' for name, kind in FIELDS.items())}>")
    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        rows = [cut(t, k, *how) for t, k in zip(texts.to_pylist(), keys.to_pylist(), strict=True)]
        kinds = {"long": pa.int64(), "string": pa.string()}
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, kind in enumerate(FIELDS.values())], list(FIELDS))

    return run


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Adds to each row of ``docs``: n long (tokens), form (plain, psm or spm), prefix_chars and
    middle_chars long (code points; null if plain), output (the text to train on).

    A null or empty text is plain with an empty output, and so is a text that holds a marker, since
    it could not be read back. A null id counts as ''. Equal rows, ids and texts give equal
    outputs. Texts of any length are cut whole. Further columns pass through; columns with the
    names added are replaced. An empty table gives no rows."""
    small_batches(docs.sparkSession)
    kept = docs.drop(*(name for name in FIELDS if name not in (text_col, id_col)))
    to = free_name(kept)
    done = kept.withColumn(to, _udf(seed, rate, suffix_first, markers)(F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return done.select(*(F.col(f"`{c}`") for c in kept.columns if c not in FIELDS), *(F.col(to)[name].alias(name) for name in FIELDS))


def restored(output: str = "output", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> F.Column:
    """The text again, from an output and its form. A text that is cut holds no marker and markers
    don't overlap, so each stands in the output once."""
    p, s, m = markers
    out = F.col(output)
    middle = F.substring_index(out, m, -1)
    before = F.substring_index(out, m, 1)
    head = lambda first, then: F.substring(F.substring_index(before, then, 1), F.lit(len(first) + 1), F.length(out))
    psm = F.concat(head(p, s), middle, F.substring_index(before, s, -1))
    spm = F.concat(F.substring_index(before, p, -1), middle, head(s, p))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLES = {
    "op12_fill_in_middle": r"""
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
               regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
        FROM documents),
    u AS (
        SELECT *, CAST(len(tokens) AS BIGINT) AS n, CAST('0x' || h[1:8] AS UBIGINT) % (len(tokens) + 1) AS a, CAST('0x' || h[9:16] AS UBIGINT) % (len(tokens) + 1) AS b,
               CAST('0x' || h[17:24] AS UBIGINT) % 100 AS c, CAST('0x' || h[25:32] AS UBIGINT) % 100 AS d
        FROM t),
    v AS (
        SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 50 THEN 'plain' WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form,
               coalesce(array_to_string(tokens[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(tokens[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
               coalesce(array_to_string(tokens[greatest(a, b) + 1:], ''), '') AS s
        FROM u)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM v"""
}
