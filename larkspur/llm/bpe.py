"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can come last in its encoding (an encoding's
prefix is the encoding of the prefix). An automaton over the vocabulary (Aho-Corasick: its
suffix links list the tokens that are suffixes of what was read) proposes the last tokens of
every prefix; token t of length k is the one iff it is compatible with the last token of the
prefix that is k shorter: no merge across their border comes before the merges that make the
two. The unique last token of every prefix is stored; following the back-pointers from the end
gives the ids.

All words of a group of texts that are not yet known are read by the automaton at once, and the
prefixes of equal length of all these words are decided together. Words repeat, so two
generations of tables, bounded by their bytes, keep the ids of pieces between white space; the
pattern never crosses white space. When the younger table is full it becomes the older one, and
pieces that come again move up from there.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Bytes of one of the two tables of known pieces in a worker (memory only, not results).
KEEP_BYTES = 40 << 20
#: Slots of the table of known pairs; bytes that a known piece takes besides its characters and ids.
PAIR_SLOTS, ENTRY = 1 << 20, 200
#: Characters of a text handled at once; cuts fall before white space. Texts are put together up to it.
SLICE = 1 << 19
#: Longer words (in bytes) are encoded one by one.
LONG = 250
_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# What the library's Unicode data (16.0) has beyond Python's (15.1). Letters and
# numbers as ranges of code points, in their order; lower case as (first, last, lower case of the first).
LETTERS_16 = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
NUMBERS_16 = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
LOWER_16 = [
    (0x1C89, 0x1C89, 0x1C8A),
    (0xA7CB, 0xA7CB, 0x0264),
    (0xA7CC, 0xA7CC, 0xA7CD),
    (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB),
    (0xA7DC, 0xA7DC, 0x019B),
    (0x10D50, 0x10D65, 0x10D70),
    (0x16EA0, 0x16EB8, 0x16EBB),
]
_LOWER = {c: low + c - first for first, last, low in LOWER_16 for c in range(first, last + 1)}
_NEW_UPPER = re.compile("[" + "".join(map(chr, _LOWER)) + "]")


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def _byte_symbols() -> list[str]:
    """The visible stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _classes() -> dict[str, str]:
    """Ranges of the letters and the numbers, by Python's Unicode data and the additions above."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    for kind, more in (("L", LETTERS_16), ("N", NUMBERS_16)):
        for span in more.split():
            a, _, z = span.partition("-")
            kinds[int(a, 16) : int(z or a, 16) + 1] = [kind] * (int(z or a, 16) + 1 - int(a, 16))
    out, at = {"L": "", "N": ""}, 0
    for kind, own in itertools.groupby(kinds):
        n = sum(1 for _ in own)
        if kind in out:
            out[kind] += f"{chr(at)}-{chr(at + n - 1)}"
        at += n
    return out


class Pieces:
    """Pieces and their ids, in one array that grows."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.ids, self.starts, self.sizes, self.bytes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.starts)
        self.at.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.bytes += len(pieces) * ENTRY + sum(map(len, pieces)) + 4 * len(ids)

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces with these codes one after the other, and how many each has."""
        return _taken(self.ids, self.starts[codes], self.sizes[codes])


def _taken(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


class WordBpe:
    """A vocabulary of the word-end kind with lower case and dropped white space."""

    def __init__(self, path: str, keep_bytes: int = KEEP_BYTES):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.text_of = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of |= {i: t for t, i in self.added.items()}
        kinds = _classes()
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^{_SPACE}{kinds['L']}{kinds['N']}]+")
        self.gap = re.compile(f"[{_SPACE}]+")
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self._read_merges([tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]])
        # tokens as bytes, the word end as a line feed, which no word holds
        byte_of = {s: b for b, s in enumerate(_byte_symbols())}
        self.automaton = ahocorasick.Automaton()
        self.length = np.zeros(self.n_ids, np.int64)
        for token, i in self.vocab.items():
            core, ends = self._core(token)
            raw = [byte_of.get(c, 10) for c in core]
            if token in self.added or 10 in raw:
                continue
            self.length[i] = len(raw) + ends
            self.automaton.add_word(bytes(raw).decode("latin-1") + "\n" * ends, i)
        self.automaton.make_automaton()
        self.whole = np.full(self.n_ids, -1, np.int8)
        self.pair_keys, self.pair_ok = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        self.keep_bytes, self.known, self.older = keep_bytes, Pieces(), Pieces()
        self.names = [self.text_of.get(i, "") for i in range(self.n_ids)]

    def _core(self, token: str) -> tuple[str, bool]:
        """A token without its word end, and whether it has one."""
        ends = token.endswith(self.end) and len(token) > len(self.end)
        return (token[: -len(self.end)], True) if ends else (token, False)

    def _read_merges(self, merges: list[tuple[str, str]]) -> None:
        """The rank of each pair of ids and, of each token, when it is made and from what. Where
        every token is made once, and after its parts, compatibility can be read off these."""
        self.n_ids = max(self.text_of) + 1
        self.rank = {pair: r for r, pair in enumerate(merges)}
        self.pair_rank: dict[int, int] = {}
        self.made, self.left, self.right = [-1] * self.n_ids, [0] * self.n_ids, [0] * self.n_ids
        self.ordered = len(self.rank) == len(merges)
        for r, (a, b) in enumerate(merges):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.ordered &= self.made[z] < 0 and self.made[x] < r and self.made[y] < r
            self.pair_rank[x << 20 | y] = r
            self.made[z], self.left[z], self.right[z] = r, x, y

    def _merge(self, tokens: Iterable[int]) -> list[str]:
        """Plain merging of the symbols of a few tokens."""
        parts: list[str] = []
        for i in tokens:
            core, ends = self._core(self.text_of[i])
            parts += core
            parts[-1] += self.end * ends
        while len(parts) > 1:
            ranks = [self.rank.get((parts[k], parts[k + 1]), 1 << 30) for k in range(len(parts) - 1)]
            best = min(ranks)
            if best == 1 << 30:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def is_whole(self, token: int) -> bool:
        """Whether a token's string encodes to the token alone."""
        if self.whole[token] < 0:
            self.whole[token] = self._merge([token]) == [self.text_of[token]]
        return self.whole[token] == 1

    def compatible(self, first: int, second: int) -> bool:
        """Whether the strings of two tokens, put together, encode to these tokens: at no time does
        a merge join the last part of the first with the first part of the second. The parts at
        the border are walked from the whole tokens back in time."""
        if not self.ordered:
            return self._merge([first, second]) == [self.text_of[first], self.text_of[second]]
        rank, made, never = self.pair_rank, self.made, len(self.rank)
        x, y, x_until, y_until = first, second, never, never
        while True:
            across = rank.get(x << 20 | y, never)
            # of merges of one rank the left one comes first
            if across < x_until and across <= y_until and across < never:
                return False
            if made[x] < 0 and made[y] < 0:
                return True
            if made[x] > made[y]:
                x, x_until = self.right[x], made[x]
            else:
                y, y_until = self.left[y], made[y]

    def _compatible(self, keys: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs (first << 20 | second), through a table of fixed size."""
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) & (PAIR_SLOTS - 1)
        out, new = self.pair_ok[slots], self.pair_keys[slots] != keys
        if new.any():
            own, at = np.unique(keys[new], return_inverse=True)
            known = np.fromiter((self.compatible(k >> 20, k & 0xFFFFF) for k in own.tolist()), bool, len(own))
            out[new] = known[at]
            self.pair_keys[slots[new]], self.pair_ok[slots[new]] = keys[new], out[new]
        return out

    def _decide(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        raw = ("\n".join(words) + "\n").encode()
        matches = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(raw.decode("latin-1"))), np.int64)
        ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
        starts = np.r_[0, ends[:-1] + 1]
        at, token = matches[::2], matches[1::2]
        before = at - self.length[token]
        place = at - np.repeat(starts, ends - starts + 1)[at]  # within the word
        first = before == at - place - 1
        first_ids = np.unique(token[first])
        alone = np.zeros(self.n_ids, bool)
        alone[first_ids] = [self.is_whole(i) for i in first_ids.tolist()]
        last = np.full(len(raw), -1, np.int64)
        order = np.argsort(place.astype(np.uint16), kind="stable")
        bounds = np.r_[0, np.cumsum(np.bincount(place))]
        for a, z in itertools.pairwise(bounds):
            own = order[a:z]
            t, b = token[own], before[own]
            ok = first[own]
            inner = ~ok
            ok = ok & alone[t]
            reached = np.flatnonzero(inner)
            reached = reached[last[b[reached]] >= 0]
            ok[reached] = self._compatible(last[b[reached]] << 20 | t[reached])
            last[at[own[ok]]] = t[ok]
        on_path, back, least = np.zeros(len(raw), bool), ends, starts
        while len(back):
            if (last[back] < 0).any():
                raise ValueError("no token ends a prefix of a word")
            on_path[back] = True
            back = back - self.length[last[back]]
            more = back >= least
            back, least = back[more], least[more]
        count = np.add.reduceat(on_path.astype(np.int64), starts)
        return last[on_path], count

    def word(self, word: str) -> list[int]:
        """Ids of one word of any length, decided prefix by prefix."""
        from array import array

        read = word.encode().decode("latin-1") + "\n"
        last, length = array("i", [-1]) * (len(read) + 1), self.length
        for end, token in self.automaton.iter(read):
            at = end + 1
            if last[at] < 0:
                before = at - int(length[token])
                if self.is_whole(token) if before == 0 else (last[before] >= 0 and self._known(last[before], token)):
                    last[at] = token
        ids, at = array("i"), len(read)
        while at:
            if last[at] < 0:
                raise ValueError("no token ends a prefix of a word")
            ids.append(last[at])
            at -= int(length[last[at]])
        return ids[::-1].tolist()

    def _known(self, first: int, second: int) -> bool:
        key = first << 20 | second
        slot = (key * 0x9E3779B97F4A7C15 % (1 << 64)) >> 44 & (PAIR_SLOTS - 1)
        if self.pair_keys[slot] != key:
            self.pair_keys[slot], self.pair_ok[slot] = key, self.compatible(first, second)
        return bool(self.pair_ok[slot])

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_decide``, for words of any length."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        if max(map(len, words)) * 4 < LONG:
            ids, sizes = self._decide(words)
            return ids.astype(np.int32), sizes
        long = [k for k, w in enumerate(words) if len(w) * 4 >= LONG]
        own = {k: np.array(self.word(words[k]), np.int32) for k in long}
        ids, sizes = self._encoded([w for w in words if len(w) * 4 < LONG])
        ends, parts, at = np.cumsum(sizes), [], 0
        for j, k in enumerate(long):  # k - j shorter words come before the word k
            to = int(ends[k - j - 1]) if k > j else 0
            parts += [ids[at:to], own[k]]
            at = to
        return np.concatenate([*parts, ids[at:]]), np.insert(sizes, [k - j for j, k in enumerate(long)], [len(own[k]) for k in long])

    def _learn(self, pieces: set[str]) -> None:
        """Puts all ``pieces`` into the younger table."""
        new = list(pieces.difference(self.known.at))
        codes = list(map(self.older.at.get, new))
        again = [c for c in codes if c is not None]
        if again:
            self.known.add([p for p, c in zip(new, codes, strict=True) if c is not None], *self.older.take(np.array(again)))
            new = [p for p, c in zip(new, codes, strict=True) if c is None]
        if not new:
            return
        words_of = self.pattern.findall
        parts = [[p] if p.isalpha() else words_of(p) for p in new]
        flat = list(itertools.chain.from_iterable(parts))
        words = list(dict.fromkeys(flat))
        ids, sizes = self._encoded(words)
        place = dict(zip(words, range(len(words)), strict=True))
        own = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        ids, sizes = _taken(ids, (np.cumsum(sizes) - sizes)[own], sizes[own])
        n_words = np.fromiter(map(len, parts), np.int64, len(parts))
        self.known.add(new, ids, np.add.reduceat(sizes, np.cumsum(n_words) - n_words))

    def _plain(self, text: str) -> Iterator[tuple[list[str], int]]:
        """(pieces, characters) of slices of a text without special tokens."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        at = 0
        while at < len(text):
            to = at + SLICE
            if to < len(text):
                gap = self.gap.search(text, to)
                to = gap.start() if gap else len(text)
            part = text[at:to] if at or to < len(text) else text
            at = to
            # one character at a time in the rule's lower case: no final sigma
            if part.isascii():
                part = part.lower()
            else:
                part = part.replace("Σ", "σ").lower()
                if not _is_latin(part) and _NEW_UPPER.search(part):
                    part = part.translate(_LOWER)
            odd = any(c in part for c in "\x1c\x1d\x1e\x1f")
            if len(part) > 2 * SLICE:  # a very long piece: word by word, each a piece of its own
                words = (m.group() for m in self.pattern.finditer(part))
                while own := list(itertools.islice(words, 65_536)):
                    yield own, sum(map(len, own))
            else:
                yield ([x for x in self.gap.split(part) if x] if odd else part.split()), len(part)

    def _segments(self, text: str | None) -> Iterator[tuple[list[str] | str, int]]:
        """Lists of pieces, and special tokens as strings, in order."""
        if not text:
            return
        if self.special and any(t in text for t in self.added):
            for k, part in enumerate(self.special.split(text)):
                if k % 2:
                    yield part, len(part)
                elif part:
                    yield from self._plain(part)
        else:
            yield from self._plain(text)

    def _resolved(self, held: list[tuple[int, list[str] | str]]) -> Iterator[tuple[int, bytes, str]]:
        lists = [s for _, s in held if not isinstance(s, str)]
        pieces = set().union(*lists)
        self._learn(pieces)
        lengths = list(map(len, lists))
        codes = np.fromiter(map(self.known.at.__getitem__, itertools.chain.from_iterable(lists)), np.int64, sum(lengths))
        ids, sizes = self.known.take(codes)
        ends = iter(np.r_[0, np.cumsum(sizes)][np.cumsum(lengths, dtype=np.int64)].tolist())
        raw, names, a = ids.astype("<u4").tobytes(), list(map(self.names.__getitem__, ids.tolist())), 0
        for k, segment in held:
            if isinstance(segment, str):
                yield k, struct.pack("<I", self.added[segment]), segment
                continue
            z = next(ends)
            if z > a:
                yield k, raw[4 * a : 4 * z], " ".join(names[a:z])
            a = z
        if self.known.bytes > self.keep_bytes:
            self.known, self.older = Pieces(), self.known if self.known.bytes < 2 * self.keep_bytes else Pieces()

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[int, bytes, str]]:
        """(number of the text, ids as little-endian 32 bits, tokens joined by blanks) of part after
        part of whole texts, in order; texts without tokens have no part."""
        held: list[tuple[int, list[str] | str]] = []
        size = 0
        for k, text in enumerate(texts):
            for segment, n in self._segments(text):
                held.append((k, segment))
                size += n
                if size >= SLICE:
                    yield from self._resolved(held)
                    held, size = [], 0
        yield from self._resolved(held)

    def ids(self, text: str | None) -> list[int]:
        raw = b"".join(x[1] for x in self.encode([text]))
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode(self, ids: list[int]) -> str:
        """The tokens with a blank between: this vocabulary file names no decoder."""
        return " ".join(self.text_of[i] for i in ids)


_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _rows(bpe: WordBpe, texts: list[str | None], keep_ids: bool) -> list[tuple]:
    """For each text the number of ids, the two digests and, with ``keep_ids``, the ids. Parts of a
    long text are digested as they come."""
    rows: list[tuple] = []
    for k, parts in itertools.groupby(bpe.encode(texts), key=lambda x: x[0]):
        rows += [_row((), keep_ids)] * (k - len(rows))
        rows.append(_row(parts, keep_ids))
    return rows + [_row((), keep_ids)] * (len(texts) - len(rows))


def _row(parts: Iterable[tuple[int, bytes, str]], keep_ids: bool) -> tuple:
    ids_hash, text_hash, size, raw = hashlib.sha256(), hashlib.sha256(), 0, []
    for _, ids, names in parts:
        if size:
            text_hash.update(b" ")
        ids_hash.update(ids)
        text_hash.update(names.encode())
        size += len(ids)
        if keep_ids:
            raw.append(ids)
    row = (size // 4, ids_hash.hexdigest(), text_hash.hexdigest())
    return (*row, np.frombuffer(b"".join(raw), "<u4").astype(np.int32)) if keep_ids else row


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Adds to each row of ``docs``: n_tokens long, ids_sha256, decoded_sha256 and, with
    ``keep_ids``, token_ids (array of int). Whole texts of any length, read in slices of half a
    million characters; null or empty: no tokens. Repeated rows, ties and further columns pass
    through; columns of these names are replaced; an empty table gives no rows. ``path``: the
    vocabulary, readable on every machine."""
    path = path or default_vocabulary()
    small_batches(docs.sparkSession)
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids

    @F.pandas_udf(f"struct<{fields.replace(' long', ':long').replace(' string', ':string').replace(' array', ':array')}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * keep_ids
        for texts in batches:
            yield pd.DataFrame(_rows(bpe, texts.tolist(), keep_ids), columns=names)

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * keep_ids
    done = docs.drop(*names).withColumn("__bpe", run(F.col(text_col)))
    return done.select(*(f"`{c}`" for c in done.columns if c != "__bpe"), *(F.col("__bpe")[n].alias(n) for n in names))


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "token_ids", to: str = "decoded") -> DataFrame:
    """Adds the decoded text of an array of ids; null stays null."""
    path = path or default_vocabulary()

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        bpe = tokenizer(path)
        return pd.Series([None if x is None else bpe.decode([int(i) for i in x]) for x in ids], dtype=object)

    return encoded.withColumn(to, run(F.col(ids_col)))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op6_bpe": op6_bpe}
ORACLES: dict[str, str] = {}
