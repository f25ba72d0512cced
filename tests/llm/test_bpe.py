import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import empty, odd, odd_rows, with_clashes

from larkspur.llm.bpe import WordBpe, decode, default_vocabulary, encode


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return WordBpe(default_vocabulary()), Tokenizer.from_file(default_vocabulary())


def same(both, text):
    own, library = both
    want = library.encode(text, add_special_tokens=False).ids
    assert own.ids(text) == want
    assert own.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(both, text):
    same(both, text)


def test_many_words(both):
    rng = random.Random(1)
    for _ in range(2000):
        same(both, "".join(rng.choice("etaoinshrdlu'S 9éß") for _ in range(rng.randint(1, 30))))
    for text in ["<|endoftext|> a<|startoftext|>b", "they're 'S", "Σίσυφος ΣΑΣ", "a\x1cb\x85c", "Å é"]:
        same(both, text)


def test_newer_characters(both):
    from larkspur.llm.bpe import LETTERS_16, LOWER_16, NUMBERS_16

    spans = [s.partition("-") for s in f"{LETTERS_16} {NUMBERS_16}".split()]
    codes = [c for a, _, z in spans for c in range(int(a, 16), int(z or a, 16) + 1)] + [c for a, z, _ in LOWER_16 for c in range(a, z + 1)]
    codes += range(0x378, 0x3A0)  # some unassigned
    for at in range(0, len(codes), 16):
        own = list(map(chr, codes[at : at + 16]))
        same(both, "q".join(own) + " " + " ".join(own))


def test_slices_and_tables(both, monkeypatch):
    """Small slices, tables that are full at once, and words read one by one give the same ids."""
    from larkspur.llm import bpe

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab cdé'1! ") for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["x" * 700 + " " + "1" * 300 + "yz" * 200, None, "", " "]
    want = [both[1].encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [both[0].ids(t) for t in texts] == want
    monkeypatch.setattr(bpe, "SLICE", 64)
    monkeypatch.setattr(bpe, "LONG", 24)
    own = WordBpe(default_vocabulary(), keep_bytes=2_000)
    for _ in range(2):
        rows = bpe._rows(own, texts, True)
        assert [list(r[3]) for r in rows] == want and [r[0] for r in rows] == list(map(len, want))
        assert [r[2] for r in rows] == [hashlib.sha256(own.decode(w).encode()).hexdigest() for w in want]


def test_compatible_is_plain_merging(both):
    own, rng = both[0], random.Random(3)
    some = rng.sample(range(49_406), 300)
    pairs = [(a, b) for a in some for b in some if not own.text_of[a].endswith(own.end)]
    assert all(own.compatible(a, b) == (own._merge([a, b]) == [own.text_of[a], own.text_of[b]]) for a, b in pairs)


def test_frame(spark, both):
    out = encode(with_clashes(odd(spark)))
    rows = out.collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        found = both[1].encode(r.text or "", add_special_tokens=False)
        assert r.n_tokens == len(found.ids) and list(r.token_ids) == found.ids
        assert r.ids_sha256 == hashlib.sha256(np.array(found.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(both[1].decode(found.ids, skip_special_tokens=False).encode()).hexdigest()
    back = decode(out.where("doc_id = 9")).first()
    assert back.decoded == both[1].decode(list(back.token_ids), skip_special_tokens=False)
    assert encode(empty(spark)).count() == 0
