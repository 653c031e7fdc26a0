from __future__ import annotations

import base64
import os
import random

import pyarrow as pa
import pytest
import regex
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rotogrid.llm import bpe

FOLDER = os.environ.get("TOKENIZERS", bpe.TOKENIZERS)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NAMES = ("byte_bpe_50k", "byte_bpe_multi_50k", "piece_bpe_32k")
VOCABULARIES = {n: bpe.load_vocabulary(n, FOLDER) for n in NAMES}


def ranks(name):
    with open(f"{FOLDER}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def reference(name):
    if name.startswith("piece"):
        model = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/{name}.model")
        return lambda t: model.encode(t)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(name), special_tokens={}).encode_ordinary


REFERENCES = {n: reference(n) for n in NAMES}
SPECIAL = ["", " ", "\n", "\n\n  x", "a'll 's 'S 'stop '' 'rex don't\n't", "<|endoftext|> <s></s><unk> <0x0A>", "x    def\n\t \tg ", "é中文　テスト ไทยไม่มีช่องว่าง हिन्दी 🎉👩‍👩‍👧 ﬁ", "１２ ²½ Ⅷ", "\x00\x1c\x1f\x85\xa0 x", "a" * 5000, " " * 777 + "x", "ab" * 3000 + "ไ" * 900, "-" * 4000, "▁ ▁▁x▁", "\U0010ffff퟿"]


def encode(name, texts):
    return bpe.encode_column(pa.array(texts, pa.string()), VOCABULARIES[name]).to_pylist()


@pytest.mark.parametrize("name", NAMES)
def test_special_texts_equal_the_library(name):
    assert encode(name, SPECIAL) == [REFERENCES[name](t) for t in SPECIAL]
    assert encode(name, [None, "", None]) == [[], [], []]
    assert encode(name, []) == []


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aab'stlrevmd  \n\t.,09中ไéдं़"), st.characters(codec="utf-8", max_codepoint=0x2FFFF, exclude_categories=("Cn", "Cs"))), max_size=60), max_size=5))
def test_any_text_equals_the_library(name, texts):
    assert encode(name, texts) == [REFERENCES[name](t) for t in texts]


def merge_plainly(table, word):
    """One merge at a time: the leftmost pair of minimum rank."""
    parts = [bytes([b]) for b in word]
    while True:
        found = [(table[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in table]
        if not found:
            return [table[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_rounds_equal_single_merges_with_any_chunking(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["the ", "ing", "er", "aa", "ion", " in", "на", "的", "0", "!", "\n"]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    table = ranks(NAMES[0])
    expected = [[i for w in regex.findall(PATTERN, t) for i in merge_plainly(table, w.encode())] for t in texts]
    for chunk, kept, long, cells in ((1 << 22, 10**6, 192, 1 << 21), (50, 3, 4, 16)):
        monkeypatch.setattr(bpe, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(bpe, "KEPT_WORDS", kept)
        monkeypatch.setattr(bpe, "LONG", long)
        monkeypatch.setattr(bpe, "CELLS", cells)
        assert bpe.encode_column(pa.array(texts), bpe.load_vocabulary(NAMES[0], FOLDER)).to_pylist() == expected


def test_counts_equal_lengths():
    got = bpe.count_column(pa.array([*SPECIAL, None]), [VOCABULARIES[n] for n in NAMES])
    for n, counts in zip(NAMES, got):
        assert counts.tolist() == [*[len(REFERENCES[n](t)) for t in SPECIAL], 0]


def test_other_kinds_go_by_their_library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{FOLDER}/word_bpe_49k.json")
    own.encode_special_tokens = True
    v = bpe.load_vocabulary("word_bpe_49k", FOLDER)
    texts = ["A tilt series", None, "", "<|endoftext|> x"]
    expected = [own.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    assert bpe.encode_column(pa.array(texts), v).to_pylist() == expected
    counts = bpe.count_column(pa.array(texts), [v, VOCABULARIES[NAMES[0]]])
    assert counts[0].tolist() == [len(e) for e in expected] and counts[1].tolist() == [len(REFERENCES[NAMES[0]](t or "")) for t in texts]


def test_pair_table():
    rng = random.Random(2)
    pairs = {(rng.randrange(50000), rng.randrange(50000)): i for i in range(5000)}
    import numpy as np

    a, b = np.array(list(pairs)).T
    table = bpe.PairTable(a, b, np.array(list(pairs.values()), np.int32))
    assert table(a, b).tolist() == list(pairs.values())
    c, d = np.array([[rng.randrange(-2, 50000) for _ in range(5000)] for _ in range(2)])
    assert table(c, d).tolist() == [pairs.get(p, bpe.NONE) for p in zip(c.tolist(), d.tolist())]


def test_corpus(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (3, "", "z")], "doc_id bigint, text string, ids string")
    got = bpe.encode_corpus(docs, NAMES[0], FOLDER)
    assert sorted(map(str, ((r.doc_id, r.ids) for r in got.collect()))) == sorted(map(str, [(1, REFERENCES[NAMES[0]]("a b"))] * 2 + [(None, []), (3, [])]))
    assert bpe.encode_corpus(docs.limit(0), NAMES[0], FOLDER).count() == 0
    assert dict(got.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
