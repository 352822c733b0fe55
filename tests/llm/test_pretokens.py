from __future__ import annotations

import random

import numpy as np
import pytest

from heliograph.llm import pretokens

P = pytest.importorskip("public_tokenizers")


def sample(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["a", "Foo", "é", "ßtz", "1", "23", "½", ".", "!?", "'", "''", "'s", "'re", "'ll", "'reader", "'m", "l", "v", "e", " ", "  ", "\n", "\n\n", "\t", " ", "\x85", "\x1c", "\x00", "<|endoftext|>", "ª"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_cuts_equal_the_pattern():
    import regex

    pattern = regex.compile(P.PATTERN)
    texts = [t for t in sample(1, 4000) if t]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    rows = np.cumsum([0, *map(len, texts)])
    want = [int(r) + m.start() for t, r in zip(texts, rows, strict=False) for m in pattern.finditer(t)]
    assert pretokens.cuts(points, rows[:-1]).tolist() == want


@pytest.mark.parametrize("kept", [2_000_000, 50])
def test_ids_equal_the_library(monkeypatch, kept):
    from tokenizers import Tokenizer

    monkeypatch.setattr(pretokens, "CACHE_TOKENS", kept)
    monkeypatch.setattr(pretokens, "MERGE", 20)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    cache = pretokens.PretokenCache(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)], ["<|endoftext|>"])
    for seed in range(12):
        texts = [*sample(seed, 60), "", "日本語 テキスト's", "Ωmega ", " x", *sample(seed + 100, 3)]
        counts, ids = cache.whole(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in cache.whole([])] == [[], []] and cache.whole(["", ""])[0].tolist() == [0, 0]


def thue_morse(n: int) -> tuple[str, str]:
    """A word of 2**n letters and its complement, which have one value under any polynomial modulo a power of two once they are long."""
    word = "a"
    for _ in range(n):
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [10, 11, 12])
def test_ids_of_words_that_break_polynomial_hashes(n):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    cache = pretokens.PretokenCache(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)])
    for text in (*thue_morse(n), "x " + thue_morse(n)[1]):
        assert cache.whole([text])[1].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_when_all_hashes_are_equal(monkeypatch):
    """Pre-tokens that share a hash, in one call and in the cache, are told apart by their text."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(pretokens, "POINT_HASH", lambda points, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    cache = pretokens.PretokenCache(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)])
    for texts in (["one"], ["two"], ["one two"], [" a b c one", "two"], ["one"]):
        assert cache.whole(texts)[1].tolist() == [x for t in texts for x in tokenizer.encode(t, add_special_tokens=False).ids]
