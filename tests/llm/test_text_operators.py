from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib

import numpy as np
import pytest
from tests.llm.fixtures import documents, texts
from tests.llm.test_pretokens import thue_morse

from heliograph.llm import byte_bpe, decontaminate, license_scan, near_dedup, quality, syncmers, token_output

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def pairs(rows):
    return sorted(rows, key=str)


# --- decontamination

ITEMS = [(1, texts()[0][1]), (2, "one"), (3, "alpha beta Gamma"), (10, texts()[4][1][:200]), (4, None), (5, " .. "), (None, "alpha"), (1, "iota kappa, iota")]


def brute_contamination(rows, items, span=10):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        if w and i is not None:
            n = min(span, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return pairs(out)


def test_contamination_equals_brute_force(spark):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.summary(decontaminate.contamination(documents(spark), bench)).collect()
    assert pairs(tuple(r) for r in got) == brute_contamination(texts(), ITEMS)


def test_contamination_in_blocks(spark):
    rows = [(i, t) for i, (_, t) in enumerate(texts())]
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert len(decontaminate.blocks(bench, 20)) > 3
    got = decontaminate.summary(decontaminate.contamination(documents(spark, rows), bench, block_words=20)).collect()
    assert pairs(tuple(r) for r in got) == brute_contamination(rows, ITEMS)
    kept = {r.doc_id for r in decontaminate.clean_documents(documents(spark, rows), bench, block_words=20).collect()}
    assert kept == {r[0] for r in brute_contamination(rows, ITEMS) if not r[-1]}


def test_contamination_in_blocks_with_repeated_and_null_ids(spark):
    rows = [*texts(), (3, "one"), (None, ITEMS[3][1]), (3, texts()[3][1])]
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.summary(decontaminate.contamination(documents(spark, rows), bench, block_words=20)).collect()
    assert pairs(tuple(r) for r in got) == brute_contamination(rows, ITEMS)


def test_contamination_of_empty_tables(spark):
    none, bench = documents(spark, []), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    got = decontaminate.summary(decontaminate.contamination(documents(spark), bench)).collect()
    assert {(r.n_hit, r.contaminated) for r in got} == {(0, False)}
    assert decontaminate.clean_documents(documents(spark), bench).columns == documents(spark).columns


# --- near duplicates


def brute_groups(rows, k, percent=80):
    def shingles(t):
        w = SPACED.findall(lower(t))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return pairs((d, len(s), None if d is None else find(d)) for d, s in sets)


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups_equal_brute_force(spark, k):
    got = near_dedup.near_groups(documents(spark), near_dedup.Params(shingle=k)).collect()
    assert pairs(tuple(r) for r in got) == brute_groups(texts(), k)


def test_a_large_group_of_near_copies(spark):
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_groups(documents(spark, rows), near_dedup.Params(shingle=2)).collect()
    assert pairs(tuple(r) for r in got) == brute_groups(rows, 2)


@pytest.mark.parametrize("k", [2, 5])
def test_words_that_break_polynomial_hashes_are_not_linked(spark, k):
    words = [w for n in (10, 11, 12) for w in thue_morse(n)]
    rows = [*enumerate(words), *((10 + i, f"the same {w} beginning and end") for i, w in enumerate(words)), (50, words[1]), (51, words[1].upper())]
    got = near_dedup.near_groups(documents(spark, rows), near_dedup.Params(shingle=k)).collect()
    assert pairs(tuple(r) for r in got) == brute_groups(rows, k)
    assert {r.doc_id for r in got if r.component_id != r.doc_id} == {50, 51}
    items = [(1, words[1]), (2, words[2])]
    found = decontaminate.summary(decontaminate.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))).collect()
    assert pairs(tuple(r) for r in found) == brute_contamination(rows, items)


def test_exact_sets():
    import random

    rng = random.Random(4)
    for k in (1, 2, 3, 5, 9):
        some = [" ".join(f"w{rng.randrange(10**6 if i % 2 else 3)}" for _ in range(rng.randrange(40))) for i in range(300)]
        sets = near_dedup.exact_sets([*some, "", "W1 w1", "w1 w1"], k)
        shingles = lambda t: {tuple(w[i : i + k]) for w in [SPACED.findall(lower(t))] for i in range(max(1, len(w) - k + 1)) if w}
        assert [len(x) for x in sets[:300]] == [len(shingles(t)) for t in some] and sets[-1].tolist() == sets[-2].tolist() and not len(sets[-3])
        for i in range(0, 300, 7):
            assert len(np.intersect1d(sets[i], sets[i + 2 if i < 298 else 0])) == len(shingles(some[i]) & shingles(some[i + 2 if i < 298 else 0]))


def test_a_leader_of_many_is_dealt_in_parts(spark):
    rows = [(i, f"{texts()[0][1]} tail{i % 50}") for i in range(200)]
    got = near_dedup.near_groups(documents(spark, rows), near_dedup.Params(shingle=2, spread=3)).collect()
    assert pairs(tuple(r) for r in got) == brute_groups(rows, 2)


def test_near_groups_of_nothing(spark):
    assert near_dedup.near_groups(documents(spark, [])).count() == 0
    kept = near_dedup.kept_documents(documents(spark))
    assert kept.columns == documents(spark).columns


# --- byte-level BPE


def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}


def test_bpe_equals_tiktoken_and_decodes(spark):
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    got = byte_bpe.digests(documents(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = []
    for d, t in texts():
        ids = encoding.encode_ordinary(t or "")
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")))
    assert pairs(tuple(r) for r in got) == pairs(want)
    assert byte_bpe.digests(documents(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_ids_round_trip(spark):
    for r in byte_bpe.encoded(documents(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        assert bytes(r.decoded) in {(t or "").encode() for d, t in texts() if d == r.doc_id}


def test_every_piece_is_reached_by_merges():
    bpe = byte_bpe.ByteBpe(ranks(), P.PATTERN)
    characters = byte_bpe.byte_characters()
    assert bpe.model.encode(["".join(characters[b] for b in k) for k in ranks()], num_threads=1) == [[i] for i in ranks().values()]
    some = [k for k in list(ranks())[::97] if k.decode("utf-8", "ignore").encode() == k]
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    for k in some:
        assert bpe.encode([k.decode()])[0].tolist() == encoding.encode_ordinary(k.decode())


# --- token files


def test_token_files_read_back(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [*((d, t) for d, t in dict(texts()).items() if d is not None), (900, "an <|endoftext|> inside"), (901, "<|endoftext|>"), (902, thue_morse(11)[0]), (903, thue_morse(11)[1])]
    path = str(tmp_path / "tokens")
    token_output.write_tokens(documents(spark, rows), path, P.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.catalogue(token_output.read_tokens(spark, path)).collect()}
    at = 0
    for d, t in sorted(rows):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    one = token_output.read_tokens(spark, path).where("doc_id = 303")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,303)]" in one._jdf.queryExecution().toString()
    assert one.count() == 1


def test_token_files_with_nulls_and_copies(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_output.write_tokens(documents(spark), path, P.path("byte_bpe_50k.json"))
    got = token_output.catalogue(token_output.read_tokens(spark, path)).collect()
    assert len(got) == len(texts())
    spans = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


# --- fingerprints


def test_fingerprints(spark):
    rows = sorted(((d, t) for d, t in dict(texts()).items() if d is not None), reverse=True)
    got = {r.doc_id: r for r in syncmers.fingerprints(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == sha(edited)
        if t == edited:
            assert got[d].fingerprint == got[d].edited_fingerprint and got[d].near_edited == 1.0
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    prints = {}
    for d, t in rows:
        prints.setdefault(t or "", set()).add(got[d].fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    assert got[200].fingerprint == got[3].fingerprint != got[201].fingerprint
    assert got[201].near_next == 0.0 and got[400].near_edited > 0.2


def test_fingerprints_of_all_awkward_rows(spark):
    assert syncmers.fingerprints(documents(spark)).count() == len(texts())
    assert syncmers.fingerprints(documents(spark, [])).count() == 0
    one = syncmers.fingerprints(documents(spark, [(5, "abcd")])).collect()
    assert [r.edited_sha256 for r in one] == [sha("abab")]


def test_fingerprints_take_a_digit_a_byte_and_hold_every_anchor():
    import base64
    import random

    rng, p = random.Random(4), syncmers.Params()
    text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(2000)).encode()
    found = syncmers.prints_of([text, b"short", b""], p)
    digits = [syncmers.written(x.stored) for x in found]
    raw = base64.b64decode(digits[0])
    units = [int.from_bytes(raw[i : i + 3], "big") for i in range(0, len(raw), 3)]
    assert [u >> 21 for u in units] == found[0].stored["gap"].tolist()
    assert [u % 2**21 for u in units] == [h % 2**21 for h in found[0].stored["hash"].tolist()]
    assert 0.8 * len(text) < len(digits[0]) < 1.2 * len(text) and [len(x) for x in digits[1:]] == [12, 0]


def test_ranges_hold_little_text_whatever_the_number_of_shuffle_partitions(spark, monkeypatch):
    rows = [(i, f"{i} some words of a text that is not long") for i in range(300)]
    want = sorted(syncmers.fingerprints(documents(spark, rows)).collect())
    monkeypatch.setattr(syncmers, "PART_BYTES", 600)
    assert syncmers.beside_next(documents(spark, rows)).rdd.getNumPartitions() > 15
    assert sorted(syncmers.fingerprints(documents(spark, rows)).collect()) == want


def test_syncmers_are_free_of_context():
    p = syncmers.Params()
    core = b"the quick brown fox jumps over the lazy dog and runs away"
    own = set(syncmers.anchors(np.frombuffer(core, np.uint8), np.array([0, len(core)]), p)[2].tolist())
    longer = b"zz zz " + core + b" and more of it"
    assert own <= set(syncmers.anchors(np.frombuffer(longer, np.uint8), np.array([0, len(longer)]), p)[2].tolist())
    assert own


def test_fingerprints_of_long_texts_hold_all_anchors():
    import random
    from collections import Counter

    rng, p = random.Random(9), syncmers.Params()
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    a, b, shared = ([word() for _ in range(n)] for n in (20_000, 20_000, 60))
    rows = [" ".join(x).encode() for x in (a[:7000] + shared + a[7000:], b[:15_000] + shared + b[15_000:], a[:9000] + ["changed"] + a[9001:], a, b, a[:50], a[:50] * 3)]
    prints = syncmers.prints_of(rows, p)

    def brute(x, y):
        def links(found):
            return [(h, k, e) for (_, h), (e, k) in zip(found, found[1:], strict=False)]

        u, v = ([(int(g), int(h)) for g, h in z.stored] for z in (x, y))
        total = 0
        for one, other in ((u, v), (v, u)):
            left, hit = Counter(links(other)), set()
            for i, k in enumerate(links(one)):
                if left[k]:
                    left[k] -= 1
                    hit |= {i, i + 1}
            total += len(hit)
        return total / 2 / (len(u) + len(v) - total / 2)

    for text, found in zip(rows, prints, strict=True):
        _, at, hashes = syncmers.anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), p)
        assert np.cumsum(found.stored["gap"].astype(int)).tolist() == at.tolist() and found.stored["hash"].tolist() == hashes.tolist()
        assert max(found.stored["gap"]) <= 8 and len(found.stored) > len(text) / 5
    assert syncmers.likeness(prints[0], prints[1]) == brute(prints[0], prints[1]) > 0.001 > syncmers.likeness(prints[3], prints[4])
    assert 0.99 < syncmers.likeness(prints[2], prints[3]) == brute(prints[2], prints[3]) < 1 == syncmers.likeness(prints[3], prints[3])
    assert prints[2].stored.tobytes() != prints[3].stored.tobytes()
    assert 0.3 < syncmers.likeness(prints[5], prints[6]) < 0.4


# --- licences

SCANNED = [
    (1, "Released under the MIT License. Under the MIT license!"),
    (2, "Apache License, Version 2.0 cc-by-nc CC BY NC"),
    (3, "# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception\ncode"),
    (4, "SPDX-License-Identifier: GPL-3.0-only"),
    (5, None),
    (6, ""),
    (7, "under the mit licenses"),
]


def test_license_scan(spark):
    got = {r.doc_id: r for r in license_scan.scan(documents(spark, SCANNED)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (2, 1, 5, "mit")
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 0, 8, "apache-2,cc-by-nc")
    assert got[3].labels == "apache-2,gpl-2.0-only,mit" and got[3].permitted is True and got[3].base_labels == ""
    assert got[4].permitted is False
    for i in (5, 6, 7):
        assert (got[i].n_base, got[i].first_word, got[i].labels, got[i].score) == (0, None, "", 0.0)


@pytest.mark.parametrize(
    ("text", "want"),
    [("mit or apache-2.0 and isc", "mit apache-2 isc and or"), ("(mit or isc) and zlib", "mit isc or zlib and"), ("gpl-2.0 with foo or mit", "gpl-2.0 foo with mit or"), ("mit or", "mit"), ("(mit", "mit"), ("", ""), ("and mit", ""), ("mit mit", "mit"), (") mit", "")],
)
def test_shunting_yard(text, want):
    assert " ".join(license_scan.postfix(text)) == want
    license_scan.evaluated(text)


def test_license_base_equals_brute_force(spark):
    rows = [(i, f"{t} under the mit license {t} cc by nc cc by nc") for i, (_, t) in enumerate(texts()[:9])]
    for r in license_scan.scan(documents(spark, rows)).collect():
        w = WORD.findall(lower(rows[r.doc_id][1]))
        at = [i for p in license_scan.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at), max(at))


# --- quality


def test_quality_on_held_out_documents(spark):
    import random

    rng = random.Random(5)
    words = [a + b for a in ("an", "er", "tion", "the", "of") for b in ("sh", "or", "nd", "ing", "ly")]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(20, 80))) + "."
    junk = [lambda: " | ".join(rng.choice(words) for _ in range(40)), lambda: " ".join([rng.choice(words)] * 60), lambda: " ".join(rng.choice(words).upper() + "!!" for _ in range(40)), lambda: " ".join(rng.choice(words) + rng.choice(["###", "$$$"]) for _ in range(40))]
    rows = [(i, good() if i % 5 else rng.choice(junk)()) for i in range(600)] + [(1000, None), (1001, ""), (None, good())]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 600) if i % 2] + [(None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    docs = documents(spark, rows)
    got = {r.doc_id: r.kept for r in quality.judged(docs, labels).collect()}
    right = [got[i] == (i % 5 > 0) for i in range(0, 600, 2)]  # none of these is labelled
    assert sum(right) / len(right) > 0.97
    assert got[1000] and got[1001] and got[None]
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def brute_ngrams(text, buckets):
    """Buckets of all n-grams of a text, token by token; only the hash functions are the operator's."""
    mix = lambda x: int(quality.splitmix(np.array([x % 2**64], np.uint64))[0])
    raw = (text or "").encode()
    tokens, shapes, last = [], [], None
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+", raw):
        t = m[0]
        is_word = bool(re.match(rb"[0-9A-Za-z\x80-\xff]", t))
        lower = np.frombuffer(t.lower(), np.uint8)
        own = int(quality.BYTE_HASH(lower, np.array([0]), np.array([len(t)]))[0])
        upper, small = sum(65 <= b <= 90 for b in t), sum(97 <= b <= 122 for b in t)
        shape = (1 if re.search(rb"[0-9]", t) else 2 if upper > 1 and not small else 3 if upper > 1 else 4 if upper else 5) if is_word else own
        same = is_word and own == last
        last = own if is_word else last
        tokens.append(6 if same else own)
        shapes.append(6 if same else shape)
    salt = [int(x) for x in quality._SALTS]
    pair = lambda a, b: mix(a * salt[5] + b)
    two = [pair(a, b) for a, b in zip(shapes, shapes[1:], strict=False)]
    kinds = [tokens, [pair(a, b) for a, b in zip(tokens, tokens[1:], strict=False)], shapes, two, [pair(a, b) for a, b in zip(two, shapes[2:], strict=False)]]
    return [mix(x ^ s) % buckets for s, kind in zip(salt, kinds, strict=False) for x in kind]


def test_ratios_and_sample_equal_brute_force(spark):
    import math
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    rng = random.Random(6)
    share = lambda i: i / 400  # noqa: E731  from all plain to all shouted, so scores are close together
    text = lambda i: " ".join(w.upper() + "!!" if rng.random() < share(i) else w for w in (rng.choice(["sun", "Moon", "star", "is", "is", "Ring", "1st"]) for _ in range(30)))
    rows = [(i, text(i)) for i in range(400)] + [(400, None), (401, "")]
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 400, 2)] + [(8, 0, 0)], "doc_id bigint, quality int, toxic int")
    p = quality.Params(buckets=256)
    docs = documents(spark, rows)
    model = quality.fitted(docs, labels, p)
    fold = {r.doc_id for r in labels.where((F.col("quality") == 1) & (F.pmod(F.xxhash64("doc_id", F.lit(p.seed + 1)), F.lit(2)) == 0)).collect()}
    grams = {d: brute_ngrams(t, p.buckets) for d, t in rows}
    raw, target = Counter(x for g in grams.values() for x in g), Counter(x for d in fold for x in grams[d])
    n, m = sum(raw.values()), sum(target.values())
    weight = [math.log((target[b] + 0.5) / (m + 128)) - math.log((raw[b] + 0.5) / (n + 128)) for b in range(256)]
    assert np.allclose(model.weights / 2**20, weight, atol=1e-6)
    score = {d: sum(weight[x] for x in g) / (len(g) + p.few) for d, g in grams.items()}
    got = {r.doc_id: r for r in quality.judged(docs, labels, p).collect()}
    assert all(math.isclose(got[d].score, s, abs_tol=1e-5) and got[d].n_ngrams == len(grams[d]) for d, s in score.items())
    k = sum(r.score >= model.cut for r in got.values())
    best = sorted(got.values(), key=lambda r: -r.key)[:k]
    assert {d for d, r in got.items() if r.kept} == {r.doc_id for r in best}
    noise = [r.key - r.score / p.temperature for r in got.values()]
    assert abs(sum(noise) / len(noise) - 0.5772) < 0.25 and len(set(noise)) == len(noise)
    moved = sum(r.kept != (r.score >= model.cut) for r in got.values())
    assert 10 < moved < 200  # a sample, not the cut itself
    assert np.mean([got[i].kept for i in range(0, 60)]) > 0.9 > 0.25 > np.mean([got[i].kept for i in range(340, 400)])


def test_quality_without_labels_or_documents(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.kept for r in quality.judged(documents(spark), labels).collect()} == {True}
    assert quality.judged(documents(spark, []), labels).count() == 0
    assert quality.good_documents(documents(spark, []), labels).count() == 0


def test_kth_largest(spark):
    values = [3.0, 1.0, 2.0, 2.0, -5.5, 1e9, 7.25] * 3
    table = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 5, 11, 21):
        assert quality.kth_largest(table, "x", k, bins=3) == sorted(values, reverse=True)[k - 1]


# --- pages

PAGES = [
    (1, "u", "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><header>Site</header><aside>Side bar text here</aside><div class='ad'>Buy now &amp; here</div><article><h1>Ti&amp;tle</h1><p><b>One  two</b>\n three<br><p>Fo<i>u</i>r &lt;5&gt;.<script>var a='</p>';</script><div class=\"comments\"><p>Nice post</p></div><footer>tags</footer></article><div id=cookie-notice>We use cookies</div><form><input><p>Sign up</p></form><footer>&copy; x</footer></body></html>"),
    (2, "u", "<p>A long paragraph of text with enough words to be counted as such by any tree there is today.</p><p>Another paragraph which has a fair number of words too, so that it stays.</p>"),
    (3, None, None),
    (4, "u", ""),
    (5, "u", "no markup at all"),
    (6, "u", "<article>unclosed <b>bold<p>next & last"),
    (7, "u", "<" * 50 + "article>" + "<!-- open comment"),
]


def test_html_text(spark):
    from heliograph.llm import html_text

    pages = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    assert got[1] == "Ti&tle One two three Four <5>."
    assert got[2].startswith("A long") and got[2].endswith("it stays.")
    assert got[3] == got[4] == ""
    assert got[5] == "no markup at all"
    assert got[6] == "unclosed bold next & last"
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_html_text_on_the_tables(spark):
    from heliograph.llm import html_text

    for r in html_text.extracted(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", inner))).split())
        assert r.text == want and r.n_chars == len(want)


def test_contamination_of_repeated_words_is_linear(spark):
    import time

    bench = spark.createDataFrame([(1, "a " * 100_000), (2, "a " * 9), (3, "b a " * 30_000)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a " * 100_000), (2, "b a " * 100_000), (3, "c " * 50)], "doc_id bigint, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.summary(decontaminate.contamination(docs, bench)).collect()}
    assert time.perf_counter() - began < 30
    assert got == {1: (100_000, 100_000, 2), 2: (200_000, 200_000, 1), 3: (50, 0, 0)}


def test_contamination_of_repetitive_texts_equals_brute_force(spark):
    import random

    rng = random.Random(8)
    items = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(3, 40)))) for k in range(6)] + [(9, "a " * 30), (10, "a " * 30)]
    rows = [(k, " ".join(rng.choice("aab") for _ in range(rng.randint(0, 120)))) for k in range(40)]
    got = decontaminate.summary(decontaminate.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))).collect()
    assert pairs(tuple(r) for r in got) == brute_contamination(rows, items)


def test_chat_format_of_hostile_texts_is_linear(spark):
    import time

    from heliograph.llm import chat_format

    table = [(1, 0, "user", " </s>" + "<<ROLE>>" * 130_000), (1, 1, "assistant", "ok"), (2, 0, "a<<ROLE>>b", "x"), (2, 1, "tool", "y <</ROLE>>"), (3, 0, "user", " </s>" + "[INST] " * 150_000), (3, 1, "assistant", "<s> " * 100_000)]
    began = time.perf_counter()
    got = chat_format.formatted(spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert time.perf_counter() - began < 30
    for r in got:
        assert r["identical"] and [tuple(t) for t in r["turns"]] == [(role, text) for c, _, role, text in table if c == r["conv_id"]]


def test_rows_of_one_id_meet_as_distinct_texts(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    near = lambda k: " ".join([*base[:k], f"x{k}", *base[k + 1 :]])
    rows = [(1, near(rng.randrange(6))) for _ in range(600)] + [(2, near(6 + rng.randrange(6))) for _ in range(600)] + [(3, "far away " * 30), (4, near(50)), (5, "far away " * 30)]
    docs = documents(spark, rows).repartition(5)
    assert pairs(tuple(r) for r in near_dedup.near_groups(docs, near_dedup.Params(shingle=2)).distinct().collect()) == sorted({tuple(r) for r in brute_groups(rows, 2)}, key=str)
    signed = near_dedup.signatures(docs, near_dedup.Params(shingle=2)).groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id())
    texts_of = near_dedup.distinct_texts(docs, signed).collect()
    assert len(texts_of) == len({t for _, t in rows}) == len({r["node"] for r in texts_of})


def test_a_shingle_of_very_many_documents_is_dealt(spark):
    import random

    rng = random.Random(10)
    rows = []
    for k in range(120):  # groups of two near copies each, all with one long common passage of half their words
        own = [f"d{k // 2}_{j}" for j in range(60)]
        own[rng.randrange(60)] = f"z{k}"
        rows.append((k, " ".join([f"c{j}" for j in range(rng.choice([20, 40]))] + own)))
    for strip in (2000, 5):
        got = near_dedup.near_groups(documents(spark, rows), near_dedup.Params(shingle=2, strip=strip, bands=4, rows=1)).collect()
        assert pairs(tuple(r) for r in got) == brute_groups(rows, 2)
