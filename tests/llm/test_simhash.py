"""SimHash groups against all pairs; thresholds and parts against the principle that they rest on."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from tests.llm.fixtures import documents, sentence, texts

from heliograph.llm import queries, simhash
from heliograph.llm.words import LOWER_TRANSLATE


def brute_print(text):
    words = (text or "").encode().translate(LOWER_TRANSLATE).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    root = {p: p for _, p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(root, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return sorted(((i, f"{p:016x}", least.get(find(p))) for i, p in prints), key=str)


def got(df):
    return sorted(((r["doc_id"], f"{r['print'] % (1 << 64):016x}", r["component_id"]) for r in df.collect()), key=str)


def clouds(seed=5):
    """Texts whose fingerprints lie close: long texts with few words changed, and many copies of them."""
    rng = random.Random(seed)
    base = [sentence(rng, 400).split() for _ in range(4)]
    rows = []
    for k in range(300):
        words = list(base[k % 4])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(50)}"
        rows.append((5000 - k, " ".join(words)))
    return rows + rows[:40]


@pytest.mark.parametrize("p", [simhash.Params(), simhash.Params(key_cost=0.01), simhash.Params(block=3, key_cost=1e6), simhash.Params(most_parts=3)])
def test_groups_equal_all_pairs(spark, p):
    rows = texts() + clouds()
    assert got(simhash.near_groups(documents(spark, rows).repartition(3), p)) == brute_groups(rows)


def test_groups_of_an_empty_table(spark):
    assert simhash.near_groups(documents(spark, [])).collect() == []


def test_groups_of_one_row_and_of_nulls(spark):
    assert got(simhash.near_groups(documents(spark, [(None, None), (None, " ")]))) == [(None, "0" * 16, None)] * 2
    assert got(simhash.near_groups(documents(spark, [(None, None), (4, ""), (2, "\t")]))) == [(2, "0" * 16, 2), (4, "0" * 16, 2), (None, "0" * 16, 2)]


def test_query_on_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op12_simhash_dedup(spark, folder).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=str) == brute_groups(rows)


def test_long_text_is_read_whole():
    text = sentence(random.Random(2), 70_000)
    assert simhash.fingerprint(text.encode()) == brute_print(text)


def test_thresholds_keep_every_pair_in_reach():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2, (500, 64))
    prints[:, 1], prints[:, 7] = prints[:, 0], prints[:, 0]
    both = prints.T @ prints
    for m in range(2, 6):
        groups = simhash.grouped_places(both, len(prints), m)
        assert sorted(k for g in groups for k in g) == list(range(64))
        assert any({0, 1, 7} <= set(g) for g in groups)
        costs = [{e: 0.0 if e < 0 else rng.random() * 10**e for e in range(-1, 5)} for _ in range(m)]
        thresholds = simhash.shared(costs, 4 - m + 1)
        assert sum(thresholds) == 4 - m + 1
        for _ in range(300):  # any four places: some part holds no more of them than its threshold
            where = set(rng.choice(64, 4, replace=False).tolist())
            assert any(len(where & set(g)) <= e for g, e in zip(groups, thresholds, strict=True))


def test_cheapest_thresholds_by_trying_all():
    from itertools import product

    rng = random.Random(4)
    for _ in range(20):
        costs = [{e: 0.0 if e < 0 else rng.random() * 10**e for e in range(-1, 5)} for _ in range(3)]
        best = min((t for t in product(range(-1, 5), repeat=3) if sum(t) == 2), key=lambda t: sum(c[e] for c, e in zip(costs, t, strict=True)))
        assert simhash.shared(costs, 2) == list(best)


def test_more_fingerprints_take_wider_parts():
    counts = [simhash.part_count(n, simhash.Params()) for n in (10**3, 10**6, 10**9, 10**11)]
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
