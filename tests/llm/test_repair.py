"""Conversation repair against a search over all edits, chunk by chunk and whole."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from heliograph.llm import queries, repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def brute_repair(rows):
    """Least (cost, audit) with its repaired rows, from all ways to edit rows of (role, text, fault), last row first."""
    fit = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    after = {q: NEXT[q][fit[q][0]] for q in NEXT}
    ends = {0: (0, "", []), 3: (0, "", [])}
    best = {q: ends.get(q) for q in NEXT}

    def inserted(best):
        for _ in range(3):
            for q in NEXT:
                if best[after[q]] is not None:
                    c, s, r = best[after[q]]
                    x = (c + 3, "I" + s, [(fit[q], ""), *r])
                    best[q] = x if best[q] is None or x[:2] < best[q][:2] else best[q]
        return best

    best = inserted(best)
    for role, text, fault in reversed(rows):
        now = {}
        for q in NEXT:
            more = 3 if fault == "truncated" else 0
            ways = [(best[q][0] + 4, "D" + best[q][1], best[q][2])]
            if fault not in ("blank", "duplicate"):
                x = best[after[q]]
                ways.append((x[0] + 3 + more, "R" + x[1], [(fit[q], text), *x[2]]))
                if (to := NEXT[q].get(role[:1])) is not None:
                    ways.append((best[to][0] + more, "K" + best[to][1], [(role, text), *best[to][2]]))
            now[q] = min(ways, key=lambda w: w[:2])
        best = inserted(now)
    return best[0]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_query(table):
    """The contract of the query, row by row."""
    told = lambda x: " " if x is None else str(x)
    by = defaultdict(list)
    for conv, turn, role, text in table:
        by[conv]
        role, text = told(role), told(text)
        harm = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        by[conv] += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    out = []
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        said = faults([r[1:] for r in rows])
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, kept = brute_repair([(r[1], r[2], f) for r, f in zip(rows, said, strict=True)]) if rows else (0, "", [])
        assert GRAMMAR.fullmatch("".join(r[0][:1] for r in kept))
        bad = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, said.count("blank"), said.count("duplicate"), said.count("truncated"), bad, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed=3, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice(["Hello.", "And you?", "Fine!", "it stops", "it stops ", " \t\n", "", None, "日本。", "x. \x0b"])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    rows += [(None, 0, "user", "No id."), (None, None, None, None), (1000, 5, "user", "a" * 200_000 + "."), (1000, 6, "assistant", "Yes.")]
    for turn in range(300):  # one conversation with very many rows
        rows.append((2000, turn // 2, ["user", "assistant"][turn % 2] if turn % 7 else "tool", f"Turn {turn % 40}." if turn % 5 else "open"))
    return rows


def rows_of(df):
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos string, code int, at double"


@pytest.mark.parametrize("bits", [12, 2])
def test_repair_equals_search_whatever_the_chunks(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    table = conversations()
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in table], SCHEMA).repartition(5)
    assert rows_of(repair.audited(df)) == brute_query(table)


def test_repaired_turns_are_given(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Yes.")], "conv_id bigint, turn bigint, role string, text string")
    summary, turns = repair.repaired(df)
    assert [(r["cost"], r["audit"]) for r in summary.collect()] == [(3, "RK")]
    assert [(r["role"], r["text"]) for r in turns.orderBy("pos", "k").collect()] == [("user", "Hi."), ("assistant", "Yes.")]


def test_repair_of_an_empty_table(spark):
    assert repair.audited(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_on_given_conversations(spark):
    folder = "/root/testdata/sf0.01"
    table = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op11_conversation_repair(spark, folder)) == brute_query(table)


def test_ranks_order_nodes_as_their_letters():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 30, 40)
    at = np.concatenate([[0], np.cumsum(sizes)])
    codes = rng.integers(0, 16, at[-1])
    found = repair.ways(codes, at, np.tile(repair.END_COST, (len(sizes), 1)))
    letters, last = found.path(np.arange(len(found.rank)))
    order = sorted(range(len(letters)), key=letters.__getitem__)
    assert all((found.rank[a] < found.rank[b]) == (letters[a] < letters[b]) for a, b in zip(order, order[1:], strict=False))
    assert (found.length == [len(x) for x in letters]).all()
    assert set((last // 4).tolist()) == set((at[1:] + np.arange(len(sizes))).tolist())
