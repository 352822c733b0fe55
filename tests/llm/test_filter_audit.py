"""The filter audit against one walk of every document through every order."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import permutations

from tests.llm.fixtures import texts

from heliograph.llm import filter_audit


def brute(rows, labels):
    """Rows of (doc_id, text, source); labels of (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = defaultdict(list)
    for i, t, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {k for k, bad in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t), i is not None and i > least[t]], strict=True) if bad}
        docs[source or ""].append((i, fails))
    out = []
    for part, members in docs.items():
        removed_by, steps = defaultdict(int), []
        for order in map("".join, permutations("ABCDE")):
            alive = members
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if f in d[1]]
                alive = [d for d in alive if f not in d[1]]
                removed_by[f] += len(gone)
                steps.append((order, step, f, len(alive), len(gone), sum(f in d[1] for d in members) - len(gone), sum(d[1] == {f} for d in members), sum(d[0] in good for d in gone if d[0] is not None), sum(d[0] in toxic for d in gone if d[0] is not None)))
        out += [(part, o, s, *rest, removed_by[f]) for o, s, f, *rest in steps]
    return sorted(out)


def table():
    rows = [(i, t, ["a", "b", None, ""][k % 4]) for k, (i, t) in enumerate(texts())]
    long = " ".join(f"w{k}" for k in range(250))
    rows += [(900 + k, long + [" #", "", "", " ABCDEFGHIJKLMNOPQRSTUVWXYZ", " W%"][k % 5], "a") for k in range(20)]
    rows += [(901, long, "b"), (901, long, "b"), (None, long, "c"), (950, "same same " * 200, "c"), (951, "X " * 300, "d & e")]
    return rows


LABELS = [(900, 1, 0), (901, 0, 1), (901, 1, None), (905, None, None), (3, 1, 1), (None, 1, 1), (906, 1, 1), (910, 2, 5), (951, 1, 0)]


def test_audit_equals_brute_force(spark):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in table()], "doc_id bigint, text string, source string, mask int, part string, n int").repartition(4)
    labels = spark.createDataFrame([(*r, "y") for r in LABELS], "doc_id bigint, quality int, toxic int, text string")
    assert sorted(map(tuple, filter_audit.audit(docs, labels).collect())) == brute(table(), LABELS)


def test_audit_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(table(), "doc_id bigint, text string, source string")
    assert sorted(map(tuple, filter_audit.audit(docs, empty).collect())) == brute(table(), [])
    assert filter_audit.audit(docs.limit(0), empty).collect() == []


def test_wide_integers_hold_large_counts():
    total = sum((1 << 60) * filter_audit.wide()[m] for m in (0, 1, 31, 1, 0, 0, 0))
    counts = filter_audit.unpacked(total)
    assert counts[0, 0].tolist() == [4 << 60, 3 << 60, 0]
    assert (counts.sum(2) <= 7 << 60).all()
