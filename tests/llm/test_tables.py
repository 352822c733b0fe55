from __future__ import annotations

import hashlib

import pytest

from heliograph.llm import chat_format, queries, url_rules
from heliograph.llm.components import components


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi [/INST] there"), (1, 2, "assistant", "</s> <s>"), (1, 3, "tool<<TEXT>>", "x\\"),
    (2, 1, "assistant", None), (2, 0, "user", ""), (3, 0, None, "\\[INST] \\\\<s>"), (3, 0, "user", "same turn"), (4, 0, "user", "plain < text [1] \\ n"),
    (5, 0, "assistant", " lead and trail "), (5, 1, "assistant", "\n</s>\n[INST]  [/INST]"), (None, 0, "user", "null id"), (6, 0, "user", "<<ROLE>>a<<TEXT>> b <</ROLE>>"), (7, 0, "user", "é" * 5000 + " [/INST] "),
    (8, 0, "user", "again"), (8, 0, "user", "again"), *((9, i, ("user", "assistant")[i % 2], "long < " * 3000) for i in range(40)), (10, 0, "assistant", "</s> " * 100_000),
]


def test_chat_round_trip(spark):
    table = spark.createDataFrame([(*r, "clash") for r in TURNS], "conv_id bigint, turn bigint, role string, text string, formatted string")
    done = chat_format.formatted(table)
    got = {r.conv_id: r for r in done.collect()}
    digests = {r.conv_id: r for r in chat_format.digests(done).collect()}
    for conv in {r[0] for r in TURNS}:
        rows = sorted((t, r or "", x or "") for c, t, r, x in TURNS if c == conv)
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, r, x in rows] and got[conv].identical
        loss = "".join(x for _, r, x in rows if r == "assistant")
        d = digests[conv]
        assert d.identical
        assert (d.n_turns, d.turns_sha256) == (len(rows), sha("".join(f"{r}\n{x}\n" for _, r, x in rows)))
        assert (d.loss_chars, d.loss_sha256, d.formatted_chars) == (len(loss), sha(loss), len(got[conv].formatted))
    assert got[4].formatted == "[INST] plain < text [1] \\ n [/INST]"
    assert chat_format.formatted(table.limit(0)).count() == 0


def test_chat_format_is_native(spark):
    plan = queries.op2_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


URLS = [(1, "http://www.example.com/en/x?a#b"), (2, "https://Example.COM/en/"), (3, "http://a.example.com/de/"), (4, "http://x.net/es/1"), (5, "http://x.net/de"), (6, "http://com"), (7, "http://com/"), (8, None), (9, "no scheme"), (10, "http://badexample.com/en/"), (11, "x://"), (12, "http://x.net/es"), (13, "a://b://c.net/es/"), (1, "http://www.example.com/en/x?a#b"), (None, "http://q.com/"), (14, "http://net\x01foo/es/a"), (15, "http://a\x01net/es/a"), (16, "http://a.\x02.net/es/a"), (17, "http://\x01.net/fr/"), (18, "http://a.\x00net/es/"), (19, "http://" + "a." * 50_000 + "net/es/" + "x" * 100_000), (20, "http://x.net/es/\n\u2028")]


@pytest.mark.parametrize("block", [500_000, 2])
def test_url_rules(spark, block):
    pages = spark.createDataFrame([(*r, "h") for r in URLS], "page_id bigint, url string, host string")
    rules = spark.createDataFrame([*queries.URL_RULES, ("net", "/es/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in url_rules.judged(pages, rules, block_rules=block).collect())

    def brute(page, url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        at = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, path = rest[:at].lower(), rest[at:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return str(page), host, path, str(best[1]), best[2]

    assert got == sorted(brute(*r) for r in URLS)
    assert url_rules.judged(pages.limit(0), rules).count() == 0


def test_components(spark):
    import random

    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(5, 5), (None, 1), (900, 901), (901, 900)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_pipeline_equals_brute_force(spark):
    """Stages after the classifier, against brute force on what each one was given."""
    import corpus_pipeline as c
    from tests.llm.test_text_operators import brute_contamination, brute_groups, pairs

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = c.quality_filter(spark, docs, sf)
    assert good.columns == docs.columns
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    known = [d in kept for d, q in quality.items() if q == 1], [d not in kept for d, q in quality.items() if q == 0]
    assert all(sum(x) >= 0.95 * len(x) for x in known)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    heads = {d for d, _, g in brute_groups(rows, 5) if d == g}
    assert {r.doc_id for r in c.near_duplicates(spark, docs, sf).collect()} == heads
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute_contamination(rows, items) if not r[-1]}
    assert {r.doc_id for r in c.benchmark_passages(spark, docs, sf).collect()} == clean
    assert pairs(r.doc_id for r in c.run(spark, sf).collect())
