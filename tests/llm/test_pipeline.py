"""The pipeline's stages on the awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import hashlib

import pytest
from tests.llm.fixtures import documents, texts
from tests.llm.test_text_operators import ITEMS, brute_contamination, brute_groups, pairs

pytest.importorskip("public_tokenizers")
c = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def folder(spark, tmp_path):
    def made(docs, labels, items):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return made


def rows_of(df):
    return pairs((r.doc_id, r.text) for r in df.collect())


def test_stages_on_awkward_rows(spark, folder):
    docs = documents(spark)
    sf = folder(docs, [(3, 1, 0), (3, 0, 0), (None, 1, 0), (5, None, None)], ITEMS)
    good = c.quality_filter(spark, docs, sf)
    assert good.columns == docs.columns and {r[0] for r in rows_of(good)} <= {d for d, _ in texts()}
    heads = [(d, g) for d, _, g in brute_groups(texts(), 5)]
    dropped = {d for d, g in heads if d is not None and d != g}
    one = c.near_duplicates(spark, docs, sf)
    assert one.columns == docs.columns and rows_of(one) == pairs((d, t) for d, t in texts() if d is None or d not in dropped)
    clean = c.benchmark_passages(spark, docs, sf)
    bad = {(d, n) for d, n, *_, hit in brute_contamination(texts(), ITEMS) if hit}
    assert clean.columns == docs.columns and len(rows_of(clean)) == len(texts()) - sum(hit for *_, hit in brute_contamination(texts(), ITEMS)) and bad
    assert pairs((r.doc_id, r.decoded_sha256) for r in c.tokens(spark, docs, sf).collect()) == pairs((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in texts())


def test_run_without_labels_or_benchmark(spark, folder):
    """Without labels and items only near copies go, and every stage takes what the one before it kept."""
    sf = folder(documents(spark), [], [])
    dropped = {d for d, _, g in brute_groups(texts(), 5) if d is not None and d != g}
    want = [(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in texts() if d is None or d not in dropped]
    assert pairs((r.doc_id, r.decoded_sha256) for r in c.run(spark, sf).collect()) == pairs(want)


def test_run_on_an_empty_table(spark, folder):
    assert c.run(spark, folder(documents(spark, []), [(1, 1, 0), (2, 0, 0)], ITEMS)).count() == 0
