"""Quality classifier by importance resampling.

Two bags of hashed n-grams are estimated: one from labelled good documents (the
target), one from all documents (the raw text). A document's score is the mean
log ratio of both models over its n-grams, drawn towards 0 for few n-grams.
Documents are sampled without replacement by Gumbel top-k on the scaled score:
k is the number of documents whose score reaches a cut, and the cut is set on
labelled documents that the target model has not seen. A document at the cut is
kept in about two of three draws, one that is below it by d temperatures with a
chance of about exp(-d), one above it by d is lost with about exp(-exp(d)).

N-grams: single and double tokens, and single, double and triple token shapes.
Tokens are runs of word characters or of symbols; a word that repeats the word
before it becomes a mark of its own, so that loops look alike in all languages.

Null and empty texts have no n-gram and score 0. Equal texts score alike; their
Gumbel numbers come from ``doc_id`` (null: 0), so rows with equal ids and texts
share their fate; with equal keys at the last place, all of them are kept. A
document with both labels counts for both kinds. Texts of any length are read
whole. Without labels of both kinds the cut keeps everything. Other columns
pass through unread. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.session import removed, written
from heliograph.llm.words import BYTE_HASH, runs, seeds, spans, splitmix


@dataclass(frozen=True)
class Params:
    """``sample``: most labelled documents of each kind and fold that are used to fit. ``temperature``: size of the Gumbel numbers against scores."""

    buckets: int = 1 << 14
    sample: int = 3_000
    few: float = 8.0
    temperature: float = 0.1
    seed: int = 7


@dataclass
class Model:
    """``weights``: log ratio of every bucket, in units of 2**-20, so that sums are exact."""

    params: Params
    weights: np.ndarray
    cut: float = float("-inf")
    report: dict = field(default_factory=dict)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    classes, low = np.full(256, 2, np.uint8), np.arange(256, dtype=np.uint8)
    for b in range(256):
        if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128:
            classes[b] = 1
        elif b <= 32:
            classes[b] = 0
    low[65:91] += 32
    return classes, low


CLASSES, LOW = _tables()
_SALTS = seeds(6, 31)


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and for each the row that it belongs to."""
    classes = CLASSES[data]
    starts, ends = spans(classes, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    token = BYTE_HASH(LOW[data], starts, ends)
    word = classes[starts] == 1
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    upper, lower, digit = (c[ends] - c[starts] for c in (count((data >= 65) & (data <= 90)), count((data >= 97) & (data <= 122)), count((data >= 48) & (data <= 57))))
    shape = np.where(digit > 0, 1, np.where((upper > 1) & (lower == 0), 2, np.where(upper > 1, 3, np.where(upper == 1, 4, 5)))).astype(np.uint64)
    shape = np.where(word, shape, token)
    at = np.flatnonzero(word)
    again = at[1:][(token[at[1:]] == token[at[:-1]]) & (row[at[1:]] == row[at[:-1]])]
    token[again] = np.uint64(6)
    shape[again] = np.uint64(6)
    same2 = row[1:] == row[:-1]
    same3 = same2[1:] & same2[:-1]
    pair = lambda x: splitmix(x[:-1] * _SALTS[5] + x[1:])
    two = pair(shape)
    three = splitmix(two[:-1] * _SALTS[5] + shape[2:])
    kinds = [(token, None), (pair(token), same2), (shape, None), (two, same2), (three, same3)]
    found, rows = [], []
    for salt, (x, keep) in zip(_SALTS, kinds, strict=False):
        bucket = (splitmix(x ^ salt) % np.uint64(buckets)).astype(np.int64)
        found.append(bucket if keep is None else bucket[keep])
        own = row[: len(x)]
        rows.append(own if keep is None else own[keep])
    return np.concatenate(found), np.concatenate(rows)


def bucket_counts(docs: DataFrame, p: Params) -> np.ndarray:
    """N-grams of all documents in each bucket. Each task adds up its own; at most ``p.buckets`` sums reach the driver."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for batch in batches:
            for _, data, offsets in runs(batch, 0):
                total += np.bincount(features(data, offsets, p.buckets)[0], minlength=p.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    sums = docs.select("text").mapInArrow(kernel, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(p.buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def row_scores(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """N-grams and score of every row."""
    bucket, row = features(data, offsets, model.params.buckets)
    n = np.bincount(row, minlength=len(offsets) - 1)
    order = np.argsort(row, kind="stable")
    total = np.concatenate([[0], np.cumsum(model.weights[bucket[order]])])
    ends = np.cumsum(n)
    return n, (total[ends] - total[ends - n]) / float(1 << 20) / (n + model.params.few)


def gumbel_keys(ids: pa.Array, score: np.ndarray, model: Model) -> np.ndarray:
    """Scaled score plus a Gumbel number from the document's id."""
    numbers = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    uniform = ((splitmix(splitmix(numbers ^ seeds(1, model.params.seed)[0])) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
    return score / model.params.temperature - np.log(-np.log(uniform))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``n_ngrams``, ``score`` and Gumbel ``key`` of every document. Map only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch, 1):
                n, score = row_scores(data, offsets, shared.value)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n.astype(np.int64)), pa.array(score), pa.array(gumbel_keys(rows.column(0), score, shared.value))], names=["doc_id", "n_ngrams", "score", "key"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(kernel, "doc_id bigint, n_ngrams bigint, score double, key double")


def best_cut(good: np.ndarray, bad: np.ndarray) -> tuple[float, dict]:
    """The cut of best balanced accuracy, in the middle of the scores around it; keeps everything where a kind is missing."""
    if not len(good) or not len(bad):
        return float("-inf"), {"good": len(good), "bad": len(bad)}
    values = np.unique(np.concatenate([good, bad]))
    kept = 1 - np.searchsorted(np.sort(good), values) / len(good)
    thrown = np.searchsorted(np.sort(bad), values) / len(bad)
    best = int(np.argmax(kept + thrown))
    cut = (values[best] + values[max(best - 1, 0)]) / 2
    return float(cut), {"good": len(good), "bad": len(bad), "good_kept": float((good >= cut).mean()), "bad_thrown": float((bad < cut).mean())}


def fitted(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Fit both models and the cut. Raw counts cover all documents; labels are a bounded sample by hash of the id.

    Labelled documents of either fold are picked by id, at most ``p.sample`` of
    each kind, so the ids are broadcast.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").alias("labelled"), "quality").distinct()
    order = F.xxhash64("labelled", F.lit(p.seed))
    part = lambda quality, fold: known.where((F.col("quality") == quality) & (F.pmod(F.xxhash64("labelled", F.lit(p.seed + 1)), F.lit(2)) == fold)).orderBy(order, "labelled").limit(p.sample)
    picked = lambda ids: docs.join(F.broadcast(ids), docs["doc_id"] == ids["labelled"])  # noqa: E731  at most 2 * p.sample ids
    target = bucket_counts(picked(part(1, 0)), p)
    raw = bucket_counts(docs, p)
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * p.buckets)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * p.buckets))
    model = Model(p, np.round(ratio * (1 << 20)).astype(np.int64) if target.any() else np.zeros(p.buckets, np.int64))
    held_out = picked(part(1, 1).unionByName(part(0, 1)).unionByName(part(0, 0)))
    result = scored(held_out.select("doc_id", "text"), model).join(F.broadcast(part(0, 1).unionByName(part(0, 0)).select("labelled", F.lit(1).alias("is_bad"))), F.col("doc_id") == F.col("labelled"), "left").select("score", "is_bad").toArrow()
    score, bad = result["score"].to_numpy(), result["is_bad"].is_valid().to_numpy()
    model.cut, model.report = best_cut(score[~bad], score[bad])
    return model


def kth_largest(table: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column, by counting in ever narrower bins; nothing is sorted or gathered but bin counts."""
    if k <= 0:
        return float("inf")
    low, high = table.agg(F.min(column), F.max(column)).first()
    if low is None:
        return float("-inf")
    above, inside = 0, table
    while True:
        width = (high - low) / bins
        if not width > abs(low) * 1e-15:
            return low
        counts = inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for r in counts:
            if above + r["n"] >= k:
                break
            above += r["n"]
        if r["low"] == r["high"] or above + r["n"] == k:
            return r["low"]
        low, high = r["low"], r["high"]
        inside = table.where(F.col(column).between(low, high))


def threshold(table: DataFrame, model: Model) -> float:
    """The least key that Gumbel top-k keeps."""
    return kth_largest(table, "key", table.where(F.col("score") >= model.cut).count())


def judged(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id``, ``n_ngrams``, ``score``, ``key`` and ``kept`` of every document."""
    model = fitted(docs, labels, p)
    table, _ = written(scored(docs, model), "scores")
    return table.withColumn("kept", F.col("key") >= threshold(table, model))


def good_documents(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` that the sample keeps, columns unchanged. Scores are taken again on the way, so no text is shuffled."""
    model = fitted(docs, labels, p)
    table, path = written(scored(docs, model).select("score", "key"), "scores")
    least = threshold(table, model)
    removed(docs.sparkSession, path)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch, text_at):
                _, score = row_scores(data, offsets, shared.value)
                yield rows.filter(pa.array(gumbel_keys(rows.column(id_at), score, shared.value) >= least))

    return docs.mapInArrow(kernel, docs.schema)
