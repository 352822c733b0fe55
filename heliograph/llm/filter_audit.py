"""How five document filters interact: every order of them, audited in one pass.

A document is reduced to a mask of the filters that it fails. What becomes of a
mask in each of the 120 orders and 5 steps is fixed, so every mask has one wide
integer with a field of 64 bits for each of the 600 outcomes: kept, removed,
redundant. The integers of a part's documents are added and unpacked once; a
field grows by at most one a document, so none overflows into the next. Equal
masks of a part are counted before they are added, n times one integer being
the sum of n of them.

A  under ``min_words`` words            B  too few distinct words
C  too many capitals                    D  holds one of ``# $ % & * |``
E  equals the text of a smaller ``doc_id`` anywhere in the table

Null texts are empty, and empty texts equal each other. A null ``source`` is the
part of the empty string. A row with a null ``doc_id`` has no label, fails E
never and makes no other row fail it; rows of equal ``doc_id`` and text are not
copies of each other. Repeated rows count each. Of repeated labels a document is
good, or toxic, if one says so. Texts are compared by SHA-256 of the whole.
Other columns are not read. An empty table gives an empty result.

No text is shuffled. A hot source or group of copies is counted before the
shuffle; a group of copies then has at most four rows for each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
CAPITALS, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
#: Outcomes of a step that have fields of their own.
KEPT, REMOVED, REDUNDANT = range(3)
COUNTS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


@dataclass(frozen=True)
class Params:
    min_words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 2


def failed(text: bytes, p: Params = Params()) -> int:
    """Which of A to D a text fails, as bits 0 to 3."""
    words = text.split()
    n, points = len(words), len(text.decode())
    capitals, symbols = len(text) - len(text.translate(None, CAPITALS)), len(text) - len(text.translate(None, SYMBOLS))
    return (n < p.min_words) | (100 * len(set(words)) < p.distinct_percent * n) << 1 | (100 * capitals > p.capital_percent * points) << 2 | (symbols > 0) << 3


def judged(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id``, ``part``, ``digest`` of the text, and ``failed`` for every row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in pc.cast(batch.column(2), pa.binary()).to_pylist()]
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array([failed(t, p) for t in texts], pa.int32())], names=["doc_id", "part", "digest", "failed"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(kernel, "doc_id bigint, part string, digest binary, failed int")


def masks(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """``part``, ``mask`` (bit k: fails filter k), ``good``, ``toxic`` and ``n``, the number of such documents."""
    rows = judged(docs, p).groupBy("doc_id", "part", "digest", "failed").agg(F.count("*").alias("n"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = rows.where("doc_id is not null").join(said, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    known = known.unionByName(rows.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    # The rows of one id, text and part are one row here, so the least id of a group has one count.
    groups = known.groupBy("digest", "part", "failed", "good", "toxic").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.expr("if(doc_id is null, n, 0)")), F.lit(0)).alias("nameless"), F.min(F.expr("if(doc_id is null, null, struct(doc_id, n))")).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    counted = groups.withColumn("first", first).withColumn("fine", F.col("nameless") + F.coalesce(F.expr("if(least.doc_id = first, least.n, 0)"), F.lit(0)))
    both = F.array(F.struct(F.col("failed").alias("mask"), F.col("fine").alias("n")), F.struct(F.col("failed").bitwiseOR(16).alias("mask"), (F.col("n") - F.col("fine")).alias("n")))
    each = counted.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.mask", "good", "toxic", "x.n").where("n > 0")
    return each.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


@cache
def orders() -> list[str]:
    return ["".join(x) for x in permutations(FILTERS)]


@cache
def wide() -> list[int]:
    """For every mask the integer whose 64-bit field 3 * (5 * order + step) + outcome is one where that is its outcome."""
    out = []
    for mask in range(1 << len(FILTERS)):
        fields = np.zeros((len(orders()), len(FILTERS), 3), "<u8")
        for o, order in enumerate(orders()):
            gone = False
            for s, name in enumerate(order):
                fails = bool(mask >> FILTERS.index(name) & 1)
                fields[o, s] = [not gone and not fails, not gone and fails, gone and fails]
                gone = gone or fails
        out.append(int.from_bytes(fields.tobytes(), "little"))
    return out


def unpacked(total: int) -> np.ndarray:
    """Counts by order, step and outcome from a sum of wide integers."""
    size = len(orders()) * len(FILTERS) * 3
    return np.frombuffer(total.to_bytes(8 * size, "little"), "<u8").reshape(len(orders()), len(FILTERS), 3).astype(np.int64)


def audit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """One row for every ``part``, ``filter_order`` and ``step`` with its counts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, place = orders(), np.array([[FILTERS.index(c) for c in x] for x in orders()])
        steps = len(names) * len(FILTERS)
        for batch in batches:
            for part, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of = lambda which: unpacked(sum(r["n"] * wide()[r["mask"]] for r in rows if which(r)))  # noqa: E731, B023
                every, good, toxic = of(lambda r: True), of(lambda r: r["good"]), of(lambda r: r["toxic"])
                alone = np.array([sum(r["n"] for r in rows if r["mask"] == 1 << k) for k in range(len(FILTERS))])
                shapley = np.array([every[:, :, REMOVED][place == k].sum() for k in range(len(FILTERS))])
                counts = [every[:, :, KEPT], every[:, :, REMOVED], every[:, :, REDUNDANT], alone[place], good[:, :, REMOVED], toxic[:, :, REMOVED], shapley[place]]
                keys = [pa.array([part] * steps, pa.string()), pa.array(np.repeat(names, len(FILTERS)), pa.string()), pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(names)))]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c.reshape(-1).astype(np.int64)) for c in counts)], names=["part", "filter_order", "step", *COUNTS])

    parts = masks(docs, labels, p).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("rows"))
    return parts.mapInArrow(kernel, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))
