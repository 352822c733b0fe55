"""Token ids in ORC files.

Documents are dealt into ranges of ``doc_id``, sorted, encoded in that order
and written as ORC: integer run-length encoding for the ids, row indexes on
every column, and a Bloom filter on ``doc_id``, so a reader of a few documents
prunes files, stripes and row groups, and a reader of everything takes stripes
in parallel. A reader finds where a document starts in the whole stream from
the per-file totals and a running sum inside each file.

Null texts are empty: they hold the end id alone. Texts of any length are
encoded whole; ids of one text are one value of the file, so a text has at most
some two thousand million ids. A string of an added token in a text becomes
that token, as the library does by itself. Rows with equal ``doc_id`` are
ordered by a hash of their texts; repeated rows have equal ids, so their order
does not matter. Null ids come first and are counted like others. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm.pretokens import PretokenCache
from heliograph.llm.words import runs

WRITE = {"orc.compress": "ZSTD", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20)}
_MADE: dict[str, PretokenCache] = {}


def _tokenizer(path: str) -> PretokenCache:
    """The worker's tokenizer for a vocabulary file on its own disk, made at first use."""
    if path not in _MADE:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _MADE[path] = PretokenCache(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)], added)
    return _MADE[path]


def encoded(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``text_hash`` of every text, in the order of the input's partitions."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _tokenizer(vocabulary)
        for batch in batches:
            for rows, _, _ in runs(batch, 1):
                counts, ids = cache.whole([t or "" for t in rows.column(1).to_pylist()])
                ends = np.cumsum(counts)
                flat = pa.array(np.insert(ids, ends, end_id).view(np.int32))
                offsets = np.concatenate([[0], ends + np.arange(1, len(counts) + 1)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts + 1), pa.ListArray.from_arrays(pa.array(offsets), flat), rows.column(2)], names=["doc_id", "n_tokens", "ids", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(kernel, "doc_id bigint, n_tokens bigint, ids array<int>, text_hash bigint")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, files: int | None = None) -> None:
    """Write the ids of all documents as ORC files, each with its number ``part`` in the order of ``doc_id``, the rows sorted. ``files``: how many; else one a shuffle partition."""
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    encoded(ordered, vocabulary, end_id).withColumn("part", F.spark_partition_id()).write.options(**WRITE).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids``, ``text_hash`` (order among equal ids) and ``part`` (order of the file) of files that ``write_tokens`` wrote."""
    return spark.read.schema("doc_id bigint, n_tokens bigint, ids array<int>, text_hash bigint, part int").orc(path)


def catalogue(tokens: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32`` from read token files.

    One row per file, as many as were written, gives each file's first
    position; inside a file a running sum goes on from there. Only counts and
    checksums are shuffled.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            at = ids.offsets.to_numpy()
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64()), batch.column(2), batch.column(3)], names=["doc_id", "n_tokens", "ids_crc32", "text_hash", "part"])

    sums = tokens.select("doc_id", "ids", "text_hash", "part").mapInArrow(kernel, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, text_hash bigint, part int")
    by_file = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = by_file.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0))
    placed = sums.withColumn("inside", inside).join(before, "part")
    return placed.select("doc_id", (F.col("before") + F.col("inside") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
