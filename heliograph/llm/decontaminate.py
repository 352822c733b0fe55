"""Benchmark decontamination by winnowing.

Words are lower-cased runs of letters and digits. A window is ``span``
consecutive words of a benchmark item; an item with fewer words is one window.

Fingerprints: of every ``span - gram + 1`` consecutive hashes of ``gram`` words
the least is kept. Any ``span`` shared words hold the same such run of hashes in
both texts, so they share a fingerprint. Each shared fingerprint is extended to
both sides: every window of the text around it is looked up, by its words
themselves, among the items' windows, and where it is one of them all its words are
hit. A place of a text is the beginning of a window once only, and equal windows of items
are held once, so the time grows with the texts however often words repeat.
Items of n < ``span`` words use n-word hashes and must agree as a whole.

The benchmark is read in blocks of bounded size (``BLOCK_WORDS``), each sent to
all tasks and held against all documents; blocks' hits are put together for
each row. One block, the usual case, needs no shuffle of documents.

Null and wordless texts have no words; null and wordless items have no window,
and items with a null ``item_id``, which no result could name, are left out.
Items with one ``item_id`` count as one. Every row is judged alone, whatever its
``doc_id``: with several blocks, hits are put together by a row number that is
written with the documents before the first block. Other columns are not read.
Empty tables give no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.session import removed, written
from heliograph.llm.words import ALNUM, ALNUM_TRANSLATE, grams, runs, word_hashes

#: Words of a block of the benchmark: some 120 MB in each Python worker.
BLOCK_WORDS = 400_000
FOUND = "n_words bigint, ranges array<struct<first:bigint,last:bigint>>, items array<string>"


def split_words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text."""
    return (text or "").encode().translate(ALNUM_TRANSLATE).split()


def winnowed(hashes: np.ndarray, same_row: np.ndarray, window: int) -> np.ndarray:
    """Positions of hashes that are least in one of the windows; ``same_row`` marks the windows' valid starts."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = hashes[:n].copy()
    for j in range(1, window):
        np.minimum(least, hashes[j : j + n], out=least)
    least[~same_row[:n]] = 0
    most = np.zeros(len(hashes), np.uint64)
    for j in range(window):
        np.maximum(most[j : j + n], least, out=most[j : j + n])
    return np.flatnonzero((most == hashes) & (most != 0))


class Block:
    """Fingerprints and windows of one block of items."""

    def __init__(self, items: list[tuple[str, str]], span: int, gram: int) -> None:
        self.span, self.gram, self.reach = span, gram, span - gram
        fingerprints: set[int] = set()
        short: dict[int, set[int]] = defaultdict(set)
        #: The ids of all items that hold a window, by its words joined by spaces, which no word holds.
        self.windows: dict[bytes, list[str]] = defaultdict(list)
        for item, text in items:
            words = split_words(text)
            if not words:
                continue
            n = min(span, len(words))
            for key in {b" ".join(words[s : s + n]) for s in range(len(words) - n + 1)}:
                self.windows[key].append(item)
            data = np.frombuffer(b" ".join(words), np.uint8)
            hashes, _ = word_hashes(data, np.array([0, len(data)]), ALNUM)
            if n < span:
                short[n].add(int(grams(hashes, n)[0]))
            else:
                g = grams(hashes, gram)
                fingerprints.update(g[winnowed(g, np.ones(len(g), bool), self.reach + 1)].tolist())
        self.windows, self.found, self.short = dict(self.windows), fingerprints, dict(short)

    def filters(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For 0 (fingerprints) and each short length: sorted hashes and a table of their top 22 bits."""
        out = {}
        for n, hashes in [(0, self.found), *self.short.items()]:
            keys = np.sort(np.fromiter(hashes, np.uint64, len(hashes)))
            top = np.zeros(1 << 22, bool)
            top[keys >> np.uint64(42)] = True
            out[n] = keys, top
        return out


def members(hashes: np.ndarray, keys: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Mask of hashes that are among the sorted keys."""
    mask = top[hashes >> np.uint64(42)]
    maybe = np.flatnonzero(mask)
    at = np.minimum(np.searchsorted(keys, hashes[maybe]), max(len(keys) - 1, 0))
    mask[maybe] = keys[at] == hashes[maybe] if len(keys) else False
    return mask


def extended(words: list[bytes], seeds: list[int], block: Block) -> tuple[list[tuple[int, int]], set[bytes]]:
    """Hit ranges [first, last) of a document and the windows that occur, from the rising positions of shared fingerprints."""
    ranges, found, done, n = [], set(), 0, block.span
    for p in seeds:
        for s in range(max(done, p - block.reach), min(p, len(words) - n) + 1):
            key = b" ".join(words[s : s + n])
            if key in block.windows:
                ranges.append((s, s + n))
                found.add(key)
        done = max(done, p + 1)
    return ranges, found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def judge(block: Block, filters: dict, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Word counts, merged hit ranges and sorted item ids of some texts."""
    span, gram = block.span, block.gram
    hashes, first = word_hashes(data, offsets, ALNUM)
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    seeds: dict[int, list[int]] = defaultdict(list)
    if block.found:
        g = grams(hashes, gram)
        same = row_of[: max(0, len(hashes) - span + 1)] == row_of[span - 1 :]
        at = winnowed(g, same, block.reach + 1)
        at = at[members(g[at], *filters[0])]
        for p in at.tolist():
            seeds[int(row_of[p])].append(p)
    short: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n in block.short:
        g = grams(hashes, n)
        same = row_of[: len(g)] == row_of[n - 1 :]
        at = np.flatnonzero(members(g, *filters[n]) & same)
        for p in at.tolist():
            short[int(row_of[p])].append((p, n))
    hit: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    names: list[list[str]] = [[] for _ in range(len(texts))]
    for r in {*seeds, *short}:
        words, start = split_words(texts[r].as_py()), int(first[r])
        ranges, keys = extended(words, [p - start for p in seeds[r]], block)
        for p, n in short[r]:
            key = b" ".join(words[p - start : p - start + n])
            if key in block.windows:
                ranges.append((p - start, p - start + n))
                keys.add(key)
        hit[r], names[r] = merged(ranges), sorted({i for key in keys for i in block.windows[key]})
    return np.diff(first).astype(np.int64), hit, names


def found_in(docs: DataFrame, items: list[tuple[str, str]], span: int, gram: int) -> DataFrame:
    """Hit ranges and items of every row against one block of items, beside its columns other than ``text`` (all bigint). Map only."""
    keys = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(items)
    pair = pa.struct([("first", pa.int64()), ("last", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value, span, gram)
        filters = block.filters()
        for batch in batches:
            for rows, data, offsets in runs(batch, len(keys)):
                n, hit, names = judge(block, filters, rows.column(len(keys)), data, offsets)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keys)], pa.array(n), pa.array([[{"first": a, "last": b} for a, b in x] for x in hit], pa.list_(pair)), pa.array(names, pa.list_(pa.string()))], names=[*keys, "n_words", "ranges", "items"])

    return docs.select(*keys, "text").mapInArrow(kernel, ", ".join([*(f"{c} bigint" for c in keys), FOUND]))


def without(docs: DataFrame, items: list[tuple[str, str]], span: int, gram: int) -> DataFrame:
    """``docs`` without the rows that hold a window of one block of items. Map only."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    text_at = docs.columns.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value, span, gram)
        filters = block.filters()
        for batch in batches:
            for rows, data, offsets in runs(batch, text_at):
                _, hit, _ = judge(block, filters, rows.column(text_at), data, offsets)
                yield rows.filter(pa.array([not x for x in hit], pa.bool_()))

    return docs.mapInArrow(kernel, docs.schema)


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """The benchmark's items in as many parts as its measured size needs, each of about ``block_words`` words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // (4 * block_words)))
    parts = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return [parts.where(F.col("block") == i).drop("block") for i in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, gram: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, merged hit ``ranges`` of word positions [first, last), and the ``items`` that occur (sorted as strings).

    With several blocks, ids and texts are first written with a row number to
    the shared folder. Each block's result is a table there before the next
    block is read, so the driver holds one block at a time; the first has all
    rows, the others those that are hit.
    """
    parts, own = blocks(benchmark, block_words), docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if len(parts) == 1:
        return found_in(own, [tuple(r) for r in parts[0].collect()], span, gram)
    numbered, path = written(own.withColumn("row", F.monotonically_increasing_id()), "numbered")
    tables = []
    for i, part in enumerate(parts):
        found = found_in(numbered, [tuple(r) for r in part.collect()], span, gram)
        tables.append(written(found.where("size(items) > 0") if i else found, "block")[0])
    removed(docs.sparkSession, path)
    union = tables[0]
    for more in tables[1:]:
        union = union.unionByName(more)
    found = union.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return found.drop("row")


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of ``contamination``'s rows. Ranges are sorted, and may overlap where there were several blocks."""
    hit = F.expr("aggregate(ranges, named_struct('n', 0L, 'last', 0L), (s, r) -> named_struct('n', s.n + greatest(0L, r.last - greatest(s.last, r.first)), 'last', greatest(s.last, r.last)), s -> s.n)")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, span: int = 10, gram: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without rows that hold a benchmark window; columns unchanged. One map-only pass for each block of the benchmark."""
    for part in blocks(benchmark, block_words):
        docs = without(docs, [tuple(r) for r in part.collect()], span, gram)
    return docs
