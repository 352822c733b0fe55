"""Document fingerprints from closed syncmers.

Of the UTF-8 bytes of a text, a k-mer is an anchor if the least of its inner
s-mers, by hash, stands at its first or last place. That depends on the k-mer
alone, so texts that share a passage share its anchors, wherever it stands.

A fingerprint holds every anchor of its text, in order: four base64 digits
each, 3 bits with the distance in bytes from the anchor before (the first: from
the start) and 21 with the hash. Adjacent anchors are at most k - s = 7 bytes
apart, so a fingerprint grows with its text, by about one digit a byte. An
anchor alone is written whole, in twelve digits (8 bits and 64).

Likeness matches anchors at a consistent offset: an anchor and the next one are
common if both hashes and the distance between them occur in the other text
too, each occurrence there used once. Only what a fingerprint holds is compared:
two different links are alike by chance with 2^-42. An anchor is matched if it is common with
one of its neighbours. With m, the mean of both texts' matched anchors,
likeness is m / (all anchors of both - m).

Null texts are empty; an empty text has an empty fingerprint, like only to
another empty one. A text without an anchor, as when shorter than k, is one
anchor as a whole. One anchor alone is like only to the same one alone. Rows with
equal ``doc_id`` are ordered by text. Null ids come after all others. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.words import BYTE_HASH, STEP_BYTES, splitmix


@dataclass(frozen=True)
class Params:
    """Bytes of k-mers and inner s-mers (k - s + 1 must be 8)."""

    k: int = 15
    s: int = 8


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def anchors(data: np.ndarray, offsets: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, byte position in the whole buffer and hash of every anchor, in order."""
    n = len(data)
    if n < p.k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total, down = BYTE_HASH.sums(data)
    inner = splitmix((total[p.s :] - total[: -p.s]) * down[: n - p.s + 1])
    two = np.minimum(inner[:-1], inner[1:])
    four = np.minimum(two[:-2], two[2:])
    least = np.minimum(four[:-4], four[4:])
    at = np.flatnonzero((least == inner[: len(least)]) | (least == inner[p.k - p.s :][: len(least)]))
    row = np.searchsorted(offsets, at, "right") - 1
    fine = at + p.k <= offsets[row + 1]
    at, row = at[fine], row[fine]
    return row, at, splitmix((total[at + p.k] - total[at]) * down[at] + np.uint64(1))


#: An anchor as stored: distance from the one before, and hash.
ANCHOR = np.dtype([("gap", "u1"), ("hash", ">u8")])
#: Bits of a hash that are written and compared; with those of the distance they fill three bytes.
HASH_BITS = 21
#: Bytes of text in a partition that is sorted, so that sorting need not spill.
PART_BYTES = 64 << 20


@dataclass(frozen=True)
class Print:
    """All anchors of a text: ``stored`` in order; ``links`` of each anchor to its next, ascending, and the anchor that each begins at."""

    stored: np.ndarray
    links: np.ndarray
    begins: np.ndarray


def written(stored: np.ndarray) -> str:
    """A fingerprint's digits."""
    if len(stored) < 2:
        return base64.b64encode(stored.tobytes()).decode()
    packed = stored["gap"].astype(">u4") << HASH_BITS | (stored["hash"] & np.uint64((1 << HASH_BITS) - 1)).astype(">u4")
    return base64.b64encode(packed.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()).decode()


def prints_of(texts: list[bytes], p: Params) -> list[Print]:
    """The anchors of every text, and their links. A link that occurs again counts as another, by its number of occurrence."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    row, at, found = anchors(data, offsets, p)
    stored = np.zeros(len(row), ANCHOR)
    stored["hash"] = found
    links, begins, link_row = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(row):
        first = np.concatenate([[True], row[1:] != row[:-1]])
        gap = at - np.where(first, offsets[row], np.concatenate([[0], at[:-1]]))
        stored["gap"] = gap
        begins = np.flatnonzero(~first[1:])
        held = found & np.uint64((1 << HASH_BITS) - 1)
        links = splitmix(held[begins] + splitmix(held[begins + 1] + (gap[begins + 1].astype(np.uint64) << np.uint64(HASH_BITS))))
        order = np.lexsort((links, row[begins]))
        begins, links = begins[order], links[order]
        link_row = row[begins]
    if len(links):
        new = np.flatnonzero(np.concatenate([[True], (link_row[1:] != link_row[:-1]) | (links[1:] != links[:-1])]))
        number = np.arange(len(links)) - np.repeat(new, np.diff(np.concatenate([new, [len(links)]])))
        again = np.flatnonzero(number)
        if len(again):
            links[again] = splitmix(links[again] + number[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.lexsort((links, link_row))
            begins, links = begins[order], links[order]
    ends, link_ends = (np.searchsorted(x, np.arange(len(texts) + 1)) for x in (row, link_row))
    out = []
    for i, text in enumerate(texts):
        own = stored[ends[i] : ends[i + 1]]
        if not len(own) and text:
            own = np.array([(0, int.from_bytes(hashlib.sha256(text).digest()[:8], "big"))], ANCHOR)
        mine = slice(link_ends[i], link_ends[i + 1])
        out.append(Print(own, links[mine], begins[mine] - ends[i]))
    return out


def matched(a: Print, common: np.ndarray) -> int:
    """How many anchors are at an end of the marked links."""
    hit = np.zeros(len(a.stored), bool)
    at = a.begins[common]
    hit[at] = True
    hit[at + 1] = True
    return int(np.count_nonzero(hit))


def among(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of the values of ``a`` in sorted ``b``, which is not empty."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def likeness(a: Print, b: Print) -> float:
    """Share of anchors that stand at a consistent offset in both texts."""
    n, m = len(a.stored), len(b.stored)
    if n < 2 or m < 2:
        return float(n == m and (not n or a.stored["hash"][0] == b.stored["hash"][0]))
    both = (matched(a, among(a.links, b.links)) + matched(b, among(b.links, a.links))) / 2
    return both / (n + m - both)


def _place(value: Column, bounds: list[int], low: int = 0) -> Column:
    """How many sorted bounds are at most the value, as nested comparisons: log(n) of them are evaluated."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(value < bounds[mid], _place(value, bounds[:mid], low)).otherwise(_place(value, bounds[mid + 1 :], low + mid + 1))


def beside_next(docs: DataFrame) -> DataFrame:
    """Documents in ranges of descending ``doc_id``, one range a partition, each closed by the first document of the next range.

    The first document of a range also goes to the range before it (that of
    the first range to the last), marked ``extra``, so every document finds its
    successor in its own partition and no window spans the table. Range bounds
    are quantiles of the ids; there are as many as shuffle partitions, or more
    where a range would else hold over ``PART_BYTES`` of text on average.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = ids.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    cuts = ids.where("doc_id is not null").select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    place = F.when(F.col("doc_id").isNull(), parts).otherwise(F.lit(parts - 1) - _place(F.col("doc_id"), sorted(set(cuts))))
    placed = ids.withColumn("place", place)
    heads = {r["place"]: r["head"] for r in placed.groupBy("place").agg(F.max("doc_id").alias("head")).collect()}  # at most parts + 1 rows
    if not heads:
        return placed.withColumn("extra", F.lit(False))
    filled = sorted(heads)
    before = dict(zip(filled, [filled[-1], *filled[:-1]], strict=True))
    at = F.col("place") + 1
    is_head = F.col("doc_id").eqNullSafe(F.element_at(F.array(*(F.lit(heads.get(i)).cast("bigint") for i in range(parts + 1))), at))
    own = F.struct(F.col("place"), F.lit(False).alias("extra"))
    more = F.struct(F.element_at(F.array(*(F.lit(before.get(i, i)) for i in range(parts + 1))), at).alias("place"), F.lit(True).alias("extra"))
    dealt = placed.select("doc_id", "text", F.explode(F.when(is_head, F.array(own, more)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("doc_id", "text", "to.extra", "to.place").repartitionById(parts + 1, F.col("place").cast("int"))
    return dealt.sortWithinPartitions("extra", F.desc_nulls_last("doc_id"), "text")


def fingerprints(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likeness to the edited and the next text.

    The edited text has its last half replaced by as much of the next
    document's beginning, by descending ``doc_id`` (after the last: the first).
    """

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, bool]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)

    def steps(rows: Iterator[tuple[int | None, str, bool]]) -> Iterator[tuple[list, list]]:
        """Documents of about a step's bytes, and their successors."""
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[1])
            if size >= STEP_BYTES // 2 and len(held) > 1:
                yield held[:-1], held[1:]
                held, size = held[-1:], len(row[1])
            if row[2]:  # further extras are copies of the same id; the first in order is the successor
                break
        if len(held) > 1:
            yield held[:-1], held[1:]
        for _ in rows:
            pass

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, following in steps(rows_of(batches)):
            texts = [t for _, t, _ in own]
            edited = [(t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode() for t, (_, n, _) in zip(texts, following, strict=True)]
            prints = prints_of([*(t.encode() for t in texts), following[-1][1].encode()], p)
            changed = prints_of(edited, p)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _, _ in own], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
                    pa.array([written(x.stored) for x in prints[:-1]], pa.string()),
                    pa.array([written(x.stored) for x in changed], pa.string()),
                    pa.array([likeness(a, b) for a, b in zip(prints, changed, strict=False)], pa.float64()),
                    pa.array([likeness(a, b) for a, b in zip(prints[:-1], prints[1:], strict=True)], pa.float64()),
                ],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return beside_next(docs).select("doc_id", "text", "extra").mapInArrow(kernel, SCHEMA)
