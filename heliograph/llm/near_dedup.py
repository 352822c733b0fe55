"""Near duplicates by min-max hashing.

A document is the set of its distinct word shingles. Every permutation of the
shingle hashes gives two signature values, the minimum and the maximum, so half
the hash evaluations make as many values as plain MinHash. Bands of values of
different permutations are hashed to bucket keys; documents that share a key
are compared on their full sets.

Work is bounded for every kind of repetition:

* documents with equal words in equal order form a class first, by a 128-bit
  cryptographic digest. A class is one node with one text, however many rows have it
  and whatever ids they bear, and only nodes are compared;
* in a bucket, each member is compared with the bucket's leader, so a bucket of
  m members gives m - 1 pairs. Where members end up in different components,
  their documents are joined on their rarest shingles, an exact filter that
  loses no link, and the pairs that pass are compared;
* a document that leads many others is sent to their comparisons in parts, and so are
  the documents of a rare shingle that very many have, in strips of like set sizes;
* components are found by label contraction on tables in the shared folder.

Signatures, candidates and set sizes use 64-bit hashes of shingles. A link is
decided on the words themselves: both texts' words are numbered exactly, and
sets of the numbers are compared.

Null and wordless texts have empty sets and link with nothing. Rows with equal
``doc_id`` are one document's: their classes belong to one component. Rows with a null
``doc_id`` stay alone: their component is null and they are kept. Texts of any
length are compared whole. Of equal similarity, nothing depends on ties: every
link counts. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.llm.components import components
from heliograph.llm.session import removed, written
from heliograph.llm.words import LOWER_TRANSLATE, SPACE, grams, runs, seeds, splitmix, word_hashes


@dataclass(frozen=True)
class Params:
    """Words per shingle, similarity as a percentage, bands and rows; ``spread``: most comparisons that one copy of a leader's text serves; ``strip``: documents of one shingle that meet in one task.

    With 40 bands of 6 values a pair at similarity 0.8 shares no bucket with
    probability (1 - 0.8**6)**40, about 5e-6; at 0.9, about 1e-13.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    spread: int = 500
    strip: int = 2000


def split_words(text: str) -> list[bytes]:
    """The words of a text, A to Z lower-cased."""
    return text.encode().translate(LOWER_TRANSLATE).split()


def digest(text: str | None) -> bytes:
    """128 bits of the words in order."""
    return hashlib.blake2b(b" ".join(split_words(text or "")), digest_size=16).digest()


def exact_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct numbers of every text's shingles. Equal numbers are equal shingles, over all texts of the list; nothing is hashed."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = [np.array(list(map(known.__getitem__, split_words(t))), np.int64) for t in texts]
    short = {i for i, w in enumerate(words) if len(w) < k}
    flat = np.concatenate([w for i, w in enumerate(words) if i not in short] or [np.zeros(0, np.int64)])
    numbers, most = flat, len(known)
    for j in range(1, k):
        if len(numbers) and int(numbers.max()) + 1 > (1 << 62) // max(most, 1):
            numbers = np.unique(numbers, return_inverse=True)[1]
        numbers = numbers[:-1] * most + flat[j:] if len(numbers) else numbers
    out, at = [], 0
    tuples: dict[tuple, int] = {}
    for i, w in enumerate(words):
        if i in short:  # the whole sequence is the one shingle, unlike any of k words
            out.append(np.array([-1 - tuples.setdefault(tuple(w.tolist()), len(tuples))] if len(w) else [], np.int64))
        else:
            out.append(np.unique(numbers[at : at + len(w) - k + 1]))
            at += len(w)
    return out


def shingle_sets(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row. A text of fewer words, but not none, is one shingle."""
    hashes, first = word_hashes(data, offsets, SPACE)
    shingles = grams(hashes, k)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(shingles[a : b - k + 1]))
        elif b > a:
            out.append(grams(hashes[a:b], int(b - a)) + np.uint64(b - a))
        else:
            out.append(hashes[:0])
    return out


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """Per row: set size, a 128-bit digest of the words in order, and the bucket keys of all bands."""
    per_side = p.bands // 2 * p.rows
    odd, shift = seeds(per_side, 21) | np.uint64(1), seeds(per_side, 22)
    salts = seeds(p.bands, 23)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch, 1):
                sets = shingle_sets(rows, data, offsets, p.shingle)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                keys = np.zeros((len(sets), p.bands), np.uint64)
                sums = np.frombuffer(b"".join(map(digest, rows.column(1).to_pylist())), "<i8").reshape(-1, 2)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    low, high = np.empty((per_side, len(full)), np.uint64), np.empty((per_side, len(full)), np.uint64)
                    for j in range(per_side):
                        permuted = flat * odd[j] + shift[j]
                        low[j], high[j] = np.minimum.reduceat(permuted, at), np.maximum.reduceat(permuted, at)
                    for side, values in enumerate((low, high)):
                        for band in range(p.bands // 2):
                            key = np.full(len(full), salts[2 * band + side])
                            for value in values[band * p.rows : (band + 1) * p.rows]:
                                key = splitmix(key ^ value)
                            keys[full, 2 * band + side] = key
                ends = pa.array(np.cumsum(np.concatenate([[0], np.where(sizes > 0, p.bands, 0)])).astype(np.int32))
                flat_keys = pa.array(keys[full].reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes), pa.array(np.ascontiguousarray(sums[:, 0])), pa.array(np.ascontiguousarray(sums[:, 1])), pa.ListArray.from_arrays(ends, flat_keys)], names=["doc_id", "n_shingles", "h1", "h2", "keys"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(kernel, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, keys array<bigint>")


def distinct_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and its ``text``; ``nodes``: node, digest (h1, h2) and an id that bears the text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.frombuffer(b"".join(map(digest, batch.column(1).to_pylist())), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ascontiguousarray(sums[:, 0])), pa.array(np.ascontiguousarray(sums[:, 1])), batch.column(1)], names=["doc_id", "h1", "h2", "text"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(kernel, "doc_id bigint, h1 bigint, h2 bigint, text string")
    key = ["doc_id", "h1", "h2"]
    return rows.join(nodes, key).groupBy(*key, "node").agg(F.first("text").alias("text")).select("node", "text")


def compared(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Sizes of intersection and union of both sets, on words, for pairs (a, b) of nodes. An ``a`` may stand in very many pairs, a ``b`` in few."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in runs(batch, 2):
                n = rows.num_rows
                sets = exact_sets([*(t or "" for t in rows.column(2).to_pylist()), *(t or "" for t in rows.column(3).to_pylist())], p.shingle)
                common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sets[:n], sets[n:], strict=True)]
                union = [len(x) + len(y) - c for x, y, c in zip(sets[:n], sets[n:], common, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "n_common", "n_union"])

    # Each copy of a leader's text serves about p.spread pairs, so no task gets all of a large group. Only leaders
    # of more pairs are counted out: at most one row for p.spread pairs, which the adaptive planner may broadcast.
    leaders = pairs.groupBy("a").agg(F.ceil(F.count("*") / p.spread).cast("int").alias("parts"))
    large = leaders.where("parts > 1").withColumnRenamed("a", "large")
    left = texts.join(leaders, F.col("node") == F.col("a")).select("a", F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    dealt = pairs.join(large, F.col("a") == F.col("large"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    joined = dealt.join(left, ["a", "part"]).join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(kernel, "a bigint, b bigint, n_common bigint, n_union bigint")


def rare_pairs(texts: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may be links; ``texts``: node, text, component.

    Shingles of a document are ordered from the rarest to the commonest. Two
    linked sets share a shingle among the first of both, and the first shared
    one leaves enough shingles after it for the overlap that a link needs; pairs
    that no shingle vouches for in this way are no links. Documents far from a
    large group begin with shingles of their own, so they are not paired with
    its members. Linked sets are of like size, so a shingle's documents meet
    only where their sizes lie in one strip or the next; those of a large strip are dealt to several tasks.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch, 2):
                sets = shingle_sets(rows, data, offsets, p.shingle)
                sizes = np.array([len(x) for x in sets], np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(sizes), pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64)))], names=["node", "component", "size", "shingles"])

    sets = texts.select("node", "component", "text").mapInArrow(kernel, "node bigint, component bigint, size bigint, shingles array<bigint>")
    each = sets.select("node", "component", "size", F.explode("shingles").alias("shingle"))
    counted = each.groupBy("shingle").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "shingle")).alias("place")
    first = each.join(counted, "shingle").select("node", "component", "size", "shingle", place).where(F.expr(f"place <= size - ceil(size * {p.percent} / 100) + 1"))
    # Read back, since it stands several times in what follows.
    first, first_at = written(first, "prefixes")
    # Of each shingle, the largest component's documents are paired with those of other components only.
    heavy = first.groupBy("shingle").agg(F.mode("component", True).alias("heavy"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle", "heavy")
    found, found_at = written(first.join(heavy, "shingle").withColumn("strip", F.expr(f"CAST(floor(ln(size) / ln({100 / p.percent})) AS INT)")), "rare")
    side = lambda c: [F.col(n).alias(f"{n}_{c}") for n in ("component", "size", "place")]
    x = found.where("component <> heavy").select("shingle", "strip", F.col("node").alias("a"), *side("a"))
    large = x.groupBy("shingle", "strip").agg(F.ceil(F.count("*") / p.strip).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    x = x.join(large, ["shingle", "strip"], "left").withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("parts")
    y = found.select("shingle", F.explode(F.array(F.col("strip") - 1, "strip", F.col("strip") + 1)).alias("strip"), F.col("node").alias("b"), *side("b"), (F.col("component") == F.col("heavy")).alias("is_heavy"))
    y = y.join(large, ["shingle", "strip"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    enough = F.expr(f"component_a <> component_b and (is_heavy or a < b) and (least(size_a - place_a, size_b - place_b) + 1) * {100 + p.percent} >= {p.percent} * (size_a + size_b)")
    pairs, _ = written(x.join(y, ["shingle", "strip", "part"]).where(enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    removed(texts.sparkSession, first_at, found_at)
    return pairs


def near_groups(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (least linked ``doc_id``) of every row of ``docs``."""
    spark = docs.sparkSession
    signed, signed_at = written(signatures(docs, p), "signatures")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    # Equal words have equal keys, so any row's keys will do; the partial aggregation takes copies together before the shuffle.
    classes, classes_at = written(filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()), "classes")
    chosen = classes.select("node", F.posexplode("keys").alias("band", "key"))
    # The leader is the least by one of four orders, so overlapping buckets of a large group do not all hang on one member.
    order = F.xxhash64("node", F.col("band") % 4)
    leaders = chosen.groupBy("key").agg(F.min(F.struct(order, "node"))["node"].alias("leader"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "leader")
    members, members_at = written(chosen.join(leaders, "key").select("key", "leader", "node"), "members")
    led = members.where("node <> leader").groupBy(F.least("leader", "node"), F.greatest("leader", "node")).agg(F.min(F.struct("leader", "node")).alias("pair"))
    star = led.select(F.col("pair.leader").alias("a"), F.col("pair.node").alias("b"))
    asked = classes.select("node", "doc_id", "h1", "h2").join(members.select("node").distinct(), "node", "left_semi")
    texts, texts_at = written(distinct_texts(docs, asked), "candidates")
    first, first_at = written(compared(star, texts, p), "star")
    is_link = F.expr(f"100 * n_common >= {p.percent} * n_union")
    links = first.where(is_link).select("a", "b")
    label, label_at = written(components(links), "labels")

    # Nodes of buckets that the star left in different components are joined on rare shingles, without loss.
    known = members.select("key", "node").join(label.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    undecided = known.join(split, "key", "left_semi").select("node", "component").distinct()
    cross = rare_pairs(texts.join(undecided, "node"), p)
    second, second_at = written(compared(cross, texts, p), "cross")

    # A doc_id that stands for several texts ties their nodes together; all rows of a class have its component.
    several = filled.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high")).where("low <> high").select("doc_id")
    shared = filled.join(several, "doc_id", "left_semi").select("doc_id", "h1", "h2").distinct().join(classes.select("h1", "h2", "node"), ["h1", "h2"])
    ties = shared.join(shared.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))
    more = second.where(is_link).select("a", "b")
    tied = label.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more).unionByName(ties).distinct()
    final, final_at = written(components(tied), "components")
    named = classes.select("h1", "h2", "doc_id", "node").join(final.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found, _ = written(named.join(least, "component").select("h1", "h2", "component_id"), "named")
    removed(spark, classes_at, members_at, texts_at, first_at, second_at, label_at, final_at)
    own = F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("component_id")).otherwise(F.col("doc_id"))
    return signed.select("doc_id", "n_shingles", "h1", "h2").join(found, ["h1", "h2"], "left").select("doc_id", "n_shingles", own.alias("component_id"))


def kept_documents(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` without the rows whose group has a smaller ``doc_id``; columns unchanged."""
    groups = near_groups(docs, p)
    dropped = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
