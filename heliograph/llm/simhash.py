"""Near duplicates by SimHash fingerprints under the generalised pigeonhole principle.

A fingerprint has 64 bits; bit k is one if it is set in over half of the 64-bit
hashes of the text's word shingles, repeats included. Rows are linked if their
fingerprints differ in ``bits`` places at most.

The 64 places are cut into parts, each with a threshold e from -1 (never
looked at) on, so that all thresholds add to ``bits - parts + 1``. Two fingerprints
in reach differ by e or less in some part, so looking up each part's values within
its e finds every link. Places that vary together are put into one part, which
leaves the others more selective; a dynamic program gives out the thresholds
by what each would cost: keys to look up, and candidates that they would meet.
Part widths, correlations and collisions are counted over all fingerprints.

Equal fingerprints are one node, whatever number of rows has them. Near copies of one
text may be many nodes that agree in most parts, so not all pairs of a key are met:

* in every key's group each member is first compared with one leader, which
  links most of a group of near copies into one component;
* then only members of different components meet. A key's component is a row, or
  several of ``block`` fingerprints, and rows of one component are passed over. Only
  blocks that hold a link leave the join.

The component of a node is the least node that it reaches, found by label
contraction on tables in the shared folder. Null and wordless texts have
fingerprint zero and are linked like any other. Texts of fewer words than a shingle
are one shingle. A row is a document of its own: rows of equal ``doc_id`` are
joined only by their fingerprints. A row with a null ``doc_id`` links others, but no
component is called null unless it has no other id. Ties do not occur: every
link counts. Texts of any length are read whole. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.components import components
from heliograph.llm.session import removed, written
from heliograph.llm.words import LOWER_TRANSLATE

WIDTH = 64


@dataclass(frozen=True)
class Params:
    """Words per shingle, seed of the hash, most differing bits; fingerprints per block; what a key costs against a comparison of two candidates."""

    shingle: int = 4
    seed: int = 42
    bits: int = 4
    block: int = 256
    key_cost: float = 100.0
    most_parts: int = 5


def fingerprint(text: bytes, p: Params = Params()) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    words = text.translate(LOWER_TRANSLATE).split()
    if not words:
        return 0
    line, k = b" ".join(words), min(p.shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    spans, digest, n = zip(starts, ends[k - 1 :].tolist(), strict=True), xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(WIDTH, np.int64)
    while hashes := [digest(line[a:b], p.seed) for a, b in itertools.islice(spans, 1 << 16)]:
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id`` and ``print`` (the fingerprint as a signed 64-bit integer) of every row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or b"", p) for t in pc.cast(batch.column(1), pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(kernel, "doc_id bigint, print bigint")


@dataclass(frozen=True)
class Part:
    """Places of a part and its threshold."""

    places: tuple[int, ...]
    threshold: int = 0

    @property
    def mask(self) -> int:
        return signed(sum(1 << k for k in self.places))

    def flips(self) -> list[int]:
        """What to change in a value to reach every value within the threshold."""
        return [signed(sum(1 << k for k in c)) for e in range(self.threshold + 1) for c in itertools.combinations(self.places, e)]


def signed(x: int) -> int:
    return x - (1 << WIDTH) if x >> (WIDTH - 1) else x


def ball(width: float, e: int) -> float:
    """Values within ``e`` differing bits of one of ``width`` bits."""
    return sum(math.comb(math.ceil(width), k) for k in range(e + 1))


def shared(costs: list[dict[int, float]], total: int) -> list[int]:
    """Thresholds of least summed cost that add up to ``total``; ``costs``: by part and threshold. A dynamic program over parts and sums."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for (have, (cost, taken)), (e, more) in itertools.product(best.items(), own.items()):
            if have + e not in nxt or cost + more < nxt[have + e][0]:
                nxt[have + e] = cost + more, [*taken, e]
        best = nxt
    return best[total][1]


def part_count(n: int, p: Params) -> int:
    """How many parts would cost least if bits were independent and even; more fingerprints need wider, so fewer parts."""

    def cost(m: int) -> float:
        own = {e: n * ball(WIDTH / m, e) * (p.key_cost + n / 2 ** (WIDTH / m)) if e >= 0 else 0.0 for e in range(-1, p.bits + 1)}
        thresholds = shared([own] * m, p.bits - m + 1)
        return sum(own[e] for e in thresholds)

    return min(range(2, max(2, min(p.most_parts, p.bits + 1)) + 1), key=cost)


def grouped_places(both: np.ndarray, n: int, m: int) -> list[tuple[int, ...]]:
    """Places in ``m`` parts of about equal width, correlated ones together; ``both[i, j]``: fingerprints with bits i and j set."""
    share = both / max(n, 1)
    mean = np.diag(share)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tie = np.abs((share - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, parts = list(range(WIDTH)), []
    for k in range(m):
        size = len(left) // (m - k)
        own = [max(left, key=lambda i: (tie[i, left].sum(), -i))]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda i: (tie[i, own].sum(), -i)))
            left.remove(own[-1])
        parts.append(tuple(sorted(own)))
    return parts


def near_share(mean: np.ndarray, e: int) -> float:
    """Pairs that differ by ``e`` or less in places of these means, against those that agree, taking places for independent."""
    chance = np.zeros(e + 1)
    chance[0] = 1.0
    for q in 2 * mean * (1 - mean):
        chance[1:], chance[0] = chance[1:] * (1 - q) + chance[:-1] * q, chance[0] * (1 - q)
    return float(chance.sum() / max(chance[0], 1e-300))


def planned(prints: DataFrame, p: Params) -> list[Part]:
    """Parts and thresholds for the distinct ``print`` of a table; only 64 x 64 counts and one number a part reach the driver."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WIDTH, WIDTH), np.int64)
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)  # exact: a batch has less than 2**24 rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH * WIDTH)), pa.array(total.reshape(-1))], names=["cell", "n"])

    n = prints.count()
    both = np.zeros(WIDTH * WIDTH, np.int64)
    for row in prints.select("print").mapInArrow(kernel, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        both[row["cell"]] = row["n"]
    both = both.reshape(WIDTH, WIDTH)
    parts = [Part(places) for places in grouped_places(both, n, part_count(n, p))]
    values = prints.select(F.explode(keys(parts)).alias("x")).groupBy("x.part", "x.key").agg(F.count("*").alias("c"))
    agreeing = {r["part"]: float(r["pairs"]) for r in values.groupBy("part").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs")).collect()}
    mean = np.diag(both) / max(n, 1)
    costs = [{-1: 0.0} | {e: p.key_cost * n * ball(len(x.places), e) + agreeing.get(k, 0.0) * near_share(mean[list(x.places)], e) for e in range(p.bits + 1)} for k, x in enumerate(parts)]
    return [Part(x.places, e) for x, e in zip(parts, shared(costs, p.bits - len(parts) + 1), strict=True)]


def keys(parts: list[Part]):
    """Of a fingerprint its value in every part, as an array of (part, key)."""
    return F.array(*(F.struct(F.lit(k).alias("part"), F.col("print").bitwiseAND(F.lit(x.mask)).alias("key")) for k, x in enumerate(parts)))


def differ(a: str, b: str) -> str:
    return f"bit_count({a} ^ {b})"


def starred(members: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) of every member with the leader of its key's group."""
    # The leader is the least by an order that depends on the part, so that leaders differ.
    leaders = members.groupBy("part", "key").agg(F.min(F.struct(F.xxhash64("print", "part"), "print"))["print"].alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    return members.join(leaders, ["part", "key"]).where(f"print <> leader and {differ('print', 'leader')} <= {p.bits}").select(F.least("print", "leader").alias("a"), F.greatest("print", "leader").alias("b"))


def met(members: DataFrame, parts: list[Part], p: Params) -> DataFrame:
    """Links (a, b) between different components; ``members``: part, key, print, component."""
    spark = members.sparkSession
    used = [k for k, x in enumerate(parts) if x.threshold >= 0]
    sized = members.where(F.col("part").isin(used)).groupBy("part", "key", "component").agg(F.count("*").alias("n"))
    # Of a component with many members of one key, each block is a row of its own.
    many = sized.where(f"n > {p.block}").select("part", "key", "component", F.ceil(F.col("n") / p.block).cast("int").alias("blocks"))
    dealt = members.where(F.col("part").isin(used)).join(many, ["part", "key", "component"], "left").withColumn("block", F.pmod(F.xxhash64("print"), F.coalesce("blocks", F.lit(1))))
    rows = dealt.groupBy("part", "key", "component", "block").agg(F.collect_list("print").alias("prints"), F.min("print").alias("one"))
    blocks, blocks_at = written(rows, "blocks")
    # The changes to a value are a table of a fixed size: what the thresholds allow.
    flips = spark.createDataFrame([(k, f) for k in used for f in parts[k].flips()], "part int, flip bigint")
    x = blocks.join(F.broadcast(flips), "part").select("part", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), F.col("component").alias("ca"), F.col("prints").alias("pa"), F.col("one").alias("oa"))
    y = blocks.select("part", "key", F.col("component").alias("cb"), F.col("prints").alias("pb"), F.col("one").alias("ob"))
    near = F.expr(f"ca < cb and if(size(pa) = 1 and size(pb) = 1, {differ('oa', 'ob')} <= {p.bits}, exists(pa, u -> exists(pb, v -> {differ('u', 'v')} <= {p.bits})))")
    same = (F.col("x.part") == F.col("y.part")) & (F.col("x.key") == F.col("y.key"))
    linked = x.alias("x").join(y.alias("y"), same & near).select("pa", "pb")
    # One link of two blocks joins their components; the components' own links are known.
    pair = F.expr(f"filter(flatten(transform(pa, u -> transform(filter(pb, v -> {differ('u', 'v')} <= {p.bits}), v -> struct(least(u, v) as a, greatest(u, v) as b)))), (x, i) -> i = 0)[0]")
    out, out_at = written(linked.select(pair.alias("x")).select("x.a", "x.b").distinct(), "met")
    removed(spark, blocks_at)
    return out


def near_groups(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id``, ``print`` and ``component_id`` (least ``doc_id`` reached) of every row of ``docs``."""
    spark = docs.sparkSession
    rows, _ = written(fingerprints(docs, p), "prints")
    nodes, nodes_at = written(rows.groupBy("print").agg(F.min("doc_id").alias("doc_id")), "nodes")
    parts = planned(nodes, p)
    members, members_at = written(nodes.select("print", F.explode(keys(parts)).alias("x")).select("x.part", "x.key", "print"), "members")
    first, first_at = written(starred(members, p).distinct(), "starred")
    label, label_at = written(components(first), "labels")
    labels = label.select(F.col("id").alias("print"), "component")
    second = met(members.join(labels, "print", "left").withColumn("component", F.coalesce("component", "print")), parts, p)
    tied = label.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(second).distinct()
    final, final_at = written(components(tied), "components")
    named = nodes.join(final.select(F.col("id").alias("print"), "component"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found, _ = written(named.join(least, "component").select("print", "component_id"), "named")
    removed(spark, nodes_at, members_at, first_at, label_at, final_at)
    return rows.join(found, "print").select("doc_id", "print", "component_id")
