"""Repair of the turn structure of conversations.

A conversation should read ``(s?(ua)+)?``: perhaps a system turn, then user and
assistant in turn. Its rows, by turn, are kept (free), given the role that fits
(3), or deleted (4, the only way for blank and duplicate rows); turns without text are
inserted (3); a truncated row that stays costs 3 more. Of the cheapest edits
the ones whose letters D, I, K, R read least are taken.

States of the grammar times places between rows are the nodes of a graph, edits
its arcs. A cost pass leaves the optimal arcs. Nodes are then ranked by the
first 1, 2, 4, ... letters of their least way on: the rank by twice as many
letters is that of the pair of ranks of a node and of the node that many steps
ahead, whose pointers double along. The ranks choose each node's arc, and
the doubled pointers read off the path. Numpy does this for all conversations of an
Arrow batch at once.

No conversation is held by one task. All rows are sorted once over the cluster
and numbered; a conversation's rows are cut into chunks of ``CHUNK`` at most.
A chunk is one 4 x 4 matrix of least costs from state to state. Per
conversation only these matrices meet, one for ``CHUNK`` rows, and give every chunk
the costs ahead of it; then each chunk finds its least path from every state
it may be entered in, and one more pass over chunks says which. No path through a
chunk is the beginning of another, as both end with the chunk's last row, so the
least letters of chunks are the least letters of the whole.

Null role and null text are one space: such a row is blank. Rows of equal turn
are ordered by role and text, null turns come first. Roles count by their first
character, case and all; an empty role fits nowhere. Rows with a null ``conv_id``
are one conversation. Repeated rows are rows of their own, and so duplicates. Texts
of any length are read whole and leave the tables only for the repaired turns.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.session import written

#: Rows of a conversation that one step handles together, as a power of two.
CHUNK_BITS = 12
#: Rows whose nodes one numpy step holds.
STEP_ROWS = 100_000
SPACES = " \t\n\x0b\x0c\r"
STATES, NONE = 4, 1 << 40
#: State 0 is the start, 1 after a system turn, 2 after a user's, 3 after an assistant's. Where a turn leads; -1: nowhere.
INITIALS = "sua"
LEADS = np.array([[1, 2, -1], [-1, 2, -1], [-1, -1, 3], [-1, 2, -1]])
#: The state after the turn of user or assistant that fits, whether inserted or given a new role.
FITTING = np.array([2, 2, 3, 2])
ROLE_AT = ["user", "user", "assistant", "user"]
ENDS = np.array([True, False, False, True])
#: What follows the last row until the conversation may end.
LAST_INSERTS = np.array([0, 2, 1, 0])
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Letters in ASCII order; an arc's letter is its number here.
LETTERS = np.frombuffer(b"DIKR", np.uint8)
D, I, K, R = range(4)  # noqa: E741
FINE, CUT, DUPLICATE, BLANK = range(4)


def arcs() -> tuple[np.ndarray, np.ndarray]:
    """Cost and next state by code (4 * initial + fault), state and letter; inserting stays before the row."""
    cost, to = np.full((16, STATES, 4), NONE, np.int64), np.zeros((16, STATES, 4), np.int64)
    for code in range(16):
        initial, fault = divmod(code, 4)
        for q in range(STATES):
            cost[code, q, D], to[code, q, D] = DELETE, q
            cost[code, q, I], to[code, q, I] = INSERT, FITTING[q]
            if fault in (FINE, CUT):
                more = TRUNCATED * (fault == CUT)
                cost[code, q, R], to[code, q, R] = REROLE + more, FITTING[q]
                if initial < 3 and LEADS[q, initial] >= 0:
                    cost[code, q, K], to[code, q, K] = KEEP + more, LEADS[q, initial]
    return cost, to


COST, TO = arcs()


def before_row(row: np.ndarray) -> np.ndarray:
    """Least costs by state when turns may be inserted first, from those (last axis) when none are."""
    once = row[..., FITTING] + INSERT
    return np.minimum(row, np.minimum(once, once[..., FITTING] + INSERT))


def steps() -> np.ndarray:
    """For every code the least costs from state to state of one row with insertions before it."""
    out = np.full((16, STATES, STATES), NONE, np.int64)
    for code in range(16):
        for q in range(STATES):
            for x in (D, K, R):
                if COST[code, q, x] < NONE:
                    out[code, q, TO[code, q, x]] = min(out[code, q, TO[code, q, x]], COST[code, q, x])
    return np.minimum(np.swapaxes(before_row(np.swapaxes(out, 1, 2)), 1, 2), NONE)


STEP = steps()
#: Cost from the end of the last row to a proper end.
END_COST = LAST_INSERTS * INSERT


def runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the lists of ``column`` hold some ``STEP_ROWS`` values together, one list at least."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0, np.int64)
        row = 0
        while row < batch.num_rows:
            before = ends[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(ends, before + STEP_ROWS, "right")))
            yield batch.slice(row, end - row)
            row = end


def flat(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all chunks one after another, and where each chunk begins."""
    sizes = np.array([len(x) for x in codes], np.int64)
    return codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def matrices(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least costs from state to state through every chunk."""
    sizes = np.diff(at)
    out = np.full((len(sizes), STATES, STATES), NONE, np.int64)
    out[:, range(STATES), range(STATES)] = 0
    order = np.argsort(-sizes, kind="stable")
    for t in range(int(sizes.max(initial=0))):
        on = order[: int(np.searchsorted(-sizes[order], -t, "left"))]
        out[on] = np.minimum((out[on][:, :, :, None] + STEP[codes[at[on] + t]][:, None]).min(2), NONE)
    return out


@dataclass
class Ways:
    """Nodes 4 * (place + chunk) + state over all chunks: the letter and target of the chosen arc, ranks, doubled pointers, steps to the end."""

    letter: np.ndarray
    rank: np.ndarray
    pointers: list[np.ndarray]
    length: np.ndarray

    def path(self, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The letters of the least path from every start, and the node that it ends in."""
        sizes = self.length[starts]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        node, step = np.repeat(starts, sizes), np.arange(begins[-1]) - np.repeat(begins[:-1], sizes)
        last, left = starts.copy(), sizes.copy()
        for k, ahead in enumerate(self.pointers):
            node = np.where(step >> k & 1, ahead[node], node)
            last = np.where(left >> k & 1, ahead[last], last)
        text = LETTERS[self.letter[node]].tobytes()
        return [text[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)], last


def ways(codes: np.ndarray, at: np.ndarray, ahead: np.ndarray) -> Ways:
    """Rank every node of every chunk by its least optimal way to the chunk's end; ``ahead``: costs from there on, by chunk and state."""
    sizes = np.diff(at)
    place = at[:-1] + np.arange(len(sizes))
    go = np.zeros((len(codes) + len(sizes), STATES), np.int64)
    go[place + sizes] = ahead
    order = np.argsort(-sizes, kind="stable")
    for t in range(int(sizes.max(initial=0))):
        on = order[: int(np.searchsorted(-sizes[order], -t, "left"))]
        here = place[on] + sizes[on] - t - 1
        code = codes[at[on] + sizes[on] - t - 1]
        row = np.stack([COST[code, :, x] + np.take_along_axis(go[here + 1], TO[code, :, x], 1) for x in (D, K, R)]).min(0)
        go[here] = before_row(row)
    n = len(go) * STATES
    # The optimal arcs: what an arc costs and what lies ahead of it are together what lies ahead of its node.
    last = np.zeros(len(go), bool)
    last[place + sizes] = True
    here = np.flatnonzero(~last)
    code, state = codes, np.arange(STATES)
    target, is_arc = np.tile(np.arange(n)[:, None], (1, 4)), np.zeros((n, 4), bool)
    for x in range(4):
        to = TO[code, :, x]
        node, next_place = here[:, None] * STATES + state, here[:, None] + (x != I)
        is_arc[node, x] = COST[code, :, x] + go[next_place, to] == go[here]
        target[node, x] = next_place * STATES + to
    # A node has at most one arc of each letter: its rank by one letter is its least letter, 0 at a chunk's end.
    inner = is_arc.any(1)
    letter = np.where(inner, is_arc.argmax(1), 0)
    pointer = np.where(inner, target[np.arange(n), letter], np.arange(n))
    rank, length, pointers = np.where(inner, letter + 1, 0).astype(np.int64), inner.astype(np.int64), [pointer]
    while inner[pointers[-1]].any():
        p = pointers[-1]
        rank = np.unique(rank * (n + 5) + rank[p], return_inverse=True)[1].astype(np.int64)
        length = length + length[p]
        pointers.append(p[p])
    # The whole ranks select: the arc of the least letter, then of the least way on.
    score = np.where(is_arc, np.arange(4) * (n + 5) + rank[target], NONE * (n + 5))
    letter = np.where(inner, score.argmin(1), 0)
    assert (np.where(inner, target[np.arange(n), letter], np.arange(n)) == pointers[0]).all()
    return Ways(letter, rank, pointers, length)


def numbered(conversations: DataFrame) -> DataFrame:
    """All rows in the order of conversations and turns, with ``pos``: consecutive inside a sorted partition, rising over all."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), filled("role"), filled("text"))
    return rows.orderBy(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text").withColumn("pos", F.monotonically_increasing_id())


def coded(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` and ``code`` (4 * initial + fault) of numbered rows."""
    tail = F.rtrim(F.col("text"), F.lit(SPACES))
    judged = rows.select("conv_id", "pos", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), (tail == "").alias("blank"), F.substring(tail, -1, 1).isin(".", "!", "?").alias("closed"))
    first = judged.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    initial: Column = F.lit(3)
    for k, c in enumerate(INITIALS):
        initial = F.when(F.substring("role", 1, 1) == c, k).otherwise(initial)
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("closed"), CUT).otherwise(FINE)
    return judged.join(first, "pos", "left").select("conv_id", "pos", (4 * initial + fault).cast("int").alias("code"))


def chunked(codes: DataFrame) -> DataFrame:
    """A row for each chunk: ``conv_id``, ``at`` (its first ``pos``), ``codes``, counts of faults, illegal neighbours inside, and its ``matrix``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 2):
            codes, at = flat(batch.column(2))
            add = lambda x: np.add.reduceat(np.append(x, 0), at[:-1]).astype(np.int64)  # noqa: E731, B023
            initial, fault = codes // 4, codes % 4
            pair = np.zeros(len(codes), np.int64)
            pair[1:] = illegal(initial[:-1], initial[1:])
            pair[at[:-1]] = 0
            counts = [add(fault == BLANK), add(fault == DUPLICATE), add(fault == CUT), add(pair)]
            cost = pa.array(matrices(codes, at).reshape(len(at) - 1, -1).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *map(pa.array, counts), pa.array(initial[at[:-1]]), pa.array(initial[at[1:] - 1]), cost], names=["conv_id", "at", "codes", "blank", "duplicate", "truncated", "illegal", "opens", "closes", "matrix"])

    # A chunk has at most 2**CHUNK_BITS rows.
    lists = codes.groupBy("conv_id", F.shiftright("pos", CHUNK_BITS)).agg(F.min("pos").alias("at"), F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("list"))
    schema = "conv_id bigint, at bigint, codes array<int>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, opens bigint, closes bigint, matrix array<bigint>"
    return lists.select("conv_id", "at", F.col("list.code").alias("codes")).mapInArrow(kernel, schema)


def illegal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One where initials are not su, ua or au."""
    return np.array([[1, 0, 1, 1], [1, 1, 0, 1], [1, 0, 1, 1], [1, 1, 1, 1]])[a, b]


def costs_ahead(chunks: DataFrame) -> DataFrame:
    """For each chunk: ``at``, ``ahead`` (least costs by state from its end on), ``leads`` and ``ends`` (first, last of its conversation), and at the first the ``cost`` of all and the illegal neighbours ``between`` chunks."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {x: [] for x in ("conv_id", "at", "ahead", "leads", "ends", "cost", "between")}
            for conv, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ahead, found = END_COST, []
                for c in reversed(chunks):
                    found.append(ahead.tolist())
                    ahead = (np.array(c["matrix"]).reshape(STATES, STATES) + ahead).min(1)
                n = len(chunks)
                between = sum(int(illegal(np.array(a["closes"]), np.array(b["opens"]))) for a, b in zip(chunks, chunks[1:], strict=False))
                for name, values in (("conv_id", [conv] * n), ("at", [c["at"] for c in chunks]), ("ahead", found[::-1]), ("leads", [k == 0 for k in range(n)]), ("ends", [k == n - 1 for k in range(n)]), ("cost", [int(ahead[0]), *[0] * (n - 1)]), ("between", [between, *[0] * (n - 1)])):
                    out[name] += values
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], names=list(out))

    lists = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "matrix", "opens", "closes"))).alias("chunks"))
    return lists.mapInArrow(kernel, "conv_id bigint, at bigint, ahead array<bigint>, leads boolean, ends boolean, cost bigint, between bigint")


def paths(chunks: DataFrame, ahead: DataFrame) -> DataFrame:
    """For each chunk: the least ``letters`` and the state reached (``exits``) from every state that it may be entered in."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 1):
            codes, at = flat(batch.column(1))
            leads = batch.column(3).to_pylist()
            found = ways(codes, at, np.array(batch.column(2).to_pylist(), np.int64).reshape(-1, STATES))
            many = np.array([1 if x else STATES for x in leads], np.int64)  # the first chunk is entered at the start
            chunk = np.repeat(np.arange(len(many)), many)
            entry = np.concatenate([np.arange(k) for k in many]) if len(many) else np.zeros(0, np.int64)
            letters, last = found.path((at[chunk] + chunk) * STATES + entry)
            ends = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array([x.decode() for x in letters], pa.string())), pa.ListArray.from_arrays(ends, pa.array(last % STATES))], names=["at", "letters", "exits"])

    both = chunks.join(ahead, "at").select("at", "codes", "ahead", "leads")
    return both.mapInArrow(kernel, "at bigint, letters array<string>, exits array<bigint>").join(ahead.select("conv_id", "at", "ends"), "at")


def chosen(found: DataFrame) -> DataFrame:
    """For each chunk: the state that it is entered in, and at the last the state after it (``after``, else null)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, entry, after = [], [], []
            for chunks in batch.column(0).to_pylist():
                q = 0
                for c in chunks:
                    at.append(c["at"])
                    entry.append(q)
                    q = c["exits"][q]
                    after.append(q if c["ends"] else None)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(entry, pa.int64()), pa.array(after, pa.int64())], names=["at", "entry", "after"])

    lists = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "exits", "ends"))).alias("chunks"))
    return lists.select("chunks").mapInArrow(kernel, "at bigint, entry bigint, after bigint")


def edits(pieces: DataFrame) -> DataFrame:
    """For each row: ``pos``, ``before`` and ``behind`` (roles inserted before it, after the last), and the ``role`` that it gets: null if deleted, empty if kept."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, before, role, behind = [], [], [], []
            for at, q, after, letters, initials in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row, inserted = 0, []
                for x in letters:
                    if x == "I":
                        inserted.append(ROLE_AT[q])
                        q = int(FITTING[q])
                        continue
                    pos.append(at + row)
                    before.append(inserted)
                    role.append(None if x == "D" else ROLE_AT[q] if x == "R" else "")
                    behind.append([])
                    q = q if x == "D" else int(FITTING[q]) if x == "R" else int(LEADS[q, initials[row]])
                    row, inserted = row + 1, []
                if after is not None:
                    for _ in range(int(LAST_INSERTS[after])):
                        behind[-1].append(ROLE_AT[after])
                        after = int(FITTING[after])
            names = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(before, names), pa.array(role, pa.string()), pa.array(behind, names)], names=["pos", "before", "new_role", "behind"])

    rows = pieces.select("at", "entry", "after", "piece", F.transform("codes", lambda c: F.floor(c / 4).cast("int")).alias("initials"))
    return rows.mapInArrow(kernel, "pos bigint, before array<string>, new_role string, behind array<string>")


def repaired(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per conversation its ``gaps``, faults, ``illegal``, ``cost`` and ``audit``; and the repaired turns: ``conv_id``, ``pos``, ``k``, ``role``, ``text``, in the order of (pos, k)."""
    rows, _ = written(numbered(conversations), "turns")
    chunks, _ = written(chunked(coded(rows)), "chunks")
    ahead, _ = written(costs_ahead(chunks), "ahead")
    found, _ = written(paths(chunks, ahead), "paths")
    taken = found.join(chosen(found), "at")
    piece = F.element_at("letters", (F.col("entry") + 1).cast("int"))
    inserts = F.expr("repeat('I', element_at(array(" + ", ".join(map(str, LAST_INSERTS)) + "), int(after) + 1))")
    pieces, _ = written(taken.select("conv_id", "at", "entry", "after", piece.alias("piece"), F.coalesce(inserts, F.lit("")).alias("tail")).join(chunks.select("at", "codes"), "at"), "pieces")
    letters = pieces.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat("piece", "tail").alias("s")))), lambda x: x["s"]), "").alias("audit"))
    turns = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    counts = chunks.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    totals = ahead.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum("between").alias("between"))
    parts = turns.unionByName(counts, True).unionByName(totals, True).unionByName(letters, True)
    summary = parts.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in parts.columns[1:])).withColumn("illegal", F.col("illegal") + F.col("between")).drop("between")

    none = F.lit("")
    empty = lambda names: F.transform(names, lambda r: F.struct(r.alias("role"), none.alias("text")))
    own = F.when(F.col("new_role").isNull(), F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(F.when(F.col("new_role") == "", F.col("role")).otherwise(F.col("new_role")).alias("role"), "text")))
    lines = F.concat(empty(F.col("before")), own, empty(F.col("behind")))
    done = rows.join(edits(pieces), "pos").select("conv_id", "pos", F.posexplode(lines).alias("k", "x")).select("conv_id", "pos", "k", "x.role", "x.text")
    return summary, done


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of every conversation's repaired ``role:text`` lines.

    A digest is made from first byte to last, so a conversation's lines pass
    through one task; they are sorted by Spark and read as a stream, and none are held.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda c, h: pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([h.hexdigest()])], names=["conv_id", "repaired_sha256"])
        now, hashed = None, None
        for batch in batches:
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hashed is not None and conv == now:
                    hashed.update(b"\n")
                else:
                    if hashed is not None:
                        yield made(now, hashed)
                    now, hashed = conv, hashlib.sha256()
                hashed.update(line.encode())
        if hashed is not None:
            yield made(now, hashed)

    lines = turns.select("conv_id", "pos", "k", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "k")
    return lines.select("conv_id", "line").mapInArrow(kernel, "conv_id bigint, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows harmed by the check sum of ``conv_id:turn`` modulo 20: 0 dropped, 1 emptied, 2 without closing marks, 3 repeated, 4 said by the user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.pmod(F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), harm.alias("harm")).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def audited(conversations: DataFrame) -> DataFrame:
    """Damage, repair, and one row for every conversation of the table."""
    summary, turns = repaired(damaged(conversations))
    known = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    parts = known.unionByName(summary, True).unionByName(digests(turns), True)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    done = parts.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in counts), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    return done
