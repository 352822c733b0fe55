"""URL rules by a sorted sweep.

A rule is a host and the start of a path. Hosts are turned round, label by
label and closed by a separator, so a rule's host and all its subdomains are
one interval of keys and intervals are nested or apart. URLs are dealt into
ranges of (key, path, id), sorted, and swept together with the sorted rules: a
stack holds the rules whose interval is open, outermost first. Of the rules on
the stack whose path fits, the longest (host and path; then the longer host;
then the verdict that sorts first) decides.

The rules come in blocks of at most ``BLOCK_RULES``, by size; each block is
broadcast and swept, and the longest of the blocks' rules is taken. Because the
range key ends in the path and the id, the URLs of one busy host are dealt to
many tasks.

Null URLs and URLs without ``://`` have empty host and path, which no rule
fits. URLs may be of any length and hold any characters. Rows may repeat; null ids are allowed. Null rule fields drop the rule;
repeated rules count once. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in one broadcast: at about 100 bytes each, some 50 MB in a Python worker.
BLOCK_RULES = 500_000
#: Closes every label of a key. Where it stands in a host itself, it is escaped, so that no label holds it.
CLOSE, ESCAPE = "\x01", "\x02"
SWEPT = "page_id bigint, host string, path string, rule string, verdict string"


def lower_ascii(text: Column) -> Column:
    """A to Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    fine = F.coalesce(url.contains("://"), F.lit(False))
    return F.when(fine, lower_ascii(F.regexp_extract(url, parts, 1))).otherwise(""), F.when(fine, F.regexp_extract(url, parts, 2)).otherwise("")


def host_key(host: Column) -> Column:
    """Labels from last to first, each closed."""
    plain = F.replace(F.replace(host, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(CLOSE), F.lit(ESCAPE + "c"))
    return F.concat(F.concat_ws(CLOSE, F.reverse(F.split(plain, r"\."))), F.lit(CLOSE))


class Sweep:
    """Judges URLs in ascending key order; ``rules``: (key, path, rule, verdict), sorted.

    A rule is pushed when the sweep reaches its key and popped when it leaves
    its interval; a URL is held against the rules on the stack only.
    """

    def __init__(self, rules: list[tuple[str, str, str, str]]) -> None:
        self.rules = rules
        self.at = 0
        self.stack: list[tuple[str, list[tuple[str, str, str]]]] = []

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        """Rule and verdict of one URL."""
        stack, rules = self.stack, self.rules
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        while self.at < len(rules) and rules[self.at][0] <= key:
            opens = rules[self.at][0]
            if key.startswith(opens):
                if not stack or stack[-1][0] != opens:
                    stack.append((opens, []))
                stack[-1][1].append(rules[self.at][1:])
            self.at += 1
        best: tuple[int, int, str, str] | None = None
        for depth, (_, own) in enumerate(stack):
            for start, rule, verdict in own:
                if path.startswith(start) and (best is None or (len(rule), depth) > best[:2]):
                    best = len(rule), depth, rule, verdict
        return (best[2], best[3]) if best else (None, None)


def swept(urls: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """One block of rules against sorted ranges of URLs (page_id, host, path, key)."""
    shared = urls.sparkSession.sparkContext.broadcast(rules)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(shared.value)
        for batch in batches:
            found = [sweep.judge(k, p) for k, p in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(kernel, SWEPT)


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", block_rules: int = BLOCK_RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``pages``; ``rules``: host, path, verdict."""
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    own = rules.where("host is not null and path is not null and verdict is not null").select(host_key(lower_ascii(F.col("host"))).alias("key"), "path", F.concat(lower_ascii(F.col("host")), "path").alias("rule"), "verdict")
    own = own.groupBy("key", "path", "rule").agg(F.min("verdict").alias("verdict"))
    n = max(1, -(-own.count() // block_rules))
    urls = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = urls.repartitionByRange(parts, "key", "path", "page_id").sortWithinPartitions("key", "path", "page_id")
    each = [swept(ordered, sorted(tuple(r) for r in own.where(F.pmod(F.xxhash64("key", "path"), F.lit(n)) == k).collect())) for k in range(n)]
    found = each[0]
    for more in each[1:]:
        found = found.unionByName(more)
    if n > 1:  # one rule of each block is left for a row; rows that repeat are judged alike
        best = F.max_by(F.struct("rule", "verdict"), F.struct(F.coalesce(F.length("rule"), F.lit(-1)), F.length(F.split_part("rule", F.lit("/"), F.lit(1))))).alias("best")
        found = found.groupBy("page_id", "host", "path").agg(best, (F.count("*") / n).cast("int").alias("copies"))
        found = found.select("page_id", "host", "path", "best.rule", "best.verdict", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
