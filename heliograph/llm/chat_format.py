"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered turn by turn:

    system     <<SYS>> text <</SYS>>
    user       [INST] text [/INST]
    assistant  <s> text </s>
    any other  <<ROLE>>role<<TEXT>> text <</ROLE>>

and parsed again by a deterministic grammar: an opening mark, a space, the
shortest text, a space and a closing mark. If the parsed turns are not the
source's, the texts are escaped (a backslash before backslashes, ``<`` and
``[``) and the result is parsed again. An escaped text holds no mark, so this one
repetition suffices: every conversation ends identical, and ``identical``, which
compares the turns read back with the source, says so. A conversation whose texts or roles hold
the mark of a named role is escaped at once: only there could the parser look in
vain, again and again, for the end of a name. So it is linear in a conversation's length.

Turns are ordered by turn, role and text; repeated rows are turns of their own.
Texts of any length are kept whole; a conversation has at most 2 GB. Null text and null role are empty.
Rows with a null ``conv_id`` form one conversation. A conversation is one value
of the output, so its turns come together in one row; nothing else is gathered.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
NAMED = "<<ROLE>>"
#: One turn of formatted text; no escaped text holds a space and a closing mark.
TURN = r"(?s)(?:<<SYS>>|\[INST\]|<s>|<<ROLE>>.*?<<TEXT>>) .*? (?:<</SYS>>|\[/INST\]|</s>|<</ROLE>>)"


def escaped(text: Column) -> Column:
    """A backslash before every backslash, ``<`` and ``[``."""
    return F.regexp_replace(text, r"([\\<\[])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\<\[])", "$1")


def rendered(turn: Column, escape: bool) -> Column:
    """The formatted text of one turn, a struct of role and text."""
    role, text = turn["role"], escaped(turn["text"]) if escape else turn["text"]
    named = escaped(role) if escape else role
    opening, closing = F.concat(F.lit("<<ROLE>>"), named, F.lit("<<TEXT>>")), F.lit("<</ROLE>>")
    for known, mark in OPEN.items():
        opening, closing = F.when(role == known, mark).otherwise(opening), F.when(role == known, CLOSE[known]).otherwise(closing)
    return F.concat(opening, F.lit(" "), text, F.lit(" "), closing)


def parsed(piece: Column) -> Column:
    """Role, raw text and its offset in one piece of formatted text."""
    other = piece.startswith("<<ROLE>>")
    role = F.when(other, unescaped(F.regexp_extract(piece, r"(?s)^<<ROLE>>(.*?)<<TEXT>> ", 1)))
    opening, closing = F.length(F.regexp_extract(piece, r"(?s)^<<ROLE>>.*?<<TEXT>>", 0)), F.lit(len("<</ROLE>>"))
    for known, mark in OPEN.items():
        is_it = piece.startswith(mark) & ~other
        role, opening, closing = F.when(is_it, known).otherwise(role), F.when(is_it, len(mark)).otherwise(opening), F.when(is_it, len(CLOSE[known])).otherwise(closing)
    raw = F.substring(piece, opening + 2, F.length(piece) - opening - closing - 2)
    return F.struct(role.alias("role"), raw.alias("raw"), (opening + 1).alias("offset"), F.length(piece).alias("size"))


def pieces(formatted: Column) -> Column:
    return F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))


def recovered(parts: Column) -> Column:
    """Turns as the parser reads them; null unless the pieces are the whole text."""
    return F.transform(parts, lambda x: F.struct(parsed(x)["role"].alias("role"), unescaped(parsed(x)["raw"]).alias("text")))


def formatted(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, the parsed ``turns``, and ``loss_spans`` (code points [first, last) of assistant texts in ``formatted``)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    gathered = conversations.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("rows"))
    source = gathered.select("conv_id", F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"))
    first = source.withColumn("plain", F.array_join(F.transform("source", lambda x: rendered(x, False)), ""))
    hostile = F.exists("source", lambda x: x["text"].contains(NAMED) | x["role"].contains(NAMED))
    first = first.withColumn("parts", pieces(F.when(~hostile, F.col("plain")).otherwise(""))).withColumn("fine", ~hostile & (F.array_join("parts", "") == F.col("plain")) & (recovered(F.col("parts")) == F.col("source")))
    chosen = first.select("conv_id", "source", F.when(F.col("fine"), F.col("plain")).otherwise(F.array_join(F.transform("source", lambda x: rendered(x, True)), "")).alias("formatted"))
    read = chosen.withColumn("parsed", F.transform(pieces(F.col("formatted")), parsed))
    # A running end for every turn, by one sorted pass over the sizes.
    read = read.withColumn("ends", F.expr("aggregate(parsed, named_struct('n', 0L, 'all', array(0L)), (s, x) -> named_struct('n', s.n + x.size, 'all', array_append(s.all, s.n + x.size)), s -> s.all)"))
    spans = F.expr("filter(transform(parsed, (x, i) -> named_struct('role', x.role, 'first', ends[i] + x.offset, 'last', ends[i] + x.offset + length(x.raw))), x -> x.role = 'assistant')")
    turns = F.transform("parsed", lambda x: F.struct(x["role"].alias("role"), unescaped(x["raw"]).alias("text")))
    done = read.select("conv_id", "formatted", "source", turns.alias("turns"), F.transform(spans, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"))).alias("loss_spans"))
    return done.select("conv_id", "formatted", "turns", "loss_spans", (F.col("turns") == F.col("source")).alias("identical"))


def digests(done: DataFrame) -> DataFrame:
    """What can be read back from ``formatted``: turn counts, digests of turns and of the text under the loss mask, and whether turns are the source's."""
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda x: unescaped(F.substring(F.col("formatted"), x["first"] + 1, x["last"] - x["first"]))), "")
    read = done.select("conv_id", "formatted", "identical", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), loss.alias("loss"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"), "identical")
