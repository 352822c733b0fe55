"""Licence scans.

One Aho-Corasick automaton finds notice phrases and identifier tags in the
word-by-word form of a text: lower-cased words, one space between them. At an
identifier tag the licence expression that follows is read from the text itself
and evaluated by a shunting-yard parser: ``or`` needs one permitted side,
``and`` both, and ``with`` adds an exception to a licence.

Null and wordless texts have no words, places or labels. Rows may repeat. Texts
of any length are scanned whole, in time that grows with their length. Places
that begin together count one by one. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.words import ALNUM_TRANSLATE, runs

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases, as words, and their labels.
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "under the apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: A tag, and what follows up to the next tag or the line's end.
EXPRESSION = re.compile(r"SPDX-License-Identifier\s*:\s*((?:(?!SPDX-License-Identifier\s*:)[^\r\n])*)", re.I)
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
#: Identifiers whose label differs from their lower-cased form.
SAME_AS = {"apache-2.0": "apache-2", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-3.0": "cc-by-nc"}
PERMITTED = frozenset({"mit", "apache-2", "bsd-2-clause", "bsd-3-clause", "isc", "cc0", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib", "public-domain"})
#: How tightly operators bind.
BINDS = {"or": 1, "and": 2, "with": 3}
SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, permitted boolean"


def postfix(expression: str) -> list[str]:
    """The expression's tokens in postfix order, by two stacks. Stops at the first token that does not fit; an unclosed bracket closes at the end."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for m in TOKEN.finditer(expression):
        token = m[0].lower()
        if token == "(" and operand_next:
            waiting.append(token)
        elif token == ")" and not operand_next and "(" in waiting:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in BINDS and not operand_next:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        elif operand_next and token not in BINDS and token not in "()":
            out.append(SAME_AS.get(token, token))
            operand_next = False
        else:
            break
    if operand_next:  # an operator without its right side, and brackets that hold nothing
        while waiting and waiting[-1] == "(":
            waiting.pop()
        if waiting:
            waiting.pop()
    while waiting:
        top = waiting.pop()
        if top != "(":
            out.append(top)
    return out


def evaluated(expression: str) -> tuple[set[str], bool | None]:
    """Licences that an expression names, exceptions left out, and whether it permits use; None for an empty one."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix(expression):
        if token not in BINDS:
            stack.append(({token}, token in PERMITTED))
            continue
        (right, right_fine), (left, left_fine) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, left_fine))
        else:
            stack.append((left | right, left_fine and right_fine if token == "and" else left_fine or right_fine))
    return stack[-1] if stack else (set(), None)


def automaton():  # noqa: ANN201
    """The Aho-Corasick automaton of all phrases, each with a space on both sides."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        made.add_word(f" {phrase} ", phrase)
    made.make_automaton()
    return made


def word_numbers(words: str, places: list[int]) -> list[int]:
    """The numbers of the words that begin at ascending places, by one pass over the text."""
    out: list[int] = []
    at = n = 0
    for place in places:
        n += words.count(" ", at, place)
        at = place
        out.append(n - 1)
    return out


def scanned(text: str, words: str, n_words: int, find) -> tuple:  # noqa: ANN001
    """A row of ``SCHEMA`` without the id. ``words``: the text's words, a space before, between and after them."""
    base: list[tuple[int, str]] = []
    labels: set[str] = set()
    places = tags = 0
    permitted: bool | None = None
    for end, phrase in find(words):
        places += 1
        if phrase == TAG:
            tags += 1
            continue
        if phrase in BASE:
            base.append((end - len(phrase), BASE[phrase]))
        labels.add(BASE.get(phrase) or NOTICES[phrase])
    if tags:
        for m in EXPRESSION.finditer(text):
            found, fine = evaluated(m[1])
            labels |= found
            if fine is not None:
                permitted = fine if permitted is None else permitted and fine
    starts = word_numbers(words, sorted(p for p, _ in base))
    return n_words, len(base), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 - 0.5 ** (places + tags), permitted


def scan(docs: DataFrame) -> DataFrame:
    """Places, labels, score (1 - 2**-evidence; a tag counts twice) and verdict of every whole text. Map only."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton().iter
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
        for batch in batches:
            for rows, _, _ in runs(batch, 1):
                found = []
                for text in rows.column(1).to_pylist():
                    words = (text or "").encode().translate(ALNUM_TRANSLATE).split()
                    found.append(scanned(text or "", f" {b' '.join(words).decode()} ", len(words), find))
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(kernel, SCHEMA)
