"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

from __future__ import annotations

import random

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, keys array<int>, n_words int, component_id bigint"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]) + rng.choice(["", "", "", ",", "s", "ing"]) for _ in range(n))


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(20, 90)) for _ in range(25)]
    rows: list[tuple[int | None, str | None]] = list(enumerate(base))
    for i in range(12):  # near copies
        words = base[i % 4].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, base[3]), (201, base[3].upper()), (202, base[3]), (3, base[3])]
    rows += [(300, None), (301, ""), (302, "   \n\t "), (303, "one"), (304, "ONE"), (305, "\x00 nul \x00"), (306, "日本語 テキスト"), (307, "a  b   c \n\n d"), (None, base[5]), (None, None)]
    rows.append((400, sentence(rng, 30_000)))
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "src", len(t or ""), "k", [1], 7, -5) for i, t in rows], COLUMNS)
