"""All queries over bars and tables."""

from __future__ import annotations

from heliograph.plans import books, calendar, cleaning, files, frames, models, nulls, ranks, recursive, registry, rules, signals, statistics, streams, sweeps, tables, texts, trades, triage, walks, windows  # noqa: F401  importing registers


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
