"""Linear recursions as window expressions: exponential and Wilder means, no row-by-row pass.

A mean y = q * y_before + a * x is a sum of terms that fade by q a row. A
symbol's values are numbered and cut into chunks of so many that a term fades
to ``FADED`` over one chunk. Inside a chunk the sum is a running sum of terms
scaled by q**-place, which stays within a double's range; of all chunks before,
only the last one's own sum still counts. Chunks are windows of their own, so a
symbol's rows spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from heliograph.functions.series import BEFORE, SO_FAR
from heliograph.operators.staged import Stage

#: What a term is worth a chunk later, against the newest one.
FADED = 1e-20


def fading(means: Mapping[str, tuple]) -> list[Stage]:
    """Stages that add exponential means; ``means``: name to (expression, weight of the newest value, least values, values of the seed).

    The seed is the plain mean of the first values (1: the first value itself).
    Null values are skipped: the mean stays as it was. It is null before
    ``least`` values are there.
    """
    number, place, own, carry, done = {}, {}, {}, {}, {}
    for name, (x, weight, *rest) in means.items():
        least, seed = [*rest, 1, 1][:2] if len(rest) < 2 else rest
        q = 1 - weight
        size = max(1, math.ceil(math.log(FADED) / math.log(q))) if q > 0 else 1
        number |= {f"{name}_x": f"CAST({x} AS DOUBLE)", f"{name}_n": f"count({x}) {SO_FAR}"}
        place |= {f"{name}_j": f"greatest({name}_n - {seed}, 0) % {size}", f"{name}_c": f"CAST(floor(greatest({name}_n - {seed}, 0) / {size}) AS BIGINT)", f"{name}_w": f"CASE WHEN {name}_n <= {seed} THEN {1 / seed!r} ELSE {weight!r} END * {name}_x"}
        window = f"OVER (PARTITION BY symbol, {name}_c ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        own |= {f"{name}_s": f"pow(CAST({q!r} AS DOUBLE), {name}_j) * sum({name}_w * pow(CAST({q!r} AS DOUBLE), -{name}_j)) {window}"}
        carry |= {f"{name}_b": f"max_by({name}_s, CASE WHEN {name}_j = {size - 1} THEN {name}_n END) {BEFORE}"}
        done |= {name: f"CASE WHEN {name}_n >= {max(least, seed)} THEN {name}_s + CASE WHEN {name}_c > 0 THEN pow(CAST({q!r} AS DOUBLE), {name}_j + 1) * {name}_b ELSE CAST(0 AS DOUBLE) END END"}
    return [number, place, own, carry, done]


def ema(x: str, span: int, least: int = 1) -> tuple:
    """Exponential mean of a span."""
    return x, 2 / (span + 1), least


def wilder(x: str, n: int, least: int = 1) -> tuple:
    """Wilder's mean from the first value on."""
    return x, 1 / n, least


def seeded(x: str, n: int) -> tuple:
    """Wilder's mean seeded with the mean of the first n values."""
    return x, 1 / n, n, n


def relative_strength(gain: str, loss: str) -> str:
    return f"CASE WHEN {gain} IS NULL THEN NULL WHEN {loss} = 0 THEN 100 ELSE 100 - 100 / (1 + {gain} / {loss}) END"


#: Of a change ``d``: its rise and its fall.
GAIN, LOSS = "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END"


def directional_index(n: int) -> list[Stage]:
    """Adds ``adx``, ``pdi`` and ``mdi`` of true range ``tr`` and the moves ``pdm`` and ``mdm``; the index starts at the first value that there is."""
    moves = {"_r": seeded("tr", n), "_p": seeded("pdm", n), "_m": seeded("mdm", n)}
    both = {"pdi": "100 * _p / nullif(_r, 0)", "mdi": "100 * _m / nullif(_r, 0)"}
    return [*fading(moves), both, {"_dx": "CASE WHEN pdi IS NOT NULL THEN coalesce(100 * abs(pdi - mdi) / nullif(pdi + mdi, 0), 0) END"}, *fading({"adx": wilder("_dx", n)})]
