"""Permutations by arithmetic: the place of any element of the k-th permutation of 0..n-1, without a sort.

A Feistel network of six rounds maps pairs of half numbers to pairs, one to one, whatever
its round function; the key says which of very many such maps. Its domain is the
least power of four that holds n, so what falls beyond n is mapped again until
it does not (cycle walking), which keeps it one to one on 0..n-1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Factors of the round function, and its modulus, a prime whose square is within 63 bits.
A, B, C, M = 40_503, 9_973, 7_919, (1 << 31) - 19
TURNS = 6


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where permutation ``key`` of 0..n-1 takes x."""
    x, n, key = (np.array(np.broadcast_to(v, np.broadcast(x, n, key).shape), np.int64) for v in (x, n, key))
    half = np.array([max(1, (int(v - 1).bit_length() + 1) // 2) for v in np.unique(n)])[np.searchsorted(np.unique(n), n)]
    mask = (np.int64(1) << half) - 1
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo] % M
        left, right = x[todo] >> h, x[todo] & m
        for turn in range(TURNS):
            z = (right % M * A + k * B + turn * C + 12_345) % M
            y = (z * z + 7 * z) % M
            left, right = right, left ^ ((y * z + 31 * y + k) % M >> 4 & m)
        x[todo] = left << h | right
        todo = todo[x[todo] >= n[todo]]
    return x


@F.pandas_udf(LongType())
def permuted_column(x: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    """``permuted`` for columns."""
    return pd.Series(permuted(x.to_numpy(np.int64), n.to_numpy(np.int64), key.to_numpy(np.int64)))


def duck_permuted(rows: str, columns: str) -> str:
    """DuckDB's form: ``rows`` (with x, n and key) and ``y``, where x goes; ``columns``: those to keep."""
    kept = f"{columns}, n, key"

    def once(source: str, x: str) -> str:
        sql = f"SELECT {kept}, h, CAST(1 AS BIGINT) << h AS size, {x} >> h AS l0, {x} & ((CAST(1 AS BIGINT) << h) - 1) AS r0 FROM {source}"
        for t in range(TURNS):
            sql = f"SELECT *, (r{t} % {M} * {A} + key % {M} * {B} + {t * C + 12_345}) % {M} AS z{t} FROM ({sql}) AS a{t}"
            sql = f"SELECT *, (z{t} * z{t} + 7 * z{t}) % {M} AS y{t} FROM ({sql}) AS b{t}"
            sql = f"SELECT {kept}, h, size, r{t} AS l{t + 1}, xor(l{t}, (((y{t} * z{t} + 31 * y{t} + key % {M}) % {M}) >> 4) & (size - 1)) AS r{t + 1} FROM ({sql}) AS c{t}"
        return f"SELECT {kept}, h, (l{TURNS} << h) | r{TURNS} AS y FROM ({sql}) AS done"

    sized = f"(SELECT *, CAST(greatest(1, (length(bin(n - 1)) + 1) // 2) AS BIGINT) AS h FROM ({rows}) AS r0) AS r1"
    return f"(WITH RECURSIVE c AS ({once(sized, 'x')} UNION ALL {once('c AS c1 WHERE y >= n', 'y')}) SELECT {columns}, y FROM c WHERE y < n)"
