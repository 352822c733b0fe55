"""Expressions in stages: each stage may use the columns of the ones before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = Mapping[str, str]


def with_stages(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Add the columns of all stages. Stages with one partitioning and order share one sort."""
    for stage in stages:
        df = df.select("*", *(F.expr(e).alias(name) for name, e in stage.items()))
    return df


def staged_sql(base: str, stages: Sequence[Stage]) -> str:
    """The same as nested SELECTs."""
    for stage in stages:
        columns = ", ".join(f"{e} AS {name}" for name, e in stage.items())
        base = f"SELECT *, {columns} FROM ({base}) AS t"
    return base
