"""Columns by name, whatever the name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of this very name; dots and backquotes in it are no syntax."""
    return F.col("`" + name.replace("`", "``") + "`")


def place(df: DataFrame, name: str) -> str:
    """What ``numbered`` calls a column."""
    return f"c{df.columns.index(name)}"


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1 and so on: what finds columns by name then takes any."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
