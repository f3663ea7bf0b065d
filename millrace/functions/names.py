"""Names for columns that an operator adds for a while, or gives beside a key of any name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(columns: Iterable[str], *wanted: str) -> list[str]:
    """`wanted`, each with as many underscores behind it as it takes to be new among `columns`, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def beside(df: DataFrame, inner: str, key: str, columns: Iterable[str]) -> DataFrame:
    """`inner` under the name `key`, and `columns`; one that has the key's name gets an underscore."""
    columns = list(columns)
    return df.select(F.col(inner).alias(key), *[quoted(c).alias(n) for c, n in zip(columns, unused([key], *columns))])


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
