"""All pairs of a set, block against block, as grouped tasks of bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block: the set is cut into ``PARTS`` blocks, whose rows are at least ``LEAST`` and at most ``MOST``. A task holds
#: two blocks and what it makes of ``SLICE`` of its rows at a time.
PARTS, LEAST, MOST, SLICE = 12, 1024, 16_384, 256


def by_blocks(rows: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, block: int | None = None, half: bool = False, most: int = MOST) -> DataFrame:
    """``compare(a, b, same)`` of every block of ``rows`` (column id) with every block, in a task of its own; ``same``: both are
    the same block. With ``half`` each pair of blocks comes once, in one order. Rows are dealt to blocks by their ids' hashes;
    n rows are shuffled once for each block: ``PARTS`` times, or, beyond ``PARTS`` blocks of ``most`` rows, n / ``most`` times."""
    n = block_count(rows, block, most)
    of = dealt(n)
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("__a", of).withColumn("__b", every)
    right = rows.withColumn("__b", of).withColumn("__a", every)
    if half:
        left, right = left.where("__a <= __b"), right.where("__a <= __b")
    return _met(left, right, compare, schema)


def between(few: DataFrame, rows: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int | None = None, most: int = MOST) -> DataFrame:
    """``compare(a, b)`` of every block of ``few`` with every block of ``rows`` (columns id). Those of ``few`` are as large as
    may be: ``rows`` are shuffled once for each."""
    m, n = max(1, math.ceil(few.count() / (block or most))), block_count(rows, block, most)
    left = few.withColumn("__a", dealt(m)).withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = rows.withColumn("__b", dealt(n)).withColumn("__a", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    return _met(left, right, lambda a, b, same: compare(a, b), schema)


def block_count(rows: DataFrame, block: int | None = None, most: int = MOST) -> int:
    size = rows.count()
    return max(1, math.ceil(size / (block or min(most, max(LEAST, math.ceil(size / PARTS))))))


def dealt(n: int) -> Column:
    """The block, of n, that a row's id is dealt to."""
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def _met(left: DataFrame, right: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str) -> DataFrame:
    keys = ["__a", "__b"]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        return compare(a.drop(columns=keys), b.drop(columns=keys), key[0] == key[1])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)
