"""Column builders shared by the operators that stay inside DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def private_names(docs: DataFrame, *labels: str) -> list[str]:
    """A name for each label that no column of ``docs`` has, whatever its case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for label in labels:
        name = f"__{label}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def plain_words(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NOT_SPACE + "+")).cast("long")
