"""Resumable copies of tables between stores, in key ranges that a ledger keeps.

    ledger/range=K         one row: range, rows, checksum; written when the range's rows are
    ranges                 the bounds, fixed by the first run
    rows/range=K           the copied rows

A range is written whole over what a lost run may have left of it, and its ledger row after it, so that doing a range twice
changes nothing and a run that was stopped goes on with the ranges that have no ledger row. Bounds come from the keys'
approximate quantiles; a key of any number of rows is in one range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import exists
from .stats import count_differences


@dataclass(frozen=True)
class Progress:
    ranges: int
    done: int
    rows: int


def _fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows and a checksum that does not depend on their order; maps count by their sorted entries."""
    plain = [F.array_sort(F.map_entries(f"`{c}`")) if t.startswith("map") else F.col(f"`{c}`") for c, t in sorted(df.dtypes)]
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*plain).cast("decimal(38,0)")), F.lit(0)).alias("c")).first()
    return int(r["n"]), int(r["c"]) % (1 << 63)


class Migration:
    """A copy of ``source`` (read again for every range, by its key) into the folder ``path``."""

    def __init__(self, source: DataFrame, path: str, key: str, ranges: int = 64):
        if ranges < 1:
            raise ValueError("at least one range")
        self.source, self.path, self.key, self.asked = source, path, key, ranges
        self.spark: SparkSession = source.sparkSession

    def bounds(self) -> list[tuple[object, object]]:
        """(from, below) of every range, None for an open end; the first range holds null keys too."""
        if not exists(self.spark, f"{self.path}/ranges/_SUCCESS"):
            kind = self.source.schema[self.key].dataType
            share = [k / self.asked for k in range(1, self.asked)]
            if kind.typeName() in ("string", "binary") or not share:
                # Strings have no quantiles; hashes of the keys cut them evenly, whatever they are.
                cuts = [str(int(-(1 << 63) + s * (1 << 64))) for s in share]
                by = "hash"
            else:
                found = self.source.agg(F.percentile_approx(self.key, share, 10_000)).first()[0] or []
                cuts, by = [str(x) for x in sorted(set(found))], "value"
            self.spark.createDataFrame([(by, cuts)], "cut_by string, cuts array<string>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ranges")
        r = self.spark.read.parquet(f"{self.path}/ranges").first()
        self.by, cuts = r["cut_by"], r["cuts"]
        return list(zip([None, *cuts], [*cuts, None]))

    def _rows(self, low: object, below: object) -> DataFrame:
        key = F.xxhash64(self.key) if self.by == "hash" else F.col(self.key)
        kind = "bigint" if self.by == "hash" else dict(self.source.dtypes)[self.key]
        inside = F.lit(True)
        if low is not None:
            inside = inside & (key >= F.lit(low).cast(kind))
        if below is not None:
            inside = inside & (key < F.lit(below).cast(kind))
        return self.source.where(inside | key.isNull() if low is None else inside)

    def _done(self, k: int) -> bool:
        return exists(self.spark, f"{self.path}/ledger/range={k}/_SUCCESS")

    def run(self, most: int | None = None) -> Progress:
        """Copy the open ranges, ``most`` of them if that is given. A range whose copy differs from its source is an error and
        stays open."""
        for k, (low, below) in enumerate(self.bounds()):
            if self._done(k):
                continue
            if most is not None and most <= 0:
                break
            at = f"{self.path}/rows/range={k}"
            rows = self._rows(low, below)
            rows.write.mode("overwrite").parquet(at)
            want, got = _fingerprint(rows), _fingerprint(self.spark.read.schema(rows.schema).parquet(at))
            if want != got:
                raise RuntimeError(f"range {k} was not copied whole: {want} against {got}")
            self.spark.createDataFrame([(k, *got)], "of_range int, rows long, checksum long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/range={k}")
            most = None if most is None else most - 1
        return self.progress()

    def progress(self) -> Progress:
        n = len(self.bounds())
        done = [k for k in range(n) if self._done(k)]
        rows = self.spark.read.schema("rows long").parquet(*[f"{self.path}/ledger/range={k}" for k in done]).agg(F.sum("rows")).first()[0] if done else 0
        return Progress(n, len(done), int(rows or 0))

    def table(self) -> DataFrame:
        """The copy, of the ranges that are done."""
        done = [f"{self.path}/rows/range={k}" for k in range(len(self.bounds())) if self._done(k)]
        return self.spark.read.schema(self.source.schema).parquet(*done) if done else self.source.limit(0)


def migrate(tables: dict[str, tuple[DataFrame, str]], path: str, ranges: int = 64) -> tuple[dict[str, DataFrame], DataFrame]:
    """(copies, counts): every table (name: rows and key) copied below ``path``, going on where an earlier run stopped, and the
    tables' rows against their source's (``stats.count_differences``)."""
    copies = {}
    expected = actual = None
    for name, (source, key) in tables.items():
        job = Migration(source, f"{path}/{name}", key, ranges)
        job.run()
        copies[name] = job.table()
        one = lambda df: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")  # noqa: B023, E731
        expected = one(source) if expected is None else expected.unionByName(one(source))
        actual = one(copies[name]) if actual is None else actual.unionByName(one(copies[name]))
    return copies, count_differences(expected, actual)
