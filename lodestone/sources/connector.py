"""Remote sources as a Spark data source: an injected client is read page by page, a partition a page.

    spark.dataSource.register(RemoteSource)
    spark.read.format("remote").options(client="package.module:factory", query="…", pages=4, page_size=25).load()

``client`` names a factory that every task imports: ``factory(options)`` gives an object with ``search(query, offset, limit,
year)``, whose results are mappings (title, url, snippet, score, doi, authors, year, metadata). An equality filter on ``year``
is handed to the client, one on ``provider`` to another provider reads nothing; Spark applies them once more. Results are made whole as they come: a missing
title is the url, a missing snippet the title, and metadata always has a source_id.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from ..functions.text import compose_query

SCHEMA = "provider string, title string, url string, snippet string, score double, doi string, author array<string>, year int, metadata map<string,string>, page int, place int"


def client_of(options: dict[str, str]) -> Any:
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name or "client")(options)


def completed(result: dict[str, Any]) -> dict[str, Any]:
    """A result with its gaps filled from what it has."""
    text = lambda k: str(result.get(k) or "").strip()
    url, title = text("url"), text("title") or text("url")
    metadata = {str(k): str(v) for k, v in (result.get("metadata") or {}).items() if v is not None}
    if not metadata.get("source_id", "").strip() and url:
        metadata["source_id"] = url
    return {"title": title, "url": url, "snippet": text("snippet") or title or url, "score": 1.0 if result.get("score") is None else float(result["score"]), "doi": result.get("doi"), "authors": [str(a) for a in result.get("authors") or []], "year": None if result.get("year") is None else int(result["year"]), "metadata": metadata}


@dataclass
class Page(InputPartition):
    number: int

    def __init__(self, number: int):
        self.number = number


class RemoteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return RemoteReader(dict(self.options))


class RemoteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.asked = options, {}
        if not options.get("client") or not options.get("query", "").strip():
            raise ValueError("options client and query are needed")
        self.size, self.pages = int(options.get("page_size", "25")), int(options.get("pages", "1"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equal years go to the client; what it does with them is not relied on, so Spark checks them once more."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("year",), ("provider",)):
                self.asked[f.attribute[0]] = f.value
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.asked.get("provider", self.options.get("provider", "remote")) != self.options.get("provider", "remote"):
            return []  # another provider's rows are asked for
        return [Page(k) for k in range(self.pages)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # there are no pages to read
            return
        found = client_of(self.options).search(self.options["query"], offset=partition.number * self.size, limit=self.size, year=self.asked.get("year"))
        for place, raw in enumerate(found):
            if place >= self.size:
                break
            r = completed(raw)
            yield (self.options.get("provider", "remote"), r["title"], r["url"], r["snippet"], r["score"], r["doi"], r["authors"], r["year"], r["metadata"], partition.number, partition.number * self.size + place)


def search(spark: SparkSession, client: str, query: str, most: int = 5, page_size: int = 25, provider: str = "remote", **options: str) -> DataFrame:
    """Up to ``most`` results in the client's order; as many pages as that takes, each a partition."""
    spark.dataSource.register(RemoteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    size = min(page_size, most)
    found = spark.read.format("remote").options(client=client, query=query, provider=provider, pages=str(-(-most // size)), page_size=str(size), **options).load()
    return found.where(F.col("place") < most)


def structured(found: DataFrame) -> DataFrame:
    """Results as providers describe them: url, title, description, doi, authors, year, score, metadata."""
    return found.select("url", "title", F.col("snippet").alias("description"), "doi", F.col("author").alias("authors"), "year", "score", "metadata", "place")


def search_structured(spark: SparkSession, client: str, fields: dict[str, Any], most: int = 5, **options: str) -> DataFrame:
    """A search by fields (query, or title, author, doi, year, keywords); without any of them, no rows."""
    query = query_of(spark, fields)
    if not query:
        return structured(spark.createDataFrame([], SCHEMA))
    return structured(search(spark, client, query, most, **options))


def query_of(spark: SparkSession, fields: dict[str, Any]) -> str:
    words = fields.get("keywords")
    row = {k: None if fields.get(k) is None else str(fields[k]) for k in ("query", "title", "author", "doi", "year")}
    listed: Column = F.lit([str(w) for w in words]) if isinstance(words, list) and words else F.array(F.lit(str(words))) if words and not isinstance(words, list) else F.array().cast("array<string>")
    lit = lambda k: F.lit(row[k]).cast("string")
    return spark.range(1).select(compose_query(lit("query"), lit("title"), lit("author"), lit("doi"), lit("year"), listed)).first()[0]
