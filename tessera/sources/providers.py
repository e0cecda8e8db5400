"""Pluggable sources: landed provider responses as a data source, and a table function for SQL."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from tessera.session import make_importable


class ResponseLog(DataSource):
    """``spark.read.format("response_log").load(folder)``: one response per JSON file, the provider named by its folder."""

    @classmethod
    def name(cls) -> str:
        return "response_log"

    def schema(self) -> str:
        return "provider string, name string, body string"

    def reader(self, schema: object) -> DataSourceReader:
        return _ResponseReader(self.options["path"])


class _File(InputPartition):
    def __init__(self, provider: str, path: str) -> None:
        self.provider, self.path = provider, path


class _ResponseReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = []
        for provider in sorted(os.listdir(self.path)):
            folder = os.path.join(self.path, provider)
            if os.path.isdir(folder):
                found += [_File(provider, os.path.join(folder, f)) for f in sorted(os.listdir(folder)) if f.endswith(".json")]
        return found

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8", errors="replace") as body:
            yield partition.provider, os.path.basename(partition.path), body.read()


@udtf(returnType="pos int, url string, title string")
class SearchItems:
    """``SELECT * FROM search_items(provider, body)``: the results of one response whose url is a text."""

    def eval(self, provider: str, body: str) -> Iterator[tuple]:
        try:
            data = json.loads(body)
            items = (data["web"] if provider == "brave" else data)["results"]
        except (ValueError, KeyError, TypeError):
            return
        good = [i for i in items if isinstance(i, dict) and isinstance(i.get("url"), str)] if isinstance(items, list) else []
        for pos, item in enumerate(good):
            yield pos, item["url"], item.get("title") or ""


def register(spark: SparkSession) -> None:
    make_importable(spark)
    spark.dataSource.register(ResponseLog)
    spark.udtf.register("search_items", SearchItems)
