"""The tables that hold text: their keys and text columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class TextTable(NamedTuple):
    name: str
    key: tuple[str, ...]
    text: str


TEXTS = {
    t.name: t
    for t in (
        TextTable("documents", ("doc_id",), "text"), TextTable("conversations", ("conv_id", "turn"), "text"),
        TextTable("pages", ("page_id",), "html"), TextTable("benchmark", ("item_id",), "text"),
    )
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
