"""Parquet tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Shaped(str):
    """A data folder whose tables are read through functions: `shapes` has them by table name."""

    shapes: dict[str, Callable[[DataFrame], DataFrame]]

    def __new__(cls, folder: str, **shapes: Callable[[DataFrame], DataFrame]) -> Shaped:
        self = super().__new__(cls, folder)
        self.shapes = shapes
        return self


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return folder.shapes[name](rows) if isinstance(folder, Shaped) and name in folder.shapes else rows
