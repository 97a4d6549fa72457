"""The error channel: problems are rows of a table, beside the data."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

ERROR_SCHEMA = "type string, code string, message string, row bigint, index int, column string"


@dataclass(frozen=True)
class ReadError:
    type: str
    code: str
    message: str
    row: int | None = None
    index: int | None = None
    column: str | None = None

    def as_dict(self) -> dict:
        return asdict(self)


def no_errors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ERROR_SCHEMA)
