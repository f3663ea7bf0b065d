"""Sinks: files of bounded size, the ledger of written ids, the configuration beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.operators.base import Operator, register
from millrace.operators.vector import build_index  # noqa: F401  the index sink
from millrace.sources.readers import FORMATS


@register("HfWriter")
class FileWriter(Operator):
    """Append files of at most `chunk_size` rows as jsonl, json, csv or parquet; nothing is overwritten."""

    def setup(self, output_path: str, chunk_size: int = 1000, output_format: str = "jsonl"):
        if output_path is None:
            raise ValueError("output_path is needed")
        if output_format not in FORMATS:
            raise ValueError(f"unknown output format {output_format!r}")
        self.path, self.size, self.format = str(output_path), chunk_size, FORMATS[output_format]

    @property
    def data_path(self) -> str:
        return f"{self.path}/data"

    @property
    def ledger_path(self) -> str:
        return f"{self.path}/processed_ids"

    def write(self, df: DataFrame) -> None:
        df.write.mode("append").option("maxRecordsPerFile", self.size).option("header", "true").format(self.format).save(self.data_path)


def commit_ids(ids: DataFrame, path: str) -> None:
    """Add ids to the ledger; call it after the data are written, so that a crash repeats rows and loses none."""
    ids.select("hash_id").distinct().write.mode("append").parquet(path)
