"""Run a reader, steps and a writer as one lazy plan and one write."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators import dedup, generate, judges, relational, text, vector  # noqa: F401  registered by import
from millrace.operators.base import Operator, register
from millrace.plans.scratch import discard, materialize
from millrace.plans.spec import Spec
from millrace.session import session
from millrace.sources import readers, writers  # noqa: F401


@register("BaseExecutor")
class SequentialExecutor(Operator):
    """reader -> pipes -> writer; without a writer `execute` gives the DataFrame. Ids are put in the ledger after the data.

    With `count_rows` the rows that leave the reader and each pipe are counted while they are written, and logged by the
    step's logger; `counts` has them by step. Counting keeps filters from moving past it, so it is off by default.
    """

    def setup(self, reader, writer=None, pipes: list | None = None, count_rows: bool = False):
        self.reader, self.writer, self.pipes, self.spec = reader, writer, list(pipes or []), None
        self.count_rows, self.counts = count_rows, {}

    def plan(self, spark: SparkSession, source: DataFrame | None = None) -> DataFrame:
        df = source if source is not None else self.reader.load(spark, self.writer.ledger_path if self.writer else None)
        df = self._counted(df, self.reader, 0)
        for k, p in enumerate(self.pipes):
            n = getattr(p, "num_tasks", None)
            df = self._counted(p.apply(df.repartition(n) if n else df), p, k + 1)
        return df

    def _counted(self, df: DataFrame, step, k: int) -> DataFrame:
        if not self.count_rows:
            return df
        seen = Observation(f"rows-{id(self)}-{k}-{len(self.counts)}")
        self._seen.append((f"{k} {type(step).__name__}", step, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def _log(self) -> None:
        for name, step, seen in self._seen:
            self.counts[name] = seen.get["rows"]
            getattr(step, "logger", self.logger).info("%s: %d rows", name, self.counts[name])

    def execute(self, spark: SparkSession | None = None) -> DataFrame | None:
        spark = spark or session()
        self._seen: list = []
        if self.writer is None:
            return self.plan(spark)
        if self.spec is not None:
            write_text(spark, f"{self.writer.path}/config.yml", self.spec.dump())
        source = self.reader.load(spark, self.writer.ledger_path)
        ids = materialize(source.select("hash_id"), "read-ids")  # what this run reads, dropped rows too
        self.writer.write(self.plan(spark, source))
        writers.commit_ids(ids, self.writer.ledger_path)
        discard(ids)
        self._log()
        return None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file beside the data, on whatever file system they are."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m millrace.plans.runner", description="Run a pipeline from its YAML file.")
    p.add_argument("config")
    spec = Spec.load(p.parse_args(args).config)
    run = spec.build()
    run.spec = spec
    run.execute()


if __name__ == "__main__":
    main()
