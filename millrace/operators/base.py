"""Operators: parameters in the constructor, `apply(df) -> df`, a registry of short names for configurations."""

from __future__ import annotations

import importlib
import importlib.util
import logging

from pyspark.sql import DataFrame

REGISTRY: dict[str, type] = {}


def register(*names: str):
    """Make a class known under its own name and `names`. One name for two classes is an error."""

    def add(cls):
        for n in (cls.__name__, *names):
            if REGISTRY.setdefault(n, cls) is not cls:
                raise ValueError(f"two operators are called {n}")
        return cls

    return add


def resolve(name: str) -> type:
    """A registered short name, or the dotted path of a class."""
    if name in REGISTRY:
        return REGISTRY[name]
    module, _, cls = name.rpartition(".")
    if not module:
        raise ValueError(f"no operator is called {name}")
    return getattr(importlib.import_module(module), cls)


class Operator:
    """A lazy step from DataFrame to DataFrame. Subclasses say in `required_packages` what they need besides Spark."""

    required_packages: tuple[str, ...] = ()
    #: Where a configuration says so, the number of tasks that rows are dealt to before this step.
    num_tasks: int | None = None
    #: Names of columns that the step reads and writes, where known; None: any. For reordering in plans.
    pure_filter = False

    def __init__(self, **parameters):
        missing = [p for p in self.required_packages if importlib.util.find_spec(p) is None]
        if missing:
            raise ImportError(f"{type(self).__name__} needs {', '.join(missing)}")
        self.logger = logging.getLogger(f"millrace.{type(self).__name__}")
        self.setup(**parameters)

    def setup(self, **parameters) -> None:
        for k, v in parameters.items():
            setattr(self, k, v)

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)


class RowOperator(Operator):
    """A step by rows in Python: override `run_each(row: dict)`, and set `schema`, the result's DDL.

    What it returns: a dict is emitted; None or an empty dict drops the row; a list or generator emits each. Rows
    travel in Arrow batches; keys that `schema` lacks are left out, columns that a dict lacks are null.
    """

    schema: str | None = None

    def run_each(self, row: dict):
        raise NotImplementedError

    def apply(self, df: DataFrame) -> DataFrame:
        import pyarrow as pa
        from millrace.functions.batches import pieces
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = StructType.fromDDL(self.schema) if self.schema else df.schema
        arrow, each = to_arrow_schema(schema), self.run_each

        def run(batches):
            for b in pieces(batches):
                out = []
                for row in b.to_pylist():
                    got = each(row)
                    if not got:
                        continue
                    out += [got] if isinstance(got, dict) else list(got)
                yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in arrow} for r in out], schema=arrow)

        return df.mapInArrow(run, schema)
