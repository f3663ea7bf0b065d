"""Projections, filters, flat maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructType

from millrace.operators.base import Operator, RowOperator, register


@register()
class RemoveColumns(Operator):
    """Drop `cols`, and by default the hidden ones, whose names begin with '_'. Absent names don't matter."""

    def setup(self, remove_hidden_cols: bool = True, cols: list[str] | None = None):
        self.hidden, self.cols = remove_hidden_cols, set(cols or ())

    def apply(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if c in self.cols or self.hidden and c.startswith("_")])


@register("LambdaFunc")
class Expression(Operator):
    """A SQL expression over the row. A struct is merged into the row and wins on equal names; a boolean filters; an
    array of structs replaces the row by its elements. Anything else is an error."""

    def setup(self, expr: str | None = None, lambda_func: str | None = None):
        self.expr = expr or lambda_func
        if not self.expr or self.expr.lstrip().startswith("lambda"):
            raise ValueError("expected a SQL expression; Python functions are registered as RowOperator")

    def apply(self, df: DataFrame) -> DataFrame:
        kind = df.select(F.expr(self.expr).alias("v")).schema["v"].dataType
        if isinstance(kind, BooleanType):
            return df.where(F.expr(self.expr))
        if isinstance(kind, StructType):
            wide = df.withColumn("_merged", F.expr(self.expr))
            return wide.withColumns({f: F.col(f"_merged.`{f}`") for f in kind.names}).drop("_merged")
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            return df.select(F.inline(F.expr(self.expr)))
        raise ValueError(f"an expression must give a struct, a boolean or an array of structs, not {kind.simpleString()}")


@register("CfgFunc")
class PythonFunction(RowOperator):
    """A registered Python function row -> dict, bool, None or list of dicts, run in Arrow batches. A dict is merged
    into the row. `schema`: DDL of the result, by default the input's."""

    FUNCTIONS: dict = {}

    @classmethod
    def function(cls, f):
        cls.FUNCTIONS[f.__name__] = f
        return f

    def setup(self, func, schema: str | None = None):
        self.func, self.schema = (func if callable(func) else self.FUNCTIONS[func]), schema

    def run_each(self, row: dict):
        got = self.func(row)
        if got is True or got is False:
            return row if got else None
        if isinstance(got, dict):
            return row | got
        if isinstance(got, list):
            return got
        raise ValueError(f"the function returned a {type(got).__name__}")


@register("ListFlatter")
class ListFlatten(Operator):
    """One row per element of an array. Text elements take the array's place; structs replace it by their fields, which
    win over columns of the same name. Rows with an empty or null array go."""

    def setup(self, text_col: str):
        self.col = text_col

    def apply(self, df: DataFrame) -> DataFrame:
        kind = df.schema[self.col].dataType
        if not isinstance(kind, ArrayType):
            raise ValueError(f"{self.col} is not an array")
        if not isinstance(kind.elementType, StructType):
            return df.withColumn(self.col, F.explode(self.col))
        names = kind.elementType.names
        kept = [f"`{c}`" for c in df.columns if c != self.col and c not in names]
        return df.select(*kept, F.inline(self.col))


@register()
class DropNull(Operator):
    """Rows without a null in `cols`."""

    def setup(self, cols: list[str]):
        self.cols = cols

    def apply(self, df: DataFrame) -> DataFrame:
        return df.dropna(subset=self.cols)
