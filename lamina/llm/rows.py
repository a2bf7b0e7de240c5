"""Rows that pass through Python tasks as they are, whatever their columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_name(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column is called so (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def carried(docs: DataFrame, *more: Column, without: tuple[str, ...] = ()) -> DataFrame:
    """A struct ``row`` of the columns of ``docs`` except ``without`` (in any case), and the columns ``more``."""
    left_out = {c.lower() for c in without}
    own = [F.col(quoted(c)) for c in docs.columns if c.lower() not in left_out]
    # a struct of nothing would have no rows in Arrow
    return docs.select(F.struct(*own, *([] if own else [F.lit(True).alias("_")])).alias("row"), *more)


def schema_with(carried_rows: DataFrame, more: str = "") -> StructType:
    """The schema of a task's result: the struct ``row``, and the columns of the DDL string ``more``."""
    extra = list(StructType.fromDDL(more)) if more else []
    return StructType([StructField("row", carried_rows.schema["row"].dataType), *extra])
