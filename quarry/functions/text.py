"""Text forms of values, as results and the line protocol show them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Elements of a vector that its text shows.
SHOWN = 4


def four_decimals(value: float) -> str:
    """As C's %.4f. Spark's format_string rounds exact ties otherwise."""
    return f"{value:.4f}"


def vector_text(values) -> str:
    shown = ",".join(f"{v:.6f}" for v in values[:SHOWN]) + (",..." if len(values) > SHOWN else "")
    return f"[{shown}] ({len(values)}d)"


def value_text(value) -> str:
    return vector_text(value) if isinstance(value, (list, tuple)) else str(value)


def with_vector_text(df: DataFrame, vector: str, name: str) -> DataFrame:
    """``df`` with the text of a vector column added.

    C's rounding of exact ties needs Python's formatting; it runs over Arrow batches.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(name, StringType())])

    def run(batches):
        for batch in batches:
            texts = [None if v is None else vector_text(v) for v in batch.column(vector).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def all_of(conditions: list[Column]) -> Column:
    from functools import reduce

    return reduce(lambda a, b: a & b, conditions)
