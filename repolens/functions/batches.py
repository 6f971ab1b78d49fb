"""Arrow batches in and out of Python functions, without pandas in between."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship

#: Rows handed to a Python worker at once; bounds its memory when texts are long.
BATCH_ROWS = 1000


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow in workers that have this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, row: Callable[..., Iterable[tuple]], schema: str | T.StructType, flush: int = 20_000) -> DataFrame:
    """row(*values) of each row of df gives any number of output rows; values come in df's column order."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                for values in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    out.extend(row(*values))
                    if len(out) >= flush:
                        yield made()
                        out = []
        if out:
            yield made()

    return in_arrow(df, run, kind)


def map_batches(df: DataFrame, batch: Callable[..., Iterable[tuple]], schema: str | T.StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """batch(*columns) gets up to `rows` rows as lists, one a column, and gives equally long columns of output rows."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                columns = batch(*(c.to_pylist() for c in b.slice(at, rows).columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return in_arrow(df, run, kind)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, if its source gives fewer (one small file, say); else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
