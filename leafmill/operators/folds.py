"""Folds of ordered rows, one key after the other, that never hold a key's rows together."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_by_key(rows: DataFrame, keys: list[str], order: list[str], begin: Callable, step: Callable, end: Callable | None, schema: str | StructType) -> DataFrame:
    """Goes through each key's rows in order with a state: begin(first row), then step(state, row) for every row.

    What step returns is a row of the result (None: no row); end(state), where given, adds
    one after a key's last row (None: no row). Rows are tuples by name, with Python's values:
    integers of any size are exact, and null is None, which is one key and comes first in
    every order. The rows are sorted by Spark, which spills, and pass through the task in
    batches: only the state is kept, so a key may have any number of rows.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = to_arrow_schema(fields)
    names = rows.columns

    def made(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of = namedtuple("Row", names, rename=True)
        at = [names.index(k) for k in keys]
        key = state = None
        for batch in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row, here = row_of._make(values), tuple(values[k] for k in at)
                if here != key:
                    if key is not None and end is not None:
                        out.append(end(state))
                    key, state = here, begin(row)
                out.append(step(state, row))
            yield made([r for r in out if r is not None])
        if key is not None and end is not None:
            last = end(state)
            yield made([last] if last is not None else [])

    # by a hash of the keys: below a map Spark drops a repartition by columns that a join has dealt the rows by already, and then may cut that join's partitions anew
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, fields)
