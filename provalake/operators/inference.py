"""Rows through a model: made once a task, fed with small batches of like length, and no failed job for a failed row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

Model = Callable[[list], list]


def _answers(model: Model, values: list) -> list[tuple[object, str | None]]:
    """(answer, error) of each value. A batch that fails is asked for again one by one, so only the values at fault fail."""
    try:
        found = list(model(values))
        if len(found) != len(values):
            raise ValueError(f"{len(found)} answers to {len(values)} rows")
        return [(a, None) for a in found]
    except Exception as error:  # whatever a model raises belongs to its rows, not to the job
        if len(values) == 1:
            return [(None, f"{type(error).__name__}: {error}"[:500])]
    return [pair for v in values for pair in _answers(model, [v])]


def infer_table(df: DataFrame, col: str, make: Callable[[], Model], out: str, out_type: str, batch_size: int = 32, error: str | None = None) -> DataFrame:
    """All rows with the model's answer in `out` and, in `error` (by default `out` + "_erro"), why a row has none.

    `make` builds the model once a task; it takes a list of values of `col` (nulls too) and gives as many answers. Within an Arrow
    batch values are grouped by length, so that a padded batch wastes little; rows keep their order. A narrow pass.
    """
    error = error or f"{out}_erro"
    answer = _parse_datatype_string(out_type)
    schema = StructType(list(df.schema.fields)).add(out, answer).add(error, "string")
    kind = to_arrow_type(answer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or make()
            values = batch.column(col).to_pylist()
            order = sorted(range(len(values)), key=lambda i: len(values[i]) if hasattr(values[i], "__len__") else 0)
            found: list = [None] * len(values)
            for start in range(0, len(order), batch_size):
                part = order[start:start + batch_size]
                for i, pair in zip(part, _answers(model, [values[i] for i in part]), strict=True):
                    found[i] = pair
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in found], kind), pa.array([e for _, e in found], pa.string())],
                                             names=[*batch.schema.names, out, error])

    return df.mapInArrow(run, schema)


def answered(df: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """Rows with an answer, without the error column, and the quarantine of the others. Both read what `infer_table` gave."""
    error = f"{out}_erro"
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull()).drop(out)
