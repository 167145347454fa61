"""Helpers of the text operators: rows through Python in bounded slices, whole rows kept apart."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seclog.session import ship_code

#: Rows turned into Python objects at a time.
SLICE_ROWS = 256


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[list[list]], Iterable[tuple]]], ddl: str,
) -> DataFrame:
    """Give slices of rows to a function that each task makes once; it yields output rows.

    The function gets one list per column of ``df``. A task holds one slice and what it yields.
    A pair of functions is taken as (work, finish): the second yields rows at the task's end.
    """
    fields = to_arrow_schema(schema_of(ddl))
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make()
        work, finish = made if isinstance(made, tuple) else (made, None)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                yield from packed(work([c.to_pylist() for c in batch.slice(start, SLICE_ROWS).columns]))
        if finish:
            yield from packed(finish())

    def packed(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        columns = list(zip(*rows))
        if columns:
            arrays = [pa.array(v, f.type) for v, f in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return df.mapInArrow(run, ddl)


def add_results(
    df: DataFrame, inputs: list[Column | str], make: Callable[[], Callable[[list[list]], Iterable[tuple]]],
    ddl: str, keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``row`` (the ``keep`` columns, all by default, untouched) and those of ``ddl``.

    A function that each task makes once gets slices of the ``inputs`` as lists and yields one
    tuple per row, in order. There is no shuffle, and what is kept never becomes a Python object.
    """
    ship_code(df.sparkSession)
    given = df.select(
        whole_row(df if keep is None else df.select(*[f"`{c}`" for c in keep])).alias("row"),
        *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(f"in{n}") for n, c in enumerate(inputs)],
    )
    wanted = given.schema["row"].dataType
    out = StructType().add("row", wanted)
    for field in schema_of(ddl):
        out.add(field)
    fields = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                made = list(zip(*work([c.to_pylist() for c in part.columns[1:]]), strict=True))
                arrays = [pa.array(v, f.type) for v, f in zip(made, list(fields)[1:], strict=True)]
                kept = part.column(0).cast(fields.field(0).type)
                yield pa.RecordBatch.from_arrays([kept, *arrays], schema=fields)

    return given.mapInArrow(run, out)


def portions(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    """Runs of texts with about ``most`` characters at most; a longer text is alone."""
    run: list[str | None] = []
    size = 0
    for text in texts:
        if run and size + len(text or "") > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text or "")
    if run:
        yield run


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that names an operator adds can never meet them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.struct()


def rows_again(df: DataFrame, row: str = "row") -> DataFrame:
    return df.select(f"{row}.*")


def digest128(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes; NULL parts are marked, so they cannot meet other values."""
    marked = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(1), *marked), F.xxhash64(F.lit(2), *marked)]
