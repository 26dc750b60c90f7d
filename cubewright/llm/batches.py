"""Arrow batches in bounded slices: the text functions see a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .worker import give_back, release

SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most ``limit`` text bytes; one longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def with_text_columns(
    df: DataFrame,
    text_col: str,
    fields: Sequence[tuple[str, T.DataType]],
    make: Callable[[], Callable[[list], Sequence[list]]],
    keep: Sequence[str] | None = None,
    state: Hashable = None,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``df`` (or its columns ``keep``) with columns computed from each whole text.

    ``make`` is called once per task and returns a function from a list of texts
    (None for null) to one list of values per new field.  A kept column that has a
    new field's name is replaced by it.  ``state``: the key under which the function
    keeps things in its Python worker; all else that is kept there goes.  ``limit``:
    bytes of text that the function gets at once, but for one longer text.
    """
    names = {name for name, _ in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    types = [to_arrow_type(kind) for _, kind in fields]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t, True) for n, t in fields])
    columns = list(dict.fromkeys([*kept, text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        release(state)
        for batch in batches:
            for part in slices(batch, text_col, limit):
                function = function or make()
                made = function(part.column(text_col).to_pylist())
                arrays = [part.column(c) for c in kept] + [pa.array(v, t) for v, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])
        give_back()

    return df.select(*[f"`{c}`" for c in columns]).mapInArrow(run, schema)
