"""Row-wise text work in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows of an Arrow batch are bounded by Spark (10 000 rows or 64 MB by default), whatever the length of single texts.
_TEXT = "__llm_text"
#: Rows whose texts are Python objects at once.
ROWS_AT_ONCE = 256


def map_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    fields: Sequence[StructField],
    make: Callable[[list[bytes | None]], list[pa.Array]],
) -> DataFrame:
    """The ``keep`` columns beside columns made from the UTF-8 bytes of ``text``.

    ``make`` gets the texts of some rows (None for null) and returns one array
    for each of ``fields``. No row is added, dropped or reordered.
    """
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(_TEXT))
    schema = StructType([*source.schema.fields[:-1], *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                texts = part.column(part.num_columns - 1)
                made = make(texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=names)

    return source.mapInArrow(run, schema)
