"""Run a Python function over the columns of a DataFrame, a small slice of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows turned into Python objects at once.
SLICE_ROWS = 256
#: Rows of an Arrow batch, at most. Texts are long, and the JVM and the Python
#: worker both hold whole batches.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Words of a text: everything between ASCII white space. ``bytes.split()``
#: without arguments cuts UTF-8 bytes at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"

Columns = Sequence[list]


def map_columns(
    df: DataFrame,
    make: Callable[[], Callable[..., Columns]],
    schema: str,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``make()`` is called once per task and gives the function that turns the
    column values of a slice into the column values of the result.

    The session's Arrow batches are set to ``BATCH_ROWS`` if they are larger.
    """
    settings = df.sparkSession.conf
    if not 0 < int(settings.get(_BATCH_SETTING)) <= BATCH_ROWS:
        settings.set(_BATCH_SETTING, str(BATCH_ROWS))
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                part = batch.slice(start, slice_rows)
                columns = function(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(columns, arrow, strict=True)],
                    schema=arrow,
                )

    return df.mapInArrow(run, struct)
