"""Blocks of documents: a bounded amount of text that one task handles at once.

A block is numbered in the task that reads it, and its rows are written before
they are used again, so the number stays the same if another task is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext

#: Characters of a block, about. A longer text is a block of its own.
BLOCK_CHARS = 1 << 21
#: Rows of a block, at most.
BLOCK_ROWS = 1 << 16
#: Blocks of a task, as bits of a block's number.
_TASK_BITS = 32


def blocks(
    batches: Iterator[pa.RecordBatch], chars: int = BLOCK_CHARS
) -> Iterator[tuple[int, list[list]]]:
    """Number and columns of each block; the last column of ``batches`` is the text."""
    number = TaskContext.get().partitionId() << _TASK_BITS
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            for row in zip(*[c.to_pylist() for c in part.columns]):
                rows.append(row)
                held += len(row[-1] or "")
                if held >= chars or len(rows) >= BLOCK_ROWS:
                    yield number, [list(c) for c in zip(*rows)]
                    number, rows, held = number + 1, [], 0
    if rows:
        yield number, [list(c) for c in zip(*rows)]
