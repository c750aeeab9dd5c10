"""Written intermediate tables.

Some steps need a value that must not change if a task is run again (the
position of a row in a global order, the state of an iteration). Those are
written once to the folder the cluster names in ``spark.checkpoint.dir`` and
read back, so the loss of an executor never recomputes them differently.

The tables may hold what the caller wants to hide. They lie in a folder of the
application that only its user may read, and they have an owner: a ``scratch``
block removes what was written inside it, and the end of the program removes
the rest.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Subfolders of the blocks that are open, the innermost last.
_blocks: list[str] = []
_owned: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests, the warehouse. On a
    cluster it must be set: its machines do not share the default warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder of the application."""
    own = f"{scratch_root(spark)}/duskveil-{spark.sparkContext.applicationId}"
    if own not in _owned:
        _owned.add(own)
        _make_private(spark, own)
        atexit.register(_remover(spark, own))
    return "/".join([own, *_blocks, uuid.uuid4().hex])


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return the written table."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stashed inside the block is removed at its end; results must be
    written or collected by then."""
    _blocks.append(f"block-{uuid.uuid4().hex}")
    path = "/".join([f"{scratch_root(spark)}/duskveil-{spark.sparkContext.applicationId}", *_blocks])
    try:
        yield
    finally:
        _blocks.pop()
        _remover(spark, path)()


def drop_scratch(spark: SparkSession) -> None:
    """Remove every table this application stashed; call when results are written."""
    own = f"{scratch_root(spark)}/duskveil-{spark.sparkContext.applicationId}"
    _remover(spark, own)()
    _owned.discard(own)


def _files(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _make_private(spark: SparkSession, folder: str) -> None:
    jvm, path, files = _files(spark, folder)
    only_owner = jvm.org.apache.hadoop.fs.permission.FsPermission("700")
    files.mkdirs(path, only_owner)
    files.setPermission(path, only_owner)


def _remover(spark: SparkSession, folder: str):
    _, path, files = _files(spark, folder)

    def remove() -> None:
        # at the end of the program the JVM may be gone before us
        with contextlib.suppress(Exception):
            files.delete(path, True)

    return remove
