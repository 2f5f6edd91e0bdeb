"""Cutting the lineage of a DataFrame that is read several times."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame


def checkpoint_folder(sc: SparkContext) -> str:
    """The folder for intermediate tables: the one that ``spark.checkpoint.dir`` names, which all executors share, so that a lost executor loses nothing.

    Where none is named, a temporary folder of this machine serves a local master, as in tests; on a cluster that is an error. What is
    written is deleted when the program ends.
    """
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        named = tempfile.mkdtemp(prefix="wardenlake-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def _delete(sc: SparkContext, folder: str) -> None:
    with contextlib.suppress(Exception):  # the context may be gone
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


_to_delete: set[str] = set()


def cut(df: DataFrame, rows: int = 0) -> DataFrame:
    """Write ``df`` once as a table of the folder and read it from there. For wide rows, ``rows`` bounds those that a reader holds at once.

    A table rather than a checkpoint: a checkpoint keeps the estimated size of its plan, which in a loop of joins grows beyond all bounds and keeps small sides
    from being broadcast; a table has the size that it has, and columns that nobody reads stay unread.
    """
    spark = df.sparkSession
    folder = checkpoint_folder(spark.sparkContext)
    if folder not in _to_delete:
        _to_delete.add(folder)
        atexit.register(_delete, spark.sparkContext, folder)
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.options(**({"parquet.block.row.count.limit": rows} if rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the tables that ``df``, made by ``cut``, is read from; nothing may read it any more."""
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession.sparkContext, file)
