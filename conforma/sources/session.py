"""What the library needs of a session: the package on executors, shared folders, settings."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application, unless they find it where the driver
    does (the working folder or PYTHONPATH)."""
    found = {Path(p).resolve() for p in (os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))}
    app = spark.sparkContext.applicationId
    if ROOT in found or app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="conforma-")) / "conforma"
    archive = shutil.make_archive(str(target), "zip", ROOT, "conforma")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def kept(rows: DataFrame) -> DataFrame:
    """rows written once, in the shared checkpoint folder, for plans that read them several times."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        root = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-shared-"))
    return rows.checkpoint()


PART_BYTES = 4 << 20


def parts_by_size(rows: DataFrame) -> int | None:
    """A part for each PART_BYTES of the files that rows are read from, once for each time they are read; none if a source
    doesn't know its size. For what tasks have to sort: the session's shuffle partitions don't grow with the tables, and
    adaptive execution joins them by their compressed size."""
    leaves, sizes = rows._jdf.queryExecution().optimizedPlan().collectLeaves().iterator(), []
    while leaves.hasNext():
        sizes.append(int(str(leaves.next().stats().sizeInBytes())))
    unknown = int(rows.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes())
    return None if not sizes or max(sizes) >= unknown else -(-sum(sizes) // PART_BYTES)


def unlimited_recursion(spark: SparkSession) -> None:
    """Recursive SQL is bounded by depth alone, not by a number of rows."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
