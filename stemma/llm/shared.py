"""Where operators keep intermediate tables, and small column helpers.

Intermediate tables cut lineage and survive lost executors, so they are written
as Parquet into the folder the cluster shares (``spark.checkpoint.dir``).  Only
where that setting is missing on one machine, as in tests, a temporary folder
takes its place; on a cluster it is an error.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Where ``written`` notes its folders, if anywhere, in this thread of the driver.
_NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def shared_folder(spark: SparkSession) -> str:
    """A new, not yet existing folder below the cluster's shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/stemma-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/stemma-{uuid.uuid4().hex}"


def _path(spark: SparkSession, folder: str):
    """The folder as a Hadoop path, and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, codec: str = "zstd", folder: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a table read back from the shared folder, which goes when the application ends; ``options`` of the writer."""
    spark = df.sparkSession
    if folder is None:
        folder = shared_folder(spark)
        if _NOTED.get() is not None:
            _NOTED.get().append(folder)
    df.write.options(**(options or {})).option("compression", codec).parquet(folder)
    path, store = _path(spark, folder)
    store.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def with_replaced(df: DataFrame, *new: str) -> list[str]:
    """Names of the columns of ``df`` that the columns called ``new`` don't replace."""
    lower = {n.lower() for n in new}
    return [c for c in df.columns if c.lower() not in lower]


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a group that a bounded sample ranks, as a multiple of those it takes.
SPARE = 4


def sampled(keys: DataFrame, by: str, sample: int) -> DataFrame:
    """The ``sample`` rows of (``k``, ``by``) of each value of ``by`` whose key has the least hash; equal keys of a group count once.

    No task ranks much more than SPARE times the sample of a group, however many
    rows it has: keys with a hash under a bound that the group's size sets go on.
    """
    keys = keys.filter("k IS NOT NULL").select("k", by).distinct()
    sizes = keys.groupBy(by).agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / (1 << 30)
    few = keys.join(few_or_shuffled(sizes), by).filter((F.col("n") <= SPARE * sample) | (place * F.col("n") < SPARE * sample))
    rank = F.row_number().over(W.partitionBy(by).orderBy(place, F.xxhash64("k"), "k"))
    return few.withColumn("rank", rank).filter(F.col("rank") <= sample).select("k", by)


def quoted(name: str):
    """The column called exactly ``name``, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Bytes of a small table that are sent to every executor at most, of a row of a few numbers, and of a key.
BROADCAST_BYTES, ROW_BYTES, KEY_BYTES = 64 << 20, 64, 24


def few(small: DataFrame, more: Column | None = None, row: int = ROW_BYTES) -> bool:
    """Whether ``small`` has no more than BROADCAST_BYTES; ``more``: bytes of a row besides ``row``, for columns that vary in length."""
    size = F.lit(row) if more is None else row + F.coalesce(more, F.lit(0))
    return (small.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def few_or_shuffled(small: DataFrame, more: Column | None = None) -> DataFrame:
    """``small`` marked for broadcast if it is ``few``; else it is left to a shuffled join."""
    return F.broadcast(small) if few(small, more) else small


def with_wide(df: DataFrame, wide: DataFrame, key: str, more: Column) -> DataFrame:
    """Rows of ``df`` joined with those of ``wide`` by ``key``.

    Where ``wide`` is too large to be sent to all executors, its keys may not be:
    then only the rows of ``df`` that have a partner are moved.
    """
    if few(wide, more):
        return df.join(F.broadcast(wide), key)
    keys = wide.select(key)
    return (df.join(F.broadcast(keys), key, "left_semi") if few(keys, row=KEY_BYTES) else df).join(wide, key)


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """The folders that ``written`` makes inside the context."""
    folders: list[str] = []
    token = _NOTED.set(folders)
    try:
        yield folders
    finally:
        _NOTED.reset(token)


def deleted(spark: SparkSession, folders: Iterable[str]) -> None:
    """Deletes folders of intermediate tables that nothing reads any more."""
    for folder in folders:
        path, store = _path(spark, folder)
        store.delete(path, True)
