"""Shared folder, intermediate tables, row keys and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import small_batches  # noqa: F401

#: The white space of the contracts: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir).

    Where no such folder is set, one is made in the machine's temporary folder and set if everything runs in one
    process (master local), as in tests; elsewhere that is an error, since other machines could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share.")
        root = "file://" + tempfile.mkdtemp(prefix="wordloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/wordloom/{tag}-{uuid.uuid4().hex}"


#: Folders that wait for the end of the application, and those of each operator that is running.
_folders: list[tuple[SparkSession, str]] = []
_running: list[list[tuple[SparkSession, str]]] = []


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The table, written to the shared folder and read again; cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, tag)
    (_running[-1] if _running else _folders).append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wordloom_path = path
    return out


@contextmanager
def scratch():
    """Removes, at its end, the tables that were stored meanwhile, but for those given to the function that it yields."""
    own: list[tuple[SparkSession, str]] = []
    kept: set[str] = set()
    _running.append(own)
    try:
        yield lambda *tables: kept.update(t._wordloom_path for t in tables)
    finally:
        _running.remove(own)
        outer = _running[-1] if _running else _folders
        outer += [x for x in own if x[1] in kept]
        for spark, path in own:
            if path not in kept:
                discard(spark, path)


def clean() -> None:
    """Removes all stored tables of this application; no result that reads them may be pending."""
    while _folders:
        with suppress(Exception):  # the session may have ended before
            discard(*_folders.pop())


atexit.register(clean)


def with_row(docs: DataFrame, name: str = "row") -> DataFrame:
    """docs and a key of each row: a hash of its file's path (64 bits) and its place there.

    That key is the same in every scan, however the files are split. Where docs is not a plain scan of Parquet files,
    it is stored first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or "parquet" not in plan.simpleString(100).lower():
        docs = stored(docs, "rows")
    return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(name))


def hot_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "left", share: int = 1000, least: int = 1000) -> DataFrame:
    """rows with the columns of their group; groups: a stored table of one row for each key, with its number of rows in `size`.

    Keys that hold a share of 1 / `share` of the rows, and `least` rows, are broadcast, which are `share` at most; so the
    rows of a hot key stay where they are.
    """
    held = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n"), F.coalesce(F.max(size), F.lit(0)).alias("most")).first()
    bound = max(least, held["n"] // share + 1)
    if held["most"] < bound:
        return rows.join(groups, keys, how)
    hot = groups.where(F.col(size) >= bound)
    inside = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(groups.where(F.col(size) < bound), keys, how)
    return inside.unionByName(rest)


def give_back() -> None:
    """Returns a worker's freed memory to the machine: idle workers keep theirs while other stages run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder below the shared one; a missing folder is no error."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder and the folder's path there; usable on driver and executors."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def settle(fs: pafs.FileSystem, attempt: str, name: str) -> None:
    """Gives a whole file its name; the same file of an earlier attempt makes room, as not every store renames onto it."""
    if fs.get_file_info(name).type != pafs.FileType.NotFound:
        fs.delete_file(name)
    fs.move(attempt, name)


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def by_bytes(batch: pa.RecordBatch, column: int, size: int = 1 << 22):
    """Slices of a batch, in order, whose text or binary column holds about size bytes; a longer row stands in one slice."""
    held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)
