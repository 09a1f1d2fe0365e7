"""What the operators of this subpackage share: tables, the shared folder, written tables."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python pattern of a word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset, and everything runs on
    one machine (tests), a temporary folder is made and set; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="kinroster-")
        atexit.register(shutil.rmtree, urlparse(where).path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(where)
    return where


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts are long: batches to Python hold fewer rows than Spark's usual 10,000, unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        drop_path(df.sparkSession, df.written_to)


def fresh(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, whatever they are named; ``select("x.*")`` gives them back untouched."""
    return F.struct("*")


def save(folder: str, name: str, array: np.ndarray) -> None:
    """An array as a file of the shared folder: written under another name, then moved."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path)
    part = f"{path}/{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).data.cast("B") if array.size else b"")
    system.move(part, f"{path}/{name}")


#: Files that a worker keeps mapped at most; Linux allows 65,530 by default.
MOST_MAPPED = 8000
_mapped: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()


def mapped(folder: str, name: str, kind: str | np.dtype) -> np.ndarray:
    """An array of the shared folder, mapped; a file that is not there is an empty array.

    A worker keeps its maps for later batches and tasks. From a store that cannot be mapped a file is
    copied when it is first asked for, once for each machine.
    """
    key = (folder, name)
    if key in _mapped:
        _mapped.move_to_end(key)
        return _mapped[key]
    system, path = fs.FileSystem.from_uri(folder)
    where = f"{path}/{name}"
    if not isinstance(system, fs.LocalFileSystem):
        where = _local_copy(system, where)
    size = os.path.getsize(where) if os.path.exists(where) else 0
    _mapped[key] = np.memmap(where, dtype=kind, mode="r") if size else np.zeros(0, dtype=kind)
    if len(_mapped) > MOST_MAPPED:
        _mapped.popitem(last=False)
    return _mapped[key]


def _local_copy(system: fs.FileSystem, where: str) -> str:
    """The machine's copy of a file that never changes; a worker that comes second finds it."""
    copy = f"{tempfile.gettempdir()}/kinroster-{os.getuid()}/{hashlib.sha256(where.encode()).hexdigest()}"
    if not os.path.exists(copy) and system.get_file_info(where).type == fs.FileType.File:
        os.makedirs(os.path.dirname(copy), exist_ok=True)
        part = f"{copy}.{uuid.uuid4().hex}"
        fs.copy_files(where, part, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        os.replace(part, copy)
    return copy


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whatever kind that is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def crc32_of(column: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes of ``column`` as text."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8"))


def word_count(text: Column) -> Column:
    """Number of words as long; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
