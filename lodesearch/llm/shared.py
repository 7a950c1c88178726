"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests on one machine, one for this session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Computes df once into a Parquet table in the shared folder and reads that, which cuts lineage.

    The table survives the loss of executors.
    """
    spark = df.sparkSession
    path = kept_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


_kept: dict[str, SparkSession] = {}


def kept_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by release() or at the end of the driver's process."""
    if not _kept:
        atexit.register(release_all)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _kept[path] = spark
    return path


def release(*tables: DataFrame) -> None:
    """Deletes tables made by materialise() that nothing reads any more."""
    for t in tables:
        delete(t._table)


def delete(path: str) -> None:
    spark = _kept.pop(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release_all() -> None:
    for path in list(_kept):
        try:
            delete(path)
        except Exception:  # the session's JVM may be gone before the process
            return


def id_type(docs: DataFrame, id_col: str) -> str:
    """The id's type as results carry it: integers as long, others as they are."""
    kind = docs.select(F.col(id_col)).schema[0].dataType
    return "long" if isinstance(kind, T.IntegralType) else kind.simpleString()


def with_long_ids(docs: DataFrame, id_col: str, run, names: list[str]) -> DataFrame:
    """run(docs) for ids of any type: those that aren't integers are numbered in their order, and the named columns of the result get them back.

    The numbers are written to the shared folder first, so that they are the same wherever they are read.
    """
    if id_type(docs, id_col) == "long":
        return run(docs)
    ids = docs.select(F.col(id_col).alias("__id")).where("__id is not null").distinct().sort("__id")
    ids = materialise(ids.withColumn("__number", F.monotonically_increasing_id()), "ids")
    own = docs.join(ids, docs[id_col] == F.col("__id")).drop("__id", id_col).withColumnRenamed("__number", id_col)
    out = run(own)
    columns = out.columns
    for name in names:
        out = out.withColumnRenamed(name, "__n").join(ids, F.col("__n") == F.col("__number")).drop("__n", "__number").withColumnRenamed("__id", name)
    return out.select(*columns)


def task_count(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions for so many rows: at least the session's, more for larger data."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // rows_each))


def sized(df: DataFrame, rows: int, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if so many rows are at most `most` bytes; beyond that the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= most else df


def spread(spark: SparkSession, value: object):
    """Broadcasts an object of a class of this subpackage; call the result in a task to get it.

    Broadcast values are pickled by reference to their class, so only the attributes are sent and the class goes with
    the function.
    """
    kind, state = type(value), spark.sparkContext.broadcast(vars(value))

    def get():
        out = object.__new__(kind)
        out.__dict__.update(state.value)
        return out

    return get
