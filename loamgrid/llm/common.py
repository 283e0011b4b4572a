"""Helpers shared by the operators: shared-folder tables, ASCII folding, exact distributed ranks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Folders of the tables that write_table made, while their frames live.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which the driver and all executors share.

    A session that names none is an error, unless driver and executors are one
    process: a folder of one machine would be missing on the others.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/loamgrid-{spark.sparkContext.applicationId}"


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks in flight, and no earlier
    stage runs again.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[back] = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(*tables: DataFrame) -> None:
    """Delete tables of write_table that nothing unwritten reads any more."""
    for t in tables:
        if t in _FOLDERS:
            _delete(t.sparkSession, _FOLDERS.pop(t))


def drop_tables(spark: SparkSession) -> None:
    """Delete every table this application wrote in the shared folder."""
    _delete(spark, shared_dir(spark))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def lower_az(text: Column) -> Column:
    """Lower-case A-Z alone; letters outside ASCII stay as they are."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash01(*cols: Column) -> Column:
    """A seeded hash as a double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") / F.lit(float(1 << 52))


def bucket_ranks(
    df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column | str], rank: str, total: str
) -> DataFrame:
    """Exact 0-based rank of each row in its group, plus the group's row count.

    `bucket` is a column that grows with `order` and spreads a group's rows
    evenly (the top bits of a hash, or a scaled uniform value).  Rows are ranked
    inside (group, bucket) and the counts of the buckets below are added, so no
    task ever holds a whole group.  The table of counts has at most
    groups x buckets rows.  Group and bucket columns must not be null.
    """
    keys = [*group, bucket]
    n, base = fresh(df, "_n", "_below")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    whole = Window.partitionBy(*group) if group else Window.partitionBy()
    below = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, F.coalesce(F.sum(n).over(below), F.lit(0)).alias(base), F.sum(n).over(whole).alias(total)
    )
    inner = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.join(offsets, keys)
        .withColumn(rank, F.col(base) + F.row_number().over(inner) - 1)
        .drop(base)
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, rows: int, id_col: str = "doc_id", label_cols: Sequence[str] = ("quality",)
) -> DataFrame:
    """Rows of `docs` with their labels for at most `rows` labelled ids.

    The ids are the first by a hash, so the choice is the same on every run and
    the broadcast table has a fixed bound.  Labels with a null id, or null in
    all columns, are left out; of an id labelled twice the least labels count.
    """
    known = labels.select(F.col(id_col).alias("_id"), *[F.col(c).cast("int").alias(f"_y_{c}") for c in label_cols])
    known = known.dropna(subset=["_id"]).dropna("all", subset=[f"_y_{c}" for c in label_cols])
    known = known.groupBy("_id").agg(*[F.min(f"_y_{c}").alias(f"_y_{c}") for c in label_cols])
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    return docs.join(F.broadcast(chosen), docs[id_col] == F.col("_id")).drop("_id")
