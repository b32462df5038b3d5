"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For tables of hashes, which no dictionary and no search makes smaller.
PLAIN = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false"}
_OWN: dict[str, str] = {}
_LEFT: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset (tests), a folder of this machine."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="chronoweave-")
    return _OWN["dir"]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table written by :func:`written`."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _LEFT:
        try:
            delete(spark, path)
        except Exception:  # the session has ended; nothing is left to ask
            return


def written(df: DataFrame, name: str, codec: str = "zstd", sorted_buckets: bool = False, conf: dict[str, str] | None = None, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Cuts the lineage: a lost executor costs no recomputation of what is written.
    The table goes when the driver ends, or by :func:`drop`.  ``sorted_buckets``: what ``df`` reads of
    :func:`bucketed` tables is taken as sorted.  ``conf``: settings of the session while it is written.
    ``by``: a column with a folder for each of its values.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    more = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"} if sorted_buckets else {}
    with _shuffles_freed(spark, more | (conf or {})):
        out = df.write.option("compression", codec)
        (out.partitionBy(by) if by else out).parquet(path)
    _LEFT.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._chronoweave_path = path
    return out


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession, more: dict[str, str] | None = None):
    """A query that ends in here leaves no shuffle files: its result is written, nothing reads them again."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **(more or {})}
    before = {key: spark.conf.get(key, None) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As :func:`written`, dealt and sorted by ``key`` into as many buckets as shuffles have partitions.

    Joins and aggregations by ``key`` then need no shuffle.  Each bucket is one file, so it is sorted.
    The rows are sorted by ``key`` alone before they are written, and the table over the files is then
    declared as sorted: a writer that is told to sort by bucket and key takes three times as long.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mark = uuid.uuid4().hex
    path = f"{shared_folder(spark)}/{name}-{mark}"
    with _shuffles_freed(spark, {"spark.sql.maxConcurrentOutputFileWriters": "4"}):
        own = df.repartition(n, key).sortWithinPartitions(key)
        own.write.format("parquet").options(**PLAIN).option("path", path).bucketBy(n, key).saveAsTable(f"chronoweave_w{mark}")
    columns = ", ".join(f"{c} {kind}" for c, kind in df.dtypes)
    spark.sql(f"DROP TABLE chronoweave_w{mark}")  # the files stay
    spark.sql(f"CREATE TABLE chronoweave_{mark} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{path}'")
    _LEFT.append((spark, path))
    out = spark.table(f"chronoweave_{mark}")
    out._chronoweave_path, out._chronoweave_table = path, f"chronoweave_{mark}"
    return out


def drop(*tables: DataFrame, part: str = "") -> None:
    """Remove tables of :func:`written` that no later plan reads, or one folder of them."""
    for t in tables:
        if part:
            delete(t.sparkSession, f"{t._chronoweave_path}/{part}")
            continue
        if hasattr(t, "_chronoweave_table"):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._chronoweave_table}")
        delete(t.sparkSession, t._chronoweave_path)
        _LEFT[:] = [x for x in _LEFT if x[1] != t._chronoweave_path]


def held(docs: DataFrame, *used: str) -> DataFrame:
    """The columns ``used``, and all others under one name, ``_own``: none can clash with those of an operator."""
    rest = [c for c in docs.columns if c not in used]
    return docs.select(*dict.fromkeys(used), F.struct(*([docs[c] for c in rest] or [F.lit(0).alias("none")])).alias("_own"))


def own(columns: list[str], *used: str) -> list[Column]:
    """What :func:`held` put away, by its own names and in its own order."""
    return [F.col(c) if c in used else F.col("_own")[c].alias(c) for c in columns]


def light(table: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """A written table, marked for broadcast if its rows take at most ``most_bytes`` in memory.

    Rows are counted with what their arrays and strings hold.  Larger tables are joined by shuffle.
    """
    fixed, loose = 32, F.lit(0).cast("long")
    for f in table.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array":
            loose = loose + 8 * F.coalesce(F.size(f.name), F.lit(0)).cast("long") + 24
        elif kind in ("string", "binary"):
            loose = loose + F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") + 16
        else:
            fixed += 16
    held = table.agg(F.coalesce(F.sum(loose + fixed), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(table) if held <= most_bytes else table
