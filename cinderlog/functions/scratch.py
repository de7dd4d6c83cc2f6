"""Shared intermediate tables: written once, read by any executor, safe when one is lost.

Tables of few and short rows are not written: they go to the driver and are literals of the plans that use them.
"""

from __future__ import annotations

import atexit
import re
import shutil
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN = "/tmp/checkpoints"
_AGAIN = re.compile(r"^[\s:+-]*(?:Join|Aggregate|Window|Sort|Deduplicate|Generate|MapIn\w+)\b", re.M)  # operators of optimized plans

LITERAL_ROWS = 20_000  # rows of a literal at most
LITERAL_BYTES = 256  # bytes of each of its strings at most
_SHORT = (T.BooleanType, T.ByteType, T.IntegerType, T.LongType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode only, one of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{_OWN}/{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


def table_dir(spark: SparkSession) -> str:
    """The application's own folder there. Hadoop's file system deletes it when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/cinderlog-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def clear(spark: SparkSession) -> None:
    """Deletes all tables stored so far. DataFrames that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: cuts the lineage."""
    spark = df.sparkSession
    path = f"{table_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """As stored(), with the number of rows, counted by the job that writes them."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, int(seen.get.get("n", 0))


def literal(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A DataFrame of rows that the driver's JVM holds."""
    jschema = spark._jsparkSession.parseDataType(schema.json())
    return DataFrame(spark._jsparkSession.createDataFrame(rows, jschema), spark)


def few_rows(df: DataFrame):
    """The rows, as a list in the driver's JVM, or None if they are more or longer than a literal may have."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not all(f.name in strings or isinstance(f.dataType, _SHORT) for f in df.schema.fields):
        return None
    names, bounded = df.columns, df
    if strings:  # longer ones stay where they are: only their places come
        long = F.greatest(*(F.coalesce(F.octet_length(c), F.lit(0)) for c in strings), F.lit(0)) > LITERAL_BYTES
        bounded = df.select(*(F.when(~long, F.col(c)).alias(c) if c in strings else c for c in names), long.alias("_long"))
    rows = bounded._jdf.limit(LITERAL_ROWS + 1).collectAsList()
    if rows.size() > LITERAL_ROWS:
        return None
    if strings:
        held = literal(df.sparkSession, rows, bounded.schema)
        if not held.filter("_long").isEmpty():
            return None
        rows = held.select(*names)._jdf.collectAsList()
    return df.sparkSession._jvm.java.util.ArrayList(rows)


def costly(df: DataFrame) -> bool:
    """Whether each further use joins, aggregates or sorts again, rather than just scan, filter and project."""
    return bool(_AGAIN.search(df._jdf.queryExecution().optimizedPlan().toString()))


def size_estimate(df: DataFrame) -> int:
    """Bytes, as the optimizer estimates them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
