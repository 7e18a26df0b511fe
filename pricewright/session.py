"""Sessions, table access and tables written between jobs."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder (tests on one machine).
DEFAULT_SCRATCH = "/tmp/checkpoints"


def build(master: str = "local[*]", name: str = "pricewright", **conf: str) -> SparkSession:
    """A session with UTC, AQE and a shuffle width fit for one machine."""
    cores = os.cpu_count() or 8
    b = SparkSession.builder.master(master).appName(name)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the input folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir of the session; a folder of this machine only if the session runs on it alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or DEFAULT_SCRATCH).rstrip("/")


def stash(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/pricewright-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    _written.append((spark, path.rpartition("/")[0]))
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            return


atexit.register(_clean)


def schema(ddl: str):
    """A struct type from `name type, ...` without a running session; types may be array<...> or map<...,...>."""
    import re

    from pyspark.sql import types as T

    plain = {"string": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}

    def kind(t: str) -> T.DataType:
        if t.startswith("array<"):
            return T.ArrayType(kind(t[6:-1]))
        if t.startswith("map<"):
            k, _, x = t[4:-1].partition(",")
            return T.MapType(kind(k), kind(x))
        return plain[t]

    return T.StructType([T.StructField(n, kind(t)) for n, t in re.findall(r"(\w+) ((?:array<[^>]*>|map<[^>]*>|\w+))", ddl)])
