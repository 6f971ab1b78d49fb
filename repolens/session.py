"""Sessions, tables, checkpoints and the shipping of this package to executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", app: str = "repolens", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g")).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir; on one machine, as in tests, one of our own where that is unset. On a
    cluster a folder that isn't named is an error: executors could not read another machine's folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
            named = tempfile.mkdtemp(prefix="repolens-checkpoint-")
        sc.setCheckpointDir(named)
        return named
    return current.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read back; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once a session: a zip goes out with the session's files, on a cluster from the
    shared folder. All operators that run Python code call this."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    name = f"repolens-{sc.applicationId}.zip"
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        path = os.path.join(tempfile.mkdtemp(prefix="repolens-"), name)
        Path(path).write_bytes(buffer.getvalue())
    else:
        target = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}")
        out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(buffer.getvalue()))
        out.close()
        path = target.toString()
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; Python code that reads it runs with this package on the executors."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
