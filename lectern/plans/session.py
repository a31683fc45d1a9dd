"""What a Spark session needs to run the library's plans."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


#: Rows of an Arrow batch. Rows here hold whole texts; Spark's own default of 10,000 would hold many MB of them twice over.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, whose Python workers import it; once for each application. Also sets smaller Arrow
    batches in a session that has Spark's default."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH[0], BATCH[1]) == BATCH[1]:
        spark.conf.set(BATCH[0], BATCH[2])
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's own checkpoint folder. Only where
    all is one machine (master local) a folder of that machine serves; a cluster without a setting is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "lectern-checkpoints")
        os.makedirs(found, exist_ok=True)
    return found


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, so that later reads neither recompute it nor need the executor that made it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
