"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Settings a session of this library wants. On a cluster leave shuffle partitions to the
# submitter: AQE coalesces from whatever it is set to.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "colloquy", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_code(spark)
    return spark


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, so that their Python workers can import it."""
    package = os.path.dirname(os.path.abspath(__file__))
    name = f"{os.path.basename(package)}-code.zip"
    if any(f.endswith(name) for f in spark.sparkContext.listFiles):
        return
    # Executors fetch the file from the driver, so it stays as long as the driver does.
    folder = tempfile.TemporaryDirectory()
    atexit.register(folder.cleanup)
    with zipfile.ZipFile(path := os.path.join(folder.name, name), "w") as out:
        for top, _, files in os.walk(package):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(top, file)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Only where the session names none (tests on one machine) a local folder is made
    and set, so that later calls share it.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        named = tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set(CHECKPOINT_DIR, named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
