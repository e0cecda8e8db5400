"""Session factory and the few session-level helpers every module shares."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # settled tables go when nothing refers to them any more
}


def build_session(app: str = "tessera", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the engine's defaults; a cluster brings its own session instead."""
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "8g"} | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    make_importable(spark)
    return spark


def make_importable(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever the driver was started.

    Local workers get the package's folder on their path; a cluster gets the package as a file, once per application.
    """
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in known:
        return
    context.environment["PYTHONPATH"] = os.pathsep.join([*known, root])
    if not context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="tessera-code-")  # on the driver, which serves the file as long as it lives
        context.addPyFile(shutil.make_archive(os.path.join(folder, "tessera"), "zip", root, "tessera"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may be without one; it then gets its own folder. A cluster without the setting is an
    error, because a machine-local folder would be lost together with its machine.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder: cuts the lineage and survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
