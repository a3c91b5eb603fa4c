"""What a Spark session needs for this package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each application; they may have no copy of it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        home = Path(__file__).resolve().parent
        tmp = tempfile.mkdtemp()  # executors fetch it from here, through the driver, as long as the application runs
        atexit.register(shutil.rmtree, tmp, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tmp}/{home.name}", "zip", home.parent, home.name))
        _shipped.add(app)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: what follows neither plans nor runs its lineage again."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not found and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        sc.setCheckpointDir(found or "/tmp/checkpoints/tessera")
    return df.checkpoint()
