"""What a Spark session needs before queries run: this package on the workers, Arrow batches of a bounded number of
texts (Spark's default of 10,000 rows is meant for narrow rows; a size that the caller has set is kept), and a shared
folder for checkpoints."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
HERE = os.path.dirname(os.path.abspath(__file__))


def ready(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, once per Spark context, so that their functions can be imported there
    whatever their path is."""
    sc = spark.sparkContext
    if ARROW_ROWS not in spark.conf.getAll:
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)
    if not getattr(sc, "_mnemo_sent", False):
        folder = tempfile.mkdtemp(prefix="mnemo-")
        path = os.path.join(folder, "mnemo.zip")
        with zipfile.ZipFile(path, "w") as z:
            for top, _, names in os.walk(HERE):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(top, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(HERE)))
        sc.addPyFile(path)
        sc._mnemo_sent = True
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """Make ``checkpoint()`` usable and return its folder: the cluster's ``spark.checkpoint.dir`` if set, else (local master
    only) a folder of this machine.  On a cluster without that setting this raises: a machine-local folder would be lost
    with its executor."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "mnemo-checkpoints")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and continue from there: later plans neither recompute it
    nor depend on executors that held its shuffle files."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def query(f):
    """A query function that makes its session ready first."""

    @wraps(f)
    def run(spark, sf_dir):
        return f(ready(spark), sf_dir)

    return run
