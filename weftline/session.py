"""Session settings shared by tests, bench and examples."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: int | str = 8, shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's settings hold."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weftline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and continue from there.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``. Only where that
    setting is missing, as in local tests, a folder of this process's own is used.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if where is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="weftline-checkpoint-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)
