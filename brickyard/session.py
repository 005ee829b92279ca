"""Session for local runs and tests; on a cluster the caller brings its own."""

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, name: str = "brickyard") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def kept(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by files in the folder of spark.checkpoint.dir (a folder of our own where that is unset and the master is local)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            folder = f"file://{tempfile.mkdtemp(prefix='brickyard-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def dropped(spark: SparkSession, *frames: DataFrame | None) -> None:
    """Removes the files of frames that kept() returned and that nothing reads any more, and those of shuffles that nothing refers to:
    Spark does so after the driver's own collections, which are rare on a large heap, and leaves kept files unless it is told otherwise."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    for df in frames:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile() if df is not None else None
        if file is not None and file.isDefined():
            path = jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(context.hadoopConfiguration()).delete(path, True)
    gc.collect()  # Python's own references to plans come first
    jvm.System.gc()
