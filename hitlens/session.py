"""Session settings the operators rely on."""

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "hitlens", **conf: str) -> SparkSession:
    builder = (SparkSession.builder.appName(app_name)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Where none is named it is a folder of the application on Hadoop's default file system,
    deleted when the session's process ends; a local file system serves a local session only.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        files = hadoop.FileSystem.get(conf)
        if files.getScheme() == "file" and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = files.makeQualified(hadoop.Path(
            conf.get("hadoop.tmp.dir"), f"hitlens-{spark.sparkContext.applicationId}"))
        files.mkdirs(path)
        files.deleteOnExit(path)
        folder = path.toString()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
