"""What every module needs of a session: tables, a folder that all executors share, cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex
_OWN: dict[str, str] = {}  # by application, the temporary folder of a session on one machine


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _on_one_machine(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.  Where that is unset a session on one machine has
    a temporary one; a cluster has none that all executors see, and it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not _on_one_machine(spark):
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = spark.sparkContext._jvm.java.nio.file.Files.createTempDirectory("folioloom-", spark.sparkContext._gateway.new_array(
            spark.sparkContext._jvm.java.nio.file.attribute.FileAttribute, 0)).toUri().toString().rstrip("/")
    return _OWN[app]


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def run_folder(spark: SparkSession) -> str:
    """One folder for all that this application writes in between, which goes when the application ends."""
    folder = f"{shared_folder(spark)}/folioloom-{spark.sparkContext.applicationId}-{_RUN}"
    fs, where = _file_system(spark, folder)
    if fs.mkdirs(where):
        fs.deleteOnExit(where)
        if shared_folder(spark) in _OWN.values():
            fs.deleteOnExit(where.getParent())
    return folder


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows of `df` as a written table in the shared folder: computed once, whole again if executors are lost.
    It stays until the application ends, as the frames made of it are read later, or until `release`."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioloom_path = path
    return out


def release(*written: DataFrame) -> None:
    """Remove tables of `materialize` that nothing will read again."""
    for df in written:
        path = getattr(df, "_folioloom_path", None)
        if path:
            fs, where = _file_system(df.sparkSession, path)
            fs.delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan over all cores where its input is a few small files.  Larger tables have parts enough and are
    not shuffled.  Decided from the files' list and size, without a job."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    part = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    few = size < cores * part and len(df.inputFiles()) < max(cores // 2, 1)
    return df.repartition(cores) if few else df
