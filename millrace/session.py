"""Session settings and scratch space shared by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What a session needs for results to agree between engines and for runtime re-planning.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Scratch folders of local applications whose ``spark.checkpoint.dir`` is unset.
_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "millrace") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``, or a fresh local one where it is unset (tests).

    A cluster without that setting is an error: its executors share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        # a session's setting cannot be changed, so the folder is kept by application
        application = spark.sparkContext.applicationId
        if application not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[application] = "file://" + tempfile.mkdtemp(prefix="millrace-")
            spark.sparkContext.setCheckpointDir(_LOCAL_ROOTS[application])
        root = _LOCAL_ROOTS[application]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark)}/millrace-{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of at most ``most`` bytes in this session, unless it has a smaller bound.

    By default a batch has 10,000 rows or 64 MB, on both sides of every Python task: long rows would make memory.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size, unit = re.fullmatch("([0-9]+) *([a-z]?).*", spark.conf.get(key, str(1 << 30)).lower()).groups()
    if int(size) << {"k": 10, "m": 20, "g": 30}.get(unit, 0) > most:
        spark.conf.set(key, str(most))


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a URI of the store that Spark reads it from: without a scheme that is the default store, not a local disk."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().toString()
    return re.sub("^file:/+", "file:///", uri)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The copy outlives executors, so a lost one costs a re-read and not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables written by :func:`materialize` that no later plan reads."""
    for df in frames:
        files = df.inputFiles()
        if not files:
            continue
        spark = df.sparkSession
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if path.getName().startswith("millrace-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
