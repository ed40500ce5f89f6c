"""Session helpers: local sessions for tests, table loading, lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skein")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SKEIN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package once a session, as a zip, so that they need no path to the repository."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="skein-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "skein.zip")
    with zipfile.ZipFile(path, "w") as z:
        for where, dirs, files in os.walk(package):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(where, f)
                    z.write(full, os.path.join("skein", os.path.relpath(full, package)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, where a table of few files would keep most of them idle.

    Only tables with fewer partitions than cores are shuffled, so what moves is small; others stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one where none is set (local runs only)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df once as a table in the shared folder and read it back.

    The copy is on shared storage, so a lost executor loses nothing, and it is written in one pass
    (a reliable RDD checkpoint would compute its input twice). release() deletes what a session wrote.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that materialize wrote in this session; call it when their results are no longer read."""
    while _written:
        remove_path(spark, _written.pop())


_written: list[str] = []


# ---- paths on any file system that Hadoop knows ---------------------------------------------------------


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Paths of what a folder holds; none where it doesn't exist."""
    fs, p = _hadoop(spark, path)
    return sorted(str(s.getPath()) for s in fs.listStatus(p)) if fs.exists(p) else []


def read_path(spark: SparkSession, path: str) -> str | None:
    """The text of a file, None where there is none."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_path(spark: SparkSession, path: str, text: str) -> None:
    """Write a file beside its place and move it there, over what was there."""
    fs, p = _hadoop(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    stream = fs.create(new, True)
    try:
        stream.write(text.encode("utf-8"))
    finally:
        stream.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(p), how)
