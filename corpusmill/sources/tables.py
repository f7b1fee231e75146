"""Reading tables, and cutting lineage through tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources import versions as V

#: Where this package lies.
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it. Machines without that folder need it shipped."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows in as many partitions as shuffles have: a table whose file is small for the work that its rows make would
    else be worked off by the few tasks that its bytes give."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: What this driver has written to the shared folder; release() removes it.
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a folder of this machine will
    do as long as all of Spark runs on it; on a cluster each executor would write to a disk of its own, so there it is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = option.get() if option.isDefined() else None
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="corpusmill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _WRITTEN.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, read again: a lost executor then costs a read, not the work before it."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables and archives have been written so far; release() can start from here."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Remove the tables and archives written to the shared folder since a mark, but for `keep`. Results that read them
    must be stored before."""
    gone = [p for p in _WRITTEN[since:] if p not in keep]
    _WRITTEN[since:] = [p for p in _WRITTEN[since:] if p in keep]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def publish(df: DataFrame, folder: str, keep: int = 2) -> int:
    """Make df the live generation of folder, and remove those before the newest `keep`. -> its number.

    It is written whole under a name of its own, then an entry of the log names it, which of several writers at a time
    each makes one of. A write that fails makes no entry, so the generation before it stays live."""
    spark, name = df.sparkSession, f"generation-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    number = max(V.numbered(spark, f"{folder}/log"), default=-1) + 1
    while not V.create_once(spark, V.entry_path(folder, number), name):
        number += 1
    for old in [n for n in V.numbered(spark, f"{folder}/log") if n <= number - keep]:
        for path in (f"{folder}/{V.read_text(spark, V.entry_path(folder, old))}", V.entry_path(folder, old)):
            files, where = V._path(spark, path)
            files.delete(where, True)
    return number


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The live generation of folder."""
    live = V.numbered(spark, f"{folder}/log")
    if not live:
        raise FileNotFoundError(f"no generation in {folder}")
    return spark.read.parquet(f"{folder}/{V.read_text(spark, V.entry_path(folder, live[-1]))}")


EXTENSIONS = (".txt", ".doc", ".exe", ".zip", ".py", ".lnk", ".sql", ".png", ".pem", ".gz", ".md", ".xyz")


def entries(docs: DataFrame) -> DataFrame:
    """Documents as the files of a source: path, size, and states that depend on the id alone."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    d = F.col("doc_id")
    return docs.select(
        "doc_id", "source", "lang", "n_chars", F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), d, ext)).alias("path"), ext.alias("ext"),
        (d % 17 != 0).alias("present"), F.when(d % 5 == 0, "indexed").when(d % 5 == 1, "rejected").when(d % 5 == 2, "metadata_only").otherwise("observed").alias("status"),
        (d % 3 != 0).alias("has_document"), (d % 7 == 0).alias("active"),
    )
