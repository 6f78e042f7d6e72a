"""Session settings and the reliable-checkpoint helper."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the package's settings to a session builder; master and memory stay the caller's."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def sized_for(builder: SparkSession.Builder, input_bytes: int) -> SparkSession.Builder:
    """Partition counts for an input of this size.

    Shuffles start with one partition per 512 MB read, at least 200; adaptive execution joins the
    small ones.
    """
    return builder.config("spark.sql.shuffle.partitions",
                          str(max(input_bytes // (512 << 20), 200)))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session, where the driver is
    the one executor, may fall back to a fresh temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lanewise-"))
    return context.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so later uses see the same rows and partitions."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def _bundle() -> bytes:
    """This package as a zip; equal sources give equal bytes."""
    root, held = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(held, "w") as zipped:
        for file in sorted(root.rglob("*.py")):
            entry = zipfile.ZipInfo(str(Path(root.name) / file.relative_to(root)))
            zipped.writestr(entry, file.read_bytes())
    return held.getvalue()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, as a zip that they fetch from the shared folder.

    The zip stays there, because executors that start later fetch it too; its name is the hash of
    its content, so it is written once however many jobs ship it.
    """
    content = _bundle()
    name = f"lanewise-{hashlib.sha256(content).hexdigest()[:16]}.zip"
    context = spark.sparkContext
    if any(added.endswith(f"/{name}") for added in context.listFiles):
        return
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(shared_dir(spark), name)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        part = hadoop.Path(shared_dir(spark), f"{name}.{uuid.uuid4().hex}")
        stream = system.create(part)
        stream.write(content)
        stream.close()
        if not system.rename(part, path):  # another job was first
            system.delete(part, False)
    context.addPyFile(system.makeQualified(path).toString())


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of our own, wherever it is stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
