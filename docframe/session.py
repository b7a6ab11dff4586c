"""Session settings and the shared folder for tables that cut a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(name: str = "docframe", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (CONF | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()
_own_folders: dict[str, str] = {}
_paths: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python functions find it wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="docframe-")) / "docframe.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def shared_path(spark: SparkSession, name: str = "stage") -> str:
    """A new path in the folder of spark.checkpoint.dir (a temporary one on a local master where that is unset)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if spark.sparkContext.applicationId not in _own_folders:
            _own_folders[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="docframe-")
        shared = _own_folders[spark.sparkContext.applicationId]
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written to the shared folder and read back: it cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> int:
    """Delete what this application has staged in the shared folder; call it when no result that reads it is needed any more."""
    paths = _paths.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)
