"""Session helpers: building a session for tests/bench and locating the
shared checkpoint folder.

The checkpoint folder comes from ``spark.checkpoint.dir`` (a shared file
system path set by whoever launches the job).  Only when it is unset is a
folder below the session's warehouse used, and on a cluster only if that is
not a local disk.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str | None = None, partitions: int = 8,
                  app: str = "tessera") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEM", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def cluster_conf(input_bytes: int, total_cores: int,
                 target_partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Partition sizing for a cluster run: shuffle partitions so each holds
    about ``target_partition_bytes`` of input (at least 2 per core), scan
    splits of the same size, AQE on to coalesce small and split skewed
    shuffle partitions at run time.  E.g. 100 TB on 8,000 cores gives about
    820k shuffle partitions of 128 MB."""
    parts = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # broadcast only what is proven small; the library's own broadcasts
        # carry explicit bounds and do not depend on this threshold
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        # lineage cuts write to spark.checkpoint.dir; drop them once unreferenced
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def require_shared(scheme: str, master: str) -> None:
    """Raise where written tables would land on each machine's own disk."""
    if scheme == "file" and not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share: "
                           "the warehouse is on a local disk")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint root, setting one below the warehouse only
    when the session has none."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(warehouse)
        require_shared(path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme(), sc.master)
        root = f"{warehouse}/_checkpoints/{uuid.uuid4().hex[:12]}"
        spark.conf.set("spark.checkpoint.dir", root)
        _drop_at_exit(spark, root)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_SCRATCH: dict[str, str] = {}


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    """Create a folder that goes when the application's JVM ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint root for written tables.  The
    application's scratch folder goes when it ends."""
    root, app = ensure_checkpoint_dir(spark), spark.sparkContext.applicationId
    if app not in _SCRATCH:
        folder = f"{root}/scratch-{uuid.uuid4().hex[:12]}"
        _drop_at_exit(spark, folder)
        _SCRATCH[app] = folder
    return f"{_SCRATCH[app]}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_bytes(df: DataFrame) -> Column:
    """About the bytes that a row takes in memory."""
    total = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            total = total + 8
    return total


def broadcast_if_small(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast a per-group side table only if its measured bytes allow.

    Joining a one-row-per-group table on a low-cardinality key (a class
    label) with a shuffle would send a hot group's rows to one task; a
    broadcast keeps the big side where it is.  Above ``max_bytes`` the plain
    join stays (keys are then many, and AQE splits skewed partitions)."""
    size = df.agg(F.coalesce(F.sum(row_bytes(df).cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= max_bytes else df


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in Python workers (mapInPandas /
    applyInPandas functions refer to it): zip the package's sources once per
    application and hand the archive to ``SparkContext.addPyFile``, which
    copies it to every executor and puts it on the workers' path."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="tessera-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    atexit.register(lambda: os.path.exists(path) and os.unlink(path))
    _SHIPPED.add(sc.applicationId)
