"""Session and shared-folder helpers used by every layer."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "strandline", cores: str = "*", partitions: int | None = None) -> SparkSession:
    """A local session with the settings the library is tested with; clusters pass their own session."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "12g")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master alone, one of our own where that is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jvm_dir = sc._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="strandline-checkpoint-")
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/strandline-{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already; the folder is scratch space
            pass

    atexit.register(drop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the rows as Parquet under the shared folder and read them back.

    Unlike a local checkpoint the files outlive the executors that wrote them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that materialize() wrote and that nothing reads any more."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles() if "/strandline-" in name}:
        remove(df.sparkSession, path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, so that they can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_strandline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="strandline-package-")) / "strandline.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, Path("strandline") / source.relative_to(root))
    sc.addPyFile(str(target))
    sc._strandline_shipped = True


def trim(spark: SparkSession) -> bool:
    """Return native memory that the driver's JVM and Python have freed to the system; False where the JVM or the C library can't (other than glibc, Java before 17.0.9).

    Compiler threads and large plans leave hundreds of MB in the C library's pools, which it keeps otherwise.
    """
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return False
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    try:
        find = jvm.java.lang.Class.forName
        signature, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(kinds):
            signature[i] = find(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        find("javax.management.MBeanServer").getMethod("invoke", signature).invoke(server, given)  # the server's own class isn't open to callers
    except Py4JError:
        return False
    return True


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that are done: it does so once the driver has collected their plans.  Its free memory goes back."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Send at most so many rows at once to Python workers, for steps run inside whose rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
