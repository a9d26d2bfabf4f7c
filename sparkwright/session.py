"""Session helpers: one place for the configuration every operator assumes."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings the operators rely on. ANSI stays on (Spark 4 default): operators use
# try_cast / try_divide / try_to_timestamp where the reference tolerates bad values.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app_name: str = "sparkwright", conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    On a cluster pass ``master=None`` and let spark-submit decide; locally
    ``local[N]`` with shuffle partitions sized to the core count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    merged = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        cores = master[len("local["):-1] if "[" in master else "1"
        cores = str(os.cpu_count() or 8) if cores == "*" else cores
        merged.setdefault("spark.sql.shuffle.partitions", cores)
        merged.setdefault("spark.driver.memory", "16g")
    merged.update(conf or {})
    for k, v in merged.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment sets it to shared storage and it is only read;
    without it operators refuse to run there. Only a ``local[..]`` session (tests)
    gets a private scratch folder when it is unset. Checkpoints are removed with
    their DataFrame where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is on (the default of :func:`get_spark`); stage tables stay for their readers
    until :func:`drop_stages`.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="sparkwright-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def stage_path(spark: SparkSession, name: str) -> str:
    """Folder under the shared checkpoint dir for a materialised stage table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/stages/{name}"


def drop_stages(spark: SparkSession, path: str) -> None:
    """Remove a stage folder once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/"
    if not path.startswith(base):
        raise ValueError(f"{path} is no stage folder")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sparkwright`` importable on executors (for the few operators that
    run Python in tasks): zip the package once and add it with ``addPyFile``,
    which Spark distributes to every executor."""
    import os
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="sparkwright-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
