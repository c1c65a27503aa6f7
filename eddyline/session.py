"""Session construction and the shared scratch folder.

Intermediate tables, stream checkpoints and drained stream results go under
``spark.checkpoint.dir`` — the shared folder a cluster names for lineage
cuts.  Only when the session has none (local tests) do we create one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # transformWithState needs the RocksDB provider; it also keeps large
    # per-key state off the JVM heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # commit cost proportional to the batch's changes, not the whole state
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def get_session(master: str | None = None, app: str = "eddyline",
                shuffle_partitions: int | None = None,
                conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    ship_package(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Event times are absolute instants; rendered window bounds are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_stateful_conf(spark: SparkSession) -> None:
    key = "spark.sql.streaming.stateStore.providerClass"
    want = DEFAULT_CONF[key]
    try:
        cur = spark.conf.get(key)
    except Exception:  # noqa: BLE001 - unset
        cur = None
    if cur != want:
        spark.conf.set(key, want)


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jdir.get() if jdir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="eddyline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, never reused sub-folder of the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/eddyline/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme (for local assertions in tests only)."""
    return path[5:] if path.startswith("file:") else path


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint in the shared folder (never a local checkpoint)."""
    spark = spark or df.sparkSession
    checkpoint_root(spark)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """``df`` written to the shared folder and read again: lineage ends there,
    and a plan that uses it more than once computes it once."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


__all__ = ["get_session", "ensure_utc", "ensure_stateful_conf", "checkpoint_root",
           "scratch_dir", "local_path", "cut_lineage", "stored", "ship_package"]


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``eddyline`` importable in Python workers (``addPyFile`` of a zip).

    Stateful processors and pandas functions are pickled by reference, so
    every executor's Python worker must be able to import this package.
    """
    sc = spark.sparkContext
    ident = sc.applicationId
    if ident in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = checkpoint_root(spark)
    local_root = local_path(root) if (root.startswith("file:") or root.startswith("/")) else None
    folder = local_root or tempfile.mkdtemp(prefix="eddyline-pkg-")
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, f"eddyline-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in base:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(target)
    # Driver-side Python runners (the stateful processor's init runner) do not
    # see addPyFile; they take PYTHONPATH from the function environment.
    parent = os.path.dirname(pkg_dir)
    cur = sc.environment.get("PYTHONPATH", "")
    if parent not in cur.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (parent, cur) if p)
    _SHIPPED.add(ident)
