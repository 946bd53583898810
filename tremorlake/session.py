"""Session settings and the shared workspace."""

import tempfile
import uuid

from pyspark.sql import SparkSession

# Set on any session the library is handed; none of these sizes anything.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A week of one-minute batches, for the totals of a long run.
    "spark.sql.streaming.numRecentProgressUpdates": "10000",
    # State that outgrows the executor heap lives on its disk.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Its count of keys, which nothing here reads, would look up every key that is written.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def settle(spark):
    """Apply the settings every operator relies on and return the session."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus="*", shuffle_partitions=8, memory="8g", app="tremorlake"):
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_roots = {}


def workspace_root(spark):
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own: on a cluster the
    executors would not see a folder of the driver's machine, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tremorlake-")
    return _local_roots[app]


def workspace(spark, name):
    """A fresh folder below the shared root; never reused, so retries cannot mix."""
    return f"{workspace_root(spark)}/tremorlake/{name}-{uuid.uuid4().hex}"
