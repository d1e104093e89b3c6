"""Session helpers: a local session for tests, and the folder that a whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: How steps run: small batches go to Python, and a step's shuffle files go when its result is written.
STEP = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_tables: list[list[str]] = []


def local_session(cores: int = 8, partitions: int = 8, name: str = "cardwright") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a new one is made and set, on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cardwright-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut, and its rows outlive executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    if _tables:
        _tables[-1].append(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unstage(*frames: DataFrame) -> None:
    """Delete tables of staged() that nothing will read again."""
    for df in frames:
        _delete(df.sparkSession, df.staged_path)
        for own in _tables:
            if df.staged_path in own:
                own.remove(df.staged_path)


def stepwise(f):
    """f, which runs steps before it returns a lazy result: they run under STEP, and the session's own settings come back
    after them. Of the tables that f has staged, those go which its result doesn't read; a caller that is stepwise takes
    over the others.
    """

    @wraps(f)
    def run(*args, **named):
        spark = next(getattr(x, "sparkSession", x) for x in (*args, *named.values()) if isinstance(x, (DataFrame, SparkSession)))
        was = {k: spark.conf.get(k) for k in STEP}
        for k, v in STEP.items():
            spark.conf.set(k, v)
        _tables.append([])
        out, left = None, True
        try:
            out = f(*args, **named)
            left = False
        finally:
            for k, v in was.items():
                spark.conf.set(k, v)
            own = _tables.pop()
            used = [x for df in (out if isinstance(out, tuple) else (out,)) if isinstance(df, DataFrame) for x in df.inputFiles()]
            used = {name for x in used for name in x.split("/")}
            for path in own:
                if left or path.rpartition("/")[2] in used:
                    if _tables:
                        _tables[-1].append(path)
                else:
                    _delete(spark, path)
        return out

    return run
