"""Session set-up, shared folders and small plan helpers used by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings a cluster session should carry; a session that already sets one keeps its own value.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(app: str = "quarrykit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults. `master` is left to spark-submit unless given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SESSION_DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the library to the executors' Python workers, once an application, so that it need not be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="quarrykit-ship-")) / "quarrykit.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(to))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where the cluster names none (tests, local mode) a temporary folder of this machine is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarrykit-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder, so a lost executor costs no recomputation of what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def once(df: DataFrame, *key: str) -> DataFrame:
    """One row of each key: exact repeats of a row count once. Which one is kept is fixed by the row's hash."""
    return df.dropDuplicates(list(key))


def slots(spark: SparkSession) -> int:
    """Tasks that run at the same time, a lower bound for the number of parts of Python-bound stages."""
    return max(spark.sparkContext.defaultParallelism, 1)


#: Bytes of input for one part of Python-bound work.
PART_BYTES = 64 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of what `df` reads, without a job: the size of its tables, and of written intermediate data at most PART_BYTES for
    each part, as the planner's guess for those grows without bound over joins."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        size = int(str(leaf.stats().sizeInBytes()))
        total += min(size, leaf.rdd().getNumPartitions() * PART_BYTES) if leaf.nodeName() in ("LogicalRDD", "ExternalRDD") else size
    return total


def _size(text: str) -> int:
    """Bytes of a size setting such as 128m."""
    m = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", text.strip().lower())
    return int(m.group(1)) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m.group(2)]


def parts_for(df: DataFrame) -> int:
    """Parts for work bound by Python CPU: at least two for each slot, and one for each PART_BYTES of input."""
    return max(slots(df.sparkSession) * 2, -(-input_bytes(df) // PART_BYTES))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows in enough parts for work that is bound by Python CPU; the count grows with the input.

    Where the input alone fills all slots twice over with splits of the file reader, and no key is named, these splits serve and
    nothing is shuffled. Only smaller inputs, which the reader hands out in few splits, are dealt out anew."""
    spark = df.sparkSession
    ship(spark)
    split = _size(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    if not by and input_bytes(df) >= 2 * slots(spark) * split:
        return df
    n = parts_for(df)
    return df.repartition(n, *[F.col(c) for c in by]) if by else df.repartition(n)


def widened(written: DataFrame) -> DataFrame:
    """A table cut from its lineage, in at least as many parts as there are slots: small ones are put together into few when they are
    written, and would then keep most slots idle. Large ones stay as they are."""
    n = slots(written.sparkSession)
    return written.repartition(n) if written.rdd.getNumPartitions() < n else written
