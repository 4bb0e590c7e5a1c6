"""Session helpers: sessions for tests and benches, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "factloom") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in spark.checkpoint.dir; a local temporary one only where none is set (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def _written(df: DataFrame) -> DataFrame:
    """A checkpoint keeps the estimated size of the plan it came from. That of a join is the product of its sides, so in a loop its
    digits double with every round, until planning takes longer than the work; a frame over the written rows alone has none."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and read it back: reliable, unlike a local checkpoint."""
    return _written(df)


def cut_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """cut(), and aggregates over the rows taken while they are written, so that no second job has to read them.

    A task that runs again may be counted twice, so only whether a count is 0 may decide anything.
    """
    seen = Observation()
    return _written(df.observe(seen, *(m.alias(n) for n, m in metrics.items()))), seen.get


def kept(df: DataFrame) -> DataFrame:
    """Write df below the checkpoint folder as Parquet and read it back; gone with the application.

    Rows of a few numbers take a fraction of a checkpoint's room, which holds them uncompressed.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/kept-{uuid.uuid4().hex}")
    df.write.parquet(path.toString())
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())


#: Rows up to which a side of a join is sent to every executor whatever its estimated size; wider keys or more rows are shuffled.
SENT_ROWS = 200_000


def sent(df: DataFrame, rows: int) -> DataFrame:
    """df as a side of a join that is sent around if it has at most SENT_ROWS rows, so that the other side stays where it is."""
    return F.broadcast(df) if rows <= SENT_ROWS else df


#: White space of any kind, as a regular-expression class that Java and RE2 both understand.
SPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"


def trimmed(col: Column | str) -> Column:
    """The text without white space of any kind at either end; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def filled(col: Column | str) -> Column:
    """The trimmed text, or null if nothing is left."""
    t = trimmed(col)
    return F.when(t != "", t)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that costs far more than a shuffle of its input.

    A large input has enough scan partitions and stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(3 * cores, key)
