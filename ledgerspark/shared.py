"""The folder that driver and executors share, and tables written to it.

A written table cuts the lineage: a lost executor costs a re-read, not a
recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only on one machine (a local master) and with the setting unset is a temporary
    folder made, and kept for the session; on a cluster that is an error."""
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        base = getattr(spark, "_own_shared_dir", None)
        if not base:
            master = spark.conf.get("spark.master", "local")
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
            base = spark._own_shared_dir = "file://" + tempfile.mkdtemp(prefix="shared-")
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_stored_path", None):
            spark = df.sparkSession
            of = spark._jvm.org.apache.hadoop.fs.Path(path)
            of.getFileSystem(spark._jsc.hadoopConfiguration()).delete(of, True)
            df._stored_path = None


#: Bytes of source files, compressed, that one part of a shuffle should stem from, about.
PART_BYTES = 4 << 20


def parts(*tables: DataFrame) -> int:
    """Parts of a shuffle of the tables: one for each core, or more so that a part stays small however large their files are."""
    leaves = {}
    for df in tables:
        found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        for i in range(found.size()):
            leaf = found.apply(i)
            leaves[leaf.canonicalized().semanticHash()] = int(str(leaf.stats().sizeInBytes()))
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, min(sum(leaves.values()) // PART_BYTES, 100_000))


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name like ``name`` that none of the tables has, in any case."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
