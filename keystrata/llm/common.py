"""Shared pieces of the corpus operators: checkpointing, table access, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def _folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only for a local master
    that names none (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            where = tempfile.mkdtemp(prefix="keystrata-ckpt-")
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table with reliable storage."""
    _folder(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage of a large table: written as compressed Parquet in the same folder."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's Arrow batches to BATCH_ROWS rows, so that a Python worker holds
    a few MB of texts at a time; a smaller setting of the session stays."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def spread(df: DataFrame) -> DataFrame:
    """For operators bound by CPU: a table of fewer splits than there are cores (a small file)
    is dealt to all of them; larger ones stay as they are read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, underscores added where `df` has a column of that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def ascii_lower(c):
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(batch, key="doc_id", text="text"):
    """(keys, texts) of an Arrow batch; a null text is the empty one."""
    keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
    return keys, ((x.as_py() or "") for x in batch.column(batch.schema.get_field_index(text)))
