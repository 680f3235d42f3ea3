"""What the training-data operators share: scratch tables, row keys and word rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the near-duplicate, decontamination, toxicity and PII operators: letters and digits of any script.
WORD = re.compile(r"\w+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares between driver and executors (spark.checkpoint.dir).

    Only where a session on one machine names none, as in tests, a temporary folder is made and set.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/foliospark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch folders made inside, once what was computed from them has been written elsewhere."""
    before = len(_made)
    yield
    for path in _made[before:]:
        remove(spark, path)
    del _made[before:]


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that Python workers get to a few MB, however long the rows are.

    These stay set, as Spark reads them only when a returned DataFrame runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null becomes empty), text_hash, and the columns named in more; other columns are left behind.

    (doc_id, text_hash) finds a row again without relying on row order; rows equal in both are interchangeable.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"), *more)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes for docs to have no such column."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def same_key(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns."""
    on = a[names[0]].eqNullSafe(b[names[0]])
    for n in names[1:]:
        on = on & a[n].eqNullSafe(b[n])
    return on


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
