"""What the corpus operators share: reading tables, saved intermediate tables, the training split."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import free_shuffles, shared_dir, ship, shuffles

#: A word, as every operator of this subpackage understands it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch of texts: with texts of some thousand characters a few megabytes.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as rows here are whole texts; a smaller setting of the session's own stands."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path goes to Spark's reader unchanged, so any store works."""
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a master that runs in this process may do without."""
    return shared_dir(spark)


def unused(columns: list[str], *wanted: str) -> list[str]:
    """Names like those wanted that none of the columns has, case aside."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def one_of_equals(docs: DataFrame, keys: DataFrame, key_id: str, key_hash: str, *kept: str) -> tuple[DataFrame, list[str]]:
    """For each row of keys the one row of docs with its doc_id (null is a value) and its text's hash: docs' columns and
    those kept of keys, under names that docs does not have, which come second.

    keys has (key_id, key_hash, n, *kept), n being the rows of docs that are equal in both; several rows of keys
    may name one text. Texts pass through a hash join whose other side holds no text, and are not sorted; only
    where rows are equal is one chosen among them.
    """
    h, place, own_id, own_hash, own_n, *own = unused(docs.columns, "h", "place", "key_id", "key_hash", "key_n", *kept)
    keys = keys.select(F.col(key_id).alias(own_id), F.col(key_hash).alias(own_hash), F.col("n").alias(own_n), *(F.col(k).alias(o) for k, o in zip(kept, own)))
    hashed = docs.withColumn(h, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(h) == F.col(own_hash))
    columns = [*(f"`{c}`" for c in docs.columns), *own]
    single = hashed.join(keys.where(F.col(own_n) == 1).hint("shuffle_hash"), same).select(*columns)
    several = keys.where(F.col(own_n) > 1)
    first = hashed.join(several.select(own_id, own_hash).distinct().hint("shuffle_hash"), same, "left_semi")
    first = first.withColumn(place, F.row_number().over(W.partitionBy("doc_id", h).orderBy(F.lit(0)))).where(F.col(place) == 1)
    return single.unionByName(first.join(several.hint("shuffle_hash"), same).select(*columns)), own


def remove(spark: SparkSession, path: str) -> None:
    """Delete a saved table in whatever store it lies."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def save(df: DataFrame, label: str, *partition_by: str, free: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage so that a lost executor costs the current stage only. The table
    goes when the driver's Python ends; ``drop_saved`` removes it earlier. With
    ``free`` what was shuffled for it goes from the executors' disks at once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/kinmerge-{label}-{uuid.uuid4().hex}"
    before = shuffles(spark) if free else 0
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if free:
        free_shuffles(spark, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    atexit.register(_remove_quietly, spark, path)
    return out


def drop_saved(df: DataFrame) -> None:
    """Remove a table that ``save`` wrote and nothing reads any more."""
    remove(df.sparkSession, df._saved_path)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended already  # noqa: BLE001
        pass


def id_remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % divisor


def width(df: DataFrame) -> int:
    """Partitions to deal rows out to: what the session is set to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
