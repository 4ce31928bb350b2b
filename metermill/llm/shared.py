"""What the operators share: intermediate tables in the cluster's folder, and how Python workers are prepared."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.shipping import ship

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Words of all operators: runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach; a private one only for local sessions without the setting."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor reaches")
        root = tempfile.mkdtemp(prefix="metermill-llm-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, later jobs read it again.

    ``narrow`` is for rows of a few numbers (links, labels): two tasks a core write them, however many partitions a shuffle has.
    """
    if narrow:
        df = df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    path = f"{shared_folder(df.sparkSession)}/llm/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_rows(spark: SparkSession, rows: int = 500) -> None:
    """Rows of an Arrow batch: with long texts the default of 10,000 would be gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def prepare(spark: SparkSession) -> None:
    ship(spark)
    arrow_rows(spark)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that no name of an operator's own meets one of theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def of_row(name: str) -> Column:
    return F.col("row").getField(name)


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    return df.select(*[changed.get(c, of_row(c)).alias(c) for c in columns])


def without(docs: DataFrame, names) -> DataFrame:
    """``docs`` without columns that have the names of an operator's results."""
    return docs.drop(*[c for c in docs.columns if c.lower() in names])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket(key: Column, salt: int, divisor: int) -> Column:
    """0 .. divisor - 1 from a key's CRC, the folds of the contracts when salt is 0."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) + F.lit(salt), F.lit(divisor))
