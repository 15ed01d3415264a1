"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space that contracts name: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers find the package where the driver found it, whatever folder they start in.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir.

    Where that is unset, a local session (tests) gets a temporary folder; on a cluster it is an error, as executors and
    driver share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cut-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage ends there and a lost executor loses nothing.

    The files stay until `clear`, as only the caller knows when the results that read them have been used.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what this application has `cut` so far; results that weren't written yet can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df` with idx, which counts the rows of each value of `keys` from 0 in the order of `order`, and total, their number.

    `keys` hold no nulls. Rows are dealt by ranges of keys and order together, so a value that holds most rows spans many
    tasks; each task counts its own rows, and only a row a task and value is summed. Rows that agree in all of `order` get
    different numbers; give it enough columns that such rows are interchangeable.
    """
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    rows = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33).alias("task")
    counts = rows.groupBy(task, *keys).agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*keys)  # a row a task that holds the value
    before = F.coalesce(F.sum("n").over(group.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(counts.select("task", *keys, (before - F.col("first_at")).alias("shift"), F.sum("n").over(group).alias("total")))
    return rows.withColumn("task", task).join(starts, ["task", *keys]).withColumn("idx", F.col("at") + F.col("shift")).drop("task", "at", "shift")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string: bit by bit, with the reflected polynomial."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda c, k: {step})))"""


def with_row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, row_hash, row): what tells a document from others, and all its columns, whatever their names.

    Rows that agree in id and text (null included) are one document; the hash tells different texts of one id apart.
    """
    return docs.select(F.col(id_col).cast("long").alias("row_id"), F.xxhash64(F.col(text_col)).alias("row_hash"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))


def without(docs: DataFrame, bad: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose (row_id, row_hash) isn't in `bad`; null ids are equal to each other."""
    keyed, bad = with_row_key(docs, id_col, text_col), bad.select(F.col("row_id").alias("bad_id"), F.col("row_hash").alias("bad_hash"))
    return keyed.join(bad, F.col("row_id").eqNullSafe(F.col("bad_id")) & (F.col("row_hash") == F.col("bad_hash")), "left_anti").select("row.*")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, all other characters unchanged."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def utf8_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
