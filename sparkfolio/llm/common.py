"""What the training-data operators share: row keys, sizes, and files in the shared folder."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of text that one Python step looks at together; a longer text is a step of its own.
STEP_BYTES = 8 << 20
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; unset, a folder of its own on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="shared-"))
        found = _OWN[0]
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * STEP_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def trimmed() -> None:
    """Give freed memory back: a Python worker serves one operator after the other."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow``, with memory given back at the end of each task; names of columns may hold dots."""
    names = df.columns
    if any("." in c for c in names):  # which mapInArrow itself would take for fields
        df = df.toDF(*[f"_c{i}" for i in range(len(names))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b.rename_columns(names) for b in batches)
        finally:
            trimmed()

    return df.mapInArrow(whole, schema)


def grouped(df: DataFrame, by: str, run: Callable, schema) -> DataFrame:
    """``df.groupBy(by).applyInArrow``, with memory given back after each group of some size."""

    def whole(table: pa.Table) -> pa.Table:
        large = table.nbytes > STEP_BYTES
        out = run(table)
        if large:
            del table
            trimmed()
        return out

    return df.groupBy(by).applyInArrow(whole, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage.

    Any executor can read it again, and shuffle files behind it are no longer needed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path  # for dropped()
    return back


def again(df: DataFrame) -> DataFrame:
    """A second frame over the files of a ``written`` one, for a join of it with itself."""
    return df.sparkSession.read.schema(df.schema).parquet(df._written_at)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of intermediate ``written`` frames and let Spark clean finished shuffles."""
    jvm = spark._jvm
    for df in frames:
        if path := getattr(df, "_written_at", None):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def swept(spark: SparkSession) -> None:
    """Ask for a collection on the driver: Spark removes the shuffle files of frames that are gone."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def parts(spark: SparkSession, units: float, each: float, least: int = 1) -> int:
    """How many groups hold ``units`` at ``each`` apiece; follows the data, no upper limit."""
    return max(least, int(-(-units // each)))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``key`` (long, unique, in the order of ids), ``id`` and ``text``; with ``whole`` also ``row``, all columns as a struct.

    Where ids are unique and never null, the id is the key.  Otherwise rows are
    sorted by id (null last) and text and numbered, and that copy is written, since
    numbers must not change between passes; repeated rows then stay separate rows.
    """
    own = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    if whole:
        own.append(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    rows = df.select(*own)
    clash = rows.select("id").groupBy("id").count().where("count > 1 OR id IS NULL").limit(1).count()
    if not clash:
        return rows.withColumn("key", F.col("id"))
    ordered = rows.sort(F.col("id").asc_nulls_last(), F.col("text").asc_nulls_last())
    return written(ordered.withColumn("key", F.monotonically_increasing_id()), "keyed")


def placed(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their place (``_place``, from 0) in an order, written.

    The sort is in ranges; a window sees one row a range, never all rows.
    """
    # the high bits of the number are the range, the low ones the place in it
    made = written(rows.sort(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    own = F.shiftright("_at", 33)
    counts = made.groupBy(own.alias("_range")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_range", before.alias("_before"))
    joined = again(made).join(F.broadcast(counts), own == F.col("_range"))
    return joined.withColumn("_place", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_range", "_before")


def free(name: str, columns: list[str]) -> str:
    """``name``, with underscores in front while a column is called so: columns that exist keep their names."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    """Where a public tokenizer's vocabulary lies: ``TOKENIZER_DIR`` or the installed package."""
    at = os.environ.get("TOKENIZER_DIR")
    if at:
        return os.path.join(at, name)
    import public_tokenizers

    return public_tokenizers.path(name)
