"""Helpers shared by the text operators: document keys, shared tables, Arrow chunks."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one Python step works on at once; bounds a worker's memory whatever the row sizes.
CHUNK_BYTES = 4 << 20
#: Rows that Spark sends to Python at once, if the session says more: texts are long, and both sides hold a batch whole.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="strandlog-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    Results are lazy and may read them at any later time, so what an operator doesn't drop itself goes when the driver ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        atexit.register(self._clear)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put_dealt(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """As `put`, as files of rows by a hash of `key`: grouping by it reads them without a shuffle.

        The buckets are known to the session's catalog only, so `drop` it when it isn't needed.
        """
        self.tables[name] = f"strandlog_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        write = df.write.format("parquet").option("path", f"{self.root}/{name}").option("compression", "zstd")
        write.bucketBy(n, key).saveAsTable(self.tables[name])
        return self.spark.table(self.tables[name])

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            self._delete(f"{self.root}/{name}")

    def _delete(self, where: str) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def _clear(self) -> None:
        try:
            self.drop(*list(self.tables))
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session has ended before; its owner clears the folder
            pass


#: Keys that hold more than one in so many rows are sent to all tasks; there are fewer of them than this.
HOT_SHARE = 1000
#: Rows of a table by key that may be sent to all tasks; beyond it such a table is joined by a shuffle.
SMALL_ROWS = 10_000


def hot_join(rows: DataFrame, by_key: DataFrame, keys: list[str], count: str) -> DataFrame:
    """`rows` joined with `by_key`, which has one row per key and, as `count`, its number of rows.

    A key with more than a thousandth of all rows would make one task late.  Fewer than a thousand keys
    can be like that, so their rows of `by_key` go to all tasks and only the other keys are shuffled.  `rows` is read three times.
    """
    least = max(rows.count() // HOT_SHARE, 1)
    hot, rest = by_key.where(F.col(count) > least), by_key.where(F.col(count) <= least)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def small_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`rows` joined with a table that is sent to all tasks if it was counted and has few rows."""
    few = table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return rows.join(F.broadcast(table) if few else table, keys, how)


def drawn(share: float, *cols: Column) -> Column:
    """True for about this share of rows, by a hash of 63 bits: a share of 1e-12 still draws what it should."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 63) - 1)) <= F.lit(draw_limit(share))


def draw_limit(share: float) -> int:
    """The greatest 63-bit hash that a share of rows reaches; -1 for none."""
    return min((1 << 63) - 1, int(share * (1 << 63)) - (share <= 0))


def held_out(doc_id: Column) -> Column:
    """True for the rows that no classifier may learn from: crc32 of the id's text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_key(*cols: Column) -> list[Column]:
    """128 bits that name a row by its content; equal rows get equal keys, nulls included."""
    return [
        F.xxhash64(F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols]).alias(name)
        for seed, name in ((11, "key_a"), (29, "key_b"))
    ]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most `limit` bytes together, one row at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system: a worker stays for later tasks, beside the JVM in one executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def add_columns(df: DataFrame, column: str, make: Callable[[], Callable], fields: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """Append the columns that `make()(texts, batch)` returns, chunk by chunk of bounded text size.

    `make` runs once in each task, so models are unpacked once and not for each batch.  A column of
    the input that has the name of a new one is replaced.
    """
    new = T._parse_datatype_string(fields)
    kept = [f.name for f in df.schema.fields if f.name not in new.names]
    if column not in kept:  # the text itself is replaced: read it under another name
        df = df.withColumn("_text_in", F.col(column))
    out = T.StructType([f for f in df.schema.fields if f.name in kept] + list(new.fields))
    source = column if column in kept else "_text_in"

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            at = batch.schema.get_field_index(source)
            for a, b in chunks(batch.column(at), limit):
                part = batch.slice(a, b - a)
                made = work(part.column(at), part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(n)) for n in kept] + list(made), names=kept + new.names
                )
        del work
        give_back()

    return df.mapInArrow(run, out)
