"""Tables, shared folders and text columns that all operators of this subpackage use.

Intermediate results that cut lineage are Parquet tables under the folder named by
``spark.checkpoint.dir`` (shared by the driver and all executors), so a lost executor
costs a re-read and never a lost block.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII letters lowered by the contracts, and the class of a word's characters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
ROWS_PER_FILE = 250_000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one is set only in local mode where none is configured (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            root = "file://" + tempfile.mkdtemp(prefix="photonspark-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes that go to a Python worker at once; a batch lies in both processes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Workspace:
    """A folder of one run for tables that cut lineage.

    ``drop`` removes those no longer needed; what the returned frame still reads goes when
    the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/photonspark/{label}-{uuid.uuid4().hex}"
        small_batches(spark)
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write and read back. A table known to have at most ``rows`` rows gets no more tasks and files than
        it can fill (and at least the cluster's parallelism), however many shuffle partitions there are."""
        if rows is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE)))
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))

    def close(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


class Recent(dict):
    """Key -> value for the keys met lately: at most two generations of about ``bound`` keys each.

    A full generation becomes the old one, and what is asked for again moves to the new one, so
    frequent keys stay and the memory is bounded.
    """

    def __init__(self, bound: int):
        super().__init__()
        self.bound, self.old = bound, {}

    def missing(self, keys: Iterable) -> list:
        """The keys without a value; all others are in the new generation."""
        if len(self) > self.bound:
            self.old = dict(self)
            self.clear()
        out = []
        for key in keys:
            if key not in self:
                if (found := self.old.get(key)) is None:
                    out.append(key)
                else:
                    self[key] = found
        return out


def words_of(words: pa.Array) -> list[str]:
    """Strings without a space, as Python's: joined and parted again, which takes a tenth of the time of ``to_pylist``."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ")


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel whose worker gives freed memory back to the system at the end of a task; workers live on between stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def per_row(df: DataFrame, columns: list[str], schema: str, kernel: Callable[[dict[str, list]], dict[str, list]], rows: int = 1024) -> DataFrame:
    """Apply ``kernel`` to lists of the named columns, a bounded block of rows at a time."""
    small_batches(df.sparkSession)
    names = [part.split()[0] for part in schema.split(",")]
    out = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(out)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = kernel({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[n], type=shape.field(n).type) for n in names], schema=shape)

    return df.select(*columns).mapInArrow(released(run), out)


def ascii_lower(text: str):
    """Lower-case A-Z only, as the contracts ask."""
    return F.translate(F.col(text), UPPER, LOWER)


def crc32_of_id(column: str = "doc_id"):
    """Unsigned CRC-32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
