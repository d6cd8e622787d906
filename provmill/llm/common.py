"""Shared plumbing: table access, Arrow mapping, shared checkpoints."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables beside each other in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests in local mode) a temporary folder of this machine is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named is None:
        named = sc._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, in one sub-folder for each application, which may go when that has ended."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once and go on from there.

    Later jobs neither repeat the work nor depend on the executor that did it.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """Like cut(), as a columnar table, so that later readers can skip columns."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: tuple = (None, None)


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library does so by itself


def remembered(key, make: Callable[[], object]):
    """What a worker keeps between batches: the one thing made for the key asked for last.

    Workers serve one operator after the other; a new key empties the slot, so
    that tables of operators that are done don't add up in a worker's memory.
    """
    global _kept
    if _kept[0] != key:
        _kept = (None, None)
        give_back()
        _kept = (key, make())
    return _kept[1]


def arrow_map(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: T.StructType) -> DataFrame:
    """mapInArrow where ``make`` turns a batch into a dict of whole columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = make(batch)
                yield pa.RecordBatch.from_arrays([_array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """Texts one at a time; null is empty."""
    for value in batch.column(batch.schema.get_field_index(column)):
        yield value.as_py() or ""


def text_column(df: DataFrame, column: str):
    """A text column with null as empty, valid UTF-8 throughout."""
    return F.coalesce(F.make_valid_utf8(F.col(column)), F.lit(""))


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)).cast("int")


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
