"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case ASCII to lower case; every other byte stays.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
CHECKPOINT_DIR = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data set, pruned to the named columns (all if none is named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like that which df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one where none is named and driver and executors are one machine."""
    named = spark.conf.get(CHECKPOINT_DIR, "")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"a cluster needs a shared folder in {CHECKPOINT_DIR}")
        named = tempfile.mkdtemp(prefix="tracksmith-checkpoint-")
    return named


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the session's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the one the session names; only where none is named (tests, a laptop) a temporary one is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(spark))
    return df.checkpoint(eager=True)


def remainder(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def remainder_column(doc_id: Column, modulus: int) -> Column:
    """The same as an expression that stays in the JVM."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() separates at exactly these six characters."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def lower_words(text: str | None) -> list[bytes]:
    """The same after A-Z are lower-cased."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def release() -> None:
    """Give back what Arrow and the allocator hold for later: Python workers live on from task to task beside each other."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def rows(batches: Iterator[pa.RecordBatch], *columns: str, step: int = 256) -> Iterator[list[tuple]]:
    """Rows of Arrow batches as short lists of tuples, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield list(zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True))
    release()


def text_function(returns: str, make: Callable[[], Callable[[list], pa.Array]]) -> Callable[[str], Column]:
    """A column function of texts; make() gives, once a task, what turns a list of texts into an array."""

    @F.arrow_udf(returns)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        function = make()
        for texts in parts:
            yield pa.concat_arrays([function(texts.slice(at, 256).to_pylist()) for at in range(0, max(1, len(texts)), 256)])
        release()

    return run


def record_batch(schema: pa.Schema, rows_out: list[tuple]) -> pa.RecordBatch:
    """A batch from row tuples."""
    columns = list(zip(*rows_out, strict=True)) if rows_out else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


ASCII_SPACE = re.compile(r"[\x20\x09-\x0D]+")
