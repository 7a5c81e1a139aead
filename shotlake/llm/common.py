"""Shared helpers: table access, lineage cuts and Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Arrow slice hands to numpy code at once.
SLICE_BYTES = 1 << 21
#: A sieve has 2 ** SIEVE_BITS words of 64 bits (2 MB), in one of which a key sets up to SIEVE_MARKS bits.
SIEVE_BITS, SIEVE_MARKS = 18, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(sc) -> str:
    """The session's checkpoint folder. Only a local session without one may use a folder of its own."""
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder."""
    shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def rows_at_once(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `limit` bytes of `column`, or one row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start, len(sizes) - start)


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Apply `fn` to bounded slices of the Arrow batches of `df`; fn returns record batches of `schema`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_at_once(batch, column, limit):
                yield fn(part)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def unsigned_hex(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the session's shared folder; later reads take only the columns they need."""
    path = f"{shared_folder(df.sparkSession.sparkContext)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate x once for every use in body."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def sieve(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that holds for each of `keys` and for few others (about 1 in 100 at a million keys, more beyond), so most rows need no shuffle before an exact join.

    It takes 2 MB however many keys there are. Null is a key like any other.
    """
    marks = " | ".join(f"shiftleft(1L, cast(shiftright(h, {6 * i}) & 63L as int))" for i in range(SIEVE_MARKS))
    rows = keys.select(F.xxhash64(key).alias("h")).selectExpr(f"shiftrightunsigned(h, {64 - SIEVE_BITS}) as word", f"{marks} as bits")
    found = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << SIEVE_BITS, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    @F.arrow_udf("boolean")
    def held(hashes: pa.Array) -> pa.Array:
        h = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
        mask = np.zeros(len(h), np.uint64)
        for i in range(SIEVE_MARKS):
            mask |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
        return pa.array(words[h >> np.uint64(64 - SIEVE_BITS)] & mask == mask)

    return lambda x: held(F.xxhash64(x))
