"""Saved indexes: vector shards in binary formats, dense indexes and sparse postings as Parquet tables with their metadata."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of shard files and the name of the tensor in one.
ENDINGS = (".safetensors", ".npy")
TENSOR = "embeddings"
#: Names of stored number types in tensor headers.
NUMBERS = {"F64": "<f8", "F32": "<f4", "F16": "<f2"}


def encode_shard(array: np.ndarray, kind: str, store: str | None = None) -> bytes:
    """A matrix in one of two file formats, as `store` numbers if given (e.g. float16)."""
    array = np.ascontiguousarray(array if store is None else array.astype(store))
    if kind == "npy":
        out = io.BytesIO()
        np.save(out, array)
        return out.getvalue()
    if kind != "safetensors":
        raise ValueError(f"unknown shard format {kind!r}")
    name = next(n for n, d in NUMBERS.items() if np.dtype(d) == array.dtype)
    head = json.dumps({TENSOR: {"dtype": name, "shape": list(array.shape), "data_offsets": [0, array.nbytes]}}).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + array.tobytes()


def decode_shard(name: str, data: bytes) -> np.ndarray:
    """The matrix in a shard file, by its ending; a damaged file is an error."""
    if name.endswith(".npy"):
        return np.load(io.BytesIO(data))
    if not name.endswith(".safetensors"):
        raise ValueError(f"unknown shard ending of {name!r}")
    size = int.from_bytes(data[:8], "little")
    told = json.loads(data[8 : 8 + size])[TENSOR]
    start, end = told["data_offsets"]
    body = data[8 + size + start : 8 + size + end]
    if len(body) != end - start:
        raise ValueError(f"{name} is cut off")
    return np.frombuffer(body, NUMBERS[told["dtype"]]).reshape(told["shape"])


def next_shard(names: Iterable[str], prefix: str = "shard-") -> int:
    """One more than the greatest number of a shard of either format, 0 without any."""
    numbers = [int(m[1]) for n in names if (m := re.fullmatch(rf"{re.escape(prefix)}(\d+)({'|'.join(map(re.escape, ENDINGS))})", n))]
    return max(numbers, default=-1) + 1


def shard_files(names: Iterable[str], prefix: str = "shard-") -> list[str]:
    return sorted(n for n in names if n.startswith(prefix) and n.endswith(ENDINGS))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, row, vec) of all shard files of a folder, in double precision; a damaged file gives a row with a null vector."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                name = path.rpartition("/")[2]
                try:
                    array = decode_shard(name, data).astype(np.float64)
                except (ValueError, KeyError, EOFError, StopIteration):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([0], pa.int64()), pa.array([None], pa.list_(pa.float64()))], ["shard", "row", "vec"])
                    continue
                n, dim = array.shape
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(array.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n)), lists], ["shard", "row", "vec"])

    files = spark.read.format("binaryFile").load(folder).select("path", "content").where(F.col("path").rlike(r"shard-\d+\.(safetensors|npy)$"))
    return files.mapInArrow(rows, "shard string, row bigint, vec array<double>")


class Dense(NamedTuple):
    """A dense index: rows (id, vec) and what they are."""

    rows: DataFrame
    model_id: str
    dim: int
    count: int


def dense(rows: DataFrame, model_id: str) -> Dense:
    """An index over (id, vec); repeated ids, unequal lengths and values that aren't finite are errors."""
    odd = F.exists("vec", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"), F.count_if(odd).alias("odd"), F.count_if(F.col("vec").isNull()).alias("absent")).first()
    if told.n != told.ids:
        raise ValueError(f"{told.n} vectors for {told.ids} ids")
    if told.absent or told.low != told.high:
        raise ValueError("vectors differ in length")
    if told.odd:
        raise ValueError(f"{told.odd} vectors hold NaN or infinity")
    return Dense(rows.select("id", "vec"), model_id, told.low or 0, told.n)


def save_dense(index: Dense, folder: str) -> None:
    index.rows.write.mode("overwrite").parquet(f"{folder}/rows")
    spark = index.rows.sparkSession
    spark.createDataFrame([(index.model_id, index.dim, index.count)], "model_id string, dim int, count bigint").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")


def load_dense(spark: SparkSession, folder: str) -> Dense:
    """A saved index; a count or length other than it says is an error."""
    meta = spark.read.parquet(f"{folder}/meta").first()
    rows = spark.read.parquet(f"{folder}/rows")
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("vec") != meta.dim).alias("odd")).first()
    if told.n != meta["count"] or told.odd:
        raise ValueError(f"index at {folder} has {told.n} rows of {meta['count']}, {told.odd} of a wrong length")
    return Dense(rows, meta.model_id, meta.dim, meta["count"])


def search(index: Dense, queries: DataFrame, k: int, model_id: str) -> DataFrame:
    """The k best rows for queries (query_id, qvec) of the same model and length."""
    from ..operators.ranking import dense_top_k

    if model_id != index.model_id:
        raise ValueError(f"queries come from {model_id!r}, the index from {index.model_id!r}")
    checked = F.when(F.size("qvec") == index.dim, F.col("qvec")).otherwise(F.raise_error(F.lit(f"a query's length isn't {index.dim}")).cast(queries.schema["qvec"].dataType))
    return dense_top_k(queries.select("query_id", checked.alias("qvec")), index.rows, k)


def vectors_for(index: Dense, ids: DataFrame) -> DataFrame:
    """(id, vec) of the ids asked for; an unknown one is an error, not a gap."""
    unknown = F.raise_error(F.concat(F.lit("unknown vector id: "), F.col("id").cast("string"))).cast(index.rows.schema["vec"].dataType)
    found = ids.select("id").join(index.rows.withColumn("known", F.lit(True)), "id", "left")
    return found.select("id", F.when(F.col("known"), F.col("vec")).otherwise(unknown).alias("vec"))


def save_sparse(weights: DataFrame, folder: str) -> None:
    """Postings (term, id, ord, dw) with positive weights, sorted by term so that a query's terms prune the files' row groups."""
    weights.where("dw > 0").select("term", "id", "ord", "dw").repartitionByRange("term").sortWithinPartitions("term", "ord").write.mode("overwrite").parquet(folder)


def load_sparse(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)
