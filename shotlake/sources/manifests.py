"""Manifests, vector tables, archives and small reports: readers, writers and the checks on them."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.evidence import last_wins
from ..operators.integrity import global_rank


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under an explicit schema: blank and unparseable lines are left out, a line that is no object is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kind = F.substring(F.ltrim("value"), 1, 1)
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select(F.when(kind.isin("[", '"') | F.col("value").rlike(r"^\s*-?[0-9.]+\s*$"), F.raise_error(F.lit("manifest line is no object")).cast(parsed_type(schema))).otherwise(parsed).alias("r"))
    return rows.where("r._bad is null").select("r.*").drop("_bad")


def parsed_type(schema: str) -> str:
    return "struct<" + ",".join(f"{x.strip().split(' ', 1)[0]}:{x.strip().split(' ', 1)[1]}" for x in re.split(r",(?![^<]*>)", schema)) + ",_bad:string>"


def append(df: DataFrame, path: str, key: str) -> None:
    """Add rows to a Parquet manifest; a null key is an error."""
    checked = df.withColumn(key, F.coalesce(F.col(key), F.raise_error(F.lit(f"{key} is null")).cast(df.schema[key].dataType)))
    checked.write.mode("append").parquet(path)


def rewrite(spark: SparkSession, source: str, target: str, keep: Column) -> int:
    """Write the rows to keep to another path; the number of rows that went."""
    rows = spark.read.parquet(source)
    rows.where(F.coalesce(keep, F.lit(False))).write.parquet(target)
    return rows.count() - spark.read.parquet(target).count()


def completed_keys(manifest: DataFrame, key: str) -> DataFrame:
    return manifest.select(key).where(F.col(key).isNotNull()).distinct()


def pending(wanted: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Inputs that no manifest row has: what a resumed stage has to do."""
    return wanted.join(completed_keys(manifest, key), key, "left_anti")


def shard_path(path: str, tag: str) -> str:
    """`name.tag.ext`; an empty tag changes nothing."""
    stem, dot, ext = path.rpartition(".")
    return f"{stem}.{tag}{dot}{ext}" if tag else path


def merged_shards(spark: SparkSession, canonical: str, schema: str) -> DataFrame:
    """The canonical manifest with the rows of its shards."""
    stem, _, ext = canonical.rpartition(".")
    return read_manifest(spark, f"{stem}*.{ext}", schema)


def write_json(path: str, payload: object) -> None:
    """A small report on the driver, whole or not at all."""
    part = Path(f"{path}.part")
    part.write_text(json.dumps(payload, ensure_ascii=False, indent=2))
    os.replace(part, path)


def discover(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """(path, length) of files with one of the extensions, in order of path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([e.lower() for e in extensions])).orderBy("path")


def substituted(text: str, env: dict[str, str]) -> str:
    """`${NAME}` replaced; a name without a value is an error."""

    def value(m: re.Match) -> str:
        if m[1] not in env:
            raise KeyError(f"{m[1]} is not set")
        return env[m[1]]

    return re.sub(r"\$\{(\w+)\}", value, text)


@dataclass(frozen=True)
class Profile:
    """Settings with their ranges checked; unknown names are an error."""

    rrf_k: int = 60
    top_k: int = 200
    window_ms: int = 10_000
    agreement: float = 0.25
    tolerance_ms: int = 2000

    @classmethod
    def of(cls, values: dict) -> Profile:
        if extra := set(values) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown settings {sorted(extra)}")
        made = cls(**values)
        if made.rrf_k < 1 or made.top_k < 1 or made.window_ms < 0 or made.tolerance_ms < 0:
            raise ValueError("a setting is out of range")
        return made


def vector_table(manifest: DataFrame, shards: DataFrame, model_id: str, dim: int) -> DataFrame:
    """manifest (keyframe_id, shard, row, model_id, dim) with its vectors (shard, row, vec); another model or dimension is an error."""
    wrong = (F.col("model_id") != model_id) | (F.col("dim") != dim) | (F.size("vec") != dim)
    joined = manifest.join(shards, ["shard", "row"])
    return joined.withColumn("vec", F.when(wrong, F.raise_error(F.lit("model or dimension differs")).cast("array<float>")).otherwise(F.col("vec").cast("array<float>")))


def violations(manifest: DataFrame, key: str, model_id: str | None = None) -> DataFrame:
    """(key, reason) of keys that repeat or carry another model."""
    twice = manifest.groupBy(key).count().where("count > 1").select(F.col(key).cast("string").alias("key"), F.lit("repeated").alias("reason"))
    if model_id is None:
        return twice
    return twice.unionByName(manifest.where(F.col("model_id") != model_id).select(F.col(key).cast("string").alias("key"), F.lit("model").alias("reason")))


def shot_meta(shots: DataFrame) -> DataFrame:
    """(shot_key, video_id, start_ms, end_ms, mid_ms), the later of rows with one key."""
    return last_wins(shots.select("shot_key", "video_id", "start_ms", "end_ms", "ord"), "shot_key").withColumn("mid_ms", F.expr("(start_ms + end_ms) div 2"))


def loaded(rows: DataFrame, key: str, *required: str) -> DataFrame:
    """The rows of a table that must be whole: a repeated key, or a null in it or in a required column, is an error."""
    absent = [F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in (key, *required)]
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys"), *absent).first().asDict()
    if any(told[f"no_{c}"] for c in (key, *required)) or told["n"] != told["keys"]:
        raise ValueError(f"{key} repeats or values are missing: {told}")
    return rows


def load_chronicle(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The evidence table of all shots, one row each."""
    return loaded(read_manifest(spark, path, schema).withColumn("shot_key", F.concat_ws(":", "video_id", "shot_id")), "shot_key", "video_id", "shot_id")


def load_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The answer ledger by shot; of rows with one key the last of the file."""
    rows = read_manifest(spark, path, schema).withColumn("ord", F.monotonically_increasing_id())
    return last_wins(rows, "shot_key").drop("ord")


def ok_rows(rows: DataFrame, key: str) -> DataFrame:
    """Rows of status ok, the last of each key."""
    return last_wins(rows.where("status = 'ok'"), key)


def zip_selection(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """(member, reason) against a safe and complete selection: unsafe paths, members named twice, wanted ones missing."""
    unsafe = members.where(F.col("member").rlike(r"(^/|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$))")).select("member", F.lit("unsafe").alias("reason"))
    twice = members.groupBy("member").count().where("count > 1").select("member", F.lit("repeated").alias("reason"))
    missing = wanted.select("member").join(members, "member", "left_anti").select("member", F.lit("missing").alias("reason"))
    return unsafe.unionByName(twice).unionByName(missing)


def parse_ids(raw: str, catalogue: list[str]) -> list[str]:
    """Comma-separated ids, each once, in the catalogue's order; unknown ids are an error."""
    asked = {x.strip() for x in raw.split(",") if x.strip()}
    if extra := asked - set(catalogue):
        raise ValueError(f"unknown ids {sorted(extra)}")
    return [x for x in catalogue if x in asked]


def id_range(spark: SparkSession, archive: str, first: int, last: int, missing: list[int]) -> DataFrame:
    """Ids of an archive: a range less its gaps."""
    numbers = spark.range(first, last + 1).where(~F.col("id").isin(missing or [-1]))
    return numbers.select(F.lit(archive).alias("archive"), F.format_string(f"{archive}_V%03d", "id").alias("video_id"))


def mismatches(expected: DataFrame, actual: DataFrame, *columns: str) -> DataFrame:
    """(path, reason): files missing, foreign, or of other size or digest."""
    a = actual.select("path", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    both = expected.withColumn("_wanted", F.lit(True)).join(a, "path", "full_outer")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    reason = F.when(F.col("_there").isNull(), "missing").when(F.col("_wanted").isNull(), "foreign").when(differs, "differs")
    return both.select("path", reason.alias("reason")).where("reason is not null")


def dataset_index(entries: DataFrame, reports: DataFrame) -> DataFrame:
    """One catalogue row a video: (archive, video_id, kind in tar/report, path, bytes, sha256) with its report's counts."""
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = entries.groupBy("archive", "video_id").agg(pick("tar", "path").alias("tar_path"), pick("report", "path").alias("report_path"), pick("tar", "bytes").alias("artifact_bytes"), pick("tar", "sha256").alias("artifact_sha256"))
    return wide.join(reports.select("archive", "video_id", "shots", "keyframes"), ["archive", "video_id"])


def batched(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """Batch numbers of fixed size over an order."""
    return global_rank(rows, *order, name="batch").withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("int"))


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "length", F.sha2("content", 256).alias("sha256"))


def completed(reports: DataFrame, facts: DataFrame) -> DataFrame:
    """Reports whose size and digest are those of the file; a missing status counts as done."""
    joined = reports.join(facts.select("artifact", F.col("bytes").alias("_b"), F.col("sha256").alias("_s")), "artifact")
    return joined.where((F.coalesce("status", F.lit("done")) == "done") & (F.col("artifact_bytes") == F.col("_b")) & (F.col("artifact_sha256") == F.col("_s"))).drop("_b", "_s")


SCHEMAS = {
    "videos": "video_id string, status string, reason string, path string, duration_ms bigint, fps_average double, has_audio boolean, is_vfr boolean, n_shots int, n_keyframes int, n_dropped_blank int, n_dropped_duplicate int",
    "shots": "video_id string, shot_id int, start_ms bigint, end_ms bigint, boundary_confidence double",
    "keyframes": "keyframe_id string, video_id string, shot_id int, frame_idx int, timestamp_ms bigint, image_path string",
    "asr": "video_id string, segments array<struct<start_ms:bigint,end_ms:bigint,text:string,confidence:double>>, reason string",
    "ocr": "keyframe_id string, video_id string, shot_id int, lines array<struct<text:string,confidence:double,bbox:array<double>>>",
    "captions": "shot_key string, status string, reason string, caption_en string, caption_vi string, actions array<string>, scene string, confidence double",
    "entities": "shot_key string, status string, persons array<string>, orgs array<string>, places array<string>",
    "counts": "shot_key string, status string, people_count int, salient_objects array<string>, counts map<string,int>",
}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])
