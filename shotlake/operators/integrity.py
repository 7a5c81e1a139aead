"""Integrity of a corpus: repair in the order of its stages, validations before publishing, stage plans and projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Rows that later jobs read again: a reliable checkpoint where the session names a folder, else cached."""
    sc = df.sparkSession.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        return df.persist()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def global_rank(rows: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """1-based number over all rows in order, without gathering them: range partitions are numbered apart and shifted by the rows before them."""
    sorted_rows = cut(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # one row a partition
    before = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = sorted_rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_first", "_before", "_at")


def broken(videos: DataFrame, shots: DataFrame, keyframes: DataFrame, readable: DataFrame) -> DataFrame:
    """(video_id, reason) of videos whose rows can't be trusted: not done, repeated keyframe ids, rows without a finished video, or a keyframe image that can't be read.

    readable: (image_path) of the images that decode.
    """
    failed = videos.where("status is null or status <> 'done'").select("video_id", F.lit("failed").alias("reason"))
    twice = keyframes.groupBy("keyframe_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("video_id").alias("v")).where("n > 1").select(F.explode("v").alias("video_id"), F.lit("duplicated").alias("reason"))
    done = videos.where("status = 'done'").select("video_id").distinct()
    named = shots.select("video_id").unionByName(keyframes.select("video_id")).distinct()
    partial = named.join(done, "video_id", "left_anti").select("video_id", F.lit("partial").alias("reason"))
    torn = keyframes.join(done, "video_id", "left_semi").join(readable.select("image_path").distinct(), "image_path", "left_anti").select("video_id", F.lit("corrupt").alias("reason"))
    return reduce(DataFrame.unionByName, [failed, twice, partial, torn]).distinct()


def without_orphans(rows: DataFrame, key: str, alive: DataFrame) -> DataFrame:
    """Rows whose key is still alive; a null key is not."""
    return rows.join(alive.select(key).distinct(), key, "left_semi")


def corrupt_shards(embeddings: DataFrame, shards: DataFrame) -> DataFrame:
    """(shard) of embedding rows (shard, row) whose file is missing, unreadable or shorter than a row says; shards (shard, rows), null rows for an unreadable one."""
    needed = embeddings.groupBy("shard").agg(F.max("row").alias("last"))
    return needed.join(shards, "shard", "left").where(F.col("rows").isNull() | (F.col("last") >= F.col("rows"))).select("shard")


def repaired(tables: dict[str, DataFrame], readable: DataFrame, shards: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables videos, shots, keyframes, embeddings, ocr, captions and asr as a clean resume needs them, and (table, dropped) for each.

    Rows of broken videos go first; what stands on them follows: embeddings and
    recognised lines by keyframe, captions by shot, speech by finished video.
    Of the embeddings those of a corrupt shard go too, all rows of it.
    """
    bad = cut(broken(tables["videos"], tables["shots"], tables["keyframes"], readable).select("video_id").distinct())
    out = {n: tables[n].join(bad, "video_id", "left_anti") for n in ("videos", "shots", "keyframes")}
    live = without_orphans(tables["embeddings"], "keyframe_id", out["keyframes"])
    out["embeddings"] = live.join(corrupt_shards(live, shards), "shard", "left_anti")
    out["ocr"] = without_orphans(tables["ocr"], "keyframe_id", out["keyframes"])
    out["captions"] = without_orphans(tables["captions"], "shot_key", out["shots"].select(F.concat_ws(":", "video_id", "shot_id").alias("shot_key")))
    out["asr"] = without_orphans(tables["asr"], "video_id", out["videos"].where("status = 'done'"))
    count = lambda df, n, sign: df.agg((sign * F.count(F.lit(1))).alias("n")).select(F.lit(n).alias("table"), "n")
    both = [count(tables[n], n, 1) for n in out] + [count(df, n, -1) for n, df in out.items()]
    return out, reduce(DataFrame.unionAll, both).groupBy("table").agg(F.sum("n").alias("dropped"))


def summed(stats: DataFrame, by: str = "worker") -> DataFrame:
    """(name, value): the counters (worker, name, value) of all workers added up."""
    return stats.groupBy("name").agg(F.sum("value").alias("value"))


def ingest_violations(videos: DataFrame, shots: DataFrame, keyframes: DataFrame, expected: DataFrame, images: DataFrame) -> DataFrame:
    """(video_id, reason) of what an ingest left undone: expected videos that aren't done, foreign or failed ones, done ones without shots or keyframes, images (image_path, bytes) missing or empty."""
    done = videos.where("status = 'done'").select("video_id").distinct()
    say = lambda df, why: df.select("video_id", F.lit(why).alias("reason"))
    found = [
        say(expected.select("video_id").join(done, "video_id", "left_anti"), "not done"),
        say(done.join(expected, "video_id", "left_anti"), "not expected"),
        say(videos.where("status is null or status <> 'done'"), "failed"),
        say(expected.select("video_id").join(shots, "video_id", "left_anti"), "no shots"),
        say(expected.select("video_id").join(keyframes, "video_id", "left_anti"), "no keyframes"),
        say(keyframes.join(images.where("bytes > 0").select("image_path"), "image_path", "left_anti"), "no image"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def publish_violations(chronicle: DataFrame, indexes: DataFrame) -> DataFrame:
    """(rule) that stands in the way of publishing: repeated shot keys, no text on screen or no speech at all, an index (name, built, loaded) with other counts."""
    has = chronicle.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shot_key").alias("keys"), F.count_if(F.size("ocr") > 0).alias("ocr"), F.count_if(F.coalesce(F.length("asr_text"), F.lit(0)) > 0).alias("asr"))
    rules = F.array(F.when(F.col("n") != F.col("keys"), "repeated shot key"), F.when(F.col("ocr") == 0, "no screen text"), F.when(F.col("asr") == 0, "no speech"))
    own = has.select(F.explode(F.array_compact(rules)).alias("rule"))
    return own.unionByName(indexes.where(~F.col("built").eqNullSafe(F.col("loaded"))).select(F.concat(F.lit("count of "), F.col("name")).alias("rule")))


def assembly_report(chronicle: DataFrame, processed: int) -> DataFrame:
    """One row: shots, those with speech and with screen text; another number of shots than was assembled is an error."""
    n = F.count(F.lit(1))
    checked = F.when(n == processed, n).otherwise(F.raise_error(F.lit(f"the assembly had {processed} rows")).cast("bigint"))
    return chronicle.agg(checked.alias("shots"), F.count_if(F.col("asr_text").isNotNull()).alias("shots_with_asr"), F.count_if(F.size("ocr") > 0).alias("shots_with_ocr"))


def projection(runs: DataFrame, corpus_images: int, per_hour: float) -> DataFrame:
    """runs (label, images, seconds) with images a second, and the hours and cost of the whole corpus at that rate; no images give null."""
    rate = F.when((F.col("images") > 0) & (F.col("seconds") > 0), F.col("images") / F.col("seconds"))
    hours = F.lit(float(corpus_images)) / rate / 3600
    return runs.select("label", F.round(rate, 9).alias("images_per_s"), F.round(hours, 9).alias("hours"), F.round(hours * per_hour, 9).alias("cost"))


def first_samples(members: DataFrame, n: int) -> DataFrame:
    """The first n images over packages in order (package, member, bytes); fewer, or an empty one among them, is an error."""
    rows = members.where(F.lower("member").endswith(".jpg")).orderBy("package", "member").limit(n)
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bytes") == 0).alias("empty")).first()
    if told.n < n or told.empty:
        raise ValueError(f"{told.n} of {n} images, {told.empty} of them empty")
    return rows


def stage_plan(done: DataFrame, shards: list[DataFrame], inputs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What a resumed stage starts from: its rows with those that workers left in shards, a key's first row only, and the inputs without any."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [done.withColumn("_from", F.lit(0)), *[s.withColumn("_from", F.lit(i + 1)) for i, s in enumerate(shards)]])
    names = [c for c in rows.columns if c not in (key, "_from")]
    merged = rows.groupBy(key).agg(F.min_by(F.struct(*names), "_from").alias("r")).select(key, "r.*")
    return merged, inputs.join(merged.select(key), key, "left_anti")


def reset(rows: DataFrame, key: str, keys: list[str] | None) -> DataFrame:
    """Rows without those of some keys, or without any."""
    return rows.where(F.lit(False)) if keys is None else rows.where(F.col(key).isNull() | ~F.col(key).isin(keys)) if keys else rows
