"""Domain views over the raw tables: keyframes, shots, speech segments, on-screen lines, rankings and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def video(number: Column) -> Column:
    return F.concat(F.lit("V"), F.lpad(number.cast("string"), 3, "0"))


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label is a video; three keyframes a shot, two seconds apart."""
    ord_ = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    base = table(spark, sf_dir, "embeddings").withColumn("ord", ord_.cast("bigint"))
    named = base.select(video(F.col("label")).alias("video_id"), F.floor(F.col("ord") / 3).cast("int").alias("shot_id"), "ord", "vec_id", "embedding")
    return named.select(
        F.format_string("%s_s%d_f%d", "video_id", "shot_id", "ord").alias("keyframe_id"),
        "video_id", "shot_id", F.concat_ws(":", "video_id", "shot_id").alias("shot_key"),
        F.col("ord").alias("frame_idx"), (F.col("ord") * 2000).alias("timestamp_ms"), "vec_id", "embedding",
    )


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        keyframes(spark, sf_dir)
        .groupBy("video_id", "shot_id", "shot_key")
        .agg(F.min("timestamp_ms").alias("start_ms"), (F.max("timestamp_ms") + 2000).alias("end_ms"))
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("conv_id") % 20) * 5000 + F.col("turn") * 700
    return table(spark, sf_dir, "conversations").select(
        video(F.col("conv_id") % 10).alias("video_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("seg_ord"),
        start.alias("start_ms"), (start + 500 + 300 * (F.length("text") % 20)).alias("end_ms"), "text", "role",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-screen text: a source is a video, a document a shot."""
    split = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("line_ord", "line"))
    confidence = ((F.col("doc_id") * 37 + F.col("line_ord") * 11) % 100).cast("double") / 100.0
    return split.where(F.trim("line") != "").select("doc_id", "video_id", "line_ord", F.trim("line").alias("text"), confidence.alias("confidence"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings: an event type is a label, a user a video, an event a shot."""
    events = table(spark, sf_dir, "events")
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return events.select(
        F.col("event_type").alias("label"), F.concat_ws(":", "user_id", "event_id").alias("shot_key"), F.col("user_id").cast("string").alias("video_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("mid_ms"), rank.alias("rank"), F.col("value").alias("score"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("A"), (F.col("doc_id") % 5).cast("string")).alias("archetype"), (F.col("quality") == 1).alias("answer_ok"), (F.col("toxic") == 0).alias("moment_ok"))


#: The same views for the oracle, as common table expressions.
SQL = {
    "kf": """kf as (select concat(video_id,'_s',shot_id,'_f',ord) keyframe_id, video_id, shot_id, concat(video_id,':',shot_id) shot_key, ord frame_idx, ord*2000 timestamp_ms, vec_id, embedding
      from (select concat('V', lpad(cast(label as varchar),3,'0')) video_id, cast(floor(ord/3) as int) shot_id, ord, vec_id, embedding
      from (select *, row_number() over (partition by label order by vec_id)-1 ord from embeddings)))""",
    "shot": "shot as (select video_id, shot_id, shot_key, min(timestamp_ms) start_ms, max(timestamp_ms)+2000 end_ms from kf group by all)",
    "seg": """seg as (select concat('V', lpad(cast(conv_id % 10 as varchar),3,'0')) video_id, conv_id*100+turn seg_ord, (conv_id % 20)*5000+turn*700 start_ms,
      (conv_id % 20)*5000+turn*700+500+300*(length(text) % 20) end_ms, text, role from conversations)""",
    "line": """line as (select doc_id, source video_id, pos line_ord, trim(l) as text, cast((doc_id*37+pos*11) % 100 as double)/100.0 confidence
      from (select doc_id, source, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)),1)-1 pos from documents) where trim(l)<>'')""",
    "hit": """hit as (select event_type label, concat(cast(user_id as varchar),':',cast(event_id as varchar)) shot_key, cast(user_id as varchar) video_id,
      epoch_us(ts)//1000 mid_ms, row_number() over (partition by event_type order by value desc, event_id) as rank, value score from events)""",
    "qa": "qa as (select doc_id, concat('A', cast(doc_id % 5 as varchar)) archetype, quality=1 answer_ok, toxic=0 moment_ok from labels)",
}
NEEDS = {"shot": ["kf"]}


def with_views(*names: str) -> str:
    """`with ...` for the named views and those that they read."""
    order = list(dict.fromkeys(x for n in names for x in [*NEEDS.get(n, []), n]))
    return "with " + ", ".join(SQL[n] for n in order)
