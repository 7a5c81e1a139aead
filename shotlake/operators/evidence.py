"""Evidence per shot: speech, on-screen text, captions and entities joined; documents for the indexes; answer ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Time bucket of interval joins, in milliseconds.
BUCKET_MS = 10_000


def last_wins(rows: DataFrame, key: str, ord_col: str = "ord") -> DataFrame:
    """One row a key, the one of greatest ord; minima and maxima are taken before rows move."""
    others = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(ord_col)).alias("r"))
    return picked.select(key, "r.*")


def align_segments(segments: DataFrame, shots: DataFrame) -> DataFrame:
    """(video_id, shot_id, asr_text): segments that overlap a shot strictly, joined by a space in segment order.

    Both sides are dealt by (video, time bucket); a pair is taken in the bucket
    where the later of the two starts, so once.
    """
    spread = lambda d, a, b: d.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / BUCKET_MS), F.floor(F.greatest(F.col(a), F.col(b) - 1) / BUCKET_MS))))
    s = spread(segments.select("video_id", F.col("seg_ord"), F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"), "text"), "s0", "s1")
    h = spread(shots.select("video_id", "shot_id", F.col("start_ms").alias("h0"), F.col("end_ms").alias("h1")), "h0", "h1")
    once = F.col("bucket") == F.floor(F.greatest("s0", "h0") / BUCKET_MS)
    met = s.join(h, ["video_id", "bucket"]).where((F.col("s1") > F.col("h0")) & (F.col("s0") < F.col("h1")) & once)
    ordered = F.array_sort(F.collect_list(F.struct("seg_ord", "text")))
    return met.groupBy("video_id", "shot_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("asr_text"))


def merge_lines(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines that are equal after NFC and case folding are one: the most confident, the first of equals, at the first one's place."""
    keyed = lines.withColumn("key", T.nfc_casefold("text"))
    picked = keyed.groupBy(*by, "key").agg(F.max_by("text", F.struct("confidence", -F.col("line_ord"))).alias("text"), F.max("confidence").alias("confidence"), F.min("line_ord").alias("line_ord"))
    return picked.drop("key")


def split_overlay(lines: DataFrame, shots_of_video: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(scene lines, overlay lines): a text, stripped and in NFC, in at least `share` of its video's shots is overlay, once a video, by its most confident line.

    Of equally confident lines the first by (shot_id, line_ord) stands for the
    text. Overlay lines are (video_id, key, text, confidence).
    """
    keyed = lines.withColumn("key", T.nfc_strip("text"))
    order = F.struct(-F.col("confidence"), F.col("shot_id"), F.col("line_ord"))
    shares = keyed.groupBy("video_id", "key").agg(F.count_distinct("shot_id").alias("n"), F.min_by(F.struct("text", "confidence"), order).alias("best"))
    over = shares.join(shots_of_video, "video_id").where((F.col("n_shots") > 0) & (F.col("n") / F.col("n_shots") >= share))
    scene = keyed.join(over.select("video_id", "key"), ["video_id", "key"], "left_anti").select(*lines.columns)
    return scene, over.select("video_id", "key", "best.text", "best.confidence")


def assemble(shots: DataFrame, speech: DataFrame, lines: DataFrame, captions: DataFrame, entities: DataFrame) -> DataFrame:
    """One row a shot, whatever evidence is missing: speech and lines by (video, shot), captions and entities of status ok by shot_key."""
    item = F.struct("line_ord", "text", "confidence")
    ocr = lines.groupBy("video_id", "shot_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"))).alias("ocr"))
    ok = captions.where("status = 'ok'").drop("status")
    named = entities.where("status = 'ok'").drop("status")
    joined = shots.join(speech, ["video_id", "shot_id"], "left").join(ocr, ["video_id", "shot_id"], "left").join(ok, "shot_key", "left").join(named, "shot_key", "left")
    return joined.withColumn("ocr", F.coalesce("ocr", F.array().cast("array<struct<text:string,confidence:double>>")))


def _texts(ocr: Column) -> Column:
    return F.transform(ocr, lambda x: x["text"])


def semantic_text(r: str = "") -> Column:
    c = lambda n: F.col(r + n)
    return T.joined("\n", F.array(c("caption_vi")), F.array(c("caption_en")), F.array(c("asr_text")), c("actions"), F.array(c("scene")))


def literal_text(r: str = "") -> Column:
    return T.joined("\n", _texts(F.col(r + "ocr")), F.array(F.col(r + "asr_text")))


def overlay_text(r: str = "") -> Column:
    return T.joined("\n", _texts(F.col(r + "overlay_ocr")))


def factoid_text(r: str = "") -> Column:
    c = lambda n: F.col(r + n)
    people = F.when(c("people_count").isNotNull(), F.concat(c("people_count").cast("string"), F.lit(" people")))
    return T.joined(". ", c("screen_text"), c("spoken_entities"), F.array(people), c("salient_objects"))


def entity_input(r: str = "") -> Column:
    c = lambda n: F.col(r + n)
    return T.joined("\n", F.array(c("asr_text")), F.array(c("caption_vi")), F.array(c("caption_en")))


def evidence_text(r: str = "") -> Column:
    c = lambda n: F.col(r + n)
    return T.joined("\n", F.array(F.coalesce(c("caption_vi"), c("caption_en"))), F.array(c("asr_text")), _texts(c("ocr")), c("actions"))


def bundles(chronicle: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Each shot's evidence with its keyframes in order of time; shots without one have an empty list."""
    frames = keyframes.groupBy("shot_key").agg(F.array_sort(F.collect_list(F.struct("timestamp_ms", "keyframe_id"))).alias("frames"))
    return chronicle.join(frames, "shot_key", "left").withColumn("frames", F.coalesce("frames", F.array().cast("array<struct<timestamp_ms:bigint,keyframe_id:string>>")))


def ledger(chronicle: DataFrame, counts: DataFrame, floor: float) -> DataFrame:
    """Answer fields of each shot: confident screen text, names once each in order, people and objects where counted."""
    screen = F.transform(F.filter("ocr", lambda x: x["confidence"] >= floor), lambda x: x["text"])
    names = F.array_distinct(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("persons", "orgs", "places")]))
    rows = chronicle.select("shot_key", screen.alias("screen_text"), names.alias("spoken_entities"))
    joined = rows.join(counts, "shot_key", "left")
    return joined.withColumn("salient_objects", F.coalesce("salient_objects", F.array().cast("array<string>")))


def ledger_answer(archetype: Column) -> Column:
    """struct(answer, field, value): the first value of the archetype's own field is the answer; else the first field with a value only shows where one may be. Null without any."""
    first = {n: F.get(F.col(n), F.lit(0)) for n in ("screen_text", "spoken_entities")}
    own = {"read_text": "screen_text", "entity": "spoken_entities"}
    told = lambda n, is_answer: F.when(first[n].isNotNull(), F.struct((first[n] if is_answer else F.lit(None).cast("string")).alias("answer"), F.lit(n).alias("field"), first[n].alias("value")))
    return F.coalesce(*[F.when(archetype == a, told(n, True)) for a, n in own.items()], *[told(n, False) for n in first])


def phrase_documents(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, id) of the documents (id, text) that hold a phrase (query_id, phrase) as it stands.

    A phrase is looked up by the rarest of its inner words, which must be whole
    words of any text that holds it; what is found is verified. Phrases without
    an inner word meet all texts.
    """
    words = lambda x: F.split(F.lower(x), r"[^\p{L}]+")
    inner = F.filter(words(F.col("phrase")), lambda w, i: (i > 0) & (i < F.size(words(F.col("phrase"))) - 1) & (w != ""))
    asked = phrases.select("query_id", "phrase", F.array_distinct(inner).alias("inner"))
    named = asked.select("query_id", "phrase", F.explode("inner").alias("term"))
    terms = docs.select("id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).join(named.select("term").distinct(), "term", "left_semi")
    held = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = named.join(held, "term", "left").groupBy("query_id", "phrase").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("term"))
    found = rarest.join(terms, "term").join(docs, "id").where(F.contains("text", "phrase")).select("query_id", "id")
    short = asked.where(F.size("inner") == 0).select("query_id", "phrase")
    return found.unionByName(docs.join(short, F.contains("text", "phrase")).select("query_id", "id"))


def evidence_window(anchors: DataFrame, meta: DataFrame, zoom_ms: int, most: int) -> DataFrame:
    """Shots of the anchor's video whose middle lies within zoom_ms of the anchor, nearest first, ties by key."""
    bucket = F.floor(F.col("mid_ms") / zoom_ms)
    a = anchors.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("anchor_ms") / zoom_ms) + i for i in (-1, 0, 1)])))
    met = a.join(meta.withColumn("bucket", bucket), ["video_id", "bucket"]).withColumn("off", F.abs(F.col("mid_ms") - F.col("anchor_ms"))).where(F.col("off") <= zoom_ms)
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("off", "shot_key")))
    return ranked.where(F.col("rank") <= most).select("query_id", "shot_key", "off", "rank")


def fast_talk(segments: Column, least: float | None) -> Column:
    """Segments of at least `least` characters a second; without a limit, or without a span, they stay."""
    if least is None:
        return segments
    return F.filter(segments, lambda s: (s["end_ms"] - s["start_ms"] <= 0) | (F.length(T.strip(s["text"])) / ((s["end_ms"] - s["start_ms"]) / 1000) >= least))


def confident_speech(rows: DataFrame, no_speech: float, log_prob: float) -> DataFrame:
    """Speech with text that both probabilities allow, with its confidence."""
    ok = (F.col("no_speech_prob") <= no_speech) & (F.col("avg_logprob") >= log_prob) & (T.strip(F.col("text")) != "")
    return rows.where(ok).withColumn("confidence", F.exp("avg_logprob"))


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text", ord_col: str = "ord") -> DataFrame:
    """(term, id, ord, dw): letter runs of the lower-cased text, weighed 1 + ln(frequency); empty documents are absent.

    Texts are dealt by id before they are taken apart, so that terms are counted,
    and can be scored by document, where they are. The session's number of
    shuffle partitions holds, since terms take several times their text.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(id_col).alias("id"), F.col(ord_col).alias("ord"), F.col(text_col).alias("text")).repartition(parts, "id")
    terms = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda t: t != "")
    counted = dealt.select("id", "ord", F.explode(terms).alias("term")).groupBy("id", "ord", "term").agg(F.count(F.lit(1)).alias("tf"))
    return counted.select("term", "id", "ord", (F.lit(1.0) + F.log(F.col("tf").cast("double"))).alias("dw"))


def phrase_hits(rows: DataFrame, phrase: str, by: str = "shot_key") -> DataFrame:
    """Keys with a text that holds the phrase after NFC and case folding."""
    needle = F.lit(phrase)
    folded = rows.withColumn("t", T.nfc_casefold("text")).withColumn("n", T.nfc_casefold(needle))
    return folded.where(F.contains("t", F.col("n"))).select(by).distinct()
