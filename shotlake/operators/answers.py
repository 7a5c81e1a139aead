"""Answers: votes over reads, counts over frames, gates, hints and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def vote(reads: DataFrame, track_a: DataFrame, bonus: float, confident_at: float, digits: int = 9, rules: T.AnswerRules = T.DEFAULT_RULES) -> DataFrame:
    """reads (question_id, answer, kind, score, ord), track_a (question_id, normalized) -> ranked answer groups.

    Groups add their scores; one that the other track also gives gets a bonus
    share. Valid groups come first, then by score and normalised answer.
    """
    keyed = reads.withColumn("normalized", T.answer_key(F.col("answer"), F.col("kind"), rules)).where(F.col("normalized") != "")
    grouped = keyed.groupBy("question_id", "normalized").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("reads"), F.min_by("answer", "ord").alias("answer"), F.first("kind").alias("kind"))
    both = grouped.join(track_a.withColumn("agrees", F.lit(True)), ["question_id", "normalized"], "left").withColumn("agrees", F.coalesce("agrees", F.lit(False)))
    scored = both.withColumn("score", F.round(F.col("sum") * F.when(F.col("agrees"), 1 + bonus).otherwise(1.0), digits)).withColumn("valid", T.valid_answer(F.col("normalized"), F.col("kind"), rules)).withColumn("confident", F.col("agrees") | (F.col("score") >= confident_at))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("valid"), F.desc("score"), "normalized"))).select("question_id", "normalized", "answer", "reads", "score", "agrees", "valid", "confident", "rank")


def swap_disconfirmed(groups: DataFrame, disconfirmed: DataFrame) -> DataFrame:
    """The first two groups change places for questions whose first is disconfirmed and that have a second."""
    told = groups.join(disconfirmed.select("question_id").distinct().withColumn("swap", F.lit(True)), "question_id", "left")
    n = F.max("rank").over(Window.partitionBy("question_id"))
    do = F.coalesce("swap", F.lit(False)) & (n >= 2) & (F.col("rank") <= 2)
    return told.withColumn("rank", F.when(do, 3 - F.col("rank")).otherwise(F.col("rank"))).drop("swap")


def reconciled_counts(frames: DataFrame, by: list[str], native: bool, least: int = 0) -> DataFrame:
    """One count of per-frame counts: their maximum if native, else the median rounded half to even; below `least` it is dropped."""
    value = F.max("n") if native else F.bround(F.median("n")).cast("int")
    return frames.groupBy(*by).agg(value.cast("int").alias("count")).where(F.col("count") >= least)


def count_of(values: Column, native: bool) -> Column:
    """The same over an array; empty gives 0."""
    s = F.array_sort(values)
    n = F.size(values)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n == 0, 0).when(F.lit(native), F.array_max(values)).otherwise(F.bround((low + high) / 2.0).cast("int"))


def above_floor(detections: Column, floor: float) -> Column:
    """Detections of each frame with at least `floor`; frames stay, 0 changes nothing."""
    return F.transform(detections, lambda frame: F.filter(frame, lambda d: d["score"] >= floor)) if floor > 0 else detections


def union_box(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The box (x0, y0, x1, y1) around all boxes of a group."""
    return boxes.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def adjudicate(detected: Column, read: Column, margin: int) -> Column:
    return F.abs(detected - read) <= margin


def count_result(detected: Column, read: Column, margin: int) -> Column:
    """The reader's count where both agree within the margin, else the detector's."""
    return F.when(read.isNotNull() & adjudicate(detected, read, margin), read).otherwise(F.coalesce(detected, read))


def peakiness(ranked: DataFrame, top: int) -> DataFrame:
    """(query_id, peak): best score over the median of the first `top`; 1 where the median isn't positive."""
    agg = ranked.where(F.col("rank") <= top).groupBy("query_id").agg(F.max("score").alias("best"), F.median("score").alias("mid"))
    return agg.select("query_id", F.when(F.col("mid") > 0, F.col("best") / F.col("mid")).otherwise(1.0).alias("peak"))


def weak_locator(peak: Column, has_answer: Column, ratio: float) -> Column:
    """Whether no answer stands by itself, no scores are there, or none stands out."""
    return ~F.coalesce(has_answer, F.lit(False)) | peak.isNull() | (peak < ratio)


def double_gate(hits: DataFrame, locator: DataFrame, top: int, ratio: float, least: float) -> DataFrame:
    """(query_id) of hypotheses with a single hit or a first `top` whose best stands out by `ratio`, and whose locator score reaches `least`."""
    alone = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    told = alone.join(peakiness(hits, top), "query_id").join(locator, "query_id")
    return told.where(((F.col("n") == 1) | (F.col("peak") >= ratio)) & (F.col("locator") >= least)).select("query_id")


def hint(budget: Column, confident: Column, pending: Column, spent: Column) -> Column:
    """First rule that holds: budget spent: wait; confident: submit; reads pending: wait; else zoom."""
    return F.when(spent >= budget, "wait_for_reads").when(confident, "submit_now").when(pending, "wait_for_reads").otherwise("escalate_zoom")


def matches(rows: DataFrame, by: list[str], rules: T.AnswerRules = T.DEFAULT_RULES) -> DataFrame:
    """(by, ok): whether an answer has the key of one that is accepted; rows (by, answer, accepted, kind). No accepted answer, or an empty key, never matches."""
    told = rows.select(*by, "kind", T.answer_key(F.col("answer"), F.col("kind"), rules).alias("key"), F.explode_outer("accepted").alias("other"))
    same = (F.col("key") != "") & (F.col("key") == T.answer_key(F.col("other"), F.col("kind"), rules))
    return told.withColumn("same", F.coalesce(same, F.lit(False))).groupBy(*by).agg(F.bool_or("same").alias("ok"))


def seed_hypotheses(rows: DataFrame, top: int) -> DataFrame:
    """(query_id, rank, spoken_entities): names of the first `top` rows, each once in first-seen order."""
    names = rows.where(F.col("rank") <= top).select("query_id", "rank", F.posexplode("spoken_entities").alias("pos", "name"))
    first = names.groupBy("query_id", "name").agg(F.min(F.struct("rank", "pos")).alias("at"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).select("query_id", "name", "ord")


def reverse_cards(cards: DataFrame) -> DataFrame:
    return cards.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "ord")))
