"""What a question or a search session gets back: cards, answer groups, reverse retrieval, hints, staged events.

Readers, hypothesisers and counters are plug-ins; here their rows are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import answers as A
from . import ranking as R
from .evaluation import next_question
from .evidence import evidence_window, ledger_answer


def video_of_shot(meta: DataFrame, bundles: DataFrame) -> DataFrame:
    """(shot_key, video_id): from the metadata, where that has none from the evidence."""
    b = bundles.select("shot_key", F.col("video_id").alias("_other"))
    return meta.select("shot_key", "video_id").join(b, "shot_key", "full_outer").select("shot_key", F.coalesce("video_id", "_other").alias("video_id"))


def cards(candidates: DataFrame, archetype: str, bundles: DataFrame, meta: DataFrame, ledger: DataFrame, most: int) -> DataFrame:
    """(query_id, shot_key, video_id, timestamp_ms, score, answer, field, value, frames, rank) of the first `most` candidates.

    bundles (shot_key, video_id, mid_ms, frames) come before meta (shot_key,
    video_id, mid_ms); a candidate with neither is dropped. The time is the
    candidate's own, else the shot's middle.
    """
    b = bundles.select("shot_key", F.col("video_id").alias("b_video"), F.col("mid_ms").alias("b_mid"), "frames", F.lit(True).alias("in_b"))
    m = meta.select("shot_key", F.col("video_id").alias("m_video"), F.col("mid_ms").alias("m_mid"), F.lit(True).alias("in_m"))
    joined = candidates.where(F.col("rank") <= most).join(b, "shot_key", "left").join(m, "shot_key", "left").where("in_b or in_m").join(ledger, "shot_key", "left")
    told = joined.withColumn("guess", ledger_answer(F.lit(archetype)))
    own = lambda x, y: F.when(F.col("in_b"), F.col(x)).otherwise(F.col(y))
    return told.select("query_id", "shot_key", own("b_video", "m_video").alias("video_id"), F.coalesce("timestamp_ms", own("b_mid", "m_mid")).alias("timestamp_ms"), "score", "guess.answer", "guess.field", "guess.value", F.coalesce("frames", F.array().cast(bundles.schema["frames"].dataType)).alias("frames"), "rank")


def packs(candidates: DataFrame, meta: DataFrame, zoom_ms: int, most: int, top: int) -> DataFrame:
    """(query_id, shot_key, window): for each of the first candidates the shots around it, nearest first, up to `most`."""
    anchors = candidates.where(F.col("rank") <= top).join(meta.select("shot_key", "video_id", "mid_ms"), "shot_key")
    asked = anchors.select(F.struct("query_id", "shot_key").alias("query_id"), "video_id", F.coalesce("timestamp_ms", "mid_ms").alias("anchor_ms"))
    near = evidence_window(asked, meta.select("shot_key", "video_id", "mid_ms"), zoom_ms, most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "shot_key"))), lambda s: s["shot_key"])
    return near.groupBy("query_id").agg(listed.alias("window")).select("query_id.query_id", "query_id.shot_key", "window")


def answer_groups(reads: DataFrame, track_a: DataFrame, contradicts: DataFrame, bonus: float, confident_at: float, rules: T.AnswerRules = T.DEFAULT_RULES) -> DataFrame:
    """Reads (question_id, shot_key, answer, kind, score, ord) of many moments voted into answers; the first two change places where the second's first moment contradicts the first.

    track_a (question_id, answer) are the ledger's guesses; contradicts
    (question_id, shot_key, answer) is what a reader found.
    """
    kinds = reads.groupBy("question_id").agg(F.first("kind").alias("kind"))
    given = track_a.join(kinds, "question_id").select("question_id", T.answer_key(F.col("answer"), F.col("kind"), rules).alias("normalized")).where("normalized <> ''").distinct()
    groups = A.vote(reads, given, bonus, confident_at, rules=rules)
    keyed = reads.withColumn("normalized", T.answer_key(F.col("answer"), F.col("kind"), rules))
    moment = keyed.groupBy("question_id", "normalized").agg(F.min_by("shot_key", "ord").alias("shot_key"))
    first = groups.where("rank = 1").select("question_id", "answer")
    second = groups.where("rank = 2").join(moment, ["question_id", "normalized"]).select("question_id", "shot_key")
    hit = first.join(second, "question_id").join(contradicts, ["question_id", "shot_key", "answer"], "left_semi")
    return A.swap_disconfirmed(groups, hit.select("question_id"))


def reverse(hypotheses: DataFrame, hits: DataFrame, locator: DataFrame, top: int, ratio: float, least: float, weight: float, most: int) -> DataFrame:
    """(question_id, answer, shot_key, score, rank): answers found by searching them.

    hypotheses (question_id, ord, answer): the first `most`, blank ones ignored;
    hits (question_id, ord, rank, shot_key, score) of their searches; locator
    (question_id, shot_key, locator): how well a moment fits the question, 0 if
    absent. A hypothesis counts if its hits are concentrated and its best
    moment fits.
    """
    asked = hypotheses.where((F.col("ord") <= most) & (T.strip(F.col("answer")) != "")).select("question_id", "ord", T.strip(F.col("answer")).alias("answer"))
    found = hits.join(asked, ["question_id", "ord"]).withColumn("query_id", F.struct("question_id", "ord"))
    best = found.where("rank = 1").join(locator, ["question_id", "shot_key"], "left").select("query_id", "question_id", "ord", "answer", "shot_key", "score", F.coalesce("locator", F.lit(0.0)).alias("locator"))
    good = A.double_gate(found, best.select("query_id", "locator"), top, ratio, least)
    won = best.join(good, "query_id", "left_semi").select("question_id", "ord", "answer", "shot_key", (F.col("score") * weight).alias("score"))
    return A.reverse_cards(won).drop("ord")


def hints(asked: DataFrame, most: int, agreeing: int) -> DataFrame:
    """(seq, hint) of answer states (session_id, seq, question, agreeing_count, cross, disconfirmed, pending) in order.

    Each final hint to submit (nothing pending) spends one of `most`; another
    question, folded, starts anew.
    """
    key = T.casefold(T.strip(F.col("question")))
    by = Window.partitionBy("session_id").orderBy("seq")
    keyed = asked.withColumn("key", key)
    turned = keyed.withColumn("run", F.sum(F.when(F.col("key").eqNullSafe(F.lag("key").over(by)), 0).otherwise(1)).over(by))
    would = ~F.coalesce("disconfirmed", F.lit(False)) & (F.col("cross") | (F.col("agreeing_count") >= agreeing))
    spends = F.when(would & (F.col("pending") == 0), 1).otherwise(0)
    spent = F.coalesce(F.sum(spends).over(Window.partitionBy("session_id", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = turned.withColumn("spent", F.least(spent, F.lit(most)))
    return told.select("session_id", "seq", A.hint(F.lit(most), would, F.col("pending") > 0, F.col("spent")).alias("hint"))


def responded(candidates: DataFrame, before: DataFrame, views: DataFrame, attributes: list[str], top_k: int) -> tuple[DataFrame, DataFrame]:
    """The tail of every search: candidates (shot_key, rank) narrowed to the session's set (key), unless none would be left, the views of the first ones, and the question that splits these best."""
    now = candidates.withColumn("key", F.col("shot_key"))
    kept = R.narrowed(before, now) if before is not None else now
    placed = R.numbered(kept.withColumn("_all", F.lit(0)).withColumnRenamed("rank", "_was"), ["_all"], F.col("_was"), most=top_k).drop("_all", "_was", "key")
    shown = placed.join(views, "shot_key")
    return shown, next_question(shown, attributes)


#: The stages of a streamed search and of a streamed answer, in order.
SEARCH_EVENTS = ("results_preview", "results", "done")
ANSWER_EVENTS = ("track_a", "reverse", "count", "track_b", "ev_hint", "done")


def staged(events: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """(query_id, seq, line): events (query_id, event, payload as JSON) as lines of JSON in the order of their stages; a preview is left out for queries with a session."""
    at = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("event"))
    known = events.where((at > 0) & ~((F.col("event") == "results_preview") & F.col("session_id").isNotNull()))
    body = F.regexp_replace("payload", r"^\{\s*", "")
    line = F.concat(F.lit('{"event": "'), F.col("event"), F.lit('"'), F.when(F.startswith(body, F.lit("}")), F.lit("")).otherwise(F.lit(", ")), body, F.lit("\n"))
    return known.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(at)).alias("seq"), line.alias("line"))


def case_metrics(cases: DataFrame, results: DataFrame, truths: DataFrame, tolerance_ms: int, rules: T.AnswerRules = T.DEFAULT_RULES) -> DataFrame:
    """(query_id, archetype, answer_ok, moment_ok): a question is right by its answer's key, and by its first result lying in a truth.

    cases (query_id, archetype, answer, accepted, kind); results and truths as in first_hits.
    """
    from .evaluation import first_hits

    told = A.matches(cases, ["query_id", "archetype"], rules).withColumnRenamed("ok", "answer_ok")
    hit = first_hits(results.where("rank = 1"), truths, tolerance_ms).select("query_id", F.col("rank").isNotNull().alias("moment_ok"))
    return told.join(hit, "query_id", "left").withColumn("moment_ok", F.coalesce("moment_ok", F.lit(False)))


def bounded(results: DataFrame, top_k: int) -> DataFrame:
    """Results of a run; more than top_k for a query is an error of the retriever."""
    n = F.max("rank").over(Window.partitionBy("query_id"))
    checked: Column = F.when(n <= top_k, F.col("rank")).otherwise(F.raise_error(F.lit(f"a query has more than {top_k} results")).cast(results.schema["rank"].dataType))
    return results.withColumn("rank", checked)
