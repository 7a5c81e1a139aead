"""Evaluation: hits, recall, answer rates, coverage, latency percentiles, query performance, repair."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .integrity import global_rank

#: Defaults of reports.
RECALL_AT, TOLERANCE_MS, MISS_RANK, RANK_COST_S = (1, 5, 10, 100), 2000, 200, 1.5


def first_hits(results: DataFrame, truths: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """(query_id, rank): the first rank whose video and time any truth covers within the tolerance; null for a miss."""
    inside = (F.col("timestamp_ms") >= F.col("t_start_ms") - tolerance_ms) & (F.col("timestamp_ms") <= F.col("t_end_ms") + tolerance_ms)
    met = results.join(truths, ["query_id", "video_id"]).where(inside).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return truths.select("query_id").distinct().join(met, "query_id", "left")


def summary(ranks: DataFrame, ks: tuple[int, ...] = RECALL_AT, penalty: int = MISS_RANK, cost_s: float = RANK_COST_S) -> DataFrame:
    """One row: cases, misses, recall at each k, median and mean rank (a miss counts as the penalty), mean time to target (ranks cut at the penalty)."""
    filled = F.coalesce("rank", F.lit(penalty))
    recalls = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks]
    return ranks.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("rank").isNull()).alias("n_misses"), *recalls, F.median(filled).alias("median_rank"), F.avg(filled).alias("mean_rank"), F.avg(T.time_to_target(F.col("rank"), cost_s, penalty)).alias("mean_ttt_s"))


def answer_rates(cases: DataFrame) -> DataFrame:
    """Per archetype and, with archetype null, overall: cases and the rates of answers, moments and both right."""
    rate = lambda c: F.round(F.avg(c.cast("double")), 9)
    a, m = F.col("answer_ok"), F.col("moment_ok")
    return cases.rollup("archetype").agg(F.count(F.lit(1)).alias("n_cases"), rate(a).alias("answer_rate"), rate(m).alias("moment_rate"), rate(a & m).alias("joint_rate"))


def video_coverage(shots: DataFrame) -> DataFrame:
    """Shots of each video, and how many have speech, screen text, captions, entities or none of these."""
    has = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("has_asr", "has_ocr", "has_caption", "has_entities")}
    none = ~(has["has_asr"] | has["has_ocr"] | has["has_caption"] | has["has_entities"])
    return shots.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_shots"), *[F.count_if(v).alias(f"n_{c[4:]}") for c, v in has.items()], F.count_if(none).alias("n_bare"))


def concentration(coverage: DataFrame, column: str) -> DataFrame:
    """One row: share of shots covered, the greatest share of a video and that video (first by id of equals), and the videos' variation coefficient."""
    c = F.col(column)
    mean = F.avg(c)
    cv = F.when((F.count(F.lit(1)) < 2) | (mean == 0), 0.0).otherwise(F.stddev_pop(c) / mean)
    share = F.when(F.sum(c) > 0, F.max(c) / F.sum(c)).otherwise(0.0)
    return coverage.agg(F.round(F.sum(c) / F.sum("n_shots"), 9).alias("coverage"), F.round(share, 9).alias("hub_share"), F.min_by("video_id", F.struct(-c, F.col("video_id"))).alias("hub"), F.round(cv, 9).alias("cv"))


def coverage_warnings(report: DataFrame, least: float | None, most_share: float | None) -> DataFrame:
    """Rows of a concentration report that an opted-in limit catches, with the reason."""
    reasons = F.array_compact(F.array(*([F.when(F.col("coverage") < least, "coverage")] if least is not None else []), *([F.when(F.col("hub_share") > most_share, "hub")] if most_share is not None else []))) if least is not None or most_share is not None else F.array().cast("array<string>")
    return report.select("*", F.explode(reasons).alias("reason"))


def percentiles(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50 (interpolated), p95 (nearest rank, rounded half to even), max and n of each group."""
    ranked = samples.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    at = F.bround(F.lit(0.95) * (F.col("n") - 1)).cast("int")
    return ranked.groupBy(*by).agg(F.median(value).alias("p50"), F.max(F.when(F.col("i") == at, F.col(value))).alias("p95"), F.max(value).alias("max"), F.count(F.lit(1)).alias("n"))


def next_question(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """The attribute whose values split the rows best: greatest entropy, the first of equals; none for single-valued ones or fewer than two rows."""
    named = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for i, a in enumerate(attributes)])
    counts = rows.select(F.explode(named).alias("x")).select("x.*").where("value is not null").groupBy("i", "attribute", "value").count()
    total = F.sum("count").over(Window.partitionBy("i"))
    p = F.col("count") / total
    entropy = counts.withColumn("e", -p * F.log2(p)).groupBy("i", "attribute").agg(F.round(F.sum("e"), 9).alias("entropy"), F.count(F.lit(1)).alias("values"))
    return entropy.where("values > 1").orderBy(F.desc("entropy"), "i").limit(1).select("attribute", "entropy")


def top_shots(rankings: DataFrame, top: int) -> DataFrame:
    """(query_id, channel, shot_key, rank): the best rank of each shot over a channel's sub-queries, up to `top`."""
    return rankings.where(F.col("rank") <= top).groupBy("query_id", T.channel_of_label(F.col("label")).alias("channel"), "shot_key").agg(F.min("rank").alias("rank"))


def spearman(pairs: DataFrame) -> DataFrame:
    """Correlation of two rank columns as they are; 0 where it is undefined."""
    c = F.corr("rank_a", "rank_b")
    return pairs.groupBy("query_id", "a", "b").agg(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias("rho"))


def agreement(rankings: DataFrame, channels: list[str], top: int, digits: int = 9) -> DataFrame:
    """(query_id, agreement): mean rank correlation over pairs of a query's channels, over the union of their shots with absent ones at top + 1; 0 for fewer than two."""
    ranks = top_shots(rankings, top)
    present = ranks.select("query_id", "channel").distinct()
    wide = ranks.groupBy("query_id", "shot_key").pivot("channel", channels).agg(F.min("rank"))
    pairs = None
    for a, b in combinations(sorted(channels), 2):
        both = present.where(F.col("channel") == a).select("query_id").join(present.where(F.col("channel") == b).select("query_id"), "query_id")
        rows = wide.join(both, "query_id").where(F.col(f"`{a}`").isNotNull() | F.col(f"`{b}`").isNotNull())
        one = rows.select("query_id", F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.col(f"`{a}`"), F.lit(top + 1)).cast("double").alias("rank_a"), F.coalesce(F.col(f"`{b}`"), F.lit(top + 1)).cast("double").alias("rank_b"))
        pairs = one if pairs is None else pairs.unionByName(one)
    queries = ranks.select("query_id").distinct()
    if pairs is None:
        return queries.withColumn("agreement", F.lit(0.0))
    means = spearman(pairs).groupBy("query_id").agg(F.round(F.avg("rho"), digits).alias("agreement"))
    return queries.join(means, "query_id", "left").select("query_id", F.coalesce("agreement", F.lit(0.0)).alias("agreement"))


def compactness(candidates: DataFrame, videos: DataFrame, top: int, digits: int = 9) -> DataFrame:
    """Share of the most frequent video among the first `top` candidates; unknown videos count below the line only."""
    first = candidates.where(F.col("rank") <= top).join(videos.select("shot_key", "video_id"), "shot_key", "left")
    n = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    most = first.where("video_id is not null").groupBy("query_id", "video_id").count().groupBy("query_id").agg(F.max("count").alias("m"))
    return n.join(most, "query_id", "left").select("query_id", F.round(F.coalesce("m", F.lit(0)) / F.col("n"), digits).alias("compactness"))


def probability(features: list[Column], coef: list[float], intercept: float, xs: list[float] | None = None, ys: list[float] | None = None) -> Column:
    """Logistic score, carried through a piecewise-linear calibration and held to 0 to 1."""
    z = F.lit(intercept)
    for f, c in zip(features, coef, strict=True):
        z = z + f * c
    p = 1 / (1 + F.exp(-z))
    if xs:
        out = F.when(p <= xs[0], ys[0])
        for (x0, y0), (x1, y1) in zip(zip(xs, ys, strict=True), list(zip(xs, ys, strict=True))[1:], strict=False):
            out = out.when(p <= x1, y0 + (p - x0) * ((y1 - y0) / (x1 - x0)) if x1 > x0 else F.lit(y1))
        p = out.otherwise(ys[-1])
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def brier(rows: DataFrame, p: str, y: str) -> DataFrame:
    return rows.agg(F.round(F.avg(F.pow(F.col(p) - F.col(y), 2)), 9).alias("brier"))


def vector_health(vectors: DataFrame, dim: int) -> DataFrame:
    """One row: vectors, those of a wrong length, those with a value that isn't finite, and the greatest distance of a norm from 1."""
    v = F.col("vec")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    odd = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(v) != dim).alias("wrong_dim"), F.count_if(odd).alias("not_finite"), F.round(F.max(F.abs(norm - 1)), 6).alias("norm_error"))


def channel_audit(hits: DataFrame, exact: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 100)) -> DataFrame:
    """First rank of an exact hit and exact hits within each k."""
    told = hits.join(exact.select("shot_key").distinct().withColumn("ok", F.lit(True)), "shot_key", "left")
    return told.agg(F.min(F.when(F.col("ok"), F.col("rank"))).alias("first_exact"), *[F.count_if(F.col("ok") & (F.col("rank") <= k)).alias(f"exact_{k}") for k in ks])


def fixture_violations(cases: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, rule) of each broken rule of a fixture: cases (query_id, kind, text, clip_path, reveals, question, accepted_answers, truths)."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    has = lambda c: F.coalesce(F.length(T.strip(F.col(c))), F.lit(0)) > 0
    kind = F.col("kind")
    rules = {
        "unknown kind": ~kind.isin("kis_t", "kis_v", "kis_c", "qa"),
        "text missing": kind.isin("kis_t", "kis_c") & ~has("text"),
        "clip missing": (kind == "kis_v") & ~has("clip_path"),
        "reveals missing": (kind == "kis_c") & (n("reveals") == 0),
        "reveals misplaced": (kind != "kis_c") & (n("reveals") > 0),
        "question missing": (kind == "qa") & (~has("question") | (n("accepted_answers") == 0)),
        "answers misplaced": (kind != "qa") & (has("question") | (n("accepted_answers") > 0)),
        "truth reversed": F.exists(F.coalesce("truths", F.array().cast(cases.schema["truths"].dataType)), lambda t: t["t_end_ms"] < t["t_start_ms"]),
    }
    broken = cases.select("query_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))).alias("rule"))
    twice = cases.groupBy("query_id").count().where("count > 1").select("query_id", F.lit("id repeated").alias("rule"))
    foreign = cases.select("query_id", F.explode("truths").alias("t")).select("query_id", "t.video_id").join(corpus, "video_id", "left_anti").select("query_id", F.lit("truth outside corpus").alias("rule")).distinct()
    return broken.unionByName(twice).unionByName(foreign)


def sampled_windows(keyframes: DataFrame, want: int, window_ms: int, per_case: int, seed: str = "0") -> DataFrame:
    """(video_id, t_start_ms, t_end_ms, frames): `want` windows of that width around keyframes (video_id, timestamp_ms, image_path).

    Keyframes are taken in seeded order over all videos; one whose window meets
    a taken one of its video is passed over. A window shows `per_case` of the
    keyframes in it, evenly spaced. Fewer come out where no more fit.
    """
    half = window_ms // 2
    h = F.md5(F.concat_ws("|", F.lit(seed), "video_id", F.col("timestamp_ms").cast("string"), "image_path"))
    start = F.greatest(F.lit(0), F.col("timestamp_ms") - half).cast("bigint")
    rows = keyframes.select("video_id", h.alias("h"), start.alias("s"))
    ordered = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("h", "s"))).alias("rows"))
    meets = lambda k, r: (k["s"] < r["s"] + window_ms) & (r["s"] < k["s"] + window_ms)
    grow = lambda a, r: F.when(F.exists(a, lambda k: meets(k, r)), a).otherwise(F.concat(a, F.array(r)))
    taken = ordered.select("video_id", F.explode(F.aggregate("rows", F.slice("rows", 1, 0), grow)).alias("r")).select("video_id", "r.h", "r.s")
    picked = taken.orderBy("h", "video_id").limit(want)
    inside = keyframes.join(picked, "video_id").where((F.col("timestamp_ms") >= F.col("s")) & (F.col("timestamp_ms") <= F.col("s") + window_ms))
    listed = inside.groupBy("video_id", "h", "s").agg(F.array_sort(F.collect_list(F.struct("timestamp_ms", "image_path"))).alias("all"))
    shown = F.least(F.lit(per_case), F.size("all"))
    frames = F.transform(F.sequence(F.lit(0), shown - 1), lambda i: F.get(F.col("all"), F.floor(i * (F.size("all") / shown)).cast("int"))["image_path"])
    return listed.select("video_id", F.col("s").alias("t_start_ms"), (F.col("s") + window_ms).alias("t_end_ms"), frames.alias("frames"))


def round_robin(rows: DataFrame, modes: list[str], *order: str) -> DataFrame:
    """Modes dealt in turn over the rows in order."""
    placed = global_rank(rows, *order, name="_place")
    return placed.withColumn("mode", F.get(F.array(*[F.lit(m) for m in modes]), ((F.col("_place") - 1) % len(modes)).cast("int"))).drop("_place")
