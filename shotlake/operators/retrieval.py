"""Retrieval composed of its parts: plans over channels, fusion, filters, reranking, grounding; baselines and ablations.

A channel is a function from sub-queries (query_id, label, text) and a depth to
rankings (query_id, label, rank, shot_key, score). All queries of a table go
through each channel at once.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranking as R
from .evaluation import first_hits, summary

log = logging.getLogger(__name__)

Channel = Callable[[DataFrame, int], DataFrame]
#: The channels that each field of a spec is sent to, and those that take the raw query.
FIELD_CHANNELS = {
    "visual_phrases": ("dense_visual", "semantic_dense"),
    "paraphrases": ("dense_visual", "semantic_dense"),
    "entity_terms": ("semantic_dense", "literal_sparse", "factoid_sparse"),
    "ocr_literals": ("literal_sparse", "factoid_sparse"),
    "asr_phrases": ("literal_sparse", "semantic_dense", "factoid_sparse"),
}
RAW_CHANNELS = ("semantic_dense", "literal_sparse")
CHUNKED = "dense_visual"


def sparse_channel(postings: DataFrame, terms: Callable[[Column], Column]) -> Channel:
    """Terms of a text, each of weight 1 a time, against postings (term, id, ord, dw)."""

    def rank(subs: DataFrame, depth: int) -> DataFrame:
        named = subs.select(F.struct("query_id", "label").alias("q"), F.explode(terms(F.col("text"))).alias("term"))
        asked = named.groupBy(F.col("q").alias("query_id"), "term").agg(F.count(F.lit(1)).cast("double").alias("qw"))
        return R.sparse_top_k(asked, postings, depth).select("query_id.query_id", "query_id.label", "rank", F.col("id").cast("string").alias("shot_key"), "score")

    return rank


def dense_channel(index: DataFrame, meta: DataFrame, encode: Callable[[DataFrame], DataFrame], oversample: int = 4) -> Channel:
    """Keyframes (id, vec) under a plug-in that gives (query_id, qvec) for (query_id, text), collapsed to the shots of meta (id, shot_key, timestamp_ms)."""

    def rank(subs: DataFrame, depth: int) -> DataFrame:
        asked = encode(subs.select(F.to_json(F.struct("query_id", "label")).alias("query_id"), "text"))
        found = R.shot_search(asked, index, meta, depth, oversample)
        key = F.from_json("query_id", subs.select("query_id", "label").schema)
        return found.select(key["query_id"].alias("query_id"), key["label"].alias("label"), "rank", "shot_key", "score", "timestamp_ms")

    return rank


def available(builders: dict[str, Callable[[], Channel | None]]) -> dict[str, Channel]:
    """Channels whose artifacts exist: a builder that gives None is left out with a warning; none at all is an error."""
    made = {name: build() for name, build in builders.items()}
    for name in [n for n, c in made.items() if c is None]:
        log.warning("no artifacts for channel %s", name)
    found = {n: c for n, c in made.items() if c is not None}
    if not found:
        raise FileNotFoundError("no retrieval channel has artifacts")
    return found


def plan(specs: DataFrame, field_weights: dict[str, float], channel_weights: dict[str, float], raw_weight: float = 0.0) -> DataFrame:
    """(query_id, label, channel, text, weight, label_ord): the sub-queries of specs (query_id, spec, raw).

    Each item of a field goes to the field's channels that have a weight; blank
    items go nowhere. With a raw weight the untouched query is sent too.
    """
    rows = []
    for i, (field, channels) in enumerate(FIELD_CHANNELS.items()):
        rows += [(field, i, j, c, channel_weights[c] * field_weights[field]) for j, c in enumerate(channels) if c in channel_weights and field in field_weights]
    rows += [("raw_query", len(FIELD_CHANNELS), j, c, channel_weights[c] * raw_weight) for j, c in enumerate(RAW_CHANNELS) if c in channel_weights and raw_weight > 0]
    table = specs.sparkSession.createDataFrame(rows, "field string, field_ord int, channel_ord int, channel string, weight double")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"spec.{f}").alias("items")) for f in FIELD_CHANNELS], F.struct(F.lit("raw_query").alias("field"), F.array("raw").alias("items")))
    items = specs.select("query_id", F.explode(fields).alias("f")).select("query_id", "f.field", F.posexplode("f.items").alias("pos", "text")).withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    # the table of fields and channels is fixed and small
    named = items.join(F.broadcast(table), "field")
    place = F.when(F.col("field") == "raw_query", F.lit("")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    labelled = named.withColumn("label", F.concat(F.col("field"), place, F.lit("."), F.col("channel")))
    return R.numbered(labelled, ["query_id"], F.col("field_ord"), F.col("pos"), F.col("channel_ord"), name="label_ord").select("query_id", "label", "channel", "text", "weight", "label_ord")


def dispatch(subs: DataFrame, channels: dict[str, Channel], depth: int) -> DataFrame:
    """Rankings of all sub-queries; those of a channel that isn't there are dropped."""
    parts = [rank(subs.where(F.col("channel") == name).select("query_id", "label", "text"), depth) for name, rank in channels.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def chunked(subs: DataFrame, most: int, share: float) -> DataFrame:
    """Sub-queries of the visual channel of several sentences as one for each, of `share` of the weight.

    pos is the sentence's place where a query has one such sub-query, else null.
    """
    parts = subs.where(F.col("channel") == CHUNKED).withColumn("parts", T.sentences(F.col("text"), most)).where(F.size("parts") > 1)
    several = parts.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    name = F.concat(F.expr("left(label, length(label) - length(channel) - 1)"), F.lit(".chunk"), F.col("pos").cast("string"), F.lit("."), F.col("channel"))
    made = parts.select("query_id", "label", "channel", "weight", "label_ord", F.posexplode("parts").alias("pos", "text")).join(several, "query_id")
    chunks = made.select("query_id", name.alias("label"), "channel", "text", (F.col("weight") * share).alias("weight"), "label_ord", F.when(F.col("n") == 1, F.col("pos")).alias("pos"))
    whole = subs.join(parts.select("query_id", "label"), ["query_id", "label"], "left_anti").withColumn("pos", F.lit(None).cast("int"))
    return whole.unionByName(chunks)


def fused(rankings: DataFrame, subs: DataFrame, meta: DataFrame | None = None, window_ms: int = 0, prior: DataFrame | None = None, k: int = R.RRF_K, **window: float) -> DataFrame:
    """(query_id, shot_key, score, timestamp_ms, rank): plain fusion, or temporal windows where metadata and a width are given."""
    weights = subs.select("query_id", "label", "label_ord", "weight")
    plain = R.rrf(rankings, weights, k)
    if meta is None or window_ms <= 0:
        return plain
    ordered = subs.where("pos is not null").select("query_id", "label", "pos") if "pos" in subs.columns else None
    found = R.fuse_windows(rankings, weights, meta, window_ms, prior=prior, label_order=ordered, k=k, **window)
    return found.join(plain.select("query_id", "shot_key", "timestamp_ms"), ["query_id", "shot_key"], "left").select("query_id", "shot_key", "score", "timestamp_ms", "rank")


def retrieve(specs: DataFrame, channels: dict[str, Channel], field_weights: dict[str, float], channel_weights: dict[str, float], meta: DataFrame, top_k: int, depth: int = 100, raw_weight: float = 0.0, evidence: DataFrame | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, extra: dict[str, float] | None = None, chunks: tuple[int, float] | None = None, **fusion) -> DataFrame:
    """From specs (query_id, spec, raw) to grounded results (query_id, video_id, timestamp_ms, score, rank).

    extra: weights of channels for these queries only, as an answer's factoid
    channel; one that isn't loaded changes nothing. A rerank that fails keeps
    the fused order. meta (shot_key, video_id, start_ms, end_ms).
    """
    subs = plan(specs, field_weights, channel_weights | (extra or {}), raw_weight)
    if chunks:
        subs = chunked(subs, *chunks)
    rankings = dispatch(subs, channels, depth)
    candidates = fused(rankings, subs, **fusion)
    if evidence is not None:
        left = R.without_own_negated(candidates, evidence, specs.select("query_id", F.col("spec.negations").alias("negations")))
        candidates = R.numbered(left.withColumnRenamed("rank", "_was"), ["query_id"], F.col("_was")).drop("_was")
    if rerank is not None:
        candidates = degraded(rerank, candidates)
    return R.ground(candidates, meta, top_k)


def degraded(step: Callable[[DataFrame], DataFrame], candidates: DataFrame) -> DataFrame:
    """The step's candidates, or those given where it can't be planned or run."""
    try:
        done = step(candidates).persist()
        done.count()
    except Exception as e:  # an optional improvement never breaks a search
        log.warning("step skipped: %s", e)
        return candidates
    return done


def fusion_search(queries: DataFrame, channels: dict[str, Channel], weights: dict[str, float], meta: DataFrame, top_k: int, depth: int = 100, chunks: tuple[int, float] | None = None, **fusion) -> DataFrame:
    """Every weighted channel takes the whole query (query_id, text); weights of unknown channels are an error."""
    if unknown := sorted(set(weights) - set(channels)):
        raise ValueError(f"weights for unknown channels {unknown}")
    table = queries.sparkSession.createDataFrame([(n, n, i, float(weights[n])) for i, n in enumerate(c for c in channels if c in weights)], "label string, channel string, label_ord int, weight double")
    whole = queries.withColumn("label", F.explode(F.array(*[F.lit(n) for n in channels if n in weights])))
    subs = whole.join(F.broadcast(table), "label").select("query_id", "label", "channel", "text", "weight", "label_ord").where(T.strip(F.col("text")) != "")
    if chunks:
        subs = chunked(subs, *chunks)
    return R.ground(fused(dispatch(subs, {n: channels[n] for n in channels if n in weights}, depth), subs, **fusion), meta, top_k)


def ablations(queries: DataFrame, channels: dict[str, Channel], weights: dict[str, float], subsets: dict[str, list[str]], meta: DataFrame, truths: DataFrame, top_k: int = 100, **fusion) -> DataFrame:
    """(variant, ...): the summary of each subset of the channels, one row each."""

    def one(name: str, kept: list[str]) -> DataFrame:
        results = fusion_search(queries, channels, {c: w for c, w in weights.items() if c in kept}, meta, top_k, **fusion)
        return summary(first_hits(results, truths)).withColumn("variant", F.lit(name))

    return reduce(DataFrame.unionByName, [one(n, s) for n, s in subsets.items()])


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, rank_a, rank_b, better): the first hits (query_id, rank) of two runs; a miss is worse than any rank."""
    both = a.select("query_id", F.col("rank").alias("rank_a")).join(b.select("query_id", F.col("rank").alias("rank_b")), "query_id", "full_outer")
    x, y = (F.coalesce(c, F.lit(1 << 30)) for c in ("rank_a", "rank_b"))
    return both.withColumn("better", F.when(x < y, "a").when(y < x, "b").otherwise("same"))


def top_dump(results: DataFrame, most: int) -> DataFrame:
    """(query_id, top): the first results of each query as one JSON text."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "video_id", "timestamp_ms", "score")))
    return results.where(F.col("rank") <= most).groupBy("query_id").agg(F.to_json(listed).alias("top"))


def random_results(queries: DataFrame, videos: DataFrame, top_k: int, seed: int = 0) -> DataFrame:
    """Seeded guesses: for each query and rank a video (video_id, duration_ms) and a time in it, by hashes; a duration that isn't positive is an error."""
    n = videos.count()
    if not n:
        raise ValueError("no videos")
    if videos.where("duration_ms <= 0").limit(1).count():
        raise ValueError("a video has no duration")
    # as in a hash join, a guess names a place among the sorted ids
    placed = R.numbered(videos.withColumn("_all", F.lit(0)), ["_all"], F.col("video_id"), name="place").drop("_all")
    guesses = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(top_k))).alias("rank"))
    drawn = guesses.withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "query_id", "rank"), F.lit(n)) + 1)
    met = drawn.join(placed, "place")
    return met.select("query_id", "video_id", F.pmod(F.xxhash64(F.lit(seed + 1), "query_id", "rank"), F.col("duration_ms")).alias("timestamp_ms"), (F.lit(top_k) - F.col("rank") + 1).cast("double").alias("score"), "rank")


def shot_centroid(shots: DataFrame, index: DataFrame, meta: DataFrame) -> DataFrame:
    """(query_id, qvec): renormalised mean vector of the keyframes of shots (query_id, shot_key); shots without keyframes are left out."""
    rows = shots.join(meta.select("id", "shot_key"), "shot_key").join(index, "id").select("query_id", "vec")
    return R.mean_vector(rows, "query_id").select("query_id", F.col("vec").alias("qvec"))


def feedback(query: DataFrame, positive: DataFrame, negative: DataFrame, index: DataFrame, meta: DataFrame, k: int, **weights: float) -> DataFrame:
    """Shots for the query vector (query_id, qvec) moved towards the keyframes of positive shots (query_id, shot_key) and away from those of negative ones."""
    of = lambda shots: shots.join(meta.select("id", "shot_key"), "shot_key").join(index, "id").select("query_id", "vec")
    return R.shot_search(R.rocchio(query, of(positive), of(negative), **weights), index, meta, k)


def similar_shots(shots: DataFrame, index: DataFrame, meta: DataFrame, k: int) -> DataFrame:
    """The k shots most like each (query_id, shot_key), itself left out."""
    found = R.shot_search(shot_centroid(shots, index, meta), index, meta, k + 1)
    others = found.join(shots, ["query_id", "shot_key"], "left_anti").withColumnRenamed("rank", "_was")
    return R.numbered(others, ["query_id"], F.col("_was"), most=k).drop("_was")


def late_interaction(candidates: DataFrame, queries: DataFrame, documents: DataFrame, pool: int, digits: int = 9) -> DataFrame:
    """Rerank the first `pool` candidates by the mean over query tokens (query_id, qvecs) of their best document token (shot_key, dvecs)."""
    met = candidates.where(F.col("rank") <= pool).select("query_id", "shot_key").join(queries, "query_id").join(documents, "shot_key")
    scores = met.select("query_id", "shot_key", F.round(R.maxsim(F.col("qvecs"), F.col("dvecs")), digits).alias("score"))
    return R.rerank(candidates, scores, pool)


def imagined(candidates: DataFrame, renders: DataFrame, query: DataFrame, index: DataFrame, meta: DataFrame, least: float, weight: float, k: int = R.RRF_K) -> DataFrame:
    """Fuse the candidates with the shots nearest to pictures made for the query.

    renders (query_id, vec) below `least` against the query (query_id, qvec)
    are dropped; queries with none left keep their candidates. The search is
    as deep as the candidates are many.
    """
    good = renders.join(query, "query_id").where(R.dot(F.col("vec"), F.col("qvec")) >= least).select("query_id", "vec")
    centre = R.mean_vector(good, "query_id").select("query_id", F.col("vec").alias("qvec"))
    sizes = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    deepest = sizes.agg(F.max("n")).first()[0] or 1
    found = R.shot_search(centre, index, meta, deepest).join(sizes, "query_id", "left").where(F.col("rank") <= F.coalesce("n", F.lit(1))).drop("n")
    pool = candidates.withColumn("label", F.lit("pool")).select("query_id", "label", "rank", "shot_key")
    both = pool.unionByName(found.withColumn("label", F.lit("imagine")).select("query_id", "label", "rank", "shot_key"))
    weights = candidates.sparkSession.createDataFrame([("pool", 0, 1.0), ("imagine", 1, float(weight))], "label string, label_ord int, weight double")
    return R.rrf(both, weights, k)
