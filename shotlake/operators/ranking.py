"""Index search and rank fusion: exact top-k, reciprocal-rank fusion, temporal windows, grounding.

Every ranking is rows (query, label, rank, shot_key, ...) with explicit order
columns; ties are broken by those columns and never by arrival.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T

#: Fusion defaults.
RRF_K, WINDOW_MS, AGREEMENT, PRIOR, ORDER_BONUS = 60, 10_000, 0.25, 0.5, 0.0
#: Query vectors up to which they are broadcast to the scan of an index.
MOST_QUERIES = 4096


def dot(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def rounded(x: Column, digits: int) -> Column:
    """x to some digits as SQL rounds doubles: the scaled number to the next whole one, halves away from zero, the sign of zero kept.

    `F.round` rounds the shortest decimal of x instead, which differs in the last
    digit where scaling meets or leaves a half.
    """
    scale = float(10**digits)
    whole = F.round(F.abs(x) * scale, 0) / scale
    return F.when(x < 0, -whole).when(x == 0, x).otherwise(whole)


def added(value: Column) -> Column:
    """The sum of a group's doubles from the smallest up, as the last digit of a sum depends on its order; nulls are left out."""
    listed = F.array_sort(F.collect_list(value))
    return F.when(F.size(listed) > 0, F.aggregate(listed, F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """L2-normalised vector; a zero, infinite or NaN vector is an error."""
    n = norm(v)
    bad = F.isnan(n) | (n == 0) | (n == float("inf"))
    return F.when(bad, F.raise_error(F.lit("vector can't be normalised")).cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def numbered(rows: DataFrame, by: list[str], *order: Column, name: str = "rank", most: int | None = None) -> DataFrame:
    """1-based rank in each group; with `most`, ranks are limited before rows are exchanged."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.where(F.col(name) <= most) if most else out


def dense_top_k(queries: DataFrame, index: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Exact inner-product search: queries (query_id, qvec), index (id, vec) -> (query_id, id, score, rank).

    Queries are broadcast against the partitioned index, in blocks of at most
    MOST_QUERIES (a stated query set against all rows); each Arrow batch is one
    matrix product, and only k rows a query and partition are exchanged. Equal
    scores are ordered by id. Vectors of another length than the queries have
    no score.
    """
    n = queries.count()
    blocks = max(1, -(-2 * n // MOST_QUERIES)) if n > MOST_QUERIES else 1
    if blocks == 1:
        return numbered(_scored(queries, index, k, digits), ["query_id"], F.desc("score"), F.col("id"), most=k)
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    parts = [_scored(dealt.where(F.col("_block") == i).drop("_block"), index, k, digits) for i in range(blocks)]
    return numbered(reduce(DataFrame.unionAll, parts), ["query_id"], F.desc("score"), F.col("id"), most=k)


def _scored(queries: DataFrame, index: DataFrame, k: int, digits: int) -> DataFrame:
    """(query_id, id, score): for each partition of the index the k best rows of each query."""
    asked = queries.select("query_id", "qvec").toArrow()
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {index.schema['id'].dataType.simpleString()}, score double"
    names = asked.column("query_id").combine_chunks()
    vectors = asked.column("qvec").to_pylist()
    dims = sorted({len(v) for v in vectors if v is not None})
    sides = [(np.array([i for i, v in enumerate(vectors) if v is not None and len(v) == dim]), dim) for dim in dims]
    sides = [(at, np.array([vectors[i] for i in at], np.float64)) for at, _ in sides]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in vectors]
        for batch in batches:
            ids, rows = batch.column("id").to_pylist(), batch.column("vec").to_pylist()
            for at, matrix in sides:
                fit = [i for i, v in enumerate(rows) if v is not None and len(v) == matrix.shape[1]]
                if not fit:
                    continue
                scores = np.round(matrix @ np.array([rows[i] for i in fit], np.float64).T, digits) + 0.0
                least = np.partition(scores, len(fit) - k, axis=1)[:, len(fit) - k] if k < len(fit) else np.full(len(at), -np.inf)
                for q, own, low in zip(at.tolist(), scores, least, strict=True):
                    best[q] += [(-own[j], ids[fit[j]]) for j in np.nonzero(own >= low)[0].tolist()]
                    if len(best[q]) > 4 * k:
                        best[q] = heapq.nsmallest(k, best[q])
        found = [(q, heapq.nsmallest(k, b)) for q, b in enumerate(best)]
        of = pa.array([q for q, b in found for _ in b], pa.int64())
        yield pa.RecordBatch.from_arrays([names.take(of), pa.array([i for _, b in found for _, i in b], types["id"]), pa.array([-s for _, b in found for s, _ in b], pa.float64())], ["query_id", "id", "score"])

    types = {"id": to_arrow_type(index.schema["id"].dataType)}
    return index.select("id", "vec").mapInArrow(run, kinds)


def dense_top_k_in_blocks(queries: DataFrame, index: DataFrame, k: int, digits: int = 9, rows: int = 8192) -> DataFrame:
    """The search of `dense_top_k` by another way, to hold against it: blocks of queries meet blocks of the index.

    Both sides are dealt by hashes into blocks of about `rows` rows, one task for
    a pair of blocks. Scores are sums of products without a matrix product, of a
    bounded piece of the pair at a time; whole rows of scores are sorted.
    """
    kind = queries.schema["query_id"].dataType.simpleString(), index.schema["id"].dataType.simpleString()
    across, down = (max(1, -(-df.count() // rows)) for df in (queries, index))
    q = queries.withColumn("_x", F.pmod(F.xxhash64("query_id"), F.lit(across)).cast("int")).withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    i = index.select("id", "vec").withColumn("_y", F.pmod(F.xxhash64("id"), F.lit(down)).cast("int")).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        asked, held = asked[asked["qvec"].notna()], held[held["vec"].notna()].sort_values("id")
        of, to = asked["qvec"].map(len), held["vec"].map(len)
        for dim in sorted(set(of) & set(to)):
            names, ids = asked["query_id"][of == dim].to_numpy(), held["id"][to == dim].to_numpy()
            a, b = (np.stack(list(x)).astype(np.float64) for x in (asked["qvec"][of == dim], held["vec"][to == dim]))
            for at in range(0, len(a), 256):
                scores = np.round(np.einsum("qd,nd->qn", a[at : at + 256], b, optimize=False), digits) + 0.0
                # ids ascend, so a stable order of scores breaks ties by id
                order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                n = order.shape[1]
                out.append(pd.DataFrame({"query_id": np.repeat(names[at : at + 256], n), "id": ids[order.ravel()], "score": np.take_along_axis(scores, order, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    met = q.groupBy("_x", "_y").cogroup(i.groupBy("_x", "_y")).applyInPandas(best, f"query_id {kind[0]}, id {kind[1]}, score double")
    return numbered(met, ["query_id"], F.desc("score"), F.col("id"), most=k)


def best_per_shot(ranked: DataFrame, meta: DataFrame, k: int) -> DataFrame:
    """Collapse keyframe hits to their shots, best first, hits without a shot dropped; (query_id, shot_key, timestamp_ms, score, rank)."""
    best = numbered(ranked.join(meta, "id"), ["query_id", "shot_key"], F.col("rank"), name="_of_shot", most=1)
    return numbered(best.drop("rank"), ["query_id"], F.desc("score"), F.col("id"), most=k).select("query_id", "shot_key", "timestamp_ms", "score", "rank")


def shot_search(queries: DataFrame, index: DataFrame, meta: DataFrame, k: int, oversample: int = 4) -> DataFrame:
    return best_per_shot(dense_top_k(queries, index, k * oversample), meta, k)


def sparse_top_k(queries: DataFrame, postings: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """queries (query_id, term, qw), postings (term, id, ord, dw) -> (query_id, id, score, rank); ties by ord.

    Weights that are not positive are ignored on both sides; documents without
    a shared term never appear. Queries are broadcast: where postings are dealt
    by id, scores need no exchange, and k rows a query and partition move.
    """
    asked = queries.where("qw > 0")
    # the filter goes below the counting of terms, which the join can't
    held = postings.where("dw > 0").join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    scored = (
        held.join(F.broadcast(asked), "term")
        .groupBy("query_id", "id", "ord").agg(F.round(F.sum(F.col("qw") * F.col("dw")), digits).alias("score"))
    )
    return numbered(scored, ["query_id"], F.desc("score"), F.col("ord"), most=k).select("query_id", "id", "score", "rank")


def _by(weights: DataFrame) -> list[str]:
    """Weights hold for a label, or for that of one query where they name it."""
    return ["query_id", "label"] if "query_id" in weights.columns else ["label"]


def rrf(rankings: DataFrame, weights: DataFrame, k: int = RRF_K, digits: int = 9) -> DataFrame:
    """Weighted reciprocal-rank fusion.

    rankings (query_id, label, rank, shot_key[, timestamp_ms]), weights (label,
    label_ord, weight). Labels without a weight are skipped; a shot that stands
    twice in a ranking adds twice; the timestamp comes from the heaviest label
    that gives one, the first of equals. -> (query_id, shot_key, score, timestamp_ms, rank)
    """
    stamped = rankings if "timestamp_ms" in rankings.columns else rankings.withColumn("timestamp_ms", F.lit(None).cast("bigint"))
    weighed = stamped.join(weights, _by(weights))
    best = F.when(F.col("timestamp_ms").isNotNull(), F.struct("weight", -F.col("label_ord"), -F.col("rank")))
    fused = weighed.groupBy("query_id", "shot_key").agg(F.round(F.sum(F.col("weight") / (F.lit(float(k)) + F.col("rank"))), digits).alias("score"), F.max_by("timestamp_ms", best).alias("timestamp_ms"))
    return numbered(fused, ["query_id"], F.desc("score"), F.col("shot_key"))


def fuse_windows(rankings: DataFrame, weights: DataFrame, meta: DataFrame, window_ms: int = WINDOW_MS, agreement: float = AGREEMENT, order_bonus: float = ORDER_BONUS, prior: DataFrame | None = None, label_order: DataFrame | None = None, k: int = RRF_K, digits: int = 9) -> DataFrame:
    """Temporal window fusion: a window is a shot with those up to window_ms before it in its video.

    Per window and label the best contribution counts; their sum is raised by
    `agreement` for each further channel and by `order_bonus` where at least two
    ordered labels appear in order, then the video's prior is added. The window
    goes to its shot of best plain fusion score, and each such shot takes its
    best window. Shots without a window follow in plain order. A window of 0
    is plain fusion. Contributions have twelve digits, so what a window adds
    may stand at a half of the last digit of its score: it is added in a fixed
    order. meta (shot_key, video_id, mid_ms); prior (query_id, video_id, prior);
    label_order (label, pos).
    -> (query_id, shot_key, score, in_window, rank)
    """
    parts = rankings.join(weights, _by(weights)).groupBy("query_id", "shot_key", "label").agg(F.sum(F.col("weight") / (F.lit(float(k)) + F.col("rank"))).alias("con"))
    base = parts.groupBy("query_id", "shot_key").agg(rounded(F.sum("con"), digits).alias("base"))
    if window_ms <= 0:
        plain = base.select("query_id", "shot_key", F.col("base").alias("score"), F.lit(False).alias("in_window"))
        return numbered(plain, ["query_id"], F.desc("score"), F.col("shot_key"))
    placed = base.join(meta, "shot_key")
    # a time bucket as wide as the window turns the band join into an equi-join on at most two buckets
    bucket = F.floor(F.col("mid_ms") / window_ms)
    heads = placed.select("query_id", "video_id", F.col("shot_key").alias("head"), F.col("mid_ms").alias("head_ms"), F.explode(F.array(bucket, bucket - 1)).alias("bucket"))
    members = placed.withColumn("bucket", bucket)
    before = (F.col("mid_ms") >= F.col("head_ms") - window_ms) & ((F.col("mid_ms") < F.col("head_ms")) | ((F.col("mid_ms") == F.col("head_ms")) & (F.col("shot_key") <= F.col("head"))))
    inside = heads.join(members, ["query_id", "video_id", "bucket"]).where(before).select("query_id", "video_id", "head", "shot_key", "mid_ms", "base")
    reps = inside.groupBy("query_id", "video_id", "head").agg(F.min_by("shot_key", F.struct(-F.col("base"), F.col("shot_key"))).alias("rep"))
    labels = inside.join(parts, ["query_id", "shot_key"]).withColumn("con", rounded(F.col("con"), 12))
    best = labels.groupBy("query_id", "head", "label").agg(F.max("con").alias("con"), F.min_by("mid_ms", F.struct(-F.col("con"), F.col("mid_ms"))).alias("at"))
    if label_order is not None:
        best = best.join(label_order, _by(label_order), "left")
    else:
        best = best.withColumn("pos", F.lit(None).cast("int"))
    line = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "at"))))
    summed = best.groupBy("query_id", "head").agg(added(F.col("con")).alias("total"), F.count_distinct(F.substring_index("label", ".", -1)).alias("channels"), line.alias("line"))
    in_order = (F.size("line") >= 2) & F.forall(F.sequence(F.lit(1), F.greatest(F.size("line"), F.lit(1))), lambda i: F.coalesce(F.get(F.col("line"), i)["at"] >= F.get(F.col("line"), i - 1)["at"], F.lit(True)))
    lifted = F.col("total") * (1 + F.lit(agreement) * (F.col("channels") - 1)) * F.when(in_order, 1 + order_bonus).otherwise(1.0)
    scored = summed.join(reps, ["query_id", "head"]).withColumn("score", lifted)
    if prior is not None:
        scored = scored.join(prior, ["query_id", "video_id"], "left").withColumn("score", F.col("score") + F.coalesce("prior", F.lit(0.0)))
    top = scored.groupBy("query_id", F.col("rep").alias("shot_key")).agg(rounded(F.max("score"), digits).alias("score")).withColumn("in_window", F.lit(True))
    tail = base.join(top, ["query_id", "shot_key"], "left_anti").select("query_id", "shot_key", F.col("base").alias("score"), F.lit(False).alias("in_window"))
    return numbered(top.unionByName(tail), ["query_id"], F.desc("in_window"), F.desc("score"), F.col("shot_key"))


def video_prior(ranked_videos: DataFrame, weight: float = PRIOR, k: int = RRF_K) -> DataFrame:
    """(query_id, video_id, rank) -> prior: weight / (k + rank)."""
    return ranked_videos.select("query_id", "video_id", (F.lit(weight) / (F.lit(float(k)) + F.col("rank"))).alias("prior"))


def ground(candidates: DataFrame, meta: DataFrame, top_k: int) -> DataFrame:
    """The first top_k candidates, then an inner join to (shot_key, video_id, start_ms, end_ms): shots without metadata shrink the result."""
    middle = F.expr("(start_ms + end_ms) div 2")
    found = candidates.where(F.col("rank") <= top_k).join(meta, "shot_key")
    return found.select("query_id", "video_id", F.coalesce("timestamp_ms", middle).alias("timestamp_ms"), "score", "rank")


def rocchio(query: DataFrame, positives: DataFrame, negatives: DataFrame, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.25, digits: int = 6) -> DataFrame:
    """(query_id, qvec) moved towards the mean of positives and away from that of negatives (query_id, vec), renormalised."""

    def centroid(rows: DataFrame, name: str) -> DataFrame:
        means = rows.select("query_id", F.posexplode("vec").alias("pos", "x")).groupBy("query_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
        return means.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias(name))

    joined = query.join(centroid(positives, "p"), "query_id", "left").join(centroid(negatives, "n"), "query_id", "left")
    zero = F.transform("qvec", lambda x: F.lit(0.0))
    moved = F.zip_with(F.zip_with("qvec", F.coalesce("p", zero), lambda q, p: alpha * q.cast("double") + beta * p), F.coalesce("n", zero), lambda a, n: a - gamma * n)
    return joined.select("query_id", moved.alias("v")).select("query_id", F.transform(normalised(F.col("v")), lambda x: F.round(x, digits)).alias("qvec"))


def maxsim(query_vecs: Column, doc_vecs: Column) -> Column:
    """Mean over query vectors of the best inner product with a document vector; 0 where either is empty."""
    best = F.transform(query_vecs, lambda q: F.array_max(F.transform(doc_vecs, lambda d: dot(q, d))))
    total = F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(query_vecs) > 0) & (F.size(doc_vecs) > 0), total / F.size(query_vecs)).otherwise(0.0)


def rerank(candidates: DataFrame, scores: DataFrame, pool: int) -> DataFrame:
    """The first `pool` candidates by (score desc, shot_key), those of them without a score after, the rest in their order."""
    joined = candidates.join(scores.select("query_id", "shot_key", F.col("score").alias("new")), ["query_id", "shot_key"], "left")
    part = F.when(F.col("rank") > pool, 2).when(F.col("new").isNull(), 1).otherwise(0)
    ordered = joined.withColumn("part", part).withColumnRenamed("rank", "old_rank")
    return numbered(ordered, ["query_id"], F.col("part"), F.when(F.col("part") == 0, -F.col("new")), F.when(F.col("part") == 0, F.col("shot_key")), F.col("old_rank")).drop("new")


def listwise(candidates: DataFrame, listed: DataFrame, pool: int) -> DataFrame:
    """Apply a given order (query_id, pos, shot_key) to the first `pool` candidates; first mention counts, others keep their order."""
    first = listed.groupBy("query_id", "shot_key").agg(F.min("pos").alias("pos"))
    joined = candidates.withColumnRenamed("rank", "old_rank").join(first, ["query_id", "shot_key"], "left")
    known = (F.col("old_rank") <= pool) & F.col("pos").isNotNull()
    return numbered(joined, ["query_id"], F.when(known, 0).when(F.col("old_rank") <= pool, 1).otherwise(2), F.when(known, F.col("pos")), F.col("old_rank")).drop("pos")


def without_negated(candidates: DataFrame, evidence: DataFrame, negations: list[str]) -> DataFrame:
    """Drop candidates whose evidence text holds a negated phrase, both case-folded; blank phrases and candidates without evidence don't count."""
    needles = [n.casefold() for n in negations if n.strip()]
    if not needles:
        return candidates
    folded = T.casefold(F.coalesce("evidence", F.lit("")))
    # folded once for each text with evidence, not for each candidate
    told = evidence.withColumn("_folded", folded).where(reduce(lambda a, b: a | b, [F.contains("_folded", F.lit(n)) for n in needles]))
    return candidates.join(told.select("shot_key").distinct(), "shot_key", "left_anti")


def without_own_negated(candidates: DataFrame, evidence: DataFrame, negations: DataFrame) -> DataFrame:
    """The same where each query (query_id, negations) has phrases of its own."""
    phrases = negations.select("query_id", F.explode("negations").alias("phrase")).where(T.strip(F.col("phrase")) != "").withColumn("phrase", T.casefold("phrase"))
    told = candidates.select("query_id", "shot_key").join(phrases, "query_id").join(evidence.withColumn("_folded", T.casefold("evidence")), "shot_key")
    hit = told.where(F.contains("_folded", F.col("phrase"))).select("query_id", "shot_key").distinct()
    return candidates.join(hit, ["query_id", "shot_key"], "left_anti")


def narrowed(before: DataFrame, now: DataFrame) -> DataFrame:
    """`now` (key, ord) restricted to `before` (key), unless nothing would be left."""
    common = now.join(before.select("key"), "key", "left_semi")
    return common if not common.isEmpty() else now


def plan_labels(spec: DataFrame, fields: DataFrame, weights: DataFrame) -> DataFrame:
    """Dispatch plan: spec (query_id, field, items) x fields (field, field_ord, channel, field_weight) x weights (channel, channel_weight)."""
    items = spec.select("query_id", "field", F.posexplode("items").alias("item_ord", "text"))
    joined = items.join(F.broadcast(fields), "field").join(F.broadcast(weights), "channel")
    label = F.concat(F.col("field"), F.col("item_ord").cast("string"), F.lit("."), F.col("channel"))
    planned = joined.select("query_id", label.alias("label"), "channel", "text", (F.col("field_weight") * F.col("channel_weight")).alias("weight"), "field_ord", "item_ord")
    return numbered(planned, ["query_id"], F.col("field_ord"), F.col("item_ord"), F.col("channel"), name="label_ord")


def chunk_labels(plan: DataFrame, channel: str, most: int) -> DataFrame:
    """Split the texts of a channel's sub-queries into sentences; each chunk is a label of its own with its position, and carries an equal share of the weight."""
    split = plan.where(F.col("channel") == channel).withColumn("parts", T.sentences(F.col("text"), most)).withColumn("n", F.size("parts"))
    chunks = split.select("query_id", F.col("label").alias("parent"), "channel", "weight", "n", F.posexplode("parts").alias("pos", "text"))
    name = F.when(F.col("n") == 1, F.col("parent")).otherwise(F.concat(F.substring_index("parent", ".", 1), F.lit("c"), F.col("pos").cast("string"), F.lit("."), F.col("channel")))
    rest = plan.where(F.col("channel") != channel).select("query_id", "label", "channel", "text", "weight", F.lit(None).cast("int").alias("pos"))
    return chunks.select("query_id", name.alias("label"), "channel", "text", (F.col("weight") / F.col("n")).alias("weight"), F.when(F.col("n") > 1, F.col("pos")).alias("pos")).unionByName(rest)


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per query of two rankings (query_id, id, rank, score): whether the id lists are equal, and the greatest difference of scores."""
    both = a.select("query_id", "rank", F.col("id").alias("id_a"), F.col("score").alias("s_a")).join(b.select("query_id", "rank", F.col("id").alias("id_b"), F.col("score").alias("s_b")), ["query_id", "rank"], "full_outer")
    return both.groupBy("query_id").agg(F.bool_and(F.col("id_a").eqNullSafe(F.col("id_b"))).alias("same"), F.max(F.abs(F.col("s_a") - F.col("s_b"))).alias("drift"))


def mean_vector(rows: DataFrame, by: str, digits: int = 6) -> DataFrame:
    """(by, vec): renormalised mean of the vectors of each group."""
    means = rows.select(by, F.posexplode("vec").alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    listed = means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v"))
    return listed.select(by, F.transform(normalised(F.col("v")), lambda x: F.round(x, digits)).alias("vec"))
