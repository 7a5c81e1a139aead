"""Registered queries on answers, evaluation, coverage, query performance and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import evaluation as EV
from ..operators import evidence as E
from ..operators import ranking as R
from ..sources import views as V
from ..streaming import sessions as S
from .catalog_ranking import POSTINGS_SQL, RRF_SQL, _rankings, _sparse, _weights
from .registry import query

READS_SQL = """rd as (select conv_id question_id, turn ord, case turn % 3 when 0 then ' Yes ' when 1 then 'no' else 'TRUE' end answer, (length(text) % 10)/10.0::double score from conversations),
 gk as (select *, lower(trim(answer)) normalized from rd)"""


def _reads(spark, d):
    t = F.col("turn")
    answer = F.when(t % 3 == 0, " Yes ").when(t % 3 == 1, "no").otherwise("TRUE")
    return V.table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), t.alias("ord"), answer.alias("answer"), F.lit("yes_no").alias("kind"), ((F.length("text") % 10).cast("double") / 10.0).alias("score"))


VOTE_SQL = f"""with {READS_SQL}, gg as (select question_id, normalized, arg_min(answer, ord) answer, count(*) reads, sum(score) s from gk group by all), vv as (select question_id, normalized, answer, reads, round(s*(case when question_id % 4 = 0 and normalized='no' then 1.25 else 1.0 end),9) score, (question_id % 4 = 0 and normalized='no') agrees from gg)
 , vo as (select question_id, normalized, answer, reads, score, agrees, true valid, (agrees or score >= 1.5) confident, row_number() over (partition by question_id order by score desc, normalized) rank from vv)"""


def _votes(spark, d):
    track = V.table(spark, d, "conversations").where("conv_id % 4 = 0").select(F.col("conv_id").alias("question_id"), F.lit("no").alias("normalized")).distinct()
    return A.vote(_reads(spark, d), track, 0.25, 1.5)


@query("a11_vote", VOTE_SQL + " select * from vo")
def vote(spark, d):
    return _votes(spark, d)


@query("x04_disconfirm", VOTE_SQL + ", n as (select question_id, count(*) n from vo group by all) select question_id, normalized, case when question_id % 3 = 0 and n >= 2 then 3-rank else rank end rank from vo join n using (question_id)")
def disconfirm(spark, d):
    groups = _votes(spark, d)
    return A.swap_disconfirmed(groups, groups.where("question_id % 3 = 0").select("question_id")).select("question_id", "normalized", "rank")


@query("a12_reconciled_median", "select user_id, event_type, cast(round_even(median(event_id % 7)::double, 0) as int) count from events group by all having cast(round_even(median(event_id % 7)::double, 0) as int) >= 3")
def median_counts(spark, d):
    return A.reconciled_counts(V.table(spark, d, "events").withColumn("n", F.col("event_id") % 7), ["user_id", "event_type"], False, 3)


@query("a12_reconciled_native", "select user_id, cast(max(event_id % 7) as int) count from events group by all")
def native_counts(spark, d):
    return A.reconciled_counts(V.table(spark, d, "events").withColumn("n", F.col("event_id") % 7), ["user_id"], True)


@query("p30_union_box", "select l_orderkey, min(l_partkey) x0, min(l_suppkey) y0, max(l_partkey) x1, max(l_suppkey) y1 from lineitem group by all")
def union_box(spark, d):
    line = V.table(spark, d, "lineitem").select("l_orderkey", *[F.col(c).alias(n) for n, c in (("x0", "l_partkey"), ("y0", "l_suppkey"), ("x1", "l_partkey"), ("y1", "l_suppkey"))])
    return A.union_box(line, ["l_orderkey"])


@query("f14_adjudicate", "select event_id, abs(event_id % 7 - user_id % 5) <= 1 agree, case when abs(event_id % 7 - user_id % 5) <= 1 then user_id % 5 else event_id % 7 end n from events")
def adjudicate(spark, d):
    a, b = F.col("event_id") % 7, F.col("user_id") % 5
    return V.table(spark, d, "events").select("event_id", A.adjudicate(a, b, 1).alias("agree"), A.count_result(a, b, 1).alias("n"))


@query("f09_weak_locator", f"{V.with_views('hit')}, p as (select label query_id, max(score)/median(score) peak from hit where rank <= 20 group by all) select query_id, round(peak, 9) peak, (query_id <> 'click' or peak < 1.2) weak from p")
def weak(spark, d):
    peaks = A.peakiness(V.hits(spark, d).withColumnRenamed("label", "query_id"), 20)
    return peaks.select("query_id", F.round("peak", 9).alias("peak"), A.weak_locator(F.col("peak"), F.col("query_id") == "click", 1.2).alias("weak"))


@query("f10_double_gate", f"{V.with_views('hit')}, n as (select label, count(*) n, max(score) best from hit group by label), p as (select label, case when median(score) > 0 then max(score)/median(score) else 1.0 end peak from hit where rank <= 50 group by label) select label query_id from n join p using (label) where (n = 1 or peak >= 1.01) and best >= 50")
def gate(spark, d):
    h = V.hits(spark, d).withColumnRenamed("label", "query_id")
    return A.double_gate(h, h.groupBy("query_id").agg(F.max("score").alias("locator")), 50, 1.01, 50.0)


@query("f15_hint", "select event_id, case when user_id % 10 >= 7 then 'wait_for_reads' when value > 200 then 'submit_now' when event_id % 3 = 0 then 'wait_for_reads' else 'escalate_zoom' end hint from events")
def hint(spark, d):
    return V.table(spark, d, "events").select("event_id", A.hint(F.lit(7), F.col("value") > 200, F.col("event_id") % 3 == 0, F.col("user_id") % 10).alias("hint"))


@query("x10_answer_matches", "select p_partkey, p_partkey % 100 in (5, 6) ok from part")
def matches(spark, d):
    said = F.concat((F.col("p_partkey") % 100).cast("string"), F.lit(" lần"))
    rows = V.table(spark, d, "part").select("p_partkey", said.alias("answer"), F.array(F.lit("năm"), F.lit("6"), F.lit("")).alias("accepted"), F.lit("number").alias("kind"))
    return A.matches(rows, ["p_partkey"])


@query("x07_seed_hypotheses", """with r as (select event_id rank, 'q' query_id, [event_type, 'u' || (user_id % 4)] n from events), f as (select query_id, unnest(n) as name, rank, generate_subscripts(n,1) pos from r where rank <= 20), g as (select query_id, name, min((rank,pos)) p from f group by all)
 select query_id, name, row_number() over (order by p) ord from g""")
def seeds(spark, d):
    e = V.table(spark, d, "events").select(F.lit("q").alias("query_id"), F.col("event_id").alias("rank"), F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string"))).alias("spoken_entities"))
    return A.seed_hypotheses(e, 20)


HITS_SQL = f"with {POSTINGS_SQL}, tr as (select b.item_id query_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text)), rk as (select b.item_id query_id, min(sr.rank) rank from benchmark b left join tr on b.item_id=tr.query_id left join sr on sr.query_id=tr.query_id and sr.id=tr.doc_id and sr.rank <= 100 where b.item_id in (select query_id from tr) group by all)"


def _first_ranks(spark, d):
    results = _sparse(spark, d, 100).select("query_id", F.col("id").cast("string").alias("video_id"), F.lit(0).alias("timestamp_ms"), "rank")
    b, docs = V.table(spark, d, "benchmark"), V.table(spark, d, "documents")
    held = E.phrase_documents(docs.select(F.col("doc_id").alias("id"), "text"), b.select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase")))
    truths = held.select("query_id", F.col("id").cast("string").alias("video_id"), F.lit(0).alias("t_start_ms"), F.lit(10).alias("t_end_ms"))
    return EV.first_hits(results, truths)


@query("j05_first_hits", HITS_SQL + " select * from rk")
def first_hits(spark, d):
    return _first_ranks(spark, d)


@query("a09_summary", HITS_SQL + """ select count(*) n_cases, count(*) filter (where rank is null) n_misses, avg((coalesce(rank,999)<=1)::int) recall_1, avg((coalesce(rank,999)<=5)::int) recall_5, avg((coalesce(rank,999)<=10)::int) recall_10, avg((coalesce(rank,999)<=100)::int) recall_100,
 median(coalesce(rank,200)) median_rank, avg(coalesce(rank,200)) mean_rank, avg(least(coalesce(rank,200),200)*1.5::double) mean_ttt_s from rk""")
def summary(spark, d):
    return EV.summary(_first_ranks(spark, d))


@query("a10_answer_rates", f"{V.with_views('qa')} select archetype, count(*) n_cases, round(avg(answer_ok::int),9) answer_rate, round(avg(moment_ok::int),9) moment_rate, round(avg((answer_ok and moment_ok)::int),9) joint_rate from qa group by rollup(archetype)")
def rates(spark, d):
    return EV.answer_rates(V.outcomes(spark, d))


COVER_SQL = f"""{V.with_views('shot', 'seg')}, cv as (select s.video_id, s.shot_id, exists(select 1 from seg where seg.video_id=s.video_id and seg.end_ms > s.start_ms and seg.start_ms < s.end_ms) a, s.shot_id % 3 = 0 o from shot s),
 cc as (select video_id, count(*) n_shots, count(*) filter (where a) n_asr, count(*) filter (where o) n_ocr, 0 n_caption, 0 n_entities, count(*) filter (where not a and not o) n_bare from cv group by all)"""


def _coverage(spark, d):
    shots = V.shots(spark, d)
    speech = E.align_segments(V.segments(spark, d), shots).select("video_id", "shot_id", F.lit(True).alias("has_asr"))
    flags = shots.join(speech, ["video_id", "shot_id"], "left").withColumn("has_ocr", F.col("shot_id") % 3 == 0).withColumn("has_caption", F.lit(False)).withColumn("has_entities", F.lit(False))
    return EV.video_coverage(flags)


@query("a14_coverage", COVER_SQL + " select * from cc")
def coverage(spark, d):
    return _coverage(spark, d)


@query("a15_concentration", COVER_SQL + " select round(sum(n_asr)/sum(n_shots),9) coverage, round(max(n_asr)/sum(n_asr),9) hub_share, arg_min(video_id, (-n_asr, video_id)) hub, round(stddev_pop(n_asr)/avg(n_asr),9) cv from cc")
def concentration(spark, d):
    return EV.concentration(_coverage(spark, d), "n_asr")


@query("f13_coverage_warnings", COVER_SQL + ", r as (select round(sum(n_asr)/sum(n_shots),9) coverage, round(max(n_asr)/sum(n_asr),9) hub_share from cc) select coverage, unnest(list_filter([case when coverage < 0.9 then 'coverage' end, case when hub_share > 0.05 then 'hub' end], lambda x: x is not null)) reason from r")
def warnings(spark, d):
    return EV.coverage_warnings(EV.concentration(_coverage(spark, d), "n_asr"), 0.9, 0.05).select("coverage", "reason")


@query("a16_percentiles", "with r as (select event_type, value, row_number() over (partition by event_type order by value)-1 i, count(*) over (partition by event_type) n from events) select event_type, median(value) p50, max(value) filter (where i = cast(round_even(0.95::double*(n-1), 0) as int)) p95, max(value) max, count(*) n from r group by all")
def percentiles(spark, d):
    return EV.percentiles(V.table(spark, d, "events"), ["event_type"], "value")


@query("a17_next_question", """with u as (select 0 i, 'lang' attribute, lang v from documents union all select 1, 'source', source from documents), c as (select i, attribute, v, count(*) n from u group by all), p as (select *, n/sum(n) over (partition by i) p from c)
 select attribute, round(sum(-p*log2(p)),9) entropy from p group by i, attribute having count(*) > 1 order by 2 desc, i limit 1""")
def question(spark, d):
    return EV.next_question(V.table(spark, d, "documents"), ["lang", "source"])


TOPS_SQL = f"""{V.with_views('hit')}, tp as (select video_id query_id, label channel, 'd' || (mid_ms // 86400000) shot_key, min(row_n) rank from (select *, row_number() over (partition by video_id, label order by rank) row_n from hit) where row_n <= 20 group by all)"""


def _tops(spark, d):
    rows = V.hits(spark, d).select(F.col("video_id").alias("query_id"), "label", F.concat(F.lit("d"), F.floor(F.col("mid_ms") / 86_400_000).cast("string")).alias("shot_key"), F.col("rank").alias("r"))
    return R.numbered(rows, ["query_id", "label"], F.col("r"), most=20)


@query("q01_channel_ranks", TOPS_SQL + " select * from tp")
def channel_ranks(spark, d):
    return EV.top_shots(_tops(spark, d), 20)


@query("q03_agreement", TOPS_SQL + """, qq as (select distinct query_id, channel from tp), pr as (select a.query_id, a.channel a, b.channel b from qq a join qq b on a.query_id=b.query_id and a.channel < b.channel),
 un as (select distinct p.query_id, p.a, p.b, t.shot_key from pr p join tp t on t.query_id=p.query_id and t.channel in (p.a, p.b)), rr as (select u.*, coalesce(x.rank,21) ra, coalesce(y.rank,21) rb from un u left join tp x on x.query_id=u.query_id and x.channel=u.a and x.shot_key=u.shot_key left join tp y on y.query_id=u.query_id and y.channel=u.b and y.shot_key=u.shot_key),
 co as (select query_id, a, b, case when count(*) < 2 or stddev_pop(ra)=0 or stddev_pop(rb)=0 then 0 else corr(ra, rb) end rho from rr group by all), mm as (select query_id, round(avg(rho),6) agreement from co group by all) select q.query_id, coalesce(agreement,0) agreement from (select distinct query_id from tp) q left join mm using (query_id)""")
def agreement(spark, d):
    return EV.agreement(_tops(spark, d), ["click", "error", "purchase", "signup", "view"], 20, 6)


@query("a23_compactness", RRF_SQL + ", g as (select query_id, shot_key, row_number() over (partition by query_id order by score desc, shot_key) rank from f), t as (select g.*, hit.video_id from g join hit using (shot_key) where g.rank <= 50) select query_id, round(max(n)/50.0, 9) compactness from (select query_id, video_id, count(*) n from t group by all) group by query_id")
def compactness(spark, d):
    fused = R.rrf(_rankings(spark, d), _weights(spark))
    return EV.compactness(fused, V.hits(spark, d), 50)


@query("q05_probability", "select event_id, round(case when p <= 0.2 then 0.1 when p <= 0.8 then 0.1 + (p-0.2)*(0.8/0.6) else 0.9 end, 9) p from (select event_id, 1/(1+exp(-(-1.0::double + value*0.02::double + (user_id % 3)*0.5::double))) p from events)")
def probability(spark, d):
    p = EV.probability([F.col("value"), (F.col("user_id") % 3).cast("double")], [0.02, 0.5], -1.0, [0.2, 0.8], [0.1, 0.9])
    return V.table(spark, d, "events").select("event_id", F.round(p, 9).alias("p"))


@query("a25_brier", "select round(avg(pow((toxic*0.5::double+0.25) - quality, 2)),9) brier from labels")
def brier(spark, d):
    return EV.brier(V.table(spark, d, "labels").withColumn("p", F.col("toxic") * 0.5 + 0.25), "p", "quality")


@query("f12_vector_health", "select count(*) n, 0 wrong_dim, 0 not_finite, round(max(abs(sqrt(list_sum([x::double*x::double for x in embedding]))-1)),6) norm_error from embeddings")
def health(spark, d):
    return EV.vector_health(V.table(spark, d, "embeddings").select(F.col("embedding").alias("vec")), 64)


@query("a26_channel_audit", RRF_SQL + """, g as (select shot_key, row_number() over (order by score desc, shot_key) rank from f), e as (select shot_key from hit where mid_ms % 5 = 0), j as (select rank, shot_key in (select shot_key from e) ok from g)
 select min(rank) filter (where ok) first_exact, count(*) filter (where ok and rank<=1) exact_1, count(*) filter (where ok and rank<=3) exact_3, count(*) filter (where ok and rank<=5) exact_5, count(*) filter (where ok and rank<=10) exact_10, count(*) filter (where ok and rank<=100) exact_100 from j""")
def audit(spark, d):
    return EV.channel_audit(R.rrf(_rankings(spark, d), _weights(spark)), V.hits(spark, d).where("mid_ms % 5 = 0"))


@query("e03_fixture_violations", """select query_id, rule from (values ('b','text missing'),('c','reveals missing'),('d','question missing'),('e','truth reversed'),('a','id repeated'),('e','truth outside corpus')) t(query_id, rule)""")
def fixture(spark, d):
    kind = "query_id string, kind string, text string, clip_path string, reveals array<string>, question string, accepted_answers array<string>, truths array<struct<video_id:string,t_start_ms:bigint,t_end_ms:bigint>>"
    ok = [("V000", 0, 10)]
    rows = [("a", "kis_t", "x", None, None, None, None, ok), ("a", "kis_v", None, "p", None, None, None, ok), ("b", "kis_t", " ", None, None, None, None, ok), ("c", "kis_c", "x", None, [], None, None, ok), ("d", "qa", None, None, None, "?", [], ok), ("e", "kis_t", "x", None, None, None, None, [("V999", 9, 1)])]
    return EV.fixture_violations(spark.createDataFrame(rows, kind), V.shots(spark, d).select("video_id").distinct())


@query("e04_sampled_windows")
def windows(spark, d):
    return EV.sampled_windows(V.keyframes(spark, d).select("video_id", "timestamp_ms", F.col("keyframe_id").alias("image_path")), 40, 9000, 3)


@query("e05_round_robin", "select doc_id, ['entity','read_text','other'][(row_number() over (order by doc_id)-1) % 3 + 1] as mode from labels")
def robin(spark, d):
    return EV.round_robin(V.table(spark, d, "labels").select("doc_id"), ["entity", "read_text", "other"], "doc_id")


@query("t02_constraints", """with r as (select conv_id session_id, list(regexp_replace(text, '^\\s+|\\s+$', '', 'g') order by turn) t from conversations group by all), n as (select session_id, list_filter(t, lambda x: x<>'') t, len(t) version from r)
 select session_id, case when len(t) <= 3 then t else list_concat([array_to_string(t[1:len(t)-2], '; ')], t[len(t)-1:]) end stack, version from n""")
def stacks(spark, d):
    return S.folded(V.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "text"), 3)


@query("t03_narrowed_sets")
def narrowed(spark, d):
    keys = F.array_distinct(F.split("text", " "))
    return S.narrowed_sets(V.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), keys.alias("keys")))


@query("t04_fresh", "with v as (select conv_id session_id, count(*) version from conversations group by all) select c.conv_id session_id, turn seen_version, turn = version accepted from conversations c join v on v.session_id=c.conv_id")
def fresh(spark, d):
    c = V.table(spark, d, "conversations")
    versions = c.groupBy(F.col("conv_id").alias("session_id")).agg(F.count(F.lit(1)).alias("version"))
    return S.fresh(c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seen_version")), versions).select("session_id", "seen_version", "accepted")


@query("t01_live_sessions", "select user_id session_id, max(epoch_us(ts)//1000) as at from events group by user_id order by 2 desc, 1 limit 10")
def live(spark, d):
    return S.live(V.hits(spark, d).select(F.col("video_id").cast("bigint").alias("session_id"), F.col("mid_ms").alias("at")), 10)


@query("t08_default_frame", f"{V.with_views('shot')}, r as (select shot_key, start_ms+2100 ts from shot) select r.shot_key, ts timestamp_ms, arg_min(keyframe_id, (abs(timestamp_ms-ts), frame_idx)) keyframe_id from r join kf using (shot_key) group by all")
def default_frame(spark, d):
    results = V.shots(spark, d).select(F.lit("q").alias("query_id"), "shot_key", (F.col("start_ms") + 2100).alias("timestamp_ms"))
    frames = V.keyframes(spark, d).select("shot_key", F.col("frame_idx").alias("ord"), "keyframe_id", F.col("timestamp_ms").alias("at_ms"))
    return S.default_frame(results, frames).drop("query_id")


@query("t09_answer_queue", "with a as (select event_type session_id, event_id seq, 'V' || (user_id % 10) video_id, event_id % 40 frame_id from events), f as (select session_id, video_id, frame_id, min(seq) seq from a group by all), r as (select *, row_number() over (partition by session_id order by seq) place from f) select * from r where place <= 100")
def queue(spark, d):
    e = V.table(spark, d, "events")
    return S.answer_queue(e.select(F.col("event_type").alias("session_id"), F.col("event_id").alias("seq"), F.concat(F.lit("V"), (F.col("user_id") % 10).cast("string")).alias("video_id"), (F.col("event_id") % 40).alias("frame_id")))


