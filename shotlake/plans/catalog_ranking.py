"""Registered queries on search, fusion and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import ranking as R
from ..sources import views as V
from .registry import query

W_DAY = 86_400_000


def _weights(spark):
    return spark.createDataFrame([("click", 0, 1.0), ("purchase", 1, 1.5), ("view", 2, 0.8), ("signup", 3, 0.5)], "label string, label_ord int, weight double")


WEIGHTS_SQL = "w as (select * from (values ('click',0,1.0::double),('purchase',1,1.5::double),('view',2,0.8::double),('signup',3,0.5::double)) t(label,label_ord,weight))"


def _rankings(spark, d):
    return V.hits(spark, d).select(F.lit("q").alias("query_id"), "label", "rank", "shot_key", F.col("mid_ms").alias("timestamp_ms"), "video_id")


RANKINGS_SQL = "r as (select 'q' query_id, label, rank, shot_key, mid_ms timestamp_ms, video_id from hit)"


def _meta(spark, d):
    return V.hits(spark, d).select("shot_key", "video_id", "mid_ms")


def _vector_index(spark, d):
    kf = V.keyframes(spark, d)
    return kf.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), kf.select(F.col("vec_id").alias("id"), "shot_key", "timestamp_ms"), kf.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


DENSE_SQL = """sc as (select q.vec_id query_id, k.vec_id id, round(list_sum(list_transform(list_zip(q.embedding, k.embedding), lambda x: x[1]::double*x[2]::double)), 9) score, k.shot_key, k.timestamp_ms
  from kf k cross join (select vec_id, embedding from kf where vec_id % 20 = 0) q),
  top as (select *, row_number() over (partition by query_id order by score desc, id) rank from sc)"""


@query("k01_dense_top_k", f"{V.with_views('kf')}, {DENSE_SQL} select query_id, id, score, rank from top where rank <= 10")
def dense(spark, d):
    index, _, queries = _vector_index(spark, d)
    return R.dense_top_k(queries, index, 10)


@query("k03_shot_search", f"""{V.with_views('kf')}, {DENSE_SQL}, b as (select *, row_number() over (partition by query_id, shot_key order by rank) n from top where rank <= 40),
  s as (select query_id, shot_key, timestamp_ms, score, row_number() over (partition by query_id order by score desc, id) rank from b where n = 1) select * from s where rank <= 10""")
def shot_search(spark, d):
    index, meta, queries = _vector_index(spark, d)
    return R.shot_search(queries, index, meta, 10, 4)


@query("k04_similar_shots", f"""{V.with_views('kf')}, {DENSE_SQL}, t as (select *, row_number() over (partition by query_id order by score desc, id) r2 from sc where id <> query_id),
  b as (select *, row_number() over (partition by query_id, shot_key order by r2) n from t where r2 <= 20),
  s as (select query_id, shot_key, timestamp_ms, score, row_number() over (partition by query_id order by score desc, id) rank from b where n = 1) select * from s where rank <= 5""")
def similar(spark, d):
    index, meta, queries = _vector_index(spark, d)
    found = R.dense_top_k(queries, index, 21).where("id <> query_id").drop("rank")
    again = R.numbered(found, ["query_id"], F.desc("score"), F.col("id"), most=20)
    return R.best_per_shot(again, meta, 5)


POSTINGS_SQL = r"""tm as (select doc_id id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) term from documents), pt as (select id, term, 1.0+ln(count(*)::double) dw from tm where term<>'' group by all),
  qt as (select query_id, term, 1.0+ln(count(*)::double) qw from (select item_id query_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) term from benchmark) where term<>'' group by all),
  ss as (select query_id, id, round(sum(qw*dw), 6) score from qt join pt using (term) group by all), sr as (select *, row_number() over (partition by query_id order by score desc, id) rank from ss)"""


def _sparse(spark, d, k):
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("doc_id").alias("ord"))
    queries = V.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit(0).alias("ord"))
    terms = E.postings(queries).select(F.col("id").alias("query_id"), "term", F.col("dw").alias("qw"))
    return R.sparse_top_k(terms, E.postings(docs), k)


@query("k02_sparse_top_k", f"with {POSTINGS_SQL} select query_id, id, score, rank from sr where rank <= 20")
def sparse(spark, d):
    return _sparse(spark, d, 20)


@query("r13_postings", r"with " + POSTINGS_SQL.split(", qt as")[0].rstrip(",\n ") + " select term, count(*) docs, round(sum(dw), 4) weight from pt group by term")
def postings(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("doc_id").alias("ord"))
    return E.postings(docs).groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.round(F.sum("dw"), 4).alias("weight"))


RRF_SQL = f"""{V.with_views('hit')}, {WEIGHTS_SQL}, {RANKINGS_SQL}, f as (select query_id, shot_key, round(sum(weight/(60.0::double+rank)),9) score, arg_max(timestamp_ms, (weight, -label_ord, -rank)) timestamp_ms from r join w using (label) group by all)"""


@query("r02_weighted_rrf", RRF_SQL + " select *, row_number() over (partition by query_id order by score desc, shot_key) rank from f")
def weighted_rrf(spark, d):
    return R.rrf(_rankings(spark, d), _weights(spark))


WINDOW_SQL = f"""{V.with_views('hit')}, {WEIGHTS_SQL}, {RANKINGS_SQL}, con as (select query_id, shot_key, label, sum(weight/(60.0::double+rank)) con from r join w using (label) group by all),
 base as (select query_id, shot_key, round(sum(con),9) base from con group by all), pl as (select base.*, hit.video_id, hit.mid_ms from base join hit using (shot_key)),
 ins as (select h.query_id, h.video_id, h.shot_key head, m.shot_key, m.mid_ms, m.base from pl h join pl m on h.query_id=m.query_id and h.video_id=m.video_id and m.mid_ms >= h.mid_ms - {W_DAY} and (m.mid_ms < h.mid_ms or (m.mid_ms = h.mid_ms and m.shot_key <= h.shot_key))),
 rep as (select query_id, head, arg_min(shot_key, (-base, shot_key)) rep from ins group by all),
 bl as (select i.query_id, i.head, c.label, max(round(c.con,12)) con, arg_min(i.mid_ms, (-round(c.con,12), i.mid_ms)) at_ms from ins i join con c on i.query_id=c.query_id and i.shot_key=c.shot_key group by all),
 sm as (select query_id, head, sum(con) total, count(distinct label) channels, bool_and(case when label='view' then true else true end) ok,
   max(case when label='view' then at_ms end) v_at, max(case when label='purchase' then at_ms end) p_at from bl group by all),
 sc as (select sm.query_id, rep.rep shot_key, round(max(total*(1+0.25*(channels-1))*(case when v_at is not null and p_at is not null and p_at >= v_at then 1.1 else 1.0 end)),9) score from sm join rep using (query_id, head) group by all),
 u as (select query_id, shot_key, score, true in_window from sc union all select query_id, shot_key, base, false from base where (query_id, shot_key) not in (select query_id, shot_key from sc))
 select *, row_number() over (partition by query_id order by in_window desc, score desc, shot_key) rank from u"""


@query("r03_window_fusion", WINDOW_SQL)
def window_fusion(spark, d):
    order = spark.createDataFrame([("view", 0), ("purchase", 1)], "label string, pos int")
    return R.fuse_windows(_rankings(spark, d), _weights(spark), _meta(spark, d), W_DAY, 0.25, 0.1, label_order=order)


@query("j03_ground", RRF_SQL + """, g as (select *, row_number() over (partition by query_id order by score desc, shot_key) rank from f)
 select query_id, video_id, timestamp_ms, score, g.rank from g join (select shot_key, video_id from hit where hash_ok) using (shot_key) where g.rank <= 50""".replace("hash_ok", "mid_ms % 2 = 0"))
def ground(spark, d):
    fused = R.rrf(_rankings(spark, d), _weights(spark))
    meta = _meta(spark, d).where("mid_ms % 2 = 0").select("shot_key", "video_id", F.col("mid_ms").alias("start_ms"), (F.col("mid_ms") + 2).alias("end_ms"))
    return R.ground(fused, meta, 50)


@query("r04_video_prior", f"{V.with_views('hit')}, v as (select video_id, max(score) best from hit where label='view' group by all), t as (select *, row_number() over (order by best desc, video_id) rank from v) select 'q' query_id, video_id, 0.5/(60.0::double+rank) prior from t where rank <= 20")
def prior(spark, d):
    best = V.hits(spark, d).where("label = 'view'").groupBy("video_id").agg(F.max("score").alias("best")).withColumn("query_id", F.lit("q"))
    return R.video_prior(R.numbered(best, ["query_id"], F.desc("best"), F.col("video_id"), most=20))


@query("v01_normalise", "select vec_id, [round(x::double/n, 6) for x in embedding] vec from (select vec_id, embedding, sqrt(list_sum([x::double*x::double for x in embedding])) n from embeddings)")
def normalise(spark, d):
    e = V.table(spark, d, "embeddings")
    return e.select("vec_id", F.transform(R.normalised(F.col("embedding")), lambda x: R.rounded(x, 6)).alias("vec"))


@query("v07_rocchio", """with e as (select vec_id, label, unnest(embedding) x, generate_subscripts(embedding,1) pos from embeddings), q as (select label query_id, pos, x::double x from e where vec_id = (select min(vec_id) from embeddings f where f.label=e.label)),
 p as (select label query_id, pos, avg(x::double) m from e where vec_id % 3 = 0 group by all), n as (select label query_id, pos, avg(x::double) m from e where vec_id % 3 = 1 group by all),
 mv as (select q.query_id, q.pos, q.x + 0.75*coalesce(p.m,0) - 0.25*coalesce(n.m,0) v from q left join p using (query_id,pos) left join n using (query_id,pos)), nm as (select query_id, sqrt(sum(v*v)) s from mv group by all)
 select query_id, list(round(v/s, 6) order by pos) qvec from mv join nm using (query_id) group by query_id""")
def rocchio(spark, d):
    e = V.table(spark, d, "embeddings").select(F.col("label").alias("query_id"), "vec_id", F.col("embedding").alias("vec"))
    q = e.groupBy("query_id").agg(F.min_by("vec", "vec_id").alias("qvec"))
    return R.rocchio(q, e.where("vec_id % 3 = 0").select("query_id", "vec"), e.where("vec_id % 3 = 1").select("query_id", "vec"))


@query("a24_maxsim", """with g as (select label, list(embedding order by vec_id) vs from embeddings where vec_id < 60 group by label)
 select a.label q, b.label c, round(list_avg([list_max([list_sum([x[1]::double*x[2]::double for x in list_zip(u, w)]) for w in b.vs]) for u in a.vs]), 6) score from g a join g b on (a.label+1) % 10 = b.label""")
def maxsim(spark, d):
    g = V.table(spark, d, "embeddings").where("vec_id < 60").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"]).alias("vs"))
    a, b = g.select(F.col("label").alias("q"), F.col("vs").alias("qs")), g.select(F.col("label").alias("c"), F.col("vs").alias("ds"))
    return a.join(b, (F.col("q") + 1) % 10 == F.col("c")).select("q", "c", F.round(R.maxsim(F.col("qs"), F.col("ds")), 6).alias("score"))


FUSED_SQL = RRF_SQL + ", g as (select query_id, shot_key, score, row_number() over (partition by query_id order by score desc, shot_key) rank from f)"


@query("k07_rerank", FUSED_SQL + """, s as (select shot_key, round(max(score),6) new from hit where event_even(shot_key) group by all), j as (select g.*, case when g.rank > 50 then 2 when new is null then 1 else 0 end part, new from g left join s using (shot_key))
 select query_id, shot_key, score, rank old_rank, part, row_number() over (partition by query_id order by part, case when part=0 then -new end, case when part=0 then shot_key end, rank) rank from j""".replace("event_even(shot_key)", "mid_ms % 2 = 0"))
def rerank(spark, d):
    fused = R.rrf(_rankings(spark, d), _weights(spark)).drop("timestamp_ms")
    scores = V.hits(spark, d).where("mid_ms % 2 = 0").groupBy("shot_key").agg(F.round(F.max("score"), 6).alias("score")).withColumn("query_id", F.lit("q"))
    return R.rerank(fused, scores, 50)


@query("k08_listwise", FUSED_SQL + """, l as (select shot_key, rank*2 pos from g where rank in (7, 3, 31, 90)), j as (select g.*, pos from g left join l using (shot_key))
 select query_id, shot_key, score, rank old_rank, row_number() over (partition by query_id order by case when rank <= 50 and pos is not null then 0 when rank <= 50 then 1 else 2 end, case when rank <= 50 and pos is not null then -pos end, rank) rank from j""")
def listwise(spark, d):
    fused = R.rrf(_rankings(spark, d), _weights(spark)).drop("timestamp_ms")
    listed = fused.where(F.col("rank").isin(7, 3, 31, 90)).select("query_id", "shot_key", (-2 * F.col("rank")).alias("pos"))
    return R.listwise(fused, listed, 50)


@query("f03_negation_filter", f"""{V.with_views('line')}, c as (select doc_id, row_number() over (order by doc_id) rank from documents), e as (select doc_id, replace(lower(string_agg(text, chr(10) order by line_ord)), 'ß', 'ss') t from line where doc_id % 7 <> 0 group by all)
 select cast(c.doc_id as varchar) shot_key, rank from c left join e using (doc_id) where coalesce(t,'')='' or not (contains(t,'the of') or contains(t,'license') or contains(t,'süss'))""")
def negation(spark, d):
    c = V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("shot_key"), "doc_id").withColumn("q", F.lit(0))
    ranked = R.numbered(c, ["q"], F.col("doc_id")).select("shot_key", "rank")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ord", "text"))), lambda s: s["text"]), "\n")
    e = V.lines(spark, d).where("doc_id % 7 <> 0").groupBy(F.col("doc_id").cast("string").alias("shot_key")).agg(text.alias("evidence"))
    return R.without_negated(ranked, e, ["the of", " ", "License", "Süß"])


@query("u03_narrow", "select doc_id as key, doc_id as ord from documents where source='src3' and lang='en'")
def narrow(spark, d):
    docs = V.table(spark, d, "documents")
    now = docs.where("lang = 'en'").select(F.col("doc_id").alias("key"), F.col("doc_id").alias("ord"))
    return R.narrowed(docs.where("source = 'src3'").select(F.col("doc_id").alias("key")), now)


@query("r01_dispatch_plan", """with s as (select item_id query_id, string_split(text, ' ') w from benchmark), i as (select query_id, 'visual' field, unnest(w[1:3]) as text, generate_subscripts(w[1:3],1)-1 item_ord from s union all select query_id, 'ocr', unnest(w[4:5]), generate_subscripts(w[4:5],1)-1 from s),
 f as (select * from (values ('visual',0,'dense',1.0::double),('ocr',1,'literal',1.5::double),('ocr',1,'semantic',1.0::double)) t(field,field_ord,channel,fw)), c as (select * from (values ('dense',1.0::double),('literal',1.0::double),('semantic',0.5::double)) t(channel,cw))
 select query_id, concat(field, item_ord, '.', channel) label, channel, text, fw*cw weight, field_ord, item_ord, row_number() over (partition by query_id order by field_ord, item_ord, channel) label_ord from i join f using (field) join c using (channel)""")
def dispatch(spark, d):
    words = F.split("text", " ")
    spec = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.create_map(F.lit("visual"), F.slice(words, 1, 3), F.lit("ocr"), F.slice(words, 4, 2))).alias("field", "items"))
    fields = spark.createDataFrame([("visual", 0, "dense", 1.0), ("ocr", 1, "literal", 1.5), ("ocr", 1, "semantic", 1.0)], "field string, field_ord int, channel string, field_weight double")
    weights = spark.createDataFrame([("dense", 1.0), ("literal", 1.0), ("semantic", 0.5)], "channel string, channel_weight double")
    return R.plan_labels(spec, fields, weights)
