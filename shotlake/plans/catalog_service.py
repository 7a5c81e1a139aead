"""Registered queries on composed retrieval, replies, integrity, query performance, cards and staged delivery."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import replies as P
from ..functions import text as T
from ..operators import evidence as E
from ..operators import integrity as I
from ..operators import ordered as O
from ..operators import performance as Q
from ..operators import ranking as R
from ..operators import retrieval as X
from ..operators import service as S
from ..sources import indexes as N
from ..sources import views as V
from .catalog_ranking import _vector_index
from .registry import query

# replies -----------------------------------------------------------------------------------------

#: Replies with the visual phrases, source and confidence of their specs; %d in a query is the key.
SPECS = [
    ('{"visual_phrases": ["red car", "a bridge", "rain", "dusk"], "confidence": 1.7}', "red car|a bridge|rain", "compiled", 1.0),
    ('```json\n{"visual_phrases": ["boat"], "negations": ["car"], "confidence": 0.25, "source": "other"}\n```', "boat", "compiled", 0.25),
    ('<think>hm</think>{"ocr_literals": ["EXIT"], "visual_phrases": []}', "", "compiled", None),
    ('{"negations": ["car"]}', "query", "fallback", None),
    ('{"visual_phrases": "boat"}', "query", "fallback", None),
    ('{"visual_phrases": ["boat"], "mood": "sad"}', "query", "fallback", None),
    ("no json", "query", "fallback", None),
    (None, "query", "fallback", None),
]
#: Replies with archetype, phrase, core, answer type and concept of their plans.
PLANS = [
    ('{"archetype": "count", "locator": {"visual_phrases": ["boat"], "confidence": 0.5}, "question_core": " how many ", "expected_answer_type": "number", "concept": " boat "}', "count", "boat", "how many", "number", "boat"),
    ('{"archetype": "riddle", "locator": [], "expected_answer_type": "essay", "concept": ""}', "other", "query", "", "text", None),
    ('{"archetype": "entity", "locator": {"mood": "sad"}, "question_core": "who"}', "entity", "query", "who", "text", None),
    ("[1]", "other", "query", "query", "text", None),
    (None, "other", "query", "query", "text", None),
]


def _pick(key, values):
    out = F.when(key == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], 1):
        out = out.when(key == i, F.lit(v))
    return out


def _sql(key: str, values: list) -> str:
    quoted = lambda v: "null" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"case {key} " + " ".join(f"when {i} then {quoted(v)}" for i, v in enumerate(values)) + " end"


@query("p27_specs", f"select p_partkey, {_sql(f'p_partkey % {len(SPECS)}', [s[1] for s in SPECS])} phrases, {_sql(f'p_partkey % {len(SPECS)}', [s[2] for s in SPECS])} as source, ({_sql(f'p_partkey % {len(SPECS)}', [s[3] for s in SPECS])})::double confidence from part")
def specs(spark, d):
    spec = P.spec_of(_pick(F.col("p_partkey") % len(SPECS), [s[0] for s in SPECS]), F.lit(" query "), 3)
    return V.table(spark, d, "part").select("p_partkey", spec.alias("s")).select("p_partkey", F.array_join("s.visual_phrases", "|").alias("phrases"), "s.source", "s.confidence")


@query("p28_plans", "select p_partkey, " + ", ".join(f"{_sql(f'p_partkey % {len(PLANS)}', [p[i] for p in PLANS])} as {n}" for i, n in enumerate(("archetype", "phrases", "core", "answer_type", "concept"), 1)) + " from part")
def plans(spark, d):
    plan = P.plan_of(_pick(F.col("p_partkey") % len(PLANS), [p[0] for p in PLANS]), F.lit("query"), 3)
    return V.table(spark, d, "part").select("p_partkey", plan.alias("p")).select("p_partkey", "p.archetype", F.array_join("p.locator.visual_phrases", "|").alias("phrases"), F.col("p.question_core").alias("core"), F.col("p.expected_answer_type").alias("answer_type"), "p.concept")


@query("p29_recognised_lines", r"with l as (select doc_id, list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') for x in regexp_split_to_array(nfc_normalize(text), '\r\n|\n|\r')], lambda x: x <> '') l from documents) select doc_id, len(l) n, md5(array_to_string(l, chr(10))) h, 1.0::double least from l where len(l) > 0")
def recognised(spark, d):
    lines = V.table(spark, d, "documents").select("doc_id", P.recognised_lines(F.col("text")).alias("l")).where("size(l) > 0")
    return lines.select("doc_id", F.size("l").alias("n"), F.md5(F.array_join("l.text", "\n")).alias("h"), F.array_min("l.confidence").alias("least"))


@query("f16_rejected_requests", "select event_id, (399 + event_id % 108) between 400 and 499 and (399 + event_id % 108) not in (429, 503) as rejected from events")
def rejected(spark, d):
    return V.table(spark, d, "events").select("event_id", P.rejected_request(399 + F.col("event_id") % 108).alias("rejected"))


# documents of the indexes --------------------------------------------------------------------------

ROLES_SQL = "ch as (select conv_id, turn, nullif(case when turn % 3 = 0 then text end, '') en, case when turn % 2 = 0 then text else '' end vi, case when turn % 4 < 2 then 'said ' || text end asr, [role, '', 'walks'] actions, text scene, [text, role] ocr from conversations)"


def _chronicle(spark, d):
    t = F.col("turn")
    line = lambda x: F.struct(x.alias("text"), F.lit(0.5).alias("confidence"))
    return V.table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(t % 3 == 0, F.col("text")).alias("caption_en"), F.when(t % 2 == 0, F.col("text")).otherwise("").alias("caption_vi"), F.when(t % 4 < 2, F.concat(F.lit("said "), "text")).alias("asr_text"),
        F.array("role", F.lit(""), F.lit("walks")).alias("actions"), F.col("text").alias("scene"), F.array(line(F.col("text")), line(F.col("role"))).alias("ocr"), F.array(line(F.col("role"))).alias("overlay_ocr"),
    )


def _joined(*parts: str) -> str:
    return f"md5(array_to_string(list_filter(list_concat({', '.join(parts)}), lambda x: x is not null and x <> ''), chr(10)))"


@query("p16_documents", f"with {ROLES_SQL} select conv_id, turn, {_joined('[vi]', '[en]', '[asr]', 'actions', '[scene]')} semantic, {_joined('ocr', '[asr]')} literal, md5(coalesce(ocr[2], '')) overlay, {_joined('[asr]', '[vi]', '[en]')} entities, {_joined('[coalesce(vi, en)]', '[asr]', 'ocr', 'actions')} evidence from ch")
def documents(spark, d):
    c = _chronicle(spark, d)
    texts = {"semantic": E.semantic_text(), "literal": E.literal_text(), "overlay": E.overlay_text(), "entities": E.entity_input(), "evidence": E.evidence_text()}
    return c.select("conv_id", "turn", *[F.md5(x).alias(n) for n, x in texts.items()])


@query("p02_parsed_ids", f"{V.with_views('kf')} select keyframe_id, video_id || '_s1' video_id, shot_id, frame_idx from (select video_id || '_s1_s' || shot_id || '_f' || frame_idx keyframe_id, video_id, shot_id, frame_idx from kf)")
def parsed(spark, d):
    kf = V.keyframes(spark, d).select(F.format_string("%s_s1_s%d_f%d", "video_id", "shot_id", "frame_idx").alias("keyframe_id"))
    return kf.select("keyframe_id", T.parse_keyframe_id(F.col("keyframe_id")).alias("k")).select("keyframe_id", "k.*")


@query("f02_confident_speech", "select event_id, exp(-value/100) confidence from events where (event_id % 10)/10.0::double <= 0.6 and -value/100 >= -1.0 and event_type <> 'view'")
def speech(spark, d):
    e = V.table(spark, d, "events").select("event_id", ((F.col("event_id") % 10).cast("double") / 10.0).alias("no_speech_prob"), (-F.col("value") / 100).alias("avg_logprob"), F.when(F.col("event_type") == "view", " ").otherwise("x").alias("text"))
    return E.confident_speech(e, 0.6, -1.0).select("event_id", "confidence")


# indexes -----------------------------------------------------------------------------------------


@query("s13_vector_table", "select 'k' || vec_id keyframe_id, round(list_sum([x[1]::double * x[2] for x in list_zip(embedding, range(len(embedding)))]), 6) h from embeddings where vec_id % 2 = 0")
def vector_table(spark, d):
    from ..sources import manifests as M

    e = V.table(spark, d, "embeddings")
    at = [F.concat(F.lit("shard-"), (F.col("vec_id") % 7).cast("string")).alias("shard"), F.floor(F.col("vec_id") / 7).alias("row")]
    manifest = e.where("vec_id % 2 = 0").select(F.concat(F.lit("k"), F.col("vec_id").cast("string")).alias("keyframe_id"), *at, F.lit("m").alias("model_id"), F.size("embedding").alias("dim"))
    dim = e.select(F.size("embedding").alias("n")).first().n
    found = M.vector_table(manifest, e.select(*at, F.col("embedding").alias("vec")), "m", dim)
    return found.select("keyframe_id", F.round(F.aggregate(F.transform("vec", lambda x, i: x.cast("double") * i), F.lit(0.0), lambda a, x: a + x), 6).alias("h"))


@query("v03_vectors_for", "select vec_id id, round(list_sum([x::double for x in embedding]), 6) s from embeddings where vec_id % 20 = 0")
def vectors_for(spark, d):
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    found = N.vectors_for(N.dense(e, "m"), e.where("id % 20 = 0").select("id"))
    return found.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("s"))


# retrieval -----------------------------------------------------------------------------------------

WORDS = r"[^\p{L}]+"
#: Two channels over documents: their texts, and their sources with languages; queries are benchmark items.
CHANNELS_SQL = r"""tm as (select cast(doc_id as varchar) id, doc_id ord, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) term from documents), lt as (select id, ord, term, 1.0+ln(count(*)::double) dw from tm where term<>'' group by all),
 fm as (select cast(doc_id as varchar) id, doc_id ord, unnest([lower(lang), 'lang' || lower(lang)]) term from documents where lang is not null), ft as (select id, ord, term, 1.0::double dw from fm),
 meta as (select cast(doc_id as varchar) shot_key, source video_id, doc_id*1000 start_ms, doc_id*1000+700 end_ms from documents)"""


def _channels(spark, d):
    docs = V.table(spark, d, "documents")
    key = F.col("doc_id").cast("string").alias("id")
    literal = E.postings(docs.select(key, F.col("doc_id").alias("ord"), "text"))
    lang = docs.where("lang is not null").select(key, F.col("doc_id").alias("ord"), F.explode(F.array(F.lower("lang"), F.concat(F.lit("lang"), F.lower("lang")))).alias("term"), F.lit(1.0).alias("dw"))
    terms = lambda x: F.filter(F.split(F.lower(x), WORDS), lambda t: t != "")
    return {"literal_sparse": X.sparse_channel(literal, terms), "factoid_sparse": X.sparse_channel(lang, terms)}


def _places(spark, d):
    return V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("shot_key"), F.col("source").alias("video_id"), (F.col("doc_id") * 1000).alias("start_ms"), (F.col("doc_id") * 1000 + 700).alias("end_ms"))


FUSION_SQL = f"""with {CHANNELS_SQL}, qt as (select item_id query_id, unnest(regexp_split_to_array(lower(text || ' langde'), '[^\\p{{L}}]+')) term from benchmark), qq as (select query_id, term, count(*) qw from qt where term <> '' group by all),
 s as (select 'literal_sparse' label, 1.0::double w, query_id, id, ord, round(sum(qw*dw), 6) score from qq join lt using (term) group by all union all select 'factoid_sparse', 0.5::double, query_id, id, ord, round(sum(qw*dw), 6) from qq join ft using (term) group by all),
 r as (select *, row_number() over (partition by label, query_id order by score desc, ord) rank from s), f as (select query_id, id shot_key, round(sum(w/(60.0::double+rank)), 9) score from r where rank <= 30 group by all),
 g as (select *, row_number() over (partition by query_id order by score desc, shot_key) rank from f)"""


def _asked(spark, d):
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" langde")).alias("text"))


@query("r06_fusion_search", FUSION_SQL + " select query_id, video_id, (start_ms+end_ms)//2 timestamp_ms, score, rank from g join meta using (shot_key) where rank <= 10")
def fusion_search(spark, d):
    return X.fusion_search(_asked(spark, d), _channels(spark, d), {"literal_sparse": 1.0, "factoid_sparse": 0.5}, _places(spark, d), 10, depth=30)


#: Specs of the queries below: the first three words on screen, the next two as a name.
SPEC_SQL = f"""with {CHANNELS_SQL}, sp as (select item_id query_id, text raw, list_filter(string_split(text, ' '), lambda x: trim(x) <> '') w from benchmark),
 it as (select query_id, 'entity_terms' field, generate_subscripts(w[4:5], 1) - 1 pos, unnest(w[4:5]) as text from sp union all select query_id, 'ocr_literals', generate_subscripts(w[1:3], 1) - 1, unnest(w[1:3]) from sp),
 su as (select query_id, field || '[' || pos || '].' || c.channel as label, c.channel, text, fw*cw weight from it join (values ('entity_terms', 1.0::double), ('ocr_literals', 1.5::double)) f(field, fw) using (field) cross join (values ('literal_sparse', 1.0::double), ('factoid_sparse', 0.25::double)) c(channel, cw)
   union all select query_id, 'raw_query.literal_sparse', 'literal_sparse', trim(raw), 0.3::double from sp),
 qt as (select query_id, label, channel, weight, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) term from su), qq as (select query_id, label, channel, weight, term, count(*) qw from qt where term <> '' group by all),
 s as (select query_id, label, weight, id, ord, round(sum(qw*dw), 6) score from qq join lt using (term) where channel = 'literal_sparse' group by all union all select query_id, label, weight, id, ord, round(sum(qw*dw), 6) from qq join ft using (term) where channel = 'factoid_sparse' group by all),
 r as (select *, row_number() over (partition by query_id, label order by score desc, ord) rank from s), f as (select query_id, id shot_key, round(sum(weight/(60.0::double+rank)), 9) score from r where rank <= 30 group by all),
 g as (select *, row_number() over (partition by query_id order by score desc, shot_key) rank from f)"""


def _specs(spark, d):
    b = V.table(spark, d, "benchmark")
    words = F.filter(F.split("text", " "), lambda w: T.strip(w) != "")
    none = F.array().cast("array<string>")
    lists = {"ocr_literals": F.slice(words, 1, 3), "entity_terms": F.slice(words, 4, 2), "negations": F.array(F.lit("STRASSE"), F.lit("thand"))}
    spec = F.struct(*[lists.get(n, none).alias(n) for n in P.SPEC_LISTS], F.lit(0.5).alias("confidence"), F.when(F.col("item_id") % 5 == 0, "fallback").otherwise("compiled").alias("source"))
    return b.select(F.col("item_id").alias("query_id"), spec.alias("spec"), F.col("text").alias("raw"))


FIELDS = {"visual_phrases": 1.0, "paraphrases": 0.5, "entity_terms": 1.0, "ocr_literals": 1.5, "asr_phrases": 1.0}


@query("r08_retrieve", SPEC_SQL + """, ev as (select cast(doc_id as varchar) shot_key, replace(lower(text), 'ß', 'ss') t from documents), h as (select g.query_id, g.shot_key, g.score, row_number() over (partition by g.query_id order by g.rank) rank from g left join ev using (shot_key) where not (contains(coalesce(t, ''), 'strasse') or contains(coalesce(t, ''), 'thand')))
 select query_id, video_id, (start_ms+end_ms)//2 timestamp_ms, score, rank from h join meta using (shot_key) where rank <= 10""")
def retrieve(spark, d):
    evidence = V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("shot_key"), F.col("text").alias("evidence"))
    return X.retrieve(_specs(spark, d), _channels(spark, d), FIELDS, {"literal_sparse": 1.0}, _places(spark, d), 10, depth=30, raw_weight=0.3, evidence=evidence, extra={"factoid_sparse": 0.25})


def _candidates(spark, d):
    specs = _specs(spark, d)
    subs = X.plan(specs, FIELDS, {"literal_sparse": 1.0, "factoid_sparse": 0.25}, 0.3)
    # every feature reads them again; they are as many as the queries ask for
    rankings = I.cut(X.dispatch(subs, _channels(spark, d), 30))
    return specs, rankings, I.cut(X.fused(rankings, subs))


@query("q04_features", SPEC_SQL + """, cr as (select query_id, split_part(label, '.', -1) channel, id, min(rank) rank from r where rank <= 20 group by all), un as (select distinct query_id, id from cr), pr as (select u.query_id, coalesce(a.rank, 21) x, coalesce(b.rank, 21) y from un u left join cr a on a.query_id=u.query_id and a.id=u.id and a.channel='literal_sparse' left join cr b on b.query_id=u.query_id and b.id=u.id and b.channel='factoid_sparse' where u.query_id in (select query_id from cr where channel='literal_sparse') and u.query_id in (select query_id from cr where channel='factoid_sparse')),
 ag as (select query_id, round(coalesce(case when stddev_pop(x) = 0 or stddev_pop(y) = 0 then 0 else corr(x, y) end, 0), 9) a from pr group by all), tp as (select query_id, arg_max(score, -rank) top, arg_max(score, rank) filter (where rank <= 2) l2, arg_max(score, rank) filter (where rank <= 10) l10, count(*) n from g group by all),
 vc as (select query_id, video_id, count(*) c from g join meta using (shot_key) where rank <= 10 group by all), co as (select query_id, max(c) c from vc group by all)
 select sp.query_id, round(coalesce(case when n < 2 then 0 else greatest(0, (top-l2)/top) end, 0), 9) margin_2, round(coalesce(case when n < 2 then 0 else greatest(0, (top-l10)/top) end, 0), 9) margin_n, coalesce(a, 0)::double agreement, round(coalesce(c / least(n, 10), 0), 9) compactness, 0.5::double confidence, (sp.query_id % 5 = 0)::int::double fallback, round(least(coalesce(n, 0) / 40.0::double, 1.0), 9) filled
 from sp left join ag using (query_id) left join tp using (query_id) left join co using (query_id)""")
def features(spark, d):
    specs, rankings, candidates = _candidates(spark, d)
    videos = _places(spark, d).select("shot_key", "video_id")
    told = Q.features(candidates, rankings, specs, videos, ["literal_sparse", "factoid_sparse"], 40)
    return told.withColumn("filled", F.round("filled", 9))


@query("q07_advice", """with f as (select conv_id query_id, count(*)/10.0::double confidence from conversations group by all), p as (select query_id, round(1/(1+exp(-(2*confidence - 0.8))), 9) p_hit from f)
 select query_id, p_hit, 100 target_k, case when p_hit < 0.5 then 'target unlikely in top 100 (P=' || round_even(100*p_hit, 0)::int || '%); consider escalating' end hint from p""")
def advice(spark, d):
    rows = V.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg((F.count(F.lit(1)) / 10.0).alias("confidence"))
    zeros = [F.lit(0.0).alias(c) for c in Q.FEATURES if c != "confidence"]
    model = Q.Model([2.0 if c == "confidence" else 0.0 for c in Q.FEATURES], -0.8, 100)
    return Q.advise(rows.select("query_id", "confidence", *zeros), model, 0.5)


@query("r12_random_results")
def random_results(spark, d):
    videos = V.shots(spark, d).groupBy("video_id").agg(F.max("end_ms").alias("duration_ms"))
    return X.random_results(V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")), videos, 20, 7)


@query("e08_side_by_side", """with a as (select distinct conv_id query_id, case when conv_id % 3 > 0 then conv_id % 7 end x, case when conv_id % 4 > 0 then conv_id % 5 end y from conversations)
 select query_id, x rank_a, y rank_b, case when coalesce(x, 1000) < coalesce(y, 1000) then 'a' when coalesce(y, 1000) < coalesce(x, 1000) then 'b' else 'same' end better from a""")
def side_by_side(spark, d):
    c = V.table(spark, d, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    q = F.col("query_id")
    return X.side_by_side(c.select("query_id", F.when(q % 3 > 0, q % 7).alias("rank")), c.select("query_id", F.when(q % 4 > 0, q % 5).alias("rank")))


@query("v08_similar_shots", f"""{V.with_views('kf')}, e as (select shot_key, unnest(embedding) x, generate_subscripts(embedding,1) pos from kf), m as (select shot_key, pos, avg(x::double) m from e group by all), n as (select shot_key, sqrt(sum(m*m)) n from m group by all), c as (select shot_key q, list(round(m/n, 6) order by pos) v from m join n using (shot_key) where cast(split_part(shot_key, ':', 2) as int) % 20 = 0 group by shot_key),
 s as (select c.q, k.vec_id, k.shot_key, round(list_sum(list_transform(list_zip(c.v, k.embedding), lambda x: x[1]::double*x[2]::double)), 9) score from kf k cross join c), t as (select *, row_number() over (partition by q order by score desc, vec_id) r from s), b as (select *, row_number() over (partition by q, shot_key order by r) n from t where r <= 24),
 u as (select q, shot_key, score, row_number() over (partition by q order by score desc, vec_id) r2 from b where n = 1), w as (select q, shot_key, score, row_number() over (partition by q order by r2) rank from u where r2 <= 6 and shot_key <> q) select q query_id, shot_key, score, rank from w where rank <= 5""")
def similar(spark, d):
    index, meta, _ = _vector_index(spark, d)
    asked = V.shots(spark, d).where("shot_id % 20 = 0").select(F.col("shot_key").alias("query_id"), "shot_key")
    return X.similar_shots(asked, index, meta, 5).select("query_id", "shot_key", "score", "rank")


# integrity -----------------------------------------------------------------------------------------

#: A corpus with a failed video, one without a record, a repeated keyframe, a torn image, orphans, and damaged shards.
CORPUS_SQL = f"""{V.with_views('shot')}, videos as (select distinct video_id, case when video_id = 'V003' then 'failed' else 'done' end status from shot where video_id <> 'V008'),
 keyframes as (select keyframe_id, video_id, shot_key, frame_idx, keyframe_id image_path, vec_id from kf union all select keyframe_id, video_id, shot_key, frame_idx, keyframe_id, vec_id from kf where video_id = 'V005' and frame_idx = 0),
 dn as (select video_id from videos where status = 'done'),
 br as (select video_id, 'failed' reason from videos where status <> 'done' union select video_id, 'duplicated' from keyframes where keyframe_id in (select keyframe_id from keyframes group by 1 having count(*) > 1) union select video_id, 'partial' from shot where video_id not in (select video_id from dn) union select video_id, 'corrupt' from keyframes where video_id = 'V002'),
 gone as (select distinct video_id from br), kk as (select * from keyframes where video_id not in (select video_id from gone)),
 em as (select keyframe_id, 'shard-' || (vec_id % 7) shard, vec_id // 7 as row from kf union all select 'V000_s9_f99999', 'shard-1', 0), sh as (select * from (values ('shard-0', 1000000), ('shard-1', 1000000), ('shard-2', 1000000), ('shard-3', null), ('shard-4', 1000000), ('shard-5', 1)) t(shard, n)),
 lv as (select * from em where keyframe_id in (select keyframe_id from kk)), bad as (select shard from (select shard, max(row) m from lv group by all) left join sh using (shard) where n is null or m >= n)"""


def _corpus(spark, d):
    kf, shots = V.keyframes(spark, d), V.shots(spark, d)
    videos = shots.select("video_id").distinct().where("video_id <> 'V008'").withColumn("status", F.when(F.col("video_id") == "V003", "failed").otherwise("done"))
    frames = kf.select("keyframe_id", "video_id", "shot_key", "frame_idx", F.col("keyframe_id").alias("image_path"))
    keyframes = frames.unionAll(frames.where("video_id = 'V005' and frame_idx = 0"))
    orphan = spark.createDataFrame([("V000_s9_f99999", "shard-1", 0)], "keyframe_id string, shard string, row bigint")
    embeddings = kf.select("keyframe_id", F.concat(F.lit("shard-"), (F.col("vec_id") % 7).cast("string")).alias("shard"), F.floor(F.col("vec_id") / 7).alias("row")).unionByName(orphan)
    more = lambda df, c, v: df.select(c).unionAll(spark.createDataFrame([(v,)], f"{c} string"))
    tables = {
        "videos": videos, "shots": shots, "keyframes": keyframes, "embeddings": embeddings, "ocr": more(kf.where("frame_idx % 2 = 0"), "keyframe_id", "V000_s9_f99999"),
        "captions": more(shots, "shot_key", "V000:none"), "asr": more(shots.select("video_id").distinct(), "video_id", "Vnone"),  # keys that no number of rows makes
    }
    readable = frames.where("not (video_id = 'V002' and frame_idx = 1)").select("image_path")
    shards = spark.createDataFrame([("shard-0", 10**6), ("shard-1", 10**6), ("shard-2", 10**6), ("shard-3", None), ("shard-4", 10**6), ("shard-5", 1)], "shard string, rows bigint")
    return tables, readable, shards


@query("u01_broken_videos", CORPUS_SQL + " select * from br")
def broken(spark, d):
    tables, readable, _ = _corpus(spark, d)
    return I.broken(tables["videos"], tables["shots"], tables["keyframes"], readable)


@query("e07_repair", CORPUS_SQL + """ select 'videos' as "table", count(*) dropped from videos where video_id in (select video_id from gone) union all select 'shots', count(*) from shot where video_id in (select video_id from gone) union all select 'keyframes', count(*) from keyframes where video_id in (select video_id from gone)
 union all select 'embeddings', (select count(*) from em) - (select count(*) from lv where shard not in (select shard from bad)) union all select 'ocr', 1 + count(*) from kf where frame_idx % 2 = 0 and keyframe_id not in (select keyframe_id from kk)
 union all select 'captions', 1 + count(*) from shot where video_id in (select video_id from gone) union all select 'asr', 1 + count(distinct video_id) from shot where video_id not in (select video_id from dn) or video_id in (select video_id from gone)""")
def repair(spark, d):
    return I.repaired(*_corpus(spark, d))[1]


@query("j13_orphans", CORPUS_SQL + " select keyframe_id, shard, row from lv where shard not in (select shard from bad)")
def orphans(spark, d):
    return I.repaired(*_corpus(spark, d))[0]["embeddings"].select("keyframe_id", "shard", "row")


@query("a20_summed", "select event_type as name, sum(event_id) as value from events group by all")
def summed(spark, d):
    return I.summed(V.table(spark, d, "events").select(F.col("user_id").alias("worker"), F.col("event_type").alias("name"), F.col("event_id").alias("value")))


@query("a21_ingest_violations", CORPUS_SQL + """ select 'V008' video_id, 'not done' reason union all select 'V003', 'not done' union all select 'V003', 'failed' union all select 'V777', u from (select unnest(['not done', 'no shots', 'no keyframes']) u) union all select 'V000', 'not expected' union all select distinct video_id, 'no image' from kf where frame_idx = 1""")
def ingest(spark, d):
    tables, _, _ = _corpus(spark, d)
    expected = tables["shots"].select("video_id").distinct().where("video_id <> 'V000'").unionAll(spark.createDataFrame([("V777",)], "video_id string"))
    images = tables["keyframes"].select("image_path", F.when(F.col("frame_idx") == 1, 0).otherwise(9).alias("bytes"))
    return I.ingest_violations(tables["videos"], tables["shots"], tables["keyframes"], expected, images)


@query("e10_publish_violations", "select 'repeated shot key' as rule where (select count(*) <> count(distinct conv_id) from conversations) union all select 'count of literal'")
def publish(spark, d):
    c = _chronicle(spark, d).withColumn("shot_key", F.col("conv_id"))
    indexes = spark.createDataFrame([("semantic", 5, 5), ("literal", 5, 4)], "name string, built bigint, loaded bigint")
    return I.publish_violations(c, indexes)


@query("e11_assembly", f"with {ROLES_SQL} select count(*) shots, count(asr) shots_with_asr, count(*) shots_with_ocr from ch")
def assembly(spark, d):
    c = _chronicle(spark, d)
    return I.assembly_report(c, c.count())


@query("e09_projection", "select cast(user_id as varchar) as label, round(count(*) / sum(value), 9) images_per_s, round(171059.0::double / (count(*) / sum(value)) / 3600, 9) as hours, round(round(171059.0::double / (count(*) / sum(value)) / 3600, 9) * 1.1, 6) as cost from events group by user_id having sum(value) > 0")
def projection(spark, d):
    runs = V.table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("images"), F.sum("value").alias("seconds"))
    return I.projection(runs.where("seconds > 0"), 171_059, 1.1).withColumn("cost", F.round(F.col("hours") * 1.1, 6))


@query("s30_first_samples", "select source package, cast(doc_id as varchar) || '.jpg' as member, length(text) as bytes from documents where text <> '' order by 1, 2 limit 25")
def samples(spark, d):
    docs = V.table(spark, d, "documents").where("text <> ''").select(F.col("source").alias("package"), F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("member"), F.length("text").alias("bytes"))
    return I.first_samples(docs, 25)


@query("g03_stage_plan", "select 'merged' kind, doc_id, case when doc_id in (select doc_id from labels) then 'done' else 'left' end origin from documents where doc_id in (select doc_id from labels) or doc_id % 3 = 0 union all select 'pending', doc_id, null from documents where doc_id not in (select doc_id from labels) and doc_id % 3 <> 0")
def stage_plan(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id")
    done = V.table(spark, d, "labels").select("doc_id", F.lit("done").alias("origin"))
    merged, pending = I.stage_plan(done, [docs.where("doc_id % 3 = 0").withColumn("origin", F.lit("left"))], docs, "doc_id")
    return merged.select(F.lit("merged").alias("kind"), "doc_id", "origin").unionByName(pending.select(F.lit("pending").alias("kind"), "doc_id", F.lit(None).cast("string").alias("origin")))


@query("v06_salvaged", "with f as (select user_id, event_id, case when event_type = 'click' then 'kept' when event_type = 'view' then 'blank' else 'duplicate' end fate, event_id // 7 shot_id from events), k as (select * from f where fate = 'kept'), s as (select *, row_number() over (partition by user_id, shot_id order by event_id) n from f where fate = 'duplicate' and (user_id, shot_id) not in (select user_id, shot_id from k)) select user_id, shot_id, event_id as ord, fate from k union all select user_id, shot_id, event_id, fate from s where n = 1")
def salvaged(spark, d):
    kind = F.when(F.col("event_type") == "click", "kept").when(F.col("event_type") == "view", "blank").otherwise("duplicate")
    rows = V.table(spark, d, "events").select("user_id", F.floor(F.col("event_id") / 7).alias("shot_id"), F.col("event_id").alias("ord"), kind.alias("fate"))
    return O.salvaged(rows, ["user_id", "shot_id"])


# answers -----------------------------------------------------------------------------------------


@query("j14_video_of_shot", f"{V.with_views('shot')} select shot_key, case when shot_id % 2 = 0 then video_id else 'B' || video_id end video_id from shot where shot_id % 2 = 0 or shot_id % 3 = 0")
def video_of_shot(spark, d):
    s = V.shots(spark, d)
    return S.video_of_shot(s.where("shot_id % 2 = 0"), s.where("shot_id % 3 = 0").withColumn("video_id", F.concat(F.lit("B"), "video_id")))


@query("j10_cards", f"""{V.with_views('hit')}, c as (select label query_id, shot_key, video_id, mid_ms, rank, score from hit where rank <= 40), k as (select *, cast(split_part(shot_key, ':', 2) as bigint) e from c)
 select query_id, shot_key, case when e % 2 = 0 then 'b' else 'm' end || video_id video_id, case when e % 5 = 0 then mid_ms when e % 2 = 0 then 1 else 2 end timestamp_ms, score, case when e % 7 = 0 then 'name' end answer, case when e % 7 = 0 then 'spoken_entities' end field, case when e % 7 = 0 then 'name' end as value, case when e % 2 = 0 then ['f'] else [] end frames, rank from k where e % 2 = 0 or e % 3 = 0""")
def cards(spark, d):
    h = V.hits(spark, d).withColumn("e", F.split_part("shot_key", F.lit(":"), F.lit(2)).cast("bigint"))
    candidates = h.select(F.col("label").alias("query_id"), "shot_key", F.when(F.col("e") % 5 == 0, F.col("mid_ms")).alias("timestamp_ms"), "score", "rank")
    side = lambda cond, p, mid, *more: h.where(cond).select("shot_key", F.concat(F.lit(p), "video_id").alias("video_id"), F.lit(mid).cast("bigint").alias("mid_ms"), *more)
    ledger = h.where("e % 7 = 0").select("shot_key", F.array().cast("array<string>").alias("screen_text"), F.array(F.lit("name")).alias("spoken_entities"))
    return S.cards(candidates, "entity", side("e % 2 = 0", "b", 1, F.array(F.lit("f")).alias("frames")), side("e % 3 = 0", "m", 2), ledger, 40)


@query("x03_answer_groups")
def groups(spark, d):
    c = V.table(spark, d, "conversations")
    t = F.col("turn")
    reads = c.select(F.col("conv_id").alias("question_id"), F.concat_ws(":", "conv_id", "turn").alias("shot_key"), F.when(t % 3 == 0, "ba người").when(t % 3 == 1, "3").otherwise("7 con").alias("answer"), F.lit("number").alias("kind"), F.lit(0.5).alias("score"), t.alias("ord"))
    track = c.where("conv_id % 2 = 0").select(F.col("conv_id").alias("question_id"), F.lit("bảy").alias("answer")).distinct()
    contradicts = reads.where("question_id % 3 = 0").select("question_id", "shot_key", F.lit("ba người").alias("answer"))
    return S.answer_groups(reads, track, contradicts, 0.25, 1.5)


@query("x06_reverse", f"""{V.with_views('hit')}, n as (select label, count(*) n, arg_max(shot_key, -rank) shot_key, arg_max(score, -rank) s from hit group by all), p as (select label, case when median(score) > 0 then max(score)/median(score) else 1.0 end pk from hit where rank <= 50 group by all)
 select 'q' question_id, upper(label) answer, shot_key, s*0.9::double score, row_number() over (order by s*0.9::double desc, case label when 'click' then 1 when 'view' then 2 when 'purchase' then 3 end) rank from n join p using (label) where label in ('click', 'view', 'purchase') and (n = 1 or pk >= 1.01) and s >= 100""")
def reverse(spark, d):
    ords = F.when(F.col("label") == "click", 1).when(F.col("label") == "view", 2).when(F.col("label") == "purchase", 3).otherwise(9)
    h = V.hits(spark, d).select(F.lit("q").alias("question_id"), ords.alias("ord"), "rank", "shot_key", "score", "label")
    hyp = h.groupBy("question_id", "ord").agg(F.concat(F.lit(" "), F.upper(F.first("label"))).alias("answer"))
    locator = h.groupBy("question_id", "shot_key").agg(F.max("score").alias("locator"))
    return S.reverse(hyp, h.where("ord < 9"), locator, 50, 1.01, 100.0, 0.9, 3)


@query("x09_hints")
def hints(spark, d):
    c = V.table(spark, d, "conversations")
    asked = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.when(F.col("turn") < 3, " Who?").otherwise("what?").alias("question"), (F.length("text") % 4).alias("agreeing_count"), (F.length("text") % 5 == 0).alias("cross"), F.lit(False).alias("disconfirmed"), (F.col("turn") % 2).alias("pending"))
    return S.hints(asked, 1, 3)


@query("x11_case_metrics", "select p_partkey query_id, 'count' archetype, p_partkey % 4 = 1 answer_ok, p_partkey % 3 = 0 moment_ok from part")
def case_metrics(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("query_id"))
    q = F.col("query_id")
    cases = p.select("query_id", F.lit("count").alias("archetype"), F.concat((q % 4).cast("string"), F.lit(" cái")).alias("answer"), F.array(F.lit("một"), F.lit("")).alias("accepted"), F.lit("number").alias("kind"))
    results = p.select("query_id", F.lit("v").alias("video_id"), F.when(q % 3 == 0, 5000).otherwise(9000).alias("timestamp_ms"), F.lit(1).alias("rank")).unionAll(p.select("query_id", F.lit("v"), F.lit(5000), F.lit(2)))
    truths = p.select("query_id", F.lit("v").alias("video_id"), F.lit(3500).alias("t_start_ms"), F.lit(4000).alias("t_end_ms"))
    return S.case_metrics(cases, results, truths, 2000)


@query("t06_staged", """with e as (select conv_id * 1000 + turn // 3 query_id, turn, case turn % 3 when 0 then 'results' when 1 then 'results_preview' else 'done' end event, conv_id % 2 = 0 held from conversations)
 select query_id, row_number() over (partition by query_id order by case event when 'results_preview' then 1 when 'results' then 2 else 3 end) seq, '{"event": "' || event || '"' || case when event = 'done' then '' else ', "n":' || turn end || '}' || chr(10) as line from e where not (event = 'results_preview' and held)""")
def staged(spark, d):
    t = F.col("turn")
    event = F.when(t % 3 == 0, "results").when(t % 3 == 1, "results_preview").otherwise("done")
    rows = V.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.floor(t / 3)).alias("query_id"), event.alias("event"), F.when(t % 3 == 2, "{}").otherwise(F.to_json(F.struct(t.alias("n")))).alias("payload"), F.when(F.col("conv_id") % 2 == 0, "s").alias("session_id"))
    return S.staged(rows, S.SEARCH_EVENTS)


@query("t05_responded", """with c as (select doc_id, row_number() over (order by length(text) desc nulls last, doc_id) rank from documents), k as (select *, row_number() over (order by rank) r from c where doc_id % 3 = 0) select cast(k.doc_id as varchar) shot_key, r rank, lang, source from k join documents using (doc_id) where r <= 12""")
def responded(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("shot_key"), "doc_id", "lang", "source", "text")
    ranked = I.global_rank(docs.select("shot_key", "doc_id", F.length("text").alias("n")), F.desc_nulls_last("n"), F.col("doc_id")).select("shot_key", "rank")
    shown, _ = S.responded(ranked, docs.where("doc_id % 3 = 0").select(F.col("shot_key").alias("key")), docs.select("shot_key", "lang", "source"), ["lang", "source"], 12)
    return shown.select("shot_key", "rank", "lang", "source")


