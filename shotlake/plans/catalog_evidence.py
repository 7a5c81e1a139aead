"""Registered queries on scalar functions, ordered operators and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import ordered as O
from ..operators import performance as P
from ..sources import manifests as M
from ..sources import views as V
from .registry import query

WS = r"'^\s+|\s+$'"


@query("p01_keyframe_ids", f"{V.with_views('kf')} select keyframe_id, video_id, shot_id, frame_idx from kf")
def keyframe_ids(spark, d):
    kf = V.keyframes(spark, d).select(T.keyframe_id(F.col("video_id"), F.col("shot_id"), F.col("frame_idx")).alias("keyframe_id"))
    return kf.select("keyframe_id", T.parse_keyframe_id(F.col("keyframe_id")).alias("k")).select("keyframe_id", "k.video_id", "k.shot_id", F.col("k.frame_idx").cast("bigint").alias("frame_idx"))


@query("p03_video_of_path", "select page_id, regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1) stem from pages where regexp_matches(regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1), '^[A-Za-z0-9][A-Za-z0-9_-]*$')")
def video_of_path(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.video_of_path(F.col("url")).alias("stem")).where("stem is not null")


@query("p04_pts_to_ms", "select l_orderkey, l_linenumber, cast(floor((2*l_partkey*1001*1000+30000)/(2*30000)) as bigint) ms from lineitem")
def pts(spark, d):
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.pts_to_ms(F.col("l_partkey"), F.lit(1001), F.lit(30000)).alias("ms"))


@query("p05_nfc_strip", f"select doc_id, md5(regexp_replace(nfc_normalize(text), {WS}, '', 'g')) h from documents")
def nfc(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.nfc_strip("text")).alias("h"))


@query("p07_fold_diacritics", "select doc_id, md5(strip_accents(replace(replace(text,'đ','d'),'Đ','D'))) h from documents")
def fold(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.fold_diacritics("text")).alias("h"))


#: Number words of the answers in the queries below, by key modulo their count, and what each is worth.
SPOKEN = [("Seven", None), (" ba ", 3), ("-12", -12), ("mười lăm", 15), ("hai mươi", 20), ("ba mươi  mốt", 31), ("một mươi ba", None), ("mười", 10), ("không", 0), ("some words more than three", None), ("", None)]


def _sql_case(key: str, values: list) -> str:
    quoted = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v + "'"
    return f"case {key} " + " ".join(f"when {i} then {quoted(v)}" for i, v in enumerate(values)) + " end"


def _case(key, values: list, kind: str):
    out = F.when(key == 0, F.lit(values[0]).cast(kind))
    for i, v in enumerate(values[1:], 1):
        out = out.when(key == i, F.lit(v).cast(kind))
    return out


@query("p08_parse_number", f"select p_partkey, case p_partkey % 2 when 0 then p_partkey else {_sql_case(f'p_partkey // 2 % {len(SPOKEN)}', [n for _, n in SPOKEN])} end n from part")
def number(spark, d):
    k = F.col("p_partkey")
    t = F.when(k % 2 == 0, k.cast("string")).otherwise(_case((k / 2).cast("bigint") % len(SPOKEN), [w for w, _ in SPOKEN], "string"))
    return V.table(spark, d, "part").select("p_partkey", T.parse_number(t).alias("n"))


#: Answers of each type with their keys and whether these are valid.
ANSWERS = [
    ("number", " ba Người ", "3", True), ("number", "PHẦN TRĂM", "phần trăm", False), ("number", "hai mươi ba %", "23", True), ("number", "many", "many", False), ("number", "-7 con", "-7", True),
    ("color", "XANH Dương", "lam", True), ("color", "Grey", "xám", True), ("color", "mauve", "mauve", False), ("text", "  STRASSE ", "strasse", True), ("text", "Straße", "strasse", True), ("text", "Phở".encode().decode(), "phở", True), ("entity", " ", "", False),
]


@query("p11_answer_keys", f"select p_partkey, {_sql_case(f'p_partkey % {len(ANSWERS)}', [a[2] for a in ANSWERS])} k, p_partkey % {len(ANSWERS)} not in ({', '.join(str(i) for i, a in enumerate(ANSWERS) if not a[3])}) as valid from part")
def keys(spark, d):
    k = F.col("p_partkey") % len(ANSWERS)
    kind = _case(k, [a[0] for a in ANSWERS], "string")
    rows = V.table(spark, d, "part").select("p_partkey", kind.alias("kind"), T.answer_key(_case(k, [a[1] for a in ANSWERS], "string"), kind).alias("k"))
    return rows.select("p_partkey", "k", T.valid_answer(F.col("k"), F.col("kind")).alias("valid"))


@query("p13_sentences", r"""with s as (select conv_id, turn, list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') for x in regexp_split_to_array(text, '[.!?;…]+|\n+')], lambda x: x<>'') p, regexp_replace(text, '^\s+|\s+$', '', 'g') t from conversations)
 select conv_id, turn, case when len(p) <= 1 then [t] when len(p) <= 3 then p else list_concat(p[1:2], [array_to_string(p[3:], '. ')]) end parts from s where t <> ''""")
def sentences(spark, d):
    c = V.table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.sentences(F.col("text"), 3).alias("parts")).where("size(parts) > 0")


@query("p15_channel_of_label", "select distinct event_type as label, split_part(event_type, '.', -1) channel from events")
def channel(spark, d):
    return V.hits(spark, d).select("label", T.channel_of_label(F.col("label")).alias("channel")).distinct()


@query("p22_evidence_block", """select conv_id, turn, substr(array_to_string(list_filter([case when role<>'' then 'role: '||role end, case when text<>'' then 'text: '||text end], lambda x: x is not null), chr(10)), 1, 80) block from conversations""")
def block(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", T.evidence_block({"role": F.col("role"), "text": F.col("text")}, 80).alias("block"))


@query("p23_boxes", """with b as (select l_orderkey, l_linenumber, (l_partkey % 100)::double x0, (l_suppkey % 100)::double y0, l_quantity::double w, (l_linenumber*10 - 10)::double h from lineitem)
 select l_orderkey, l_linenumber, case when least((x0+w)/200,1.0) > x0/200 and least((y0+h)/100,1.0) > y0/100 then [x0/200, y0/100, least((x0+w)/200,1.0), least((y0+h)/100,1.0)] end box from b""")
def boxes(spark, d):
    x0, y0 = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double")
    x1, y1 = x0 + F.col("l_quantity").cast("double"), y0 + (F.col("l_linenumber") * 10 - 10).cast("double")
    points = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.box_of(points, F.lit(200.0), F.lit(100.0)).alias("box"))


@query("p24_reply_json", "select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def reply(spark, d):
    fenced = F.concat(F.lit("<think>x</think>```json\n"), F.col("props"), F.lit("\n```"))
    return V.table(spark, d, "events").select("event_id", T.reply_json(fenced, "k bigint")["k"].alias("k"))


@query("p34_time_to_target", "select event_id, least(user_id, 200)*1.5 ttt from events")
def ttt(spark, d):
    return V.table(spark, d, "events").select("event_id", T.time_to_target(F.col("user_id"), 1.5, 200).alias("ttt"))


@query("p35_cleaned_names", "select doc_id, list(w order by first) names from (select doc_id, w, min(i) first from (select doc_id, unnest(string_split(text,' ')[1:12]) w, generate_subscripts(string_split(text,' ')[1:12],1) i from documents) where trim(regexp_replace(w, '^\\s+|\\s+$', '', 'g'))<>'' and not regexp_matches(w, '\\s') group by all) group by doc_id")
def names(spark, d):
    words = F.filter(F.slice(F.split("text", " "), 1, 12), lambda w: ~w.rlike(r"\s"))
    return V.table(spark, d, "documents").select("doc_id", T.cleaned_names(words).alias("names")).where("size(names) > 0")


@query("p36_first_integer", r"select doc_id, try_cast(regexp_extract(text, '\d+', 0) as int) n from documents")
def first_integer(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.first_integer(F.col("text")).alias("n"))


@query("s22_submission", """select shot_key, concat(video_id, ',', start_ms) csv, concat('{"video_id": "', video_id, '", "timestamp_ms": ', start_ms, '}') json from shot""".join([V.with_views("shot") + " ", ""]))
def submission(spark, d):
    v, t = F.col("video_id"), F.col("start_ms")
    return V.shots(spark, d).select("shot_key", T.submission(v, t, "csv").alias("csv"), T.submission(v, t, "json").alias("json"))


@query("w03_word_segments", """with w as (select user_id::varchar video_id, row_number() over (partition by user_id order by ts, event_id) ord, epoch_us(ts)//1000 start_ms, epoch_us(ts)//1000 + cast(floor(value*1000) as bigint) end_ms, event_type as text from events),
 p as (select *, max(end_ms) over (partition by video_id order by ord rows between unbounded preceding and 1 preceding) pe from w), g as (select *, sum(case when pe is null or start_ms - pe > 3600000 then 1 else 0 end) over (partition by video_id order by ord) seg from p)
 select video_id, seg, min(start_ms) start_ms, max(end_ms) end_ms, string_agg(text, ' ' order by ord) as text from g group by all""")
def word_segments(spark, d):
    e = V.table(spark, d, "events")
    from pyspark.sql import Window

    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    words = e.select(F.col("user_id").cast("string").alias("video_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("ord"), ms.alias("start_ms"), (ms + F.floor(F.col("value") * 1000)).alias("end_ms"), F.col("event_type").alias("text"))
    return O.word_segments(words, 3_600_000)


SHORT_SQL = """with s as (select user_id::varchar video_id, event_id ord, event_id*1000 start_ms, event_id*1000 + (event_id*37 % 900) end_ms from events), f as (select *, case when row_number() over (partition by video_id order by ord)=1 or end_ms-start_ms >= 400 then 1 else 0 end n from s),
 g as (select *, sum(n) over (partition by video_id order by ord) grp from f), a as (select video_id, grp, min(start_ms) start_ms, max(end_ms) end_ms from g group by all), b as (select *, max(case when grp=1 then end_ms-start_ms end) over (partition by video_id) first from a),
 c as (select video_id, case when grp=2 and first<400 then 1 else grp end grp, start_ms, end_ms from b), m as (select video_id, grp, min(start_ms) start_ms, max(end_ms) end_ms from c group by all)
 select video_id, start_ms, end_ms, row_number() over (partition by video_id order by grp)-1 shot_id from m"""


@query("w04_merge_short_shots", SHORT_SQL)
def short_shots(spark, d):
    e = F.col("event_id")
    rows = V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("video_id"), e.alias("ord"), (e * 1000).alias("start_ms"), (e * 1000 + e * 37 % 900).alias("end_ms"))
    return O.merge_short_shots(rows, 400)


@query("w06_keyframe_positions", """select shot_key, list_sort(list_distinct([shot_id*10 + cast(round_even((span*s)::double, 0) as int) for s in [0.05, 0.35, 0.65, 0.95]])) frames from (select *, cast((end_ms-start_ms)//40 as int) span from shot)""".join([V.with_views("shot") + " ", ""]))
def positions(spark, d):
    first = F.col("shot_id") * 10
    span = F.floor((F.col("end_ms") - F.col("start_ms")) / 40).cast("int")
    return V.shots(spark, d).select("shot_key", O.keyframe_positions(first, first + span).alias("frames"))


@query("w07_fill_gaps", """with f as (select distinct user_id::varchar video_id, event_id*1000 ms from events), g as (select *, lead(ms) over (partition by video_id order by ms)-ms gap from f), i as (select video_id, ms, gap, gap//20000 n, unnest(range(1, gap//20000+1)) i from g where gap > 20000)
 select video_id, ms from f union select video_id, ms + (gap*i)//(n+1) from i""")
def gaps(spark, d):
    rows = V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("video_id"), (F.col("event_id") * 1000).alias("ms"))
    return O.fill_gaps(rows, 20_000)


@query("w08_motion_peak", """with f as (select user_id::varchar video_id, 0 shot_id, event_id frame, value as level from events), g as (select *, abs(level - lag(level) over (partition by video_id, shot_id order by frame)) diff from f)
 select video_id, shot_id, arg_max(frame, (diff, -frame)) filter (where diff is not null) frame, max(diff) diff from g group by video_id, shot_id having count(*) >= 3 and max(diff) >= 1.0""")
def motion(spark, d):
    rows = V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("video_id"), F.lit(0).alias("shot_id"), F.col("event_id").alias("frame"), F.col("value").alias("level"))
    return O.motion_peak(rows, 1.0)


@query("w09_reading_order")
def reading(spark, d):
    h = F.pmod(F.xxhash64("doc_id", "line_ord"), F.lit(100)).cast("double")
    rows = V.lines(spark, d).select("doc_id", F.col("line_ord").alias("ord"), "text", (h / 100).alias("x0"), ((F.col("line_ord") / 3) * 10 + h / 50).alias("y0"), ((F.col("line_ord") / 3) * 10 + h / 50 + 5).alias("y1"))
    return O.reading_order(rows, 0.6, ["doc_id"])


@query("w11_variable_rate", """with f as (select user_id::varchar video_id, epoch_us(ts)//1000 ms from events), g as (select video_id, ms - lag(ms) over (partition by video_id order by ms) gap from f), l as (select video_id, list_sort(list(gap)) g from g where gap is not null group by video_id)
 select video_id, list_max(g)-list_min(g) > g[len(g)//2+1]*0.5 is_vfr from l""")
def variable_rate(spark, d):
    return O.variable_rate(V.hits(spark, d).select("video_id", F.col("mid_ms").alias("ms")), 0.5)


@query("w12_rank_margin", f"{V.with_views('hit')} select label query_id, round(case when count(*) < 2 or arg_max(score, -rank) <= 0 then 0.0 else greatest(0.0, (arg_max(score, -rank) - arg_max(score, rank)) / arg_max(score, -rank)) end, 9) margin from hit where rank <= 10 group by label")
def margin(spark, d):
    return P.margin(V.hits(spark, d).withColumnRenamed("label", "query_id"), 10)


@query("j08_nearest_frames", f"""{V.with_views('kf')}, t as (select distinct video_id, frame_idx*700 target_ms from kf), c as (select t.*, k.timestamp_ms, row_number() over (partition by t.video_id, target_ms order by abs(k.timestamp_ms-target_ms), k.timestamp_ms) n from t join kf k using (video_id))
 select video_id, target_ms, timestamp_ms frame_ms from c where n=1""")
def nearest(spark, d):
    kf = V.keyframes(spark, d)
    return O.nearest_frames(kf.select("video_id", (F.col("frame_idx") * 700).alias("target_ms")).distinct(), kf.select("video_id", F.col("timestamp_ms").alias("ms")))


@query("v04_greedy_cosine")
def greedy(spark, d):
    return O.greedy_cosine(V.keyframes(spark, d).select("video_id", F.col("frame_idx").alias("ord"), F.col("embedding").alias("vec")), 0.3)


def _hashed(spark, d):
    bits = [F.when(F.get("embedding", F.lit(i)) > 0, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i in range(12)]
    value = bits[0]
    for b in bits[1:]:
        value = value.bitwiseOR(b)
    return V.keyframes(spark, d).select("video_id", F.col("frame_idx").alias("ord"), value.alias("phash"))


@query("v05_greedy_hamming")
def hamming(spark, d):
    return O.greedy_hamming(_hashed(spark, d), 2)


ALIGN_SQL = "al as (select video_id, shot_id, string_agg(seg.text, ' ' order by seg_ord) asr_text from seg join shot using (video_id) where seg.end_ms > shot.start_ms and seg.start_ms < shot.end_ms group by all)"


@query("j02_align_segments", f"{V.with_views('shot', 'seg')}, {ALIGN_SQL} select * from al")
def align(spark, d):
    return E.align_segments(V.segments(spark, d), V.shots(spark, d))


LINES_OF_SHOTS = "ln as (select shot.video_id, shot.shot_id, line.line_ord, line.text, line.confidence from shot join line on line.doc_id % 200 = shot.shot_id and line.video_id = 'src' || cast(cast(substr(shot.video_id,2) as int) as varchar))"


def _shot_lines(spark, d):
    s = V.shots(spark, d).withColumn("src", F.concat(F.lit("src"), F.substring("video_id", 2, 9).cast("int").cast("string"))).select("video_id", "shot_id", "src")
    lines = V.lines(spark, d).select(F.col("video_id").alias("src"), (F.col("doc_id") % 200).cast("int").alias("shot_id"), "line_ord", "text", "confidence")
    return s.join(lines, ["src", "shot_id"]).drop("src")


@query("j01_assemble", f"""{V.with_views('shot', 'seg', 'line')}, {ALIGN_SQL}, {LINES_OF_SHOTS}, oc as (select video_id, shot_id, count(*) n_lines, md5(string_agg(text, '|' order by line_ord, text, confidence)) lines_md5 from ln group by all)
 select shot.video_id, shot.shot_id, asr_text, coalesce(n_lines, 0) n_lines, coalesce(lines_md5, md5('')) lines_md5, case when shot.shot_id % 2 = 0 then 'caption ' || shot.shot_key end caption_en from shot left join al using (video_id, shot_id) left join oc using (video_id, shot_id)""")
def assemble(spark, d):
    shots = V.shots(spark, d)
    captions = shots.select("shot_key", F.when(F.col("shot_id") % 2 == 0, "ok").otherwise("failed").alias("status"), F.concat(F.lit("caption "), F.col("shot_key")).alias("caption_en"))
    entities = shots.select("shot_key", F.lit("failed").alias("status"), F.array().cast("array<string>").alias("persons"))
    made = E.assemble(shots, E.align_segments(V.segments(spark, d), shots), _shot_lines(spark, d), captions, entities)
    return made.select("video_id", "shot_id", "asr_text", F.size("ocr").cast("bigint").alias("n_lines"), F.md5(F.array_join(F.transform("ocr", lambda x: x["text"]), "|")).alias("lines_md5"), "caption_en")


@query("a02_merge_lines", f"""{V.with_views('line')} select doc_id, arg_max(text, (confidence, -line_ord)) as text, max(confidence) confidence, min(line_ord) line_ord from line where doc_id % 1 = 0 group by doc_id, lower(replace(nfc_normalize(text), 'ß', 'ss'))""".replace("where doc_id % 1 = 0 ", ""))
def merge_lines(spark, d):
    return E.merge_lines(V.lines(spark, d), ["doc_id"]).select("doc_id", "text", "confidence", "line_ord")


#: On odd documents the letter e with acute stands in its decomposed form.
OVERLAY_SQL = f"""{V.with_views('line')}, ln as (select video_id, doc_id, line_ord, confidence, t as text, regexp_replace(nfc_normalize(t), {WS}, '', 'g') as key from (select *, case when doc_id % 2 = 1 then replace(text, chr(233), 'e' || chr(769)) else text end t from line)),
 n as (select video_id, count(distinct doc_id) n_shots from ln group by all), o as (select video_id, key, arg_min(text, (-confidence, doc_id, line_ord)) as text, max(confidence) confidence from ln join n using (video_id) group by video_id, key, n_shots having count(distinct doc_id) / n_shots >= 0.01)"""


def _overlay(spark, d):
    text = F.when(F.col("doc_id") % 2 == 1, F.replace("text", F.lit("\u00e9"), F.lit("e\u0301"))).otherwise(F.col("text"))
    lines = V.lines(spark, d).withColumn("text", text).withColumnRenamed("doc_id", "shot_id")
    return E.split_overlay(lines, lines.groupBy("video_id").agg(F.count_distinct("shot_id").alias("n_shots")), 0.01)


@query("a03_overlay_lines", OVERLAY_SQL + " select * from o")
def overlay(spark, d):
    return _overlay(spark, d)[1]


@query("a03_scene_lines", OVERLAY_SQL + " select video_id, count(*) n from ln where (video_id, key) not in (select video_id, key from o) group by video_id")
def scene(spark, d):
    return _overlay(spark, d)[0].groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))


@query("s20_bundles", f"{V.with_views('shot')} select shot.shot_key, list(keyframe_id order by timestamp_ms, keyframe_id) frames from shot join kf using (shot_key) group by all")
def bundles(spark, d):
    made = E.bundles(V.shots(spark, d).select("shot_key"), V.keyframes(spark, d).select("shot_key", "timestamp_ms", "keyframe_id"))
    return made.select("shot_key", F.transform("frames", lambda f: f["keyframe_id"]).alias("frames"))


LEDGER_SQL = f"""{V.with_views('line')}, s as (select cast(doc_id as varchar) shot_key, list(text order by line_ord) filter (where confidence >= 0.5) screen_text from line group by all)"""


def _ledger(spark, d):
    item = F.struct("line_ord", "text", "confidence")
    chron = V.lines(spark, d).groupBy(F.col("doc_id").cast("string").alias("shot_key")).agg(F.array_sort(F.collect_list(item)).alias("ocr"))
    named = chron.withColumn("persons", F.array(F.lit("A"), F.lit("B"))).withColumn("orgs", F.array(F.lit("B"))).withColumn("places", F.lit(None).cast("array<string>"))
    counts = V.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("shot_key"), F.col("quality").alias("people_count"), F.lit(None).cast("array<string>").alias("salient_objects"))
    return E.ledger(named, counts, 0.5)


@query("x01_ledger", LEDGER_SQL + " select shot_key, coalesce(screen_text, []) screen_text, ['A','B'] spoken_entities, quality people_count from s left join labels on cast(labels.doc_id as varchar)=shot_key")
def ledger(spark, d):
    return _ledger(spark, d).select("shot_key", "screen_text", "spoken_entities", "people_count")


@query("x02_ledger_answer", LEDGER_SQL + " select shot_key, screen_text[1] answer, case when screen_text[1] is null then 'spoken_entities' else 'screen_text' end field, coalesce(screen_text[1], 'A') as value from s")
def answer(spark, d):
    return _ledger(spark, d).select("shot_key", E.ledger_answer(F.lit("read_text")).alias("a")).select("shot_key", "a.answer", "a.field", "a.value")


@query("p19_factoid_text", LEDGER_SQL + " select shot_key, md5(array_to_string(list_concat(list_concat(coalesce(screen_text, []), ['A','B']), case when quality is null then [] else [quality || ' people'] end), '. ')) h from s left join labels on cast(labels.doc_id as varchar)=shot_key")
def factoid(spark, d):
    return _ledger(spark, d).select("shot_key", F.md5(E.factoid_text()).alias("h"))


@query("j07_evidence_window", f"""{V.with_views('shot')}, m as (select shot_key, video_id, (start_ms+end_ms)//2 mid_ms from shot), a as (select video_id query_id, video_id, min(mid_ms)+20000 anchor_ms from m group by video_id),
 w as (select query_id, shot_key, abs(mid_ms-anchor_ms) off from a join m using (video_id) where abs(mid_ms-anchor_ms) <= 30000), r as (select *, row_number() over (partition by query_id order by off, shot_key) rank from w) select * from r where rank <= 5""")
def zoom(spark, d):
    meta = V.shots(spark, d).select("shot_key", "video_id", F.expr("(start_ms + end_ms) div 2").alias("mid_ms"))
    anchors = meta.groupBy("video_id").agg((F.min("mid_ms") + 20_000).alias("anchor_ms")).withColumn("query_id", F.col("video_id"))
    return E.evidence_window(anchors, meta, 30_000, 5)


@query("f01_speech_rate", f"{V.with_views('seg')} select video_id, count(*) kept from seg where end_ms-start_ms <= 0 or length(regexp_replace(text, {WS}, '', 'g'))/((end_ms-start_ms)/1000.0::double) >= 20 group by video_id")
def rate(spark, d):
    grouped = V.segments(spark, d).groupBy("video_id").agg(F.collect_list(F.struct("start_ms", "end_ms", "text")).alias("s"))
    return grouped.select("video_id", F.size(E.fast_talk(F.col("s"), 20)).cast("bigint").alias("kept")).where("kept > 0")


@query("f18_phrase_hits", f"{V.with_views('line')} select distinct doc_id from line where contains(lower(nfc_normalize(text)), 'the of')")
def phrase(spark, d):
    return E.phrase_hits(V.lines(spark, d), "THE of", "doc_id")


@query("s21_last_wins", "select user_id, arg_max(event_type, event_id) event_type, max(event_id) last_id from events where value > 10 group by user_id")
def last_wins(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id"), F.when(F.col("value") > 10, "ok").otherwise("failed").alias("status"), "event_type", F.col("event_id").alias("ord"), F.col("event_id").alias("last_id"))
    return M.ok_rows(e, "user_id").select("user_id", "event_type", "last_id")


@query("s15_shot_meta", f"{V.with_views('shot')} select shot_key, video_id, start_ms, end_ms, (start_ms+end_ms)//2 mid_ms from shot")
def shot_meta(spark, d):
    return M.shot_meta(V.shots(spark, d).withColumn("ord", F.col("shot_id"))).select("shot_key", "video_id", "start_ms", "end_ms", "mid_ms")


@query("j12_pending", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def pending(spark, d):
    return M.pending(V.table(spark, d, "documents").select("doc_id"), V.table(spark, d, "labels"), "doc_id")


@query("s14_violations", "select cast(user_id as varchar) as key, 'repeated' reason from events group by user_id having count(*) > 1 union all select cast(user_id as varchar), 'model' from events where event_type <> 'click'")
def violations(spark, d):
    return M.violations(V.table(spark, d, "events").withColumnRenamed("event_type", "model_id"), "user_id", "click")


@query("s26_id_range", "select 'L01' archive, 'L01_V' || lpad(i::varchar, 3, '0') video_id from range(1, 32) t(i) where i not in (7, 19)")
def id_range(spark, d):
    return M.id_range(spark, "L01", 1, 31, [7, 19])


@query("s27_mismatches", "with a as (select url path, length(html) bytes from pages where page_id % 5 <> 0), e as (select url path, length(html) + (page_id % 7 = 0)::int bytes from pages where page_id % 3 <> 0) select path, case when a.bytes is null then 'missing' when e.bytes is null then 'foreign' else 'differs' end reason from e full join a using (path) where a.bytes is distinct from e.bytes")
def mismatches(spark, d):
    p = V.table(spark, d, "pages").select(F.col("url").alias("path"), F.length("html").alias("bytes"), "page_id")
    expected = p.where("page_id % 3 <> 0").select("path", (F.col("bytes") + F.when(F.col("page_id") % 7 == 0, 1).otherwise(0)).alias("bytes"))
    return M.mismatches(expected, p.where("page_id % 5 <> 0").select("path", "bytes"), "bytes")


@query("s29_batches", "select page_id, cast((row_number() over (order by page_id)-1)//50 as int) batch from pages")
def batches(spark, d):
    return M.batched(V.table(spark, d, "pages").select("page_id"), 50, "page_id")
