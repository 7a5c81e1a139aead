"""Edge cases of operators against plain Python."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlake.functions import text as T
from shotlake.operators import answers as A
from shotlake.operators import evaluation as EV
from shotlake.operators import evidence as E
from shotlake.operators import ordered as O
from shotlake.operators import ranking as R
from shotlake.sources import manifests as M
from shotlake.streaming import sessions as S


def test_golden_report(spark):
    """Published fusion ranks give the published figures."""
    ranks = [1] * 5 + [2, 3, 4, 4, 5] + [8] + [20, 30, 40, 50] + [None]
    got = EV.summary(spark.createDataFrame([(str(i), r) for i, r in enumerate(ranks)], "query_id string, rank int")).first()
    assert (got.n_cases, got.n_misses, got.recall_1, got.recall_5, got.recall_10, got.recall_100) == (16, 1, 0.3125, 0.625, 0.6875, 0.9375)
    assert got.mean_ttt_s == pytest.approx(sum(min(r or 200, 200) for r in ranks) * 1.5 / 16)


def brute_windows(rows, weights, meta, w, agreement, k=60):
    con = {}
    for label, rank, shot in rows:
        if label in weights:
            con[shot, label] = con.get((shot, label), 0) + weights[label] / (k + rank)
    base = {}
    for (s, _), c in con.items():
        base[s] = base.get(s, 0) + c
    best = {}
    for head in (s for s in base if s in meta):
        inside = [s for s in base if s in meta and meta[s][0] == meta[head][0] and meta[head][1] - w <= meta[s][1] and (meta[s][1], s) <= (meta[head][1], head)]
        per = {}
        for s in inside:
            for (t, label), c in con.items():
                if t == s:
                    per[label] = max(per.get(label, 0), c)
        score = sum(per.values()) * (1 + agreement * (len({x.split(".")[-1] for x in per}) - 1))
        rep = min(inside, key=lambda s: (-round(base[s], 9), s))
        best[rep] = max(best.get(rep, 0), score)
    out = [(s, round(v, 9)) for s, v in sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))]
    return out + [(s, round(v, 9)) for s, v in sorted(base.items(), key=lambda x: (-round(x[1], 9), x[0])) if s not in best]


@pytest.mark.parametrize("seed", range(3))
def test_window_fusion(spark, seed):
    rng = random.Random(seed)
    shots = [f"s{i:02d}" for i in range(30)]
    meta = {s: (f"v{rng.randrange(3)}", rng.randrange(12) * 10) for s in shots[:26]}
    labels = ["a.dense", "b.dense", "c.sparse"]
    rows = [(x, r + 1, s) for x in labels for r, s in enumerate(rng.sample(shots, 14))] + [("a.dense", 15, shots[3])]
    weights = {"a.dense": 1.0, "b.dense": 0.5, "c.sparse": 1.5}
    got = R.fuse_windows(
        spark.createDataFrame([("q", *x) for x in rows], "query_id string, label string, rank int, shot_key string"),
        spark.createDataFrame([(x, i, w) for i, (x, w) in enumerate(weights.items())], "label string, label_ord int, weight double"),
        spark.createDataFrame([(s, v, m) for s, (v, m) in meta.items()], "shot_key string, video_id string, mid_ms bigint"), 20, 0.25,
    ).orderBy("rank").collect()
    assert [(r.shot_key, r.score) for r in got] == [(s, pytest.approx(v, abs=2e-9)) for s, v in brute_windows(rows, weights, meta, 20, 0.25)]


def test_greedy_dedup(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    kept = []
    for i, x in enumerate(v):
        if all(float(x @ v[j]) < 0.4 for j in kept):
            kept.append(i)
    rows = spark.createDataFrame([("v", i, x.tolist()) for i, x in enumerate(v)], "video_id string, ord int, vec array<double>")
    assert sorted(r.ord for r in O.greedy_cosine(rows, 0.4).collect()) == kept


def test_greedy_hamming(spark):
    rng = random.Random(5)
    rows = [(f"v{i // 12}", i % 12, rng.randrange(64)) for i in range(60)]
    seen, out = set(), []
    for v in sorted({r[0] for r in rows}):
        own = []
        for _, o, h in sorted(r for r in rows if r[0] == v):
            if h in seen or any((h ^ k).bit_count() <= 1 for k in own):
                continue
            own.append(h)
            seen.add(h)
            out.append((v, o))
    got = O.greedy_hamming(spark.createDataFrame(rows, "video_id string, ord int, phash bigint"), 1).collect()
    assert sorted((r.video_id, r.ord) for r in got) == sorted(out)


def test_reading_order(spark):
    lines = [("d", 0, "b", 50.0, 0.0, 10.0), ("d", 1, "a", 10.0, 4.0, 14.0), ("d", 2, "d", 90.0, 9.0, 19.0), ("d", 3, "c", 5.0, 12.0, 22.0), ("e", 0, "x", None, 1.0, 2.0), ("e", 1, "y", 0.0, 0.0, 1.0)]
    rows = spark.createDataFrame(lines, "doc string, ord int, text string, x0 double, y0 double, y1 double")
    got = {k: [r.text for r in sorted(v, key=lambda r: r.reading_ord)] for k, v in _by(O.reading_order(rows, 0.6, ["doc"]).collect(), "doc").items()}
    assert got == {"d": ["a", "b", "c", "d"], "e": ["x", "y"]}


def _by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_ranges_that_meet_stay_one_row_each(spark):
    """A frame that ends one range and starts the next is timed twice."""
    ranges = spark.createDataFrame([("v", 0, 4), ("v", 4, 9), ("v", 4, 9)], "video_id string, first bigint, last bigint")
    p = spark.createDataFrame([("v", 3, 0.2), ("v", 3, 0.7)], "video_id string, frame bigint, p double")
    times = spark.createDataFrame([("v", 0, 0), ("v", 4, 160), ("v", 4, 160), ("v", 9, 360)], "video_id string, frame bigint, ms bigint")
    got = sorted(map(tuple, O.ranges_to_shots(ranges, p, times).select("first", "last", "start_ms", "end_ms", "boundary_confidence").collect()))
    assert got == [(0, 4, 0, 160, 1.0), (4, 9, 160, 360, 0.7), (4, 9, 160, 360, 0.7)]


def test_unicode_functions(spark):
    words = ["Straße", "  é ", "Đặng", "é", None, ""]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(T.nfc_casefold("w").alias("c"), T.nfc_strip("w").alias("n"), T.fold_diacritics("w").alias("f")).collect()
    assert [r.c for r in got] == [None if w is None else unicodedata.normalize("NFC", w).casefold() for w in words]
    assert [r.n for r in got] == [None if w is None else unicodedata.normalize("NFC", w).strip() for w in words]
    assert got[2].f == "Dang"


def test_text_functions(spark):
    one = spark.createDataFrame([("hai mươi ba", "3 phần trăm", "người", "```json\n{\"a\": 1}\n```", "a. b! c\nd")], "n string, u string, only string, j string, s string")
    number = F.lit("number")
    r = one.select(T.parse_number(F.col("n")).alias("n"), T.without_unit(F.col("u"), number).alias("u"), T.without_unit(F.col("only"), number).alias("only"), T.reply_json(F.col("j"), "a int")["a"].alias("a"), T.sentences(F.col("s"), 3).alias("s"), T.parse_number(F.col("n"), T.PLAIN_RULES).alias("plain")).first()
    assert (r.n, r.u, r.only, r.a, r.s, r.plain) == (23, "3", "người", 1, ["a", "b", "c. d"], None)


def test_negations_are_case_folded(spark):
    candidates = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("p", "a", 1)], "query_id string, shot_key string, rank int")
    evidence = spark.createDataFrame([("a", "die STRASSE"), ("c", "Straße")], "shot_key string, evidence string")
    assert {r.shot_key for r in R.without_negated(candidates, evidence, ["Straße", " "]).collect()} == {"b"}
    own = spark.createDataFrame([("q", ["Straße", ""]), ("p", ["x"])], "query_id string, negations array<string>")
    assert {(r.query_id, r.shot_key) for r in R.without_own_negated(candidates, evidence, own).collect()} == {("q", "b"), ("p", "a")}


def test_counts_round_half_to_even(spark):
    r = spark.createDataFrame([([2, 3], [], [1, 4])], "a array<int>, b array<int>, c array<int>").select(A.count_of(F.col("a"), False).alias("a"), A.count_of(F.col("b"), False).alias("b"), A.count_of(F.col("c"), True).alias("c")).first()
    assert (r.a, r.b, r.c) == (2, 0, 4)


def test_vectors_must_be_normalisable(spark):
    with pytest.raises(Exception, match="normalised"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(R.normalised(F.col("v"))).collect()


def test_alignment_is_strict(spark):
    segs = spark.createDataFrame([("v", 1, 0, 100, "a"), ("v", 2, 100, 25_000, "b"), ("v", 3, 90, 90, "c")], "video_id string, seg_ord int, start_ms bigint, end_ms bigint, text string")
    shots = spark.createDataFrame([("v", 0, 0, 100), ("v", 1, 100, 200), ("v", 2, 24_999, 30_000)], "video_id string, shot_id int, start_ms bigint, end_ms bigint")
    assert {r.shot_id: r.asr_text for r in E.align_segments(segs, shots).collect()} == {0: "a c", 1: "b", 2: "b"}


def test_manifest_reader(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"video_id": "a", "shot_id": 1}\n\n{"video_id": "b", "sho\n{"video_id": "c", "shot_id": 2}\n')
    assert sorted(r.video_id for r in M.read_manifest(spark, str(path), "video_id string, shot_id int").collect()) == ["a", "c"]
    path.write_text('["x"]\n')
    with pytest.raises(Exception, match="no object"):
        M.read_manifest(spark, str(path), "video_id string, shot_id int").collect()


def test_settings_and_ids():
    assert M.substituted("a ${X}", {"X": "1"}) == "a 1"
    with pytest.raises(KeyError):
        M.substituted("${Y}", {})
    with pytest.raises(ValueError):
        M.Profile.of({"nonsense": 1})
    assert M.parse_ids(" b, a,b", ["a", "b", "c"]) == ["a", "b"]
    with pytest.raises(ValueError):
        M.parse_ids("z", ["a"])


def test_archive_checks(spark):
    members = spark.createDataFrame([("a/1.jpg",), ("a/1.jpg",), ("../x",), ("/abs",)], "member string")
    wanted = spark.createDataFrame([("a/1.jpg",), ("a/2.jpg",)], "member string")
    assert sorted((r.member, r.reason) for r in M.zip_selection(members, wanted).collect()) == [("../x", "unsafe"), ("/abs", "unsafe"), ("a/1.jpg", "repeated"), ("a/2.jpg", "missing")]


def test_session_stream(spark, tmp_path):
    kind = "session_id string, seq bigint, text string"
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("s", 1, " a "), ("s", 2, "b"), ("s", 3, "c"), ("t", 1, "")], kind).coalesce(1).write.parquet(source)
    seen = []
    query = S.stream(spark.readStream.schema(kind).parquet(source), 2, None).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", sink).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {r.session_id: (r.stack, r.version) for r in seen} == {"s": (["a; b", "c"], 3), "t": ([], 1)}
    batch = S.folded(spark.read.schema(kind).parquet(source), 2).collect()
    assert {r.session_id: (r.stack, r.version) for r in batch} == {"s": (["a; b", "c"], 3), "t": ([], 1)}


def test_search_of_many_queries(spark, monkeypatch):
    from shotlake.operators import ranking

    index = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(40)], "id int, vec array<double>")
    queries = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(23)], "query_id int, qvec array<double>")
    whole = sorted(map(tuple, ranking.dense_top_k(queries, index, 4).collect()))
    monkeypatch.setattr(ranking, "MOST_QUERIES", 8)
    assert sorted(map(tuple, ranking.dense_top_k(queries, index, 4).collect())) == whole and len(whole) == 92
