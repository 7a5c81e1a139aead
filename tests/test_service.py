"""Saved indexes, plug-ins, reports, composed retrieval and sessions, against plain Python."""

import hashlib
import os
import random
import shutil
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlake import plugins
from shotlake.functions import replies
from shotlake.operators import evaluation as EV
from shotlake.operators import integrity as I
from shotlake.operators import performance as Q
from shotlake.operators import ranking as R
from shotlake.operators import retrieval as X
from shotlake.operators import service as S
from shotlake.sources import indexes as N
from shotlake.sources import manifests as M
from shotlake.sources import reports

ROOT = Path(__file__).resolve().parents[1]


def test_rest_stands_without_the_corpus_operators(tmp_path):
    kept = shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "spark-warehouse"))
    told = "import __spark_entry__ as e; q = set(e.queries()); assert set(e.oracle_sql()) <= q and len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    for gone in (None, "corpus_pipeline.py"):
        if gone:
            os.remove(kept / gone)
        subprocess.run([sys.executable, "-c", told], cwd=kept, check=True, env={**os.environ, "PYTHONPATH": str(kept)})


@pytest.mark.parametrize("kind", ["npy", "safetensors"])
def test_shards(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    arrays = {f"shard-{i:05d}.{kind}": rng.normal(size=(i + 2, 4)).astype(np.float32) for i in range(3)}
    for name, a in arrays.items():
        (tmp_path / name).write_bytes(N.encode_shard(a, kind, "float16" if "2" in name else None))
    (tmp_path / f"shard-00007.{kind}").write_bytes(N.encode_shard(arrays[f"shard-00000.{kind}"], kind)[:-3])
    (tmp_path / "notes.txt").write_text("x")
    rows = {(r.shard, r.row): r.vec for r in N.read_shards(spark, str(tmp_path)).collect()}
    for name, a in arrays.items():
        assert np.allclose([rows[name, i] for i in range(len(a))], a, atol=2e-3 if "2" in name else 0)
    assert rows[f"shard-00007.{kind}", 0] is None and len(rows) == 2 + 3 + 4 + 1
    names = os.listdir(tmp_path)
    assert N.next_shard(names) == 8 and N.next_shard([]) == 0 and N.shard_files(names)[0] == f"shard-00000.{kind}"
    with pytest.raises(ValueError, match="format"):
        N.encode_shard(arrays[f"shard-00000.{kind}"], "txt")


def test_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "key string, n int")
    M.append(rows, f"{tmp_path}/m", "key")
    M.append(rows.where("n = 1").withColumn("key", F.lit("d")), f"{tmp_path}/m", "key")
    assert M.rewrite(spark, f"{tmp_path}/m", f"{tmp_path}/n", F.col("n") > 1) == 3
    assert [r.key for r in spark.read.parquet(f"{tmp_path}/n").collect()] == ["b"]
    with pytest.raises(Exception, match="key is null"):
        M.append(rows.withColumn("key", F.lit(None).cast("string")), f"{tmp_path}/m", "key")
    assert M.shard_path("x/name.jsonl", "w1") == "x/name.w1.jsonl" and M.shard_path("x/name.jsonl", "") == "x/name.jsonl"
    (tmp_path / "ledger.jsonl").write_text('{"shot_key": "a", "n": 1}\n\nbroken\n{"shot_key": "b", "n": 2}\n{"shot_key": "a", "n": 3}\n')
    (tmp_path / "ledger.w1.jsonl").write_text('{"shot_key": "c", "n": 4}\n')
    schema = "shot_key string, n int"
    assert sorted((r.shot_key, r.n) for r in M.load_ledger(spark, f"{tmp_path}/ledger.jsonl", schema).collect()) == [("a", 3), ("b", 2)]
    assert M.merged_shards(spark, f"{tmp_path}/ledger.jsonl", schema).count() == 4
    (tmp_path / "chronicle.jsonl").write_text('{"video_id": "v", "shot_id": 0}\n{"video_id": "v", "shot_id": 1}\n')
    assert M.load_chronicle(spark, f"{tmp_path}/chronicle.jsonl", "video_id string, shot_id int").count() == 2
    (tmp_path / "twice.jsonl").write_text('{"video_id": "v", "shot_id": 0}\n{"video_id": "v", "shot_id": 0}\n')
    with pytest.raises(ValueError, match="repeats"):
        M.load_chronicle(spark, f"{tmp_path}/twice.jsonl", "video_id string, shot_id int")
    M.write_json(f"{tmp_path}/r.json", {"a": 1})
    assert not (tmp_path / "r.json.part").exists()
    (tmp_path / "v").mkdir()
    for name in ("b.MP4", "a.mp4", "c.txt"):
        (tmp_path / "v" / name).write_bytes(name.encode())
    assert [r.path.rpartition("/")[2] for r in M.discover(spark, f"{tmp_path}/v", [".mp4"]).collect()] == ["a.mp4", "b.MP4"]
    assert {r.sha256 for r in M.checksums(spark, f"{tmp_path}/v").collect()} == {hashlib.sha256(n).hexdigest() for n in (b"b.MP4", b"a.mp4", b"c.txt")}


def test_dense_index(spark, tmp_path):
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(30, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id bigint, vec array<double>")
    index = N.dense(rows, "m1")
    N.save_dense(index, f"{tmp_path}/i")
    again = N.load_dense(spark, f"{tmp_path}/i")
    assert (again.model_id, again.dim, again.count) == ("m1", 5, 30)
    queries = spark.createDataFrame([(q, vecs[q].tolist()) for q in (3, 8)], "query_id bigint, qvec array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in N.search(again, queries, 40, "m1").collect()}
    for q in (3, 8):
        assert [got[q, k + 1] for k in range(30)] == np.argsort(-(vecs @ vecs[q]), kind="stable").tolist()
    with pytest.raises(ValueError, match="m2"):
        N.search(again, queries, 3, "m2")
    with pytest.raises(Exception, match="length"):
        N.search(again, queries.withColumn("qvec", F.array(F.lit(1.0))), 3, "m1").collect()
    asked = spark.createDataFrame([(4,), (99,)], "id bigint")
    assert N.vectors_for(again, asked.where("id = 4")).first().vec == vecs[4].tolist()
    with pytest.raises(Exception, match="unknown vector id: 99"):
        N.vectors_for(again, asked).collect()
    for bad in (rows.unionAll(rows), rows.withColumn("vec", F.when(F.col("id") == 1, F.array(F.lit(1.0))).otherwise(F.col("vec"))), rows.withColumn("vec", F.transform("vec", lambda x: F.lit(float("nan"))))):
        with pytest.raises(ValueError):
            N.dense(bad, "m1")
    spark.createDataFrame([("m1", 5, 31)], "model_id string, dim int, count bigint").write.mode("overwrite").parquet(f"{tmp_path}/i/meta")
    with pytest.raises(ValueError, match="rows"):
        N.load_dense(spark, f"{tmp_path}/i")
    sparse = spark.createDataFrame([("a", 1, 0, 0.5), ("b", 1, 0, -1.0), ("a", 2, 1, 0.2)], "term string, id int, ord int, dw double")
    N.save_sparse(sparse, f"{tmp_path}/s")
    assert sorted((r.term, r.id) for r in N.load_sparse(spark, f"{tmp_path}/s").collect()) == [("a", 1), ("a", 2)]


def test_search_in_blocks_and_with_ties(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_QUERIES", 4)
    index = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(20)] + [(50, [1.0])], "id bigint, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(9)], "query_id bigint, qvec array<double>")
    rows = R.dense_top_k(queries, index, 4).orderBy("query_id", "rank").collect()
    assert [r.id for r in rows] == [2, 5, 8, 11] * 9 and all(r.score == 2.0 + r.query_id for r in rows)


def test_endpoint_pairs():
    assert replies.endpoint_pairs("a, b", "m") == [("a", "m"), ("b", "m")]
    assert replies.endpoint_pairs(["a", "b"], ["m", "n"]) == [("a", "m"), ("b", "n")]
    assert replies.endpoint_pairs(None, "m") == [(None, "m")]
    for bad in (([], "m"), ("a", []), (["a"], ["m", "n"])):
        with pytest.raises(ValueError):
            replies.endpoint_pairs(*bad)


def test_registry_cache_and_pool():
    registry = plugins.Registry()
    registry.register("ocr", "plain")(lambda scale=1: scale)
    assert registry.make("ocr", "plain", scale=3) == 3 and registry.names("ocr") == ["plain"]
    with pytest.raises(ValueError, match="known: plain"):
        registry.make("ocr", "other")
    with pytest.raises(ValueError):
        registry.register("ocr", "plain")(int)
    cache, made = plugins.ModelCache(2), []
    for key in "abacab":
        cache.get(key, lambda key=key: made.append(key) or key)
    assert made == ["a", "b", "c", "b"] and "c" not in cache
    now = [0.0]
    calls = []

    def client(name, fails):
        def call(request):
            calls.append(name)
            if request in fails:
                raise ConnectionError(request)
            return name + request

        return call

    pool = plugins.EndpointPool([client("a", {"x"}), client("b", set())], 10.0, clock=lambda: now[0])
    assert [pool.call(r) for r in ("x", "y", "z")] == ["bx", "by", "bz"] and calls == ["a", "b", "b", "b"]
    now[0] = 11.0
    assert {pool.call("y") for _ in range(4)} == {"ay", "by"}
    assert pool.batch(["y", "x", "z"])[1] == "bx"
    strict = plugins.EndpointPool([client("a", {"x"}), client("b", set())], refused=lambda e: True)
    with pytest.raises(ConnectionError):
        strict.call("x")
    assert strict.batch(["x"]) in ([None], ["bx"])


def test_late_or_failing_steps_change_nothing(spark):
    rows = spark.range(3)
    assert plugins.with_timeout(lambda d: d.limit(1), rows, 5).count() == 1
    assert plugins.with_timeout(lambda d: time.sleep(3), rows, 0.1) is rows
    assert plugins.with_timeout(lambda d: 1 / 0, rows, 5) is rows
    assert X.degraded(lambda d: d.select("missing"), rows) is rows
    assert X.degraded(lambda d: d.limit(2), rows).count() == 2


def test_plugins_in_batches(spark):
    class Hashing:
        model_id, dim = "hash", 3

        def encode_texts(self, texts):
            return np.array([[float(b) for b in hashlib.md5(t.encode()).digest()[:3]] for t in texts])

        def encode_images(self, images):
            return np.zeros((len(images), 3))

    assert isinstance(Hashing(), plugins.ImageTextEncoder) and not isinstance(Hashing(), plugins.Translator)
    rows = spark.createDataFrame([("q1", "a"), ("q2", "b")], "query_id string, text string")
    got = {r.query_id: r.qvec for r in plugins.texts_encoded(rows, Hashing, "hash").collect()}
    assert got["q2"] == Hashing().encode_texts(["b"])[0].tolist()
    videos = spark.createDataFrame([("v", bytearray(b"abc"), [0, 2])], "video_id string, content binary, targets array<int>")
    decode = lambda: lambda data, targets: {t: data[t : t + 1] for t in targets}
    assert [(r.at_ms, bytes(r.image)) for r in plugins.frames_of(videos, decode, "bytes").collect()] == [(0, b"a"), (2, b"c")]
    assert plugins.entropy_bits(np.zeros((4, 4))) == 0 and plugins.entropy_bits(np.arange(256).reshape(16, 16)) == pytest.approx(8)
    cases = spark.createDataFrame([("q", "kis_t", "x", ["y"])], "query_id string, kind string, text string, reveals array<string>")
    post = lambda url, body: {"results": [{"video_id": body["query"], "timestamp_ms": i, "score": 1.0} for i in range(5)]}
    found = plugins.RemoteRetriever("http://h/", post=post).search(cases, 3).collect()
    assert [(r.video_id, r.timestamp_ms, r["rank"]) for r in found] == [("x\ny", 0, 1), ("x\ny", 1, 2), ("x\ny", 2, 3)]
    with pytest.raises(Exception, match="clips"):
        plugins.RemoteRetriever("http://h", post=post).search(cases.withColumn("kind", F.lit("kis_v")), 3).collect()


def test_global_rank(spark):
    values = [random.Random(3).randrange(50) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(values)), "id int, v int").repartition(5)
    got = {r.id: r["rank"] for r in I.global_rank(rows, F.desc("v"), "id").collect()}
    order = sorted(range(400), key=lambda i: (-values[i], i))
    assert got == {i: k + 1 for k, i in enumerate(order)}
    assert I.global_rank(rows.where("id < 0"), "v").count() == 0
    modes = EV.round_robin(rows, ["x", "y"], "id").collect()
    assert {r.id: r.mode for r in modes} == {i: "xy"[i % 2] for i in range(400)}


def test_sampled_windows(spark):
    rng = random.Random(4)
    frames = [(f"v{rng.randrange(4)}", rng.randrange(60_000), f"p{i}") for i in range(120)]
    rows = spark.createDataFrame(frames, "video_id string, timestamp_ms bigint, image_path string")
    got = {(r.video_id, r.t_start_ms, r.t_end_ms): r.frames for r in EV.sampled_windows(rows, 12, 5000, 3).collect()}
    want, taken = {}, {}
    for v, ts, p in sorted(frames, key=lambda f: hashlib.md5(f"0|{f[0]}|{f[1]}|{f[2]}".encode()).hexdigest()):
        s = max(0, ts - 2500)
        if len(want) == 12:
            break
        if any(a < s + 5000 and s < a + 5000 for a in taken.get(v, [])):
            continue
        taken.setdefault(v, []).append(s)
        inside = sorted((t, q) for u, t, q in frames if u == v and s <= t <= s + 5000)
        n = min(3, len(inside))
        want[v, s, s + 5000] = [inside[int(i * (len(inside) / n))][1] for i in range(n)]
    assert got == want


def test_performance_model(spark):
    rng = np.random.default_rng(5)
    x = rng.random((40, len(Q.FEATURES)))
    y = (x[:, 0] + 0.3 * rng.normal(size=40) > 0.5).astype(float)
    rows = spark.createDataFrame([(f"q{i:02d}", *map(float, x[i]), float(y[i])) for i in range(40)], ["query_id", *Q.FEATURES, "hit"])
    model, brier, loo = Q.train(rows, 10, calibrated=True)
    w = np.array([*model.coef, model.intercept])
    z = np.hstack([x, np.ones((40, 1))])
    slope = z.T @ (1 / (1 + np.exp(-z @ w)) - y) + np.array([*model.coef, 0.0])
    assert np.abs(slope).max() < 1e-6 and brier < 0.25 and len(loo) == 40
    assert model.ys == sorted(model.ys) and Q.Model.read(model.saved()) == model
    told = {r.query_id: r for r in Q.advise(rows, model._replace(xs=None, ys=None), 0.5).collect()}
    assert all(told[f"q{i:02d}"].p_hit == pytest.approx(1 / (1 + np.exp(-z[i] @ w)), abs=1e-8) for i in range(40))
    assert all((r.hint is None) == (r.p_hit >= 0.5) for r in told.values())
    with pytest.raises(ValueError, match="both"):
        Q.train(rows.where("hit = 1"), 10)
    with pytest.raises(ValueError, match="version"):
        Q.Model.read({"artifact_version": 0})
    assert Q.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]))[1] == [0.0, 0.5, 0.5, 1.0]


def test_vector_steps(spark):
    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(24, 4))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id bigint, vec array<double>")
    meta = spark.createDataFrame([(i, f"s{i // 2}", i * 10) for i in range(24)], "id bigint, shot_key string, timestamp_ms bigint")
    q = rng.normal(size=4)
    query = spark.createDataFrame([("q", q.tolist())], "query_id string, qvec array<double>")

    def shots(v, k):
        best = {}
        for i in np.argsort(-(vecs @ v)).tolist():
            best.setdefault(f"s{i // 2}", vecs[i] @ v)
        return sorted(best, key=lambda s: -best[s])[:k]

    some = lambda *keys: spark.createDataFrame([("q", k) for k in keys], "query_id string, shot_key string")
    moved = q + 0.75 * vecs[[2, 3, 8, 9]].mean(0) - 0.25 * vecs[[10, 11]].mean(0)
    found = X.feedback(query, some("s1", "s4"), some("s5"), index, meta, 5).orderBy("rank").collect()
    assert [r.shot_key for r in found] == shots(moved / np.linalg.norm(moved), 5)
    centre = vecs[[6, 7]].mean(0)
    assert [r.shot_key for r in X.similar_shots(some("s3"), index, meta, 4).orderBy("rank").collect()] == [s for s in shots(centre, 13) if s != "s3"][:4]
    candidates = spark.createDataFrame([("q", s, 1.0 / (k + 1), k + 1) for k, s in enumerate(["s2", "s0", "s9"])], "query_id string, shot_key string, score double, rank int")
    renders = spark.createDataFrame([("q", vecs[4].tolist()), ("q", (-q).tolist())], "query_id string, vec array<double>")
    fused = X.imagined(candidates, renders, spark.createDataFrame([("q", vecs[4].tolist())], "query_id string, qvec array<double>"), index, meta, 0.5, 0.7).collect()
    want = {}
    for w, names in ((1.0, ["s2", "s0", "s9"]), (0.7, shots(vecs[4], 3))):
        for k, s in enumerate(names):
            want[s] = want.get(s, 0) + w / (60 + k + 1)
    assert {r.shot_key: r.score for r in fused} == pytest.approx(want, abs=1e-8)
    none = X.imagined(candidates, renders.where("false"), query, index, meta, 0.5, 0.7)
    assert [r.shot_key for r in none.orderBy("rank").collect()] == ["s2", "s0", "s9"]
    docs = spark.createDataFrame([("s0", [[1.0, 0.0]]), ("s9", [[0.0, 1.0], [0.9, 0.0]])], "shot_key string, dvecs array<array<double>>")
    again = X.late_interaction(candidates, spark.createDataFrame([("q", [[0.0, 1.0], [1.0, 0.0]])], "query_id string, qvecs array<array<double>>"), docs, 3)
    assert [r.shot_key for r in again.orderBy("rank").collect()] == ["s9", "s0", "s2"]


def test_plans_chunks_and_channels(spark):
    lists = {n: [] for n in replies.SPEC_LISTS} | {"visual_phrases": ["A red car. It turns! Night", " "], "ocr_literals": ["EXIT"]}
    kind = "struct<" + ",".join(f"{n}:array<string>" for n in lists) + ">"
    specs = spark.createDataFrame([("q", tuple(lists.values()), "raw")], f"query_id string, spec {kind}, raw string")
    weights = {"dense_visual": 1.0, "literal_sparse": 2.0}
    subs = X.plan(specs, {"visual_phrases": 1.0, "ocr_literals": 1.5}, weights, 0.25)
    assert [(r.label, r.weight) for r in subs.orderBy("label_ord").collect()] == [("visual_phrases[0].dense_visual", 1.0), ("ocr_literals[0].literal_sparse", 3.0), ("raw_query.literal_sparse", 0.5)]
    chunks = X.chunked(subs, 3, 0.5).where("channel = 'dense_visual'").orderBy("label").collect()
    assert [(r.label, r.text, r.weight, r.pos) for r in chunks] == [(f"visual_phrases[0].chunk{i}.dense_visual", t, 0.5, i) for i, t in enumerate(["A red car", "It turns", "Night"])]
    assert set(X.available({"a": lambda: 1, "b": lambda: None})) == {"a"}
    with pytest.raises(FileNotFoundError):
        X.available({"b": lambda: None})
    with pytest.raises(ValueError, match="unknown channels"):
        X.fusion_search(specs.select("query_id", F.lit("x").alias("text")), {}, {"a": 1.0}, specs, 3)


def test_hints_spend_their_budget(spark):
    rng = random.Random(7)
    rows = [(s, i, rng.choice(["Who?", " who? ", "what"]), rng.randrange(5), rng.random() < 0.2, rng.random() < 0.2, rng.randrange(2)) for s in "ab" for i in range(40)]
    asked = spark.createDataFrame(rows, "session_id string, seq int, question string, agreeing_count int, cross boolean, disconfirmed boolean, pending int")
    got = {(r.session_id, r.seq): r.hint for r in S.hints(asked, 2, 3).collect()}
    want = {}
    for s in "ab":
        key, spent = None, 0
        for _, i, q, n, cross, no, pending in (r for r in rows if r[0] == s):
            if q.strip().casefold() != key:
                key, spent = q.strip().casefold(), 0
            good = not no and (cross or n >= 3)
            want[s, i] = "wait_for_reads" if spent >= 2 else "submit_now" if good else "wait_for_reads" if pending else "escalate_zoom"
            spent += want[s, i] == "submit_now" and not pending
    assert got == want


def test_answer_groups_and_packs(spark):
    reads = spark.createDataFrame([("q", "a", "ba người", "number", 1.0, 0), ("q", "b", "3", "number", 0.5, 1), ("q", "c", "7", "number", 1.4, 2), ("q", "d", "many", "number", 9.0, 3)], "question_id string, shot_key string, answer string, kind string, score double, ord int")
    none = spark.createDataFrame([], "question_id string, shot_key string, answer string")
    track = spark.createDataFrame([("q", "bảy")], "question_id string, answer string")
    order = lambda df: [r.normalized for r in df.orderBy("rank").collect()]
    assert order(S.answer_groups(reads, track.where("false"), none, 0.25, 9.0)) == ["3", "7", "many"]
    assert order(S.answer_groups(reads, track, none, 0.25, 9.0)) == ["7", "3", "many"]
    contradicts = spark.createDataFrame([("q", "c", "ba người")], "question_id string, shot_key string, answer string")
    assert order(S.answer_groups(reads, track.where("false"), contradicts, 0.25, 9.0)) == ["7", "3", "many"]
    meta = spark.createDataFrame([(f"s{i}", "v", i * 1000) for i in range(8)], "shot_key string, video_id string, mid_ms bigint")
    candidates = spark.createDataFrame([("q", "s3", None, 1), ("q", "s6", 6900, 2), ("q", "s0", None, 3)], "query_id string, shot_key string, timestamp_ms bigint, rank int")
    packs = {r.shot_key: r.window for r in S.packs(candidates, meta, 1500, 3, 2).collect()}
    assert packs == {"s3": ["s3", "s2", "s4"], "s6": ["s7", "s6"]}
    with pytest.raises(Exception, match="more than 2"):
        S.bounded(candidates, 2).collect()


def test_reports(spark, tmp_path):
    ranks = spark.createDataFrame([("a", 1), ("b", None), ("c", 7)], "query_id string, rank int")
    text = reports.summary_markdown(EV.summary(ranks))
    assert text.splitlines()[:5] == ["| metric | value |", "| --- | --- |", "| cases | 3 |", "| misses | 1 |", "| recall@1 | 0.333 |"]
    cases = spark.createDataFrame([("count", True, False), ("entity", True, True)], "archetype string, answer_ok boolean, moment_ok boolean")
    text = reports.answers_markdown(EV.answer_rates(cases), 2.5)
    assert "| qa correct (both) | 0.500 |" in text and "| entity | 1 | 1.000 | 1.000 | 1.000 |" in text
    shots = spark.createDataFrame([("v1", True), ("v1", False), ("v2", True)], "video_id string, has_asr boolean")
    told = EV.video_coverage(shots.select("*", *[F.lit(False).alias(c) for c in ("has_ocr", "has_caption", "has_entities")]))
    assert "| asr | 0.667 | 0.500 | v1 | 0.000 |" in reports.coverage_markdown(told, {"asr": EV.concentration(told, "n_asr")})
    reports.save_report(ranks, f"{tmp_path}/r.json")
    assert "query_id" in (tmp_path / "r.json").read_text()
    with pytest.raises(ValueError):
        reports.save_report(ranks, f"{tmp_path}/s.json", 2)


def test_samples_and_resets(spark):
    members = spark.createDataFrame([("b", "2.JPG", 1), ("a", "9.jpg", 1), ("a", "x.txt", 1), ("b", "1.jpg", 0)], "package string, member string, bytes int")
    assert [(r.package, r.member) for r in I.first_samples(members, 1).collect()] == [("a", "9.jpg")]
    for n in (2, 5):
        with pytest.raises(ValueError):
            I.first_samples(members, n)
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "video_id string")
    assert I.reset(rows, "video_id", ["a"]).count() == 2 and I.reset(rows, "video_id", None).count() == 0 and I.reset(rows, "video_id", []).count() == 3
