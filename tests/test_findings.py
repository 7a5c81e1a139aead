"""Queries against their SQL on small tables that the given data do not contain."""

import functools
import itertools
import math
import operator

import duckdb
import pytest
from oracle import bag
from pyspark.sql import functions as F

from shotlake.operators import ranking as R
from shotlake.plans import registry


def both(spark, folder, name, **tables):
    """A query and its SQL over tables given as SQL."""
    with duckdb.connect() as con:
        for table, sql in tables.items():
            con.execute(f"copy ({sql}) to '{folder}/{table}.parquet' (format parquet)")
            con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
        return registry.QUERIES[name](spark, str(folder)).toPandas(), con.execute(registry.ORACLES[name]).df()


def test_pages_may_share_a_url(spark, tmp_path):
    pages = "select i::bigint page_id, case when i in (3, 4, 5, 14) then 'a' else '/../u' || i end url, 'x' html from range(30) t(i)"
    got, want = both(spark, tmp_path, "s24_zip_selection", pages=pages)
    assert bag(got) == bag(want)


def test_vectors_round_as_in_sql(spark, tmp_path):
    """Negative numbers that round to zero keep their sign, as in the SQL."""
    vectors = "select i::bigint vec_id, [-0.0000001, -0.0, 0.3, i]::float[] embedding, 0 as label from range(1, 4) t(i)"
    got, want = both(spark, tmp_path, "v01_normalise", embeddings=vectors)
    assert bag(got) == bag(want)
    with duckdb.connect() as con:
        values = [r[0] for r in con.execute("select (i * 7919 % 20011 - 10000)::double / 1024 / 125 from range(20011) t(i)").fetchall()]
        rounded = con.execute("select list(round(x, 6)) from (select unnest(?::double[]) x)", [values]).fetchone()[0]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(R.rounded(F.col("x"), 6)).collect()] == rounded


def test_windows_round_as_in_sql(spark):
    """Contributions near a half of the ninth digit, once after rounding to twelve."""
    ranks = [15470, 32551, 125026, 130753]
    rankings = spark.createDataFrame([("q", "click", r, f"s{r}") for r in ranks], "query_id string, label string, rank bigint, shot_key string")
    weights = spark.createDataFrame([("click", 0, 1.0)], "label string, label_ord int, weight double")
    meta = spark.createDataFrame([(f"s{r}", f"v{r}", r) for r in ranks], "shot_key string, video_id string, mid_ms bigint")
    got = {r.shot_key: r.score for r in R.fuse_windows(rankings, weights, meta, 1000).collect()}
    with duckdb.connect() as con:
        assert got == dict(con.execute("select 's' || r, round(round(1.0::double / (60.0::double + r), 12), 9) from (select unnest(?::bigint[]) r)", [ranks]).fetchall())


def sum_in_order(values):
    """`sum` makes up for lost digits, which doubles added one by one do not."""
    return functools.reduce(operator.add, values, 0.0)


def test_windows_add_in_a_fixed_order(spark):
    """What three labels add rounds to other digits in another order; it is added from the smallest up, not in order of arrival."""
    weight = {"click": 1.0, "purchase": 1.5, "view": 0.8}
    ranks = [(2677, 1531, 596), (1282, 1461, 1104), (844, 1683, 2991)]
    cases = {f"v{i}{''.join(o)}": (dict(zip(weight, r, strict=True)), o) for i, r in enumerate(ranks) for o in itertools.permutations(weight)}
    rankings = spark.createDataFrame([("q", x, r[x], f"{v}:{x}") for v, (r, _) in cases.items() for x in weight], "query_id string, label string, rank bigint, shot_key string")
    weights = spark.createDataFrame([(x, i, w) for i, (x, w) in enumerate(weight.items())], "label string, label_ord int, weight double")
    meta = spark.createDataFrame([(f"{v}:{x}", v, t) for v, (_, o) in cases.items() for t, x in enumerate(o)], "shot_key string, video_id string, mid_ms bigint")
    score = lambda r, order: math.floor(sum_in_order(order(round(weight[x] / (60.0 + r[x]), 12) for x in weight)) * 1.5 * 1e9 + 0.5) / 1e9
    want = {v: score(r, sorted) for v, (r, _) in cases.items()}
    fused = R.fuse_windows(rankings, weights, meta, 1000).groupBy(F.substring_index("shot_key", ":", 1).alias("video")).agg(F.max("score").alias("score"))
    assert {r.video: r.score for r in fused.collect()} == want


def test_orphans_stay_orphans_in_a_large_corpus(spark, tmp_path):
    """Video V000 has more than 999 shots, and there is a video V999."""
    vectors = "select i::bigint vec_id, [1.0, 2.0]::float[] embedding, case when i < 3003 then 0 when i < 3010 then 999 else i % 9 end::int as label from range(3200) t(i)"
    got, want = both(spark, tmp_path, "e07_repair", embeddings=vectors)
    assert bag(got) == bag(want)


def test_gaps_are_filled_as_in_sql(spark, tmp_path):
    events = "select (i * i * 7 % 1201)::bigint event_id, (i % 5)::bigint user_id from range(300) t(i)"
    got, want = both(spark, tmp_path, "w07_fill_gaps", events=events)
    assert bag(got) == bag(want)


def test_gaps_move_rows_once(spark):
    """Frames are dealt by video; what is added is not dealt again, as it can't meet a frame or another gap's."""
    from shotlake.operators import ordered as O

    frames = spark.createDataFrame([("v", 0), ("v", 0), ("v", 95), ("v", None), ("w", 7), ("v", None)], "video_id string, ms bigint")
    filled = O.fill_gaps(frames, 20)
    assert sorted(map(str, (tuple(r) for r in filled.collect()))) == sorted(map(str, [("v", None), *[("v", 95 * i // 5) for i in range(6)], ("w", 7)]))
    assert filled._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_gaps_of_a_query_move_rows_once(spark, tmp_path):
    """The whole query deals its frames once, too, and frames that stand twice, or have no user or time, count once."""
    events = "select case when i % 31 = 0 then null else i * i * 7 % 1201 end::bigint event_id, case when i % 17 = 0 then null else i % 3 end::bigint user_id from range(300) t(i)"
    got, want = both(spark, tmp_path, "w07_fill_gaps", events=events)
    assert bag(got.assign(ms=got.ms.astype("Int64"))) == bag(want.assign(ms=want.ms.astype("Int64")))
    plan = registry.QUERIES["w07_fill_gaps"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1


def test_sparse_scores_stay_with_their_documents(spark):
    """Terms are counted and scored where their document is; only the best rows of a query move on."""
    import re

    from shotlake.operators import evidence as E

    docs = spark.createDataFrame([(1, 0, "a b b"), (1, 0, "b c"), (2, 1, "c"), (3, 2, "")], "id int, ord int, text string")
    queries = spark.createDataFrame([("q", "b", 1.0), ("q", "c", 2.0), ("r", "c", -1.0), ("r", "z", 1.0)], "query_id string, term string, qw double")
    found = R.sparse_top_k(queries, E.postings(docs), 5)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [("q", 1, 4.098612, 1), ("q", 2, 2.0, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(id[^)]*term", plan)


@pytest.mark.parametrize("rows", [8192, 7])
def test_second_search_in_blocks(spark, rows):
    """Pairs of blocks give what the first search gives, with ties, nulls and vectors of other lengths."""
    made = [(i, [float(i % 7), float(i % 5)] if i % 11 else None) for i in range(60)] + [(60, [1.0]), (61, [2.0, 1.0, 0.0])]
    index = spark.createDataFrame(made, "id int, vec array<double>")
    queries = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(23)] + [(23, [3.0]), (24, None)], "query_id int, qvec array<double>")
    told = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))
    assert told(R.dense_top_k_in_blocks(queries, index, 4, rows=rows)) == told(R.dense_top_k(queries, index, 4))


def test_parity_meets_blocks_not_pairs(spark, tmp_path):
    """No row for each pair of a query and a vector, which 1 GB has too many of."""
    with duckdb.connect() as con:
        con.execute(f"copy (select i::bigint vec_id, [i % 7, i % 5]::float[] embedding, (i % 3)::int as label from range(100) t(i)) to '{tmp_path}/embeddings.parquet' (format parquet)")
    found = registry.QUERIES["v12_parity"](spark, str(tmp_path))
    assert {(r.same, r.drift) for r in found.collect()} == {(True, 0.0)} and found.count() == 5
    assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
