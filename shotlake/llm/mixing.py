"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's documents, in a seeded order, are cut into blocks. Its target
weight w gives block j (from 1) of a source the release slot floor((j - 1) / w)
and the deadline ceil(j / w); in every slot the released block with the
earliest deadline goes out. Weights are whole shares of a cycle of slots, so
the schedule of one cycle repeats, and a source is never a block or more away
from its share while all sources last. A source that runs out leaves its slots
empty; the others keep their order. Every document gets a place.

Null sources form a source of their own, named by the empty string; so do
empty names. Repeated rows stay, equal rows take adjacent places in any order.
An empty table gives an empty result. Of the input's columns only those go that
have the name of a column that `mix` adds; all others, of any name, are carried along.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Slots of a cycle at least (never fewer than sources), documents of a block, and documents that are numbered together.
CYCLE, BLOCK, TOGETHER = 1000, 16, 256
MOST_BUCKETS = 65536
#: The columns that `mix` adds.
ADDED = {"mix_source": "string", "mix_block": "bigint", "mix_slot": "bigint", "mix_position": "bigint"}


def shares(weights: dict[str, float], cycle: int = CYCLE) -> dict[str, int]:
    """Whole slots of a cycle for each source, at least one, by largest remainder."""
    cycle = max(cycle, len(weights))
    total = sum(weights.values())
    exact = {s: w / total * (cycle - len(weights)) for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: cycle - sum(out.values())]:
        out[s] += 1
    return out


def cycle_of(units: dict[str, int]) -> list[tuple[int, str, int]]:
    """(slot, source, block of the source in the cycle) by earliest deadline first among released blocks."""
    q = sum(units.values())
    releases = sorted((j * q // a, math.ceil((j + 1) * q / a), s, j) for s, a in units.items() for j in range(a))
    ready: list[tuple[int, str, int]] = []
    out, i = [], 0
    for slot in range(q):
        while i < len(releases) and releases[i][0] <= slot:
            _, deadline, s, j = releases[i]
            heapq.heappush(ready, (deadline, s, j))
            i += 1
        deadline, s, j = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline is missed")
        out.append((slot, s, j))
    return out


def tempered(counts: dict[str, int], power: float = 0.5) -> dict[str, float]:
    return {s: n**power for s, n in counts.items()}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = "text", block: int = BLOCK, cycle: int = CYCLE) -> DataFrame:
    """Adds mix_source, mix_block (of its source, from 0), mix_slot and mix_position (from 0, without gaps).

    weights: target weight of each source, by default the square root of its
    size; sources that it doesn't name get the smallest weight named. Sources
    are counted on the driver, which holds one number for each slot of a cycle:
    their number must be small against the rows.
    """
    # input columns travel under names of their own, so none can clash with those used here
    names = [f"in{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    kept = {c: n for c, n in of.items() if c not in ADDED}
    rows = docs.toDF(*names).withColumn("source", F.coalesce(F.col(of[source_col]), F.lit("")))
    counts = {r[0]: r[1] for r in rows.groupBy("source").count().collect()}
    if not counts:
        return rows.select(*kept.values(), *[F.lit(None).cast(kind).alias(c) for c, kind in ADDED.items()]).toDF(*kept, *ADDED)
    wanted = weights or tempered(counts)
    units = shares({s: wanted.get(s, min(wanted.values())) for s in counts}, cycle)
    order = sorted(units)
    q = sum(units.values())
    schedule = cycle_of(units)
    slots: dict[str, list[int]] = {s: [] for s in order}
    for slot, s, _ in schedule:
        slots[s].append(slot)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, j, slot) for slot, s, j in schedule], "source string, j bigint, at bigint")
    sources = F.from_json(F.lit(json.dumps([{"n": counts[s], "a": units[s], "slots": slots[s]} for s in order])), "array<struct<n:bigint,a:bigint,slots:array<bigint>>>")
    sizes = spark.createDataFrame([(s, counts[s], units[s], min(MOST_BUCKETS, -(-counts[s] // TOGETHER))) for s in order], "source string, n bigint, a bigint, buckets int")

    # sources are few and one row each here
    spread = rows.withColumn("hash", F.xxhash64(of[id_col])).join(F.broadcast(sizes), "source").withColumn("bucket", F.pmod("hash", "buckets"))
    filled = spread.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    begin = filled.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("begin"))
    ties: list[Column] = [F.col("hash"), F.col(of[id_col])] + ([F.xxhash64(of[text_col])] if text_col else [])
    own = F.row_number().over(Window.partitionBy("source", "bucket").orderBy(*ties))
    numbered = spread.withColumn("own", own).join(begin, ["source", "bucket"]).withColumn("k", F.col("begin") + F.col("own") - 1)
    blocked = numbered.withColumn("block", F.floor(F.col("k") / block)).withColumn("j", F.col("block") % F.col("a")).withColumn("round", F.floor(F.col("block") / F.col("a")))
    placed = blocked.join(F.broadcast(plan), ["source", "j"])

    def sent(s: Column) -> Column:
        """Documents of a source in the slots before this one: in a cycle the whole blocks of its share, and one more if that already went."""
        whole = F.floor(F.col("at") * s["a"] / q)
        return F.least(s["n"], block * (F.col("round") * s["a"] + whole + F.when(F.get(s["slots"], whole.cast("int")) < F.col("at"), 1).otherwise(0)))

    position = F.aggregate(F.transform(sources, sent), F.lit(0).cast("bigint"), lambda a, x: a + x) + F.col("k") % block
    return placed.select(*kept.values(), "source", "block", (F.col("round") * q + F.col("at")).alias("slot"), position.alias("position")).toDF(*kept, *ADDED)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, text_col=None).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")
