"""Sessions: constraint stacks, narrowing candidate sets, versions; as folds over events and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T


def constraints(reveals: Column, cap: int) -> Column:
    """The stack after reveals in order: trimmed, blank ones ignored; a full stack merges its two oldest entries with '; '."""

    def step(a: Column, t: Column) -> Column:
        merged = F.concat(F.array(F.concat(F.get(a, F.lit(0)), F.lit("; "), F.get(a, F.lit(1)))), F.slice(a, 3, 1_000_000), F.array(t))
        return F.when(F.size(a) >= cap, merged).otherwise(F.concat(a, F.array(t)))

    told = F.filter(F.transform(reveals, T.strip), lambda t: t != "")
    return F.aggregate(told, F.array().cast("array<string>"), step)


def folded(events: DataFrame, cap: int) -> DataFrame:
    """(session_id, stack, version): events (session_id, seq, text); one version a reveal."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda e: e["text"])
    grouped = events.groupBy("session_id").agg(ordered.alias("reveals"))
    return grouped.select("session_id", constraints(F.col("reveals"), cap).alias("stack"), F.size("reveals").cast("bigint").alias("version"))


def session_query(query: Column, stack: Column) -> Column:
    return T.joined("\n", F.array(query), stack)


def fresh(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Requests with `accepted`: false where the session has moved on since the version they name."""
    return requests.join(versions, "session_id", "left").withColumn("accepted", F.coalesce(F.col("seen_version") == F.col("version"), F.lit(False)))


def narrowed_sets(steps: DataFrame) -> DataFrame:
    """(session_id, keys): candidate lists (session_id, seq, keys) intersected in order; an empty intersection takes the new list."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "keys"))), lambda s: s["keys"])

    def step(a: Column, k: Column) -> Column:
        both = F.array_intersect(k, F.coalesce(a, k))
        return F.when(F.size(both) > 0, both).otherwise(k)

    return steps.groupBy("session_id").agg(ordered.alias("s")).select("session_id", F.aggregate("s", F.lit(None).cast("array<string>"), step).alias("keys"))


def live(created: DataFrame, cap: int) -> DataFrame:
    """The `cap` sessions last used; older ones are evicted. Only `cap` rows are gathered."""
    return created.groupBy("session_id").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "session_id").limit(cap)


def default_frame(results: DataFrame, frames: DataFrame) -> DataFrame:
    """The keyframe nearest to a result's time, the first of equals: (query_id, shot_key, timestamp_ms) with (shot_key, ord, keyframe_id, at_ms)."""
    near = F.struct(F.abs(F.col("at_ms") - F.col("timestamp_ms")), F.col("ord"))
    return results.join(frames, "shot_key").groupBy("query_id", "shot_key", "timestamp_ms").agg(F.min_by("keyframe_id", near).alias("keyframe_id"))


def answer_queue(answers: DataFrame, cap: int = 100) -> DataFrame:
    """Answers (session_id, seq, video_id, frame_id), each frame once at its first place, `cap` a session."""
    first = answers.groupBy("session_id", "video_id", "frame_id").agg(F.min("seq").alias("seq"))
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")))
    return ranked.where(F.col("place") <= cap)


def stream(events: DataFrame, cap: int, idle: str | None = "2 hours") -> DataFrame:
    """The stack and version of each session after each batch of a stream of (session_id, seq, text); idle sessions end, or none if `idle` is None."""

    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stack, version = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for text in pd.concat(list(pdfs)).sort_values("seq")["text"]:
            version += 1
            if text and text.strip():
                if len(stack) >= cap:
                    stack = [f"{stack[0]}; {stack[1]}", *stack[2:]]
                stack.append(text.strip())
        state.update((stack, version))
        if idle:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame({"session_id": [key[0]], "stack": [stack], "version": [version]})

    kind = events.schema["session_id"].dataType.simpleString()
    return events.groupBy("session_id").applyInPandasWithState(update, f"session_id {kind}, stack array<string>, version bigint", "stack array<string>, version bigint", "update", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
