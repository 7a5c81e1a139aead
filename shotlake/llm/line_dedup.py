"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

A line goes if an equal line, or one within `tau` edits, stands earlier: in a
document of smaller id, or higher up in the same one. Distinct lines of at
least MIN_CHARS characters have tau + 1 segments, as long as the class of
their length says. A line probes the index of (class, segment number, segment)
with those of its substrings that a line within tau edits must share
(multi-match-aware selection), in its own class and, near its border, in the
one below. Only keys with two lines or more are looked at further, and no
pairs are written: the earliest line of a key is held against all its others,
those that are left meet the earlier ones in an array of at most BUCKET lines,
and the lines of crowded keys meet again by a second segment of what lies
beyond the first, in blocks if they still crowd. Lines are verified by a
bit-parallel automaton over the 2 tau + 1 diagonals of the band, after their
lengths and the counts of a few letters.

Null and empty texts have no line that can go. Lines shorter than MIN_CHARS
have no segments to join by: from `shortest` characters on they go if an equal
line stands earlier, and blank ones stay. Ids are whole numbers; null ids count
as one document before all others. Rows that share an id count as one document:
equal lines of equal number both stay. An empty table gives an empty result,
and other columns of any name are carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table, written

TAU = 2
MIN_CHARS = 24
#: Least characters of a line that goes if an equal one precedes it, in the query and the pipeline.
SHORTEST = 1
#: Length classes grow by this ratio; the narrowest, at MIN_CHARS, is wider than tau.
RATIO = 1.25
#: Lines and characters of a key up to which its lines meet in one array, and lines of a block beyond.
BUCKET, BUCKET_CHARS = 64, 1 << 22
BLOCK = 4096
#: Letters whose counts are compared before a pair is verified.
MARKS = "eanirots"


def within(a: Column, b: Column, tau: int = TAU) -> Column:
    """Whether the edit distance of two strings is at most tau.

    Bit d + tau of register e is set if, with j characters of a and j + d of b
    read, e edits suffice. One fold over a's characters updates all registers.
    """
    band = (1 << (2 * tau + 1)) - 1
    width = 2 * tau + 1

    def of(s: Column) -> Column:
        a, b = s["a"], s["b"]
        start, r = 0, 1 << tau
        for e in range(tau + 1):
            start |= r << (e * width)
            r = (r | r << 1) & band

        def step(state: Column, j: Column) -> Column:
            c = F.get(a, j)
            same = sum((F.when(F.get(b, j + d) == c, 1 << (d + tau)).otherwise(0) for d in range(-tau, tau + 1)), F.lit(0))

            def after(m: Column) -> Column:
                old = [F.shiftrightunsigned(state, e * width).bitwiseAND(band) for e in range(tau + 1)]
                new = [old[0].bitwiseAND(m)]
                for e in range(1, tau + 1):
                    x = old[e].bitwiseAND(m).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1)).bitwiseOR(F.shiftleft(new[e - 1], 1))
                    new.append(x.bitwiseAND(band))
                out = new[0]
                for e in range(1, tau + 1):
                    out = out.bitwiseOR(F.shiftleft(new[e], e * width))
                return out

            return F.when(state == 0, state).otherwise(let(same.cast("bigint"), after))

        end = F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(start).cast("bigint"), step)
        goal = sum((1 << (e * width) for e in range(tau + 1)), 0)
        bit = F.size(b) - F.size(a) + tau
        last = F.when(F.size(a) == 0, F.size(b) <= tau).otherwise(end.bitwiseAND(F.call_function("shiftleft", F.lit(goal).cast("bigint"), bit)) != 0)
        return F.when(F.abs(F.size(b) - F.size(a)) <= tau, last).otherwise(False)

    chars = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ""))
    return let(F.struct(chars(a).alias("a"), chars(b).alias("b")), of)


def pieces(text: Column, size: Column, tau: int) -> list[tuple[int, int, Column]]:
    """(segment, shift, substring): the substrings of a text that a text within tau edits can share with its own tau + 1 segments.

    Segments have `size` characters; the first half counts from the start, the
    others from the end. Segment i may be shifted by the edits that fit on its
    counted side (multi-match-aware selection); shift 0 is the text's own one.
    """
    out = []
    for i in range(tau + 1):
        ahead = i <= tau - i
        room = i if ahead else tau - i
        for shift in range(-room, room + 1):
            at = size * i + shift + 1 if ahead else -(size * (tau - i + 1) + shift)
            out.append((i, shift, F.substring(text, at, size)))
    return out


def _least(n: Column) -> Column:
    """Least length of the class that n characters belong to."""
    return F.pow(F.lit(RATIO), F.floor(F.log(n.cast("double")) / math.log(RATIO)))


def _segment(least: Column, tau: int) -> Column:
    return F.floor(least / (tau + 1)).cast("int")


def line_keys(lines: DataFrame, tau: int) -> DataFrame:
    """(id, role, key) of lines (id, line, n); a role is the place of a key: those of the line's own class, then of the class below where a line within tau edits can belong to it."""
    own, lower = _least(F.col("n")), _least(F.greatest(F.col("n") - tau, F.lit(1)))
    classed = lines.select("id", "line", own.alias("own"), lower.alias("lower")).withColumn("s0", _segment(F.col("own"), tau)).withColumn("s1", _segment(F.col("lower"), tau))
    keys = [F.xxhash64("own", F.lit(i), piece) for i, _, piece in pieces(F.col("line"), F.col("s0"), tau)]
    below = [F.xxhash64("lower", F.lit(i), piece) for i, _, piece in pieces(F.col("line"), F.col("s1"), tau)]
    every = F.when(F.col("lower") < F.col("own"), F.array(*keys, *below)).otherwise(F.array(*keys))
    return classed.select("id", F.posexplode(every).alias("role", "key"))


def finer_keys(rows: DataFrame, tau: int) -> DataFrame:
    """rows (role, key, own and others) with keys that lines of one key share if they are within tau edits: the key, and a segment of what lies beyond it.

    That is what follows a segment counted from the start, or precedes one
    counted from the end; the edits that fit there split it as they do a line.
    """
    kinds = [(i, shift) for i, shift, _ in pieces(F.lit(""), F.lit(0), tau)]
    at = F.col("role") % len(kinds)
    of = lambda values: F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), at)
    line, n, seg, shift, size = (F.col(c) for c in ("own.line", "own.n", "seg", "shift", "size"))
    ahead = seg <= tau - seg
    named = rows.withColumn("seg", of([i for i, _ in kinds])).withColumn("shift", of([d for _, d in kinds]))
    least = F.when(F.col("role") < len(kinds), _least(n)).otherwise(_least(F.greatest(n - tau, F.lit(1))))
    sized = named.withColumn("least", least).withColumn("size", _segment(F.col("least"), tau)).withColumn("taken", size * F.when(ahead, seg + 1).otherwise(tau - seg + 1))
    beyond = F.when(ahead, F.substring(line, F.col("taken") + shift + 1, n)).otherwise(F.substring(line, F.lit(1), n - F.col("taken") - shift))
    cut = sized.withColumn("beyond", beyond).withColumn("edits", F.when(ahead, tau - seg).otherwise(seg)).withColumn("part", F.floor((F.col("least") - F.col("taken")) / (F.col("edits") + 1)).cast("int"))
    keys = F.array().cast("array<bigint>")
    for e in range(tau + 1):
        keys = F.when(F.col("edits") == e, F.array(*[F.xxhash64("key", F.lit(k), piece) for k, _, piece in pieces(F.col("beyond"), F.col("part"), e)])).otherwise(keys)
    return cut.select(*[c for c in rows.columns if c != "key"], F.explode(F.array_distinct(keys)).alias("key"))


def _judged(line: Column, shortest: int) -> Column:
    """Whether a line can go: long ones, and shorter ones that aren't blank."""
    n = F.length(line)
    return (n >= MIN_CHARS) | ((n >= shortest) & line.rlike(r"[^\x20\x09-\x0D]"))


#: Documents are numbered in places by their id; null ids come before all others.
UNIT, BEFORE = 1 << 32, -(1 << 63) - 1


def distinct_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = MIN_CHARS) -> DataFrame:
    """(id, id2, line, n, first): each distinct line with two hashes, its length and earliest place (document and number in one decimal)."""
    lines = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("no", "line")).where(_judged(F.col("line"), shortest))
    doc = F.coalesce(F.col("doc").cast("decimal(20,0)"), F.lit(str(BEFORE)).cast("decimal(20,0)"))
    place = (doc * F.lit(UNIT).cast("decimal(12,0)") + F.col("no")).cast("decimal(38,0)")
    firsts = lines.select("line", place.alias("place")).groupBy("line").agg(F.min("place").alias("first"))
    return firsts.select(F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"), "line", F.length("line").alias("n"), "first")


def _marks(line: Column) -> Column:
    """How often each of MARKS stands in the line: one edit changes two counts at most, by one."""
    n = F.length(line)
    return F.struct(*[(n - F.length(F.replace(line, F.lit(c)))).alias(f"c{i}") for i, c in enumerate(MARKS)])


def _near(a: Column, b: Column, tau: int) -> Column:
    """Whether two structs of a line (line, n, marks) are within tau edits: lengths and counts first, then the automaton."""
    apart = sum((F.abs(a["marks"][f"c{i}"] - b["marks"][f"c{i}"]) for i in range(len(MARKS))), F.lit(0))
    return (F.abs(a["n"] - b["n"]) <= tau) & (apart <= 2 * tau) & within(a["line"], b["line"], tau)


def near_earlier(lines: DataFrame, tau: int = TAU) -> DataFrame:
    """(id, id2) of the distinct lines that another line within tau edits precedes."""
    keyed = line_keys(lines, tau)
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    met = written(keyed.join(shared, "key", "left_semi"))
    own = F.struct("first", "line", "n", _marks(F.col("line")).alias("marks"))
    rows = lines.join(met, "id").select("role", "key", "id", "id2", own.alias("own"), F.lit(True).alias("alive"))
    gone, crowded = _settled(rows, tau)
    if crowded.isEmpty():
        return gone
    # lines of crowded keys meet again by a second segment, and those that still crowd in blocks
    more, crowded = _settled(finer_keys(crowded.select("id", "id2", "own", "alive", "role", "key"), tau), tau)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    x = crowded.where("alive").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).alias("x")
    y = crowded.withColumn("block", F.pmod("id", blocks).cast("int")).select("key", "block", "own").alias("y")
    a, b = F.col("x.own"), F.col("y.own")
    met_in_block = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (b["first"] < a["first"]) & _near(a, b, tau)
    last = x.join(y, met_in_block, "left_semi").select("id", "id2")
    return written(gone.unionAll(more).unionAll(last).distinct())


def _settled(rows: DataFrame, tau: int) -> tuple[DataFrame, DataFrame]:
    """Lines (role, key, id, id2, own, alive) that an earlier one of their key precedes within tau edits, and the rows of crowded keys that hold lines still to judge.

    The earliest line of each key is held against all others: copies of one
    line are done then, by as many rows as there are lines. What is left meets
    all earlier lines of its key, in one array where the key has few.
    """
    rows = written(rows)
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("own.n").cast("bigint")).alias("chars"), F.min_by("own", "own.first").alias("leader")).where("members > 1")
    follows = F.col("own.first") > F.col("leader.first")
    # one row a key on this side; a crowded key is split on the other where the join isn't a broadcast one
    held = rows.join(keys, "key").select("key", "members", "chars", "id", "id2", "own", "role", (F.col("alive") & follows).alias("alive"), (follows & _near(F.col("leader"), F.col("own"), tau)).alias("near"))
    judged = written(held)
    by_leader = judged.where("near").select("id", "id2").distinct()
    marked = judged.join(by_leader.withColumn("gone", F.lit(True)), ["id", "id2"], "left").withColumn("alive", F.col("alive") & F.col("gone").isNull()).drop("near", "gone")
    few = (F.col("members") <= BUCKET) & (F.col("chars") <= BUCKET_CHARS)
    listed = marked.where(few).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("own.first", "id", "id2", "own.line", "own.n", "own.marks", "alive"))).alias("all"))
    found = F.filter("all", lambda a, i: a["alive"] & F.exists(F.slice(F.col("all"), F.lit(1), i), lambda b: _near(b, a, tau)))
    by_other = listed.where(F.exists("all", lambda a: a["alive"])).select(F.explode(found).alias("x")).select("x.id", "x.id2")
    open_keys = marked.where(~few).groupBy("key").agg(F.bool_or("alive").alias("open")).where("open").select("key")
    return written(by_leader.unionAll(by_other).distinct()), written(marked.where(~few).join(open_keys, "key", "left_semi"))


def kept_lines(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text", shortest: int = MIN_CHARS) -> DataFrame:
    """(doc, kept): the numbers of the lines that can go and stay, for documents with any."""
    lines = written(distinct_lines(docs, id_col, text_col, shortest))
    gone = near_earlier(lines.where(F.col("n") >= MIN_CHARS), tau)
    stay = lines.select("id", "id2", "first").join(gone, ["id", "id2"], "left_anti")
    unit = F.lit(UNIT).cast("decimal(12,0)")
    doc = F.floor(F.col("first") / unit)
    no = (F.col("first") - doc * unit).cast("int")
    placed = stay.select(F.when(doc > F.lit(str(BEFORE)).cast("decimal(20,0)"), doc.cast("bigint")).alias("doc"), no.alias("no"))
    return placed.groupBy("doc").agg(F.array_sort(F.collect_list("no")).alias("kept"))


def _removed(lines: Column, kept: Column, shortest: int) -> Column:
    """Numbers of the lines that go: those judged without those kept."""
    judged = F.filter(F.transform(lines, lambda x, i: F.when(_judged(x, shortest), i)), lambda i: i.isNotNull())
    return F.array_except(judged, F.coalesce(kept, F.array().cast("array<int>")))


def dedup(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text", shortest: int = MIN_CHARS) -> DataFrame:
    """docs with `text_col` rid of repeated lines; a null text stays null, a text without remaining lines is empty."""
    # input columns travel under names of their own, so none can clash with those used here
    names = [f"in{i}" for i in range(len(docs.columns))]
    source = docs.toDF(*names)
    of = dict(zip(docs.columns, names, strict=True))
    kept = kept_lines(source, tau, of[id_col], of[text_col], shortest)
    joined = source.join(kept, F.col(of[id_col]).eqNullSafe(F.col("doc")), "left")

    def left(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), _removed(lines, F.col("kept"), shortest))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col(of[text_col]).isNotNull(), let(F.split(F.col(of[text_col]), "\n"), left))
    return joined.select(*[text if c == text_col else F.col(of[c]) for c in docs.columns]).toDF(*docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    kept = kept_lines(docs, shortest=SHORTEST)
    joined = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("doc")), "left")
    counted = joined.select("doc_id", let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), _removed(x, F.col("kept"), SHORTEST).alias("gone"))).alias("r"))
    return counted.select("doc_id", F.col("r.n").alias("n_lines"), F.size("r.gone").cast("long").alias("n_removed"), F.array_join(F.col("r.gone").cast("array<string>"), ",").alias("removed_lines"))
