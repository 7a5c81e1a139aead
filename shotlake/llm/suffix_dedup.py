"""Exact substring deduplication over the bytes of all documents.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in
a document of smaller id, or before in the same one. Strings never cross
documents and are judged on the input.

Every string of LENGTH bytes has a minimizer, the leftmost of its K-grams of
least hash, so equal strings share it. Runs of consecutive starts with one
minimizer form a segment. Segments are dealt by minimizer; a minimizer that
occurs once can't repeat and is dropped, equal segments are folded into the
earliest of them, and what is left are different segments around one repeated
minimizer. Those are cut into shards, each shard gets its Burrows-Wheeler
transform, and the transforms are merged by refining their interleave: each
round distributes the current order stably by the preceding bytes, which sorts
as many bytes deeper, and marks new block borders, so a border's round gives
its common prefix. Blocks after LENGTH rounds are the repeated intervals; in each,
all but the earliest string go. No suffix is sorted again.

Null texts count as empty. Texts shorter than LENGTH lose nothing. Repeated
rows (same id and text) get the same result; rows with one id and different
texts are ordered by a hash of the text. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, raw_texts, table, written

LENGTH, K = 100, 24
#: Starts of a document that are scanned at once, bytes of segments merged at once, and shards of a merge.
PIECE = 1 << 22
MERGE_BYTES = 1 << 19
SHARDS = 2
#: Bytes that a round of a merge takes at once, where they divide the depth.
WIDE = 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_POS = np.uint64((1 << 24) - 1)

ROWS = "part long, kind int, h long, hw long, doc long, rid long, start long, runs int"


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the K bytes from each place on; places without K bytes hash what follows."""
    x = (np.concatenate([b, np.zeros(K, np.uint8)]).astype(np.uint64) + np.uint64(1)) * _MUL
    width, power, parts, powers = 1, int(_MUL), {1: x}, {1: int(_MUL)}
    while width * 2 <= K:
        x = x[: len(x) - width] * np.uint64(power) + x[width:]
        width, power = width * 2, power * power & (1 << 64) - 1
        parts[width], powers[width] = x, power
    left, at, out = K, 0, None
    for width in sorted(parts, reverse=True):
        if left >= width:
            piece = parts[width][at : at + len(b)]
            out = piece if out is None else out * np.uint64(powers[width]) + piece
            left, at = left - width, at + width
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, start, number of starts, minimizer hash, segment hash) of all segments of the texts."""
    window = LENGTH - K + 1
    joined = b"".join(texts)
    b = np.frombuffer(joined, np.uint8)
    n = np.array([len(t) for t in texts])
    first = np.cumsum(n) - n
    ok = np.nonzero(n >= LENGTH)[0]
    if not len(ok):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    x = _gram_hashes(b)
    v = (x & ~_POS) | (np.arange(len(b), dtype=np.uint64) & _POS)
    width = 1
    while width * 2 <= window:
        v = np.minimum(v[: len(v) - width], v[width:])
        width *= 2
    if window > width:
        v = np.minimum(v[: len(v) - (window - width)], v[window - width :])
    place = (v & _POS).astype(np.int64)
    fresh = np.ones(len(place), bool)
    fresh[1:] = place[1:] != place[:-1]
    fresh[first[ok]] = True
    valid = np.zeros(len(place) + 1, np.int32)
    np.add.at(valid, first[ok], 1)
    np.add.at(valid, first[ok] + n[ok] - LENGTH + 1, -1)
    starts = np.nonzero(fresh & (np.cumsum(valid[:-1]) > 0))[0]
    owner = np.searchsorted(first[ok], starts, side="right") - 1
    last = (first[ok] + n[ok] - LENGTH + 1)[owner]
    runs = np.minimum(np.concatenate([starts[1:], [len(b)]]), last) - starts
    h = x[place[starts]]
    digest = xxhash.xxh64_intdigest
    hw = np.array([digest(joined[a:e]) for a, e in zip(starts.tolist(), (starts + runs + LENGTH - 1).tolist(), strict=True)], np.uint64)
    return ok[owner], starts - first[ok][owner], runs, h.view(np.int64), hw.view(np.int64)


def _groups(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """True where, along order, any key differs from the one before."""
    out = np.ones(len(order), bool)
    if len(order):
        out[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Segments of (doc, rid, text) as ROWS: kind 0 for the earliest of equal segments of a slice, 1 for others, which go."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, docs_, rids = raw_texts(batch), batch.column("doc").to_numpy(), batch.column("rid").to_numpy()
        parts = []
        piece: list[tuple[int, int, bytes]] = [(i, s, t[s : s + PIECE + LENGTH - 1]) for i, t in enumerate(texts) for s in range(0, max(1, len(t) - LENGTH + 1), PIECE)]
        held: list[tuple[int, int, bytes]] = []

        def flush() -> None:
            if held:
                who, start, runs, h, hw = segments([p[2] for p in held])
                base = np.array([p[1] for p in held])
                number = np.array([p[0] for p in held])
                parts.append((number[who], start + base[who], runs, h, hw))
                held.clear()

        size = 0
        for p in piece:
            if held and size + len(p[2]) > PIECE:
                flush()
                size = 0
            held.append(p)
            size += len(p[2])
        flush()
        who, start, runs, h, hw = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(5))
        doc, rid = docs_[who], rids[who]
        order = np.lexsort((start, rid, doc, hw, h))
        kind = np.where(_groups(order, h, hw), 0, 1).astype(np.int32)
        h, hw, doc, rid, start, runs = (x[order] for x in (h, hw, doc, rid, start, runs))
        part = np.where(kind == 0, h, rid * 31 + start)
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array(kind), pa.array(h), pa.array(hw), pa.array(doc), pa.array(rid), pa.array(start), pa.array(runs.astype(np.int32))], [x.split()[0] for x in ROWS.split(", ")])

    return map_texts(docs.select("doc", "rid", "text"), run, ROWS)


def _whole_groups(batches: Iterable[pa.RecordBatch], key: str, limit: int, weight: str | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups of batches sorted by key, of about limit rows (or bytes of weight)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows if weight is None else batch.column(weight).nbytes
        if size < limit:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = whole.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield whole.slice(0, cut)
            rest = whole.slice(cut)
            held = rest.to_batches()
            size = rest.num_rows if weight is None else rest.column(weight).combine_chunks().nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def fold(rows: DataFrame) -> DataFrame:
    """Of ROWS: kind 1 for segments that an equal one precedes, 2 for the earliest of each kind of segment around a minimizer with several kinds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, "part", 200_000):
            own = {c: whole.column(c).to_numpy() for c in whole.column_names}
            kind, h, hw = own["kind"], own["h"], own["hw"]
            out = np.where(kind == 1, 1, 0).astype(np.int32)
            at = np.nonzero(kind == 0)[0]
            order = at[np.lexsort((own["start"][at], own["rid"][at], own["doc"][at], hw[at], h[at]))]
            if len(order):
                new_h, new_hw = _groups(order, h), _groups(order, h, hw)
                group = np.cumsum(new_h) - 1
                kinds = np.bincount(group, weights=new_hw)
                out[order[~new_hw]] = 1
                out[order[new_hw & (kinds[group] > 1)]] = 2
            keep = np.nonzero(out)[0]
            yield pa.RecordBatch.from_arrays([pa.array(out[keep]), *(pa.array(own[c][keep]) for c in ("h", "doc", "rid", "start", "runs"))], ["kind", "h", "doc", "rid", "start", "runs"])

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "kind int, h long, doc long, rid long, start long, runs int")


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of a shard in the order of their first 128 symbols, by prefix doubling from packed 8 symbols."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | wide[i : i + n]
    order = np.argsort(key)
    depth = 8
    while True:
        fresh = np.ones(n, bool)
        fresh[1:] = key[order][1:] != key[order][:-1]
        if depth >= 128 or fresh.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh)
        later = np.zeros(n, np.uint64)
        later[: max(0, n - depth)] = rank[depth:]
        key = rank << np.uint64(32) | later
        order = np.argsort(key)
        depth *= 2


def _symbols(text: np.ndarray, step: int) -> np.ndarray:
    """The `step` bytes before each place, as one number in byte order; the text is a circle."""
    out = np.zeros(len(text), np.uint64)
    for i in range(step, 0, -1):
        out = out << np.uint64(8) | np.roll(text, i)
    return out


def _alphabet(shards: list[np.ndarray], depth: int) -> tuple[int, list[np.ndarray]]:
    """How many bytes a round takes, and for each place of each shard the number of the bytes before it among all shards' kinds, in byte order.

    Kinds are no more than places, so numbers of twice as many bytes are had by numbering pairs.
    """
    step = next(s for s in (5, 4, 2, 1) if depth % s == 0)
    ends = np.cumsum([len(s) for s in shards])[:-1]
    keys = np.concatenate([_symbols(s, step) for s in shards])
    while True:
        number = np.unique(keys, return_inverse=True)[1].astype(np.uint32)
        if step >= WIDE or depth % (2 * step):
            return step, np.split(number, ends)
        before = np.concatenate([np.roll(x, step) for x in np.split(number, ends)])
        keys = before.astype(np.uint64) << np.uint64(32) | number
        step *= 2


def _stable_order(symbol: np.ndarray) -> np.ndarray:
    """The stable order of 32-bit numbers; numpy sorts by radix up to 16 bits."""
    order = np.argsort(symbol.astype(np.uint16), kind="stable")
    high = (symbol >> np.uint32(16)).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def merge_transforms(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the shards' transforms by interleave refinement to `depth` bytes.

    A transform holds for each suffix, in order, the bytes before it; a round
    takes several bytes at once, as one numbered symbol. Returns
    for each merged place its shard, its place in the shard's text, and the
    common prefix with the place before it, in whole rounds, at most `depth`.
    """
    orders = [suffix_order(s) for s in shards]
    step, symbols = _alphabet(shards, depth)
    transforms = [x[o] for x, o in zip(symbols, orders, strict=True)]
    z = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s) for s in shards])
    block = np.zeros(len(z), np.int32)
    common = np.full(len(z), depth, np.int16)
    common[:1] = 0
    known = np.zeros(len(z), bool)
    symbol = np.empty(len(z), np.uint32)
    for level in range(0, depth, step):
        for s, t in enumerate(transforms):
            symbol[z == s] = t
        order = _stable_order(symbol)
        z = z[order]
        now, block = symbol[order], block[order]
        border = np.zeros(len(z), bool)
        border[1:] = (now[1:] != now[:-1]) | (block[1:] != block[:-1])
        # a border stays one in all later rounds
        common[border & ~known] = level
        known = border
        block = np.cumsum(border, dtype=np.int32)
    place = np.empty(len(z), np.int64)
    for s, o in enumerate(orders):
        place[z == s] = o
    return z, place, common


def repeats(strings: list[bytes], runs: np.ndarray, doc: np.ndarray, rid: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(string number, first start, last start + 1) of runs of starts whose LENGTH bytes begin earlier in another string."""
    sizes = np.array([len(s) + 1 for s in strings])
    cut = np.searchsorted(np.cumsum(sizes), np.linspace(0, sizes.sum(), SHARDS + 1)[1:-1])
    bounds = [0, *np.unique(cut[(cut > 0) & (cut < len(strings))]).tolist(), len(strings)]
    shards, owners, places = [], [], []
    for a, b in zip(bounds, bounds[1:], strict=False):
        # a terminator follows each string; byte 0 of a string shares its symbol, which only starts without LENGTH bytes could mistake
        shards.append(np.frombuffer(b"".join(s + b"\0" for s in strings[a:b]), np.uint8))
        owners.append(np.repeat(np.arange(a, b), sizes[a:b]))
        ends = np.cumsum(sizes[a:b])
        places.append(np.arange(int(ends[-1])) - np.repeat(ends - sizes[a:b], sizes[a:b]))
    z, place, common = merge_transforms(shards, LENGTH)
    offset = np.cumsum([0, *(len(s) for s in shards)])
    flat = offset[z] + place
    owner, at = np.concatenate(owners)[flat], np.concatenate(places)[flat]
    interval = np.cumsum(common < LENGTH)
    real = np.nonzero(at < runs[owner])[0]
    owner, at, interval = owner[real], at[real], interval[real]
    if not len(owner):
        return np.zeros((0, 3), np.int64)
    # segments of a document share no start, so theirs come in the order of the segments
    rank = np.empty(len(strings), np.int64)
    rank[np.lexsort((start, rid, doc))] = np.arange(len(strings))
    key = rank[owner] * (int(runs.max()) + 1) + at
    heads = np.nonzero(_groups(np.arange(len(interval)), interval))[0]
    least = np.repeat(np.minimum.reduceat(key, heads), np.diff([*heads, len(key)]))
    late = np.nonzero(key != least)[0]
    owner, at = owner[late], at[late]
    order = np.argsort(owner * (int(runs.max()) + 1) + at)
    owner, at = owner[order], at[order]
    if not len(owner):
        return np.zeros((0, 3), np.int64)
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.nonzero(new)[0]
    return np.stack([owner[first], at[first], at[np.concatenate([first[1:], [len(owner)]]) - 1] + 1], axis=1)


def merged(probes: DataFrame) -> DataFrame:
    """(rid, a, b): byte ranges of segments (h, doc, rid, start, runs, piece) that repeat earlier ones of their minimizer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, "h", MERGE_BYTES, "piece"):
            strings = whole.column("piece").to_pylist()
            runs, doc, rid, start = (whole.column(c).to_numpy() for c in ("runs", "doc", "rid", "start"))
            found = repeats(strings, runs, doc, rid, start)
            a = start[found[:, 0]] + found[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array(rid[found[:, 0]]), pa.array(a), pa.array(start[found[:, 0]] + found[:, 2] + LENGTH - 1)], ["rid", "a", "b"])

    return probes.repartition("h").sortWithinPartitions("h").mapInArrow(run, "rid long, a long, b long")


def _pieces(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted segments, cut out of their documents."""
    by_doc = wanted.groupBy("rid").agg(F.collect_list(F.struct("h", "doc", "start", "runs")).alias("wanted"))
    schema = "h long, doc long, rid long, start long, runs int, piece binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw_texts(batch)
        lists = batch.column("wanted")
        flat = lists.flatten()
        owner = pa.compute.list_parent_indices(lists).to_numpy()
        h, doc, start, runs = (flat.field(c) for c in ("h", "doc", "start", "runs"))
        cut = [texts[o][s : s + r + LENGTH - 1] for o, s, r in zip(owner.tolist(), start.to_pylist(), runs.to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([h, doc, batch.column("rid").take(pa.array(owner)), start, runs, pa.array(cut, pa.binary())], [x.split()[0] for x in schema.split(", ")])

    return map_texts(docs.select("rid", "text").join(by_doc, "rid"), run, schema)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(rid, a, b): byte ranges of (doc, rid, text) that go; they may overlap."""
    folded = written(fold(scan(docs)))
    whole = folded.where("kind = 1").select("rid", F.col("start").alias("a"), (F.col("start") + F.col("runs") + LENGTH - 1).alias("b"))
    return whole.unionAll(merged(_pieces(docs, folded.where("kind = 2"))))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text")).withColumn("rid", F.xxhash64("doc", "text"))


def _union(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept, spans): kept holds the remaining bytes."""
    named = identified(docs, id_col, text_col)
    ranges = repeated_ranges(named)
    by_doc = ranges.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    schema = f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, own in zip(raw_texts(batch), batch.column("ranges").to_pylist(), strict=True):
            spans = _union(own)
            keep, at = [], 0
            for a, b in spans:
                keep.append(text[at:a])
                at = b
            rest = b"".join([*keep, text[at:]])
            out.append((len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest, ",".join(f"{a}:{b}" for a, b in spans)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], [x.split()[0] for x in schema.split(", ")])

    return map_texts(named.join(by_doc, "rid", "left").select("doc", "text", "ranges"), run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
