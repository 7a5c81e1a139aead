"""SimHash near-duplicates: 64-bit fingerprints linked by a generalised pigeonhole.

Fingerprints are computed in Arrow batches. Everything after that works on the
distinct fingerprints: the co-occurrence of bits over all of them (64 x 64
counts) groups correlated bits into partitions, a dynamic programme gives each
partition its own threshold from estimated candidate counts, an equi-join
probes the partitions and `bit_count(a ^ b)` verifies.

Null and empty texts, and texts without a word, have fingerprint zero and link
like any other. Repeated rows share a fingerprint. `filtered` takes these links and
beside them those of similar shingles, whose candidates meet in bands of minima. An empty
table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, raw_texts, settle, sieve, unsigned_hex
from .graph import components

BITS = 64
#: Members of a bucket up to which a plain join probes it at least (else 8 times the mean); larger buckets go to blocks of this many rows.
BUCKET = 64
BIN_BITS = 8
BINS = 1 << BIN_BITS
BLOCK = 2048
#: Cost of one probe row against one candidate pair, for the dynamic programme.
PROBE_COST = 8.0


def _hashes(text: bytes, words: int) -> list[int]:
    """XXH64 (seed 42) of each run of `words` words of an ASCII-lower-cased text."""
    found = text.lower().split()
    if not found:
        return []
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(found), 42)]
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[: len(found) - words] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def fingerprint_array(texts: list[bytes], words: int) -> np.ndarray:
    """uint64 fingerprints: a bit is 1 if set in over half of a text's shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    flat: list[int] = []
    rows: list[int] = []
    starts: list[int] = []

    def flush() -> None:
        if not rows:
            return
        hashes = np.array(flat, np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        sizes = np.diff([*starts, len(flat)])
        packed = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")
        out[rows] = np.ascontiguousarray(packed).view(np.uint64)[:, 0]
        flat.clear(), rows.clear(), starts.clear()

    for i, text in enumerate(texts):
        if got := _hashes(text, words):
            rows.append(i)
            starts.append(len(flat))
            flat.extend(got)
            if len(flat) > 200_000:
                flush()
    flush()
    return out


def _sketch(hashes: np.ndarray, rows: list[int], sizes: np.ndarray, out: list[bytes]) -> None:
    """One-permutation sketches: in each of BINS ranges of the hash the least value's 15 low bits plus 1; 0 for an empty bin."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    cell = np.repeat(np.arange(len(rows)), sizes) * BINS + (mixed >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    value = (mixed << np.uint64(BIN_BITS)) >> np.uint64(BIN_BITS)
    order = np.lexsort((value, cell))
    first = np.ones(len(order), bool)
    first[1:] = cell[order][1:] != cell[order][:-1]
    table = np.zeros(len(rows) * BINS, np.uint16)
    picked = order[first]
    table[cell[picked]] = (value[picked] & np.uint64(0x7FFF)).astype(np.uint16) + 1
    for i, row in zip(rows, table.reshape(-1, BINS), strict=True):
        out[i] = row.tobytes()


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp): one row per document, fp the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = fingerprint_array(raw_texts(batch, text_col), words).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fps)], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(id_col, text_col), run, f"{id_col} {kind}, fp long", text_col)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, over all of them, how often bits i and j are both set."""

    def run(batches):
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total, both = total + len(x), both + bits.T @ bits
        cells = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.concatenate([both.ravel(), [total]]))], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r.cell] = r.n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bits into `parts` groups of near-equal size, correlated bits together."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for g in range(parts):
        size = len(left) // (parts - g)
        own = [max(left, key=lambda b: (corr[b, list(left)].sum(), -b))]
        left.discard(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda b: (corr[b, own].sum(), -b)))
            left.discard(own[-1])
        groups.append(sorted(own))
    return groups


def match_share(p: np.ndarray, bits: list[int]) -> float:
    """Estimated share of pairs that agree in all of `bits`, from each bit's frequency over all fingerprints."""
    return float(np.prod([1 - 2 * p[b] * (1 - p[b]) for b in bits]))


def variants(n: int, t: int) -> int:
    return sum(comb(n, i) for i in range(t + 1))


def radii(t: int) -> tuple[int, int]:
    """Flips on the index side and on the probe side that together reach t."""
    return t // 2, t - t // 2


def allocate(n: int, p: np.ndarray, groups: list[list[int]], tau: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = tau + 1 and the least estimated cost, by dynamic programming.

    Two fingerprints within tau differ in at most t_i bits of some group i, or
    the sum over the groups would exceed tau. -1 leaves a group out. The cost
    of a threshold is its rows on both sides and the candidates that meet.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in groups:
        share = match_share(p, bits)
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(len(bits) - 1, tau - used) + 1):
                more = 0.0
                if t >= 0:
                    a, b = (variants(len(bits), r) for r in radii(t))
                    more = PROBE_COST * n * (a + b) + share * a * b * n * n / 2
                if used + t + 1 not in step or cost + more < step[used + t + 1][0]:
                    step[used + t + 1] = (cost + more, [*chosen, t])
        best = step
    return best.get(tau + 1, (float("inf"), []))


def plan(fps: DataFrame, tau: int) -> list[tuple[int, int, list[int]]]:
    """(group, threshold, bits) for the cheapest split into 1 to tau + 1 groups."""
    n, both = bit_counts(fps)
    p = both.diagonal() / max(n, 1)
    options = []
    for parts in range(1, min(tau + 1, 8) + 1):
        groups = group_bits(n, both, parts)
        cost, chosen = allocate(n, p, groups, tau)
        options.append((cost, [(g, t, bits) for g, (t, bits) in enumerate(zip(chosen, groups, strict=False)) if t >= 0]))
    return min(options, key=lambda x: x[0])[1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _variants(bits: list[int], t: int) -> list[int]:
    """XOR masks of at most t bits."""
    return [_signed(sum(1 << b for b in flip)) for k in range(t + 1) for flip in combinations(bits, k)]


def _keyed(fps: DataFrame, groups: list[tuple[int, int, list[int]]], probe: bool) -> DataFrame:
    def keys(g: int, t: int, bits: list[int]) -> Column:
        key = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        masks = F.split(F.lit(",".join(map(str, _variants(bits, radii(t)[probe])))), ",").cast("array<bigint>")
        return F.transform(masks, lambda m: F.struct(F.lit(g).alias("part"), key.bitwiseXOR(m).alias("key")))

    return fps.select("fp", F.explode(F.flatten(F.array(*[keys(*g) for g in groups]))).alias("k")).select("fp", "k.part", "k.key")


def _spanning(tau: int):
    """For one block pair: a spanning forest of the links between its fingerprints."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("fp").sort_values("fp")
        x = pdf["fp"].to_numpy(np.int64)
        parent = np.arange(len(x))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        out = []
        for i in range(len(x) - 1):
            near = i + 1 + np.nonzero(np.bitwise_count(np.bitwise_xor(x[i + 1 :], x[i]).view(np.uint64)) <= tau)[0]
            for j in near.tolist():
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((x[i], x[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def links(distinct: DataFrame, tau: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) of at most `tau` differing bits.

    Buckets of usual size give every link. A bucket far above the mean is dealt
    in pairs of blocks to many tasks, each of which returns a spanning forest
    of the links of its block pair, so that components are exact and a bucket's
    rows do not grow with its square.
    """
    groups = plan(distinct.select("fp"), tau)
    index, probes = _keyed(distinct, groups, probe=False), _keyed(distinct, groups, probe=True)
    sizes = settle(probes.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")))
    usual = {r.part: r.mean for r in sizes.groupBy("part").agg(F.avg("n").alias("mean")).collect()}
    most = F.create_map(*[F.lit(x) for part, mean in usual.items() for x in (part, float(max(BUCKET, 8 * mean)))]) if usual else None
    hot = sizes.where(F.col("n") > most[F.col("part")]) if usual else sizes
    b = index.select("part", "key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau)
    small = probes.join(hot, ["part", "key"], "left_anti").withColumnRenamed("fp", "a").join(b, ["part", "key"]).where(near).select("a", "b").distinct()
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    member = probes.unionByName(index).distinct() if any(t for _, t, _ in groups) else index
    dealt = (
        member.join(hot, ["part", "key"])
        .withColumn("x", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
        .withColumn("y", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("fp", "part", "key", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    )
    large = dealt.groupBy("part", "key", "x", "y").applyInPandas(_spanning(tau), "a long, b long")
    return small.unionAll(large).distinct()


def sketch_share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of sketches: equal bins among those that either has filled."""
    filled = ((a > 0) | (b > 0)).sum(-1)
    return np.where(filled > 0, ((a == b) & (a > 0)).sum(-1) / np.maximum(filled, 1), 1.0)


def near_duplicates(docs: DataFrame, words: int = 3, tau: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component): component is the smallest id reachable over links."""
    fps = settle(fingerprints(docs, words, id_col, text_col))
    distinct = settle(fps.groupBy("fp").agg(F.min(id_col).alias("rep")))
    labels = components(links(distinct.drop("rep"), tau))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    by_fp = named.join(least, "label").select("fp", "component")
    return fps.select(id_col, "fp").join(by_fp, "fp").select(id_col, "fp", "component")


#: For filtering a corpus: words of a shingle and the share of shingles that links.
FILTER_WORDS, FILTER_SIMILARITY = 5, 0.8
#: Bands of ROWS minima: a pair of similarity s meets in none with probability (1 - s ** ROWS) ** BANDS, 3e-6 at 0.8.
BANDS, ROWS = 24, 4
#: Members of a band's bucket up to which all pairs are given; larger buckets go to blocks.
BAND_BUCKET = 32
#: Estimated similarity from which a pair in a block is looked at: 0.8 less four standard errors of BINS bins.
LOOSE = 0.7


def _set_of(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(np.array(_hashes(text, words), np.uint64))


def band_keys(hashes: np.ndarray, starts: list[int]) -> np.ndarray:
    """Keys of BANDS bands for each non-empty set; set i begins at starts[i] of hashes."""
    rng = np.random.default_rng(42)
    salt = rng.integers(0, 1 << 64, (BANDS * ROWS, 2), np.uint64)
    out = np.zeros((len(starts), BANDS), np.uint64)
    for k, (flip, odd) in enumerate(salt):
        least = np.minimum.reduceat((hashes ^ flip) * (odd | np.uint64(1)), starts)
        mixed = (out[:, k // ROWS] ^ least) * np.uint64(0x9E3779B97F4A7C15)
        out[:, k // ROWS] = mixed ^ (mixed >> np.uint64(29))
    return out


def shingle_nodes(docs: DataFrame, words: int, fp_words: int) -> DataFrame:
    """(key, node, n, bands, fp) of docs (id, own, text), key a struct of id and own: the 64-bit digest of a text's shingle set, its size, and its band keys, which equal sets share, and the text's fingerprint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw_texts(batch)
        sets = [_set_of(t, words) for t in texts]
        fps = fingerprint_array(texts, fp_words).view(np.int64)
        full = [i for i, x in enumerate(sets) if len(x)]
        keys = np.zeros((len(sets), BANDS), np.uint64)
        if full:
            sizes = [len(sets[i]) for i in full]
            keys[full] = band_keys(np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64))
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("own"), pa.array(_digests(sets)), pa.array([len(x) for x in sets], pa.int64()), bands, pa.array(fps)], ["id", "own", "node", "n", "bands", "fp"])

    kind = docs.schema["id"].dataType.simpleString()
    nodes = map_texts(docs.select("id", "own", "text"), run, f"id {kind}, own long, node long, n long, bands array<bigint>, fp long")
    return nodes.select(F.struct("id", "own").alias("key"), "node", "n", "bands", "fp")


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in sets], np.uint64).view(np.int64)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the shingle sets of docs as bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [_set_of(t, words) for t in raw_texts(batch)]
        return pa.RecordBatch.from_arrays([pa.array(_digests(sets)), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "hashes"])

    return map_texts(docs.select("text"), run, "node long, hashes binary")


def sketches_of(sets: list[np.ndarray]) -> np.ndarray:
    made = [bytes(2 * BINS)] * len(sets)
    full = [i for i, x in enumerate(sets) if len(x)]
    if full:
        _sketch(np.concatenate([sets[i] for i in full]), full, np.array([len(sets[i]) for i in full]), made)
    return np.stack([np.frombuffer(x, np.uint16) for x in made])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two shingle sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b, hashes_a, hashes_b), those of that similarity."""

    def run(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("hashes_a", "hashes_b"))
            fit = [jaccard(x, y) >= similarity for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fit, pa.bool_()))

    return pairs.select("a", "b", "hashes_a", "hashes_b").mapInArrow(run, "a long, b long")


def _forest(similarity: float):
    """For one block pair of a bucket: a spanning forest of the links between its sets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        x = pdf["node"].to_numpy(np.int64)
        sets = [np.frombuffer(h, np.uint64) for h in pdf["hashes"]]
        sketches, label, out = sketches_of(sets), np.arange(len(x)), []
        for i in range(len(x) - 1):
            apart = i + 1 + np.nonzero(label[i + 1 :] != label[i])[0]
            for j in apart[sketch_share(sketches[apart], sketches[i]) >= LOOSE].tolist():
                if label[i] != label[j] and jaccard(sets[i], sets[j]) >= similarity:
                    label[label == label[j]] = label[i]
                    out.append((x[i], x[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def similar_links(docs: DataFrame, distinct: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links between shingle sets (node, rep, n, bands) that meet in a band and have that similarity.

    As in `links`, crowded buckets are dealt in pairs of blocks and give a
    spanning forest.
    """
    keyed = distinct.select("node", "n", F.posexplode("bands").alias("band", "key"))
    sizes = settle(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    met = settle(keyed.join(sizes, ["band", "key"]))
    asked = settle(distinct.join(met.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("key")))
    wanted = docs.where(sieve(asked, "key")(F.col("key"))).join(asked, "key", "left_semi")
    sets = settle(shingle_sets(wanted, words).dropDuplicates(["node"]))
    usual = met.where(F.col("members") <= BAND_BUCKET)
    a = usual.select("band", "key", F.col("node").alias("a"), F.col("n").alias("na"))
    b = usual.select("band", "key", F.col("node").alias("b"), F.col("n").alias("nb"))
    sized = (F.col("a") < F.col("b")) & (F.least("na", "nb") / F.greatest("na", "nb") >= similarity)
    pairs = a.join(b, ["band", "key"]).where(sized).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b")), "b")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = (
        met.where(F.col("members") > BAND_BUCKET)
        .withColumn("x", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("y", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("node", "band", "key", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .join(sets, "node")
    )
    large = dealt.groupBy("band", "key", "x", "y").applyInPandas(_forest(similarity), "a long, b long")
    return _alike(both, similarity).unionAll(large).distinct()


def fingerprint_links(nodes: DataFrame, tau: int) -> DataFrame:
    """(a, b): links between nodes (node, fp) whose fingerprints differ in at most `tau` bits, found by the pigeonhole; of those with one fingerprint the smallest node meets the others."""
    own = settle(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.select("node", "fp").distinct().join(own, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    first = lambda c: own.select(F.col("fp").alias(c), F.col("first").alias(f"node_{c}"))
    apart = links(own.select("fp"), tau).join(first("a"), "a").join(first("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return same.unionAll(apart.where("a <> b"))


def filtered(docs: DataFrame, words: int = FILTER_WORDS, similarity: float = FILTER_SIMILARITY, id_col: str = "doc_id", text_col: str = "text", fp_words: int = 3, tau: int = 3) -> DataFrame:
    """The rows of docs, in all their columns, with the smallest id of their component; one row for each id and text.

    Links are those of `near_duplicates`, all that the pigeonhole finds within
    `tau` bits, and beside them those of `similarity` in shingles. Fingerprints
    of the latter differ in about 10 bits at 0.8, too many for a pigeonhole
    that still tells texts apart, so these meet in bands of minima. Null ids come
    first; rows that share an id but not their text are documents of their own,
    in the order of a hash of the text.
    """
    # input columns travel under names of their own, so none can clash with those used here
    names = [f"in{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names).withColumn("id", F.col(of[id_col])).withColumn("own", F.xxhash64(of[text_col])).withColumn("text", F.col(of[text_col]))
    # structs with equal null ids are equal, so one plain key serves joins and the last grouping
    keyed = rows.withColumn("key", F.struct("id", "own"))
    nodes = settle(shingle_nodes(rows, words, fp_words))
    distinct = settle(nodes.groupBy("node").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    linked = fingerprint_links(nodes, tau).unionAll(similar_links(keyed.select("key", "text"), distinct, words, similarity))
    labels = components(linked.distinct())
    named = distinct.join(labels, "node", "left").select("rep", F.coalesce("label", "node").alias("label"))
    stay = settle(named.groupBy("label").agg(F.min("rep").alias("key")).select("key"))
    # a row that stays and has no equal needs no meeting with others; only the rest is shuffled with its texts
    often = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key")
    doubtful = sieve(nodes.select("key").join(stay, "key", "left_anti").unionAll(often), "key")(F.col("key"))
    rest = keyed.where(doubtful).join(stay, "key", "left_semi").dropDuplicates(["key"])
    return keyed.where(~doubtful).select(*names).unionAll(rest.select(*names)).toDF(*docs.columns)


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
