"""SentencePiece encoding and decoding over a relational lattice.

A text is normalised as the model says (a space in front, spaces as U+2581)
and cut into words in front of each run of U+2581 and around the ASCII
characters that stand in no piece; no piece crosses such a cut. `encode_words` explodes each distinct word's substrings of at most the
longest piece's length, equi-joins them to the piece table, groups the edges
by word and folds them with Spark's higher-order aggregate: for unigram models
Viterbi, for BPE models the merges in order of score, leftmost first, which
alone give that kind's pieces. Characters without a piece become byte pieces.

`encode` counts the words of all texts, has the lattice encode the most
frequent ones (as many as fit a fixed bound), and broadcasts them; words beyond
the bound, and words longer than the fold takes, are folded by the same rule
in the task that meets them, all new words of a batch at once. `decode` joins pieces and bytes back to text.

Null and empty texts give no pieces; a text of any length is encoded whole.
Repeated rows get equal pieces. U+2581 itself decodes to a space, as in the
model's own decoder.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, map_texts, table, texts_of, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words that may be broadcast, and the longest word that the relational fold takes.
MOST_WORDS = 1 << 18
LONGEST = 24
#: Words kept by a Python worker beyond the broadcast ones.
KEPT_WORDS = 300_000
NEVER = float("inf")


class Pieces(NamedTuple):
    """The piece table of a model: name -> (id, score); byte pieces apart."""

    known: dict[str, tuple[int, float]]
    byte_ids: list[int]
    unigram: bool
    longest: int
    unknown: int
    cost: dict[str, float] = {}  # noqa: RUF012  names with scores turned round
    cuts: str = ""  # ASCII characters that stand in no piece, as of a pattern's class: no piece crosses them

    @property
    def word(self) -> str:
        """Pattern of a word: characters after a run of U+2581, such a run at the end, or one character that cuts."""
        one = f"|[{self.cuts}]" if self.cuts else ""
        return f"{SPACE}*[^{SPACE}{self.cuts}]+|{SPACE}+{one}"


@lru_cache(maxsize=2)
def load(model: str = MODEL) -> Pieces:
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    known, byte_ids = {}, [-1] * 256
    for i in range(sp.get_piece_size()):
        name = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            known[name] = (i, sp.get_score(i))
    # the model's type stands in its serialised trainer settings: field 2, field 3
    return Pieces(known, byte_ids, _model_type(sp.serialized_model_proto()) == 1, max(map(len, known)), sp.unk_id(), {name: -score for name, (_, score) in known.items()}, _cuts(known))


def _cuts(known: dict) -> str:
    held = {c for name in known for c in name}
    return "".join(f"\\x{c:02x}" for c in range(128) if chr(c) not in held and chr(c) != " ")


def _fields(data: bytes):
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        elif tag & 7 == 2:
            size = number()
            at += size
            yield tag >> 3, data[at - size : at]
        else:
            size = 8 if tag & 7 == 1 else 4
            at += size
            yield tag >> 3, data[at - size : at]


def _model_type(model: bytes) -> int:
    """1 for unigram (also where nothing is said), 2 for BPE."""
    return next((v for f, body in _fields(model) if f == 2 for g, v in _fields(body) if g == 3), 1)


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", "").otherwise(F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE))))


def words_of(text: Column, pieces: Pieces) -> Column:
    return F.regexp_extract_all(normalised(text), F.lit(f"({pieces.word})"), 1)


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    rows = [(name, i, score) for name, (i, score) in pieces.known.items()]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def _bits(a: Column, b: Column) -> Column:
    """Bits a to b - 1."""
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x)
    return one(b) - one(a)


def fold_merges(n: Column, edges: Column) -> Column:
    """Borders (bit p for place p) after merging, again and again, the best edge that covers exactly two parts."""

    # the bits that an edge needs set, and those inside it, are worked out once
    marked = F.transform(edges, lambda e: F.struct((-e["score"]).alias("s"), e["a"].alias("a"), _bits(e["a"], e["a"] + 1).bitwiseOR(_bits(e["b"], e["b"] + 1)).alias("ends"), _bits(e["a"] + 1, e["b"]).alias("inner")))
    longer = F.filter(marked, lambda e: e["inner"] != 0)

    def run(edges: Column) -> Column:
        usable = lambda mask: F.filter(edges, lambda e: (mask.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(mask.bitwiseAND(e["inner"])) == 1))
        step = lambda mask, _: let(F.array_min(usable(mask)), lambda x: F.when(x.isNull(), mask).otherwise(mask.bitwiseAND(F.bitwise_not(x["inner"]))))
        return F.aggregate(F.sequence(F.lit(1), n), _bits(F.lit(0), n + 1), step)

    return let(longer, run)


def fold_viterbi(n: Column, edges: Column, unknown: float = -100.0) -> Column:
    """Borders of the path of greatest total score; a single character without a piece costs `unknown`."""
    start = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("m")))

    def step(paths: Column, j: Column) -> Column:
        ends = F.filter(edges, lambda e: e["b"] == j)
        ways = F.transform(ends, lambda e: let(F.get(paths, e["a"]), lambda p: F.struct((p["s"] + e["score"]).alias("s"), p["m"].bitwiseOR(_bits(e["a"], e["a"] + 1)).alias("m"))))
        single = let(F.get(paths, j - 1), lambda p: F.struct((p["s"] + unknown).alias("s"), p["m"].bitwiseOR(_bits(j - 1, j)).alias("m")))
        every = F.when(F.exists(ends, lambda e: e["a"] == j - 1), ways).otherwise(F.concat(ways, F.array(single)))
        return F.concat(paths, F.array(F.array_max(every)))

    paths = F.aggregate(F.sequence(F.lit(1), n), start, step)
    return let(F.get(paths, n), lambda p: p["m"].bitwiseOR(_bits(n, n + 1)))


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of distinct words of 1 to LONGEST characters, by the relational lattice."""
    spark = words.sparkSession
    n = F.length("word")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda a: F.transform(F.sequence(a + 1, F.least(n, a + pieces.longest)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    cut = words.select("word", F.explode(spans).alias("e")).select("word", "e.a", "e.b", F.expr("substring(word, e.a + 1, e.b - e.a)").alias("piece"))
    # the piece table is a model's fixed vocabulary; the left join keeps words without any piece
    joined = cut.join(F.broadcast(piece_table(spark, pieces)), "piece", "left")
    edge = F.when(F.col("id").isNotNull(), F.struct("score", "a", "b", "id"))
    lattice = joined.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    fold = fold_viterbi if pieces.unigram else fold_merges
    bordered = lattice.withColumn("mask", fold(n, F.col("edges")))
    places = F.filter(F.sequence(F.lit(0), n), lambda p: F.col("mask").bitwiseAND(_bits(p, p + 1)) != 0)
    byte_ids = F.split(F.lit(",".join(map(str, pieces.byte_ids))), ",").cast("array<int>")

    def as_bytes(piece: Column) -> Column:
        if pieces.byte_ids[0] < 0:
            return F.array(F.lit(pieces.unknown))
        code = F.hex(F.encode(piece, "utf-8"))
        return F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda k: F.get(byte_ids, F.conv(F.call_function("substring", code, k, F.lit(2)), 16, 10).cast("int")))

    def ids(places: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            q = F.get(places, i + 1)
            own = F.get(F.filter(F.col("edges"), lambda e: (e["a"] == p) & (e["b"] == q)), F.lit(0))
            return let(own, lambda e: F.when(e.isNull(), as_bytes(F.call_function("substring", F.col("word"), p + 1, q - p))).otherwise(F.array(e["id"])))

        return F.flatten(F.transform(F.slice(places, 1, F.size(places) - 1), one))

    return bordered.select("word", let(places, ids).alias("ids"))


def fold_word(word: str, pieces: Pieces) -> list[int]:
    """The pieces of one word by the same rule as the relational fold; any length."""
    known = pieces.known
    if pieces.unigram:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            ways = [(best[i][0] + known[word[i:j]][1], i) for i in range(max(0, j - pieces.longest), j) if word[i:j] in known]
            if not any(i == j - 1 for _, i in ways):
                ways.append((best[j - 1][0] - 100.0, j - 1))
            best.append(max(ways))
        parts, j = [], len(word)
        while j:
            parts.append(word[best[j][1] : j])
            j = best[j][1]
        parts.reverse()
    elif len(word) <= 40:
        parts = list(word)
        cost = pieces.cost.get
        pairs = [cost(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) < NEVER:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = cost(parts[i] + parts[i + 1], NEVER)
            if i:
                pairs[i - 1] = cost(parts[i - 1] + parts[i], NEVER)
    else:
        parts = _merge_long(word, known)
    out: list[int] = []
    for p in parts:
        if (got := known.get(p)) is not None:
            out.append(got[0])
        elif pieces.byte_ids[0] >= 0:
            out.extend(pieces.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
        else:
            out.append(pieces.unknown)
    return out


def _merge_long(word: str, known: dict[str, tuple[int, float]]) -> list[str]:
    """Merges with a heap of adjacent pairs, for words of any length."""
    parts: list[str | None] = list(word)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < len(parts) and (got := known.get(both := parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (-got[1], i, both))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [p for p in parts if p is not None]


def frequent_words(docs: DataFrame, pieces: Pieces, text_col: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """(word): the words of up to LONGEST characters that are most frequent over all texts, at most `most`, whole frequencies at a time."""
    counted = docs.select(F.explode(words_of(F.col(text_col), pieces)).alias("word")).where(F.length("word") <= LONGEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted.where("n > 1"))
    level = F.floor(F.log2("n") * 64)
    kept, least = 0, None
    for r in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        kept += r["count"]
        if kept > most:
            break
        least = r["level"]
    return counted.where(level >= (1 << 30 if least is None else least)).select("word")


class Merges(NamedTuple):
    """The merges of a BPE piece table as arrays: which two symbols join to which piece, and how early.

    Symbols are the pieces and all characters that stand in one; others never join.
    """

    of_char: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    ids: np.ndarray


NONE = np.int32(2**31 - 1)


def merges(pieces: Pieces) -> Merges:
    names = list(pieces.known)
    number = {name: i for i, name in enumerate(names)}
    for c in sorted({c for name in names for c in name}):
        number.setdefault(c, len(number))
    of_char = np.full(0x110000, -1, np.int32)
    for name, i in number.items():
        if len(name) == 1:
            of_char[ord(name)] = i
    costs = np.array([pieces.cost[name] for name in names])
    rank = np.unique(costs, return_inverse=True)[1].astype(np.int32)
    found = [(number[name[:k]] * len(number) + number[name[k:]], i) for i, name in enumerate(names) for k in range(1, len(name)) if name[:k] in number and name[k:] in number]
    keys, made = np.array([k for k, _ in found] or [-1], np.int64), np.array([i for _, i in found] or [0], np.int32)
    order = np.argsort(keys)
    ids = np.array([pieces.known[name][0] for name in names] + [-1] * (len(number) - len(names) + 1), np.int32)
    return Merges(of_char, keys[order], rank[made[order]], made[order], ids)


def fold_words(words: list[str], pieces: Pieces, table: Merges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, sizes): word i has the `sizes[i]` ids from `starts[i]`, those that fold_word gives.

    All words merge at once, each its earliest pair, leftmost of equals, a
    round. Words of more than 40 characters, and those with characters that are
    no pieces, go to fold_word.
    """
    sizes, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    parts: list[np.ndarray] = [np.zeros(0, np.int32)]
    used = 0
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    alone = lengths > (0 if pieces.unigram else 40)
    n_symbols = len(table.ids) - 1

    def join(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = x.astype(np.int64) * n_symbols + y
        at = np.minimum(np.searchsorted(table.keys, key), len(table.keys) - 1)
        hit = (table.keys[at] == key) & (x >= 0) & (y >= 0)
        return np.where(hit, table.ranks[at], NONE), table.made[at]

    order = np.argsort(lengths, kind="stable")
    order = order[~alone[order]]
    for begin in range(0, len(order), 8192):
        rows = order[begin : begin + 8192]
        size = lengths[rows]
        wide = int(size.max(initial=1))
        symbols = np.full((len(rows), wide), -1, np.int32)
        symbols[np.arange(wide) < size[:, None]] = table.of_char[np.frombuffer("".join([words[i] for i in rows]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        rank, made = join(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            live = rank[np.arange(len(rows)), best] < NONE if rank.shape[1] else np.zeros(len(rows), bool)
            if not live.all():
                over, n = rows[~live], size[~live]
                own = np.arange(symbols.shape[1]) < n[:, None]
                got = table.ids[symbols[~live]]
                alone[over] = ((got < 0) & own).any(1)
                sizes[over], starts[over] = n, used + np.cumsum(n) - n
                parts.append(got[own])
                used += len(parts[-1])
                rows, size, best = rows[live], size[live], best[live]
                symbols, rank, made = symbols[live], rank[live], made[live]
            size = size - 1
            every = np.arange(len(rows))
            if not len(rows):
                break
            symbols[every, best] = made[every, best]
            at = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, at + (at > best[:, None]), 1)
            at = np.arange(rank.shape[1] - 1)
            cut = at + (at >= best[:, None])
            rank, made = np.take_along_axis(rank, cut, 1), np.take_along_axis(made, cut, 1)
            for side in (best - 1, best):
                fits = np.nonzero((side >= 0) & (side < rank.shape[1]))[0]
                x = side[fits]
                rank[fits, x], made[fits, x] = join(symbols[fits, x], symbols[fits, x + 1])
    for i in np.nonzero(alone)[0].tolist():
        parts.append(np.array(fold_word(words[i], pieces), np.int32))
        starts[i], sizes[i] = used, len(parts[-1])
        used += len(parts[-1])
    return np.concatenate(parts), starts, sizes


class Coder:
    """Encodes texts in a Python worker from the broadcast words, folding others as they come."""

    def __init__(self, words: list[str], ids: np.ndarray, sizes: np.ndarray, pieces: Pieces):
        self.pieces, self.table, self.word = pieces, merges(pieces), re.compile(pieces.word)
        self.base = (words, ids, sizes)
        self.reset()

    def reset(self) -> None:
        words, ids, sizes = self.base
        self.index = {w: i for i, w in enumerate(words)}
        self.flat, self.sizes, self.starts = ids, sizes, np.cumsum(sizes) - sizes

    def _learn(self, words: list[str]) -> None:
        if len(self.index) - len(self.base[0]) > KEPT_WORDS:
            self.reset()
        fresh = list({w for w in words if w not in self.index})
        ids, starts, sizes = fold_words(fresh, self.pieces, self.table)
        self.index.update(zip(fresh, range(len(self.sizes), len(self.sizes) + len(fresh)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + starts])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); words are taken 50,000 at a time, also those of one text."""
        parts, sizes, pending = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), []

        def flush() -> None:
            words = [w for _, ws in pending for w in ws]
            self._learn(words)
            get = self.index.get
            at = np.array([get(w) for w in words], np.int64)
            own = self.sizes[at]
            ends = np.cumsum(own)
            parts.append(self.flat[np.arange(int(ends[-1])) + np.repeat(self.starts[at] - ends + own, own)])
            of = np.repeat([i for i, _ in pending], [len(ws) for _, ws in pending])
            np.add.at(sizes, of, own)
            pending.clear()

        held = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            words = self.word.findall(SPACE + text.replace(" ", SPACE))
            for s in range(0, len(words), 50_000):
                pending.append((i, words[s : s + 50_000]))
                held += len(pending[-1][1])
                if held >= 50_000:
                    flush()
                    held = 0
        if pending:
            flush()
        return np.concatenate(parts), sizes


class Decoder:
    """Bytes of piece ids, by flat tables; control pieces give none."""

    def __init__(self, pieces: Pieces):
        names = [b""] * (max([i for i, _ in pieces.known.values()] + pieces.byte_ids) + 1)
        for name, (i, _) in pieces.known.items():
            names[i] = name.replace(SPACE, " ").encode()
        for b, i in enumerate(pieces.byte_ids):
            if i >= 0:
                names[i] = bytes([b])
        self.sizes = np.fromiter(map(len, names), np.int64, len(names))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(names), np.uint8)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """One text for each of `sizes`, without the space in front that encoding adds."""
        own = self.sizes[ids]
        ends = np.cumsum(own)
        total = int(ends[-1]) if len(ends) else 0
        joined = self.bytes[np.arange(total) + np.repeat(self.starts[ids] - ends + own, own)].tobytes()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [joined[a + 1 : b] if joined[a : a + 1] == b" " and b > a else joined[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


_CODERS: dict[int, tuple[Coder, Decoder]] = {}


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, carried: tuple[str, ...] = (), counted: DataFrame | None = None) -> DataFrame:
    """(id_col, n_pieces, ids, decoded_sha256, carried): the pieces of each whole text, and a digest of what they decode to.

    counted: the texts whose frequent words are encoded beforehand, by default docs.
    """
    pieces = load(model)
    # at most MOST_WORDS words come to the driver, to be broadcast
    coded = encode_words(frequent_words(docs if counted is None else counted, pieces, text_col), pieces).toArrow().combine_chunks().sort_by("word")
    lists = coded.column("ids").combine_chunks()
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((coded.column("word").to_pylist(), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), sizes, pieces))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = shared.id if hasattr(shared, "id") else id(shared)
        if key not in _CODERS:
            _CODERS.clear()
            _CODERS[key] = Coder(*shared.value), Decoder(shared.value[3])
        coder, decoder = _CODERS[key]
        ids, sizes = coder.encode(texts_of(batch, text_col))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
        digest = pa.array([hashlib.sha256(x).hexdigest() for x in decoder.decode(ids, sizes)], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(sizes), lists, digest, *[batch.column(c) for c in carried]], [id_col, "n_pieces", "ids", "decoded_sha256", *carried])

    kind = docs.schema[id_col].dataType.simpleString()
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    return map_texts(docs.select(id_col, text_col, *carried), run, f"{id_col} {kind}, n_pieces long, ids array<int>, decoded_sha256 string{more}", text_col)


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(id_col, text) from piece ids; null ids give null, bytes that are no UTF-8 give U+FFFD."""
    decoder = Decoder(load(model))

    def run(batches):
        for batch in batches:
            lists = batch.column(ids_col)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = decoder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            texts = [x.decode("utf-8", "replace") if there else None for x, there in zip(found, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, text string")


def op1(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
