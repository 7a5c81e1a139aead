"""Language identification by prediction by partial matching.

A variable-order byte context tree is grown for each language from a bounded
sample of labelled texts and then frozen. In a context with T counts and D
different bytes, a byte seen c times has probability c / (T + D); the escape
probability D / (T + D) goes to the other bytes in proportion to the next
shorter context, so each context holds a proper distribution. A text's code
length is the sum of -log2 of its bytes' probabilities in the longest known
contexts; the language with the shortest code wins, ties by name.

Texts that are null or have no letter get `und` with score 0. Repeated rows
get equal predictions. If nothing is labelled, every text is `und`. Only the
id, text and label columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, table

ORDER = 3
#: Bound of the fitting sample: expected texts for each language, and bytes of each language's joined sample.
SAMPLE_TEXTS = 300
SAMPLE_BYTES = 1_500_000
LETTER = regex.compile(r"\p{L}")


class Model:
    """Frozen tables: symbols of bytes, context rows and code lengths for each language."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.langs = sorted(samples)
        seen = sorted({b for texts in samples.values() for t in texts for b in set(t)})
        self.n_rare = 256 - len(seen)
        self.n = len(seen) + 1
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, self.n)
        self.order = order
        self.tables = [self._grow(samples[x]) for x in self.langs]

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts, each text preceded by `order` breaks, and where texts begin."""
        pad = b"\n" * self.order
        joined = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
        return self.symbol[joined], np.cumsum([0, *(len(t) + self.order for t in texts)])

    def _keys(self, sym: np.ndarray, k: int) -> np.ndarray:
        """For each position from `order` on, its k preceding symbols as one number."""
        key = np.zeros(len(sym) - self.order, np.int64)
        for j in range(k, 0, -1):
            key = key * self.n + sym[self.order - j : len(sym) - j]
        return key

    def _grow(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(row of each context of `order` symbols, code length of each symbol in each row)."""
        sym, starts = self.symbols(texts)
        body = np.ones(len(sym), bool)
        for j in range(self.order):
            body[starts[:-1] + j] = False
        body = body[self.order :]
        now = sym[self.order :][body]
        # the root escapes to all 256 bytes alike; bytes that no sample has share symbol 0
        flat = np.full(self.n, 1 / 256)
        flat[0] = max(self.n_rare, 1e-3) / 256
        rows = self._mix(np.zeros(len(now), np.int64), now, 1, flat[None, :], np.zeros(1, np.int64))
        row_of = np.zeros(1, np.int64)
        for k in range(1, self.order + 1):
            keys = self._keys(sym, k)[body]
            known, inverse = np.unique(keys, return_inverse=True)
            parent = row_of[known % self.n ** (k - 1)]
            fresh = self._mix(inverse, now, len(known), rows, parent)
            longer = np.tile(row_of, self.n)
            longer[known] = len(rows) + np.arange(len(known))
            rows, row_of = np.concatenate([rows, fresh]), longer
        return row_of.astype(np.int32), (-np.log2(rows)).astype(np.float32)

    def _mix(self, context: np.ndarray, now: np.ndarray, n: int, rows: np.ndarray, parent: np.ndarray) -> np.ndarray:
        counts = np.bincount(context * self.n + now, minlength=n * self.n).reshape(n, self.n).astype(np.float64)
        kinds = (counts > 0).sum(1, keepdims=True)
        total = counts.sum(1, keepdims=True) + kinds
        rest = np.where(counts > 0, 0, rows[parent])
        left = rest.sum(1, keepdims=True)
        share = np.divide(kinds, total * left, out=np.zeros_like(left), where=left > 0)
        mixed = counts / np.maximum(total, 1) + rest * share
        return mixed / mixed.sum(1, keepdims=True)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits that each language's tree needs for each text: (texts, languages)."""
        sym, starts = self.symbols(texts)
        keys, now = self._keys(sym, self.order), sym[self.order :]
        out = np.zeros((len(texts), len(self.langs)))
        sizes = np.diff(starts) - self.order
        full = np.nonzero(sizes)[0]
        for j, (row_of, bits) in enumerate(self.tables):
            cost = bits.ravel()[row_of[keys].astype(np.int64) * self.n + now]
            sums = np.concatenate([[0], np.cumsum(cost, dtype=np.float64)])
            begin = starts[:-1][full]
            out[full, j] = sums[begin + sizes[full]] - sums[begin]
        return out


@lru_cache(maxsize=2)
def _model(samples: tuple[tuple[str, bytes], ...]) -> Model:
    by: dict[str, list[bytes]] = {}
    for lang, text in samples:
        by.setdefault(lang, []).append(text)
    return Model(by)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS, size: int = SAMPLE_BYTES) -> tuple[tuple[str, bytes], ...]:
    """About `texts` labelled texts of each language, chosen by a hash of the text over all training rows, in the order of that hash up to `size` bytes a language."""
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    if not counts:
        return ()
    limits = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, texts / n))])
    place = F.pmod(F.xxhash64(text_col, F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.where(place < limits[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place"))
    # the bound on bytes holds before anything comes to the driver; a first text beyond it is cut
    order = Window.partitionBy("lang").orderBy("place", "text")
    sized = chosen.withColumn("n", F.row_number().over(order)).withColumn("before", F.sum(F.octet_length("text")).over(order))
    bounded = sized.where((F.col("before") <= size) | (F.col("n") == 1)).select("lang", "n", F.left("text", F.lit(size)).alias("text"))
    return tuple((r.lang, r.text.encode()[:size]) for r in bounded.orderBy("lang", "n").collect())


def identify(docs: DataFrame, sample: tuple[tuple[str, bytes], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, bits_per_byte): score is the winner's share of the languages' probability at a tenth of the code length."""
    shared = docs.sparkSession.sparkContext.broadcast(sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [x or b"" for x in batch.column(text_col).cast(pa.binary()).to_pylist()]
        letters = [bool(LETTER.search(x.decode("utf-8", "replace"))) for x in raw]
        pred, score, rate = ["und"] * len(raw), np.zeros(len(raw)), np.zeros(len(raw))
        if shared.value:
            model = _model(shared.value)
            bits = model.code_lengths(raw)
            best = bits.argmin(1)
            gap = (bits - bits.min(1, keepdims=True)) / 10
            share = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
            for i, ok in enumerate(letters):
                if ok:
                    pred[i], score[i], rate[i] = model.langs[best[i]], min(1.0, share[i]), bits[i, best[i]] / len(raw[i])
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(pred), pa.array(score), pa.array(rate)], [id_col, "lang_pred", "score", "bits_per_byte"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(id_col, text_col), run, f"{id_col} {kind}, lang_pred string, score double, bits_per_byte double", text_col)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, training_sample(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


