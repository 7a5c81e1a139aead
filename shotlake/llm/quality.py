"""Quality rules: distribution divergence from language references, in DataFrame functions only.

Each text gives two histograms, of character classes and of common words. The
references are, for each language, the summed histograms of all documents that
pass the base rules and have at most one symbol in SYMBOL_SHARE characters. A text
is rejected if its character classes, those without letters and digits, its common
words among each other, or their share of all words lie further (by
Jensen-Shannon distance) from every language's reference than that language's
limit, which is set from the distances of its own documents;
texts shorter than the guards are not judged this way. The base rules on word
count and repeated words reject by themselves.

Null texts count as empty: no words, all counts zero, base rule failed.
Repeated rows and copies get equal verdicts. An empty table gives an empty
result; where no document has a language, only the base rules judge. Columns
other than those named are carried along or ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table, written

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 5
#: Guards: fewer word characters, words or common words than this give no divergence verdict.
MIN_CHARS, MIN_WORDS, MIN_COMMON = 200, 40, 100
SYMBOL_SHARE = 100
#: A distance rejects beyond the mean of a language's own documents by SPREAD standard deviations, and by FLOOR at least; languages with fewer than ENOUGH such documents take the widest limit of the others, and none rejects where no language has one.
SPREAD, FLOOR, ENOUGH = 6.0, 0.1, 20

#: Character classes that are counted; what is left, the lower-case letters, is the first class.
CLASSES = {
    "upper": r"\p{Lu}",
    "digit": r"\p{Nd}",
    "stop": r"[.,;:?'\"-]",
    "symbol": r"[#*$%&|<>!=+/\\@^~_{}\[\]()]",
    "space": SPACE,
    "other": r"[^\p{Ll}\p{Lu}\p{Nd}.,;:?'\"\-#*$%&|<>!=+/\\@^~_{}\[\]()\x20\x09-\x0D]",
}
#: Frequent function words of four languages.
COMMON = (
    "the of and to in a is that it for on was be with as"  # English
    " de la le et les des en un du une que est pour qui dans"  # French
    " der die und den von zu das mit sich des auf ist im dem nicht"  # German
    " el los las por con para una su al lo como más pero sus y"  # Spanish
).split()
WORDS = list(dict.fromkeys(COMMON))


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more."""

    def covered(grams: Column) -> Column:
        marked = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        def union(p: Column) -> Column:
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda a, x: F.struct((x + WINDOW).alias("end"), (a["n"] + x + WINDOW - F.greatest(a["end"], x)).alias("n"))
            return F.aggregate(p, start, step)["n"]

        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), union(let(marked, places))).otherwise(0)

    grams = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) > WINDOW, let(grams(h), covered)).otherwise(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def word_histogram(words: Column) -> Column:
    """Counts of each of WORDS, then of all other words."""
    known = F.split(F.lit(" ".join(WORDS)), " ")
    # no lambda for each word and count: short words are looked up once, and a count is what its removal takes away
    short = F.filter(words, lambda w: F.length(w) <= max(map(len, WORDS)))
    hits = F.array_remove(F.transform(short, lambda w: F.array_position(known, w).cast("int")), 0)
    count = lambda h: F.array(*[F.size(h) - F.size(F.array_remove(h, k)) for k in range(1, len(WORDS) + 1)])
    return let(hits, lambda h: F.concat(count(h), F.array(F.size(words) - F.size(h))))


def class_histogram(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    counts = F.array(*[F.regexp_count(text, F.lit(p)).cast("int") for p in CLASSES.values()])
    return let(counts, lambda c: F.concat(F.array(F.length(text) - F.aggregate(c, F.lit(0), lambda a, x: a + x)), c))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count histograms of equal length; 1 if either is empty."""

    def of(p: Column, q: Column) -> Column:
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
        part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
        terms = lambda n, m: F.zip_with(p, q, lambda a, b: part(a / n, b / m) + part(b / m, a / n))
        return let(F.struct(total(p).alias("n"), total(q).alias("m")), lambda t: F.when((t["n"] > 0) & (t["m"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms(t["n"], t["m"])) / 2))).otherwise(1.0))

    return of(p, q)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base measures and the two histograms."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    worded = docs.withColumn("_words", words_of(F.col(text_col)))
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")
    out = worded.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        symbols.alias("n_symbols"),
        duplicate_lines(F.col(text_col)).alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        class_histogram(F.col(text_col)).alias("classes"),
        word_histogram(F.col("_words")).alias("commons"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
    )
    return out


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


#: What a verdict compares: the histogram, the count that must reach the guard, and the guard.
def _shapes() -> dict[str, tuple[Column, Column, int]]:
    n = len(WORDS)
    common = F.slice("commons", 1, n)
    hits = F.aggregate(common, F.lit(0), lambda a, x: a + x.cast("int"))
    return {
        "char": (F.col("classes"), F.col("word_chars"), MIN_CHARS),
        "mark": (F.slice("classes", 4, 3), F.col("n_words"), MIN_WORDS),
        "word": (common, hits, MIN_COMMON),
        "share": (F.array(hits.cast("bigint"), F.get("commons", F.lit(n)).cast("bigint")), F.col("n_words"), MIN_WORDS),
    }


def _eligible(measured: DataFrame, lang_col: str) -> DataFrame:
    return measured.where(F.col(lang_col).isNotNull()).where(f"not ({BASE_FAILED}) and {SYMBOL_SHARE} * n_symbols <= word_chars")


def references(measured: DataFrame, lang_col: str = "lang") -> list[dict]:
    """For each language the summed histograms of its documents and the limit of each distance.

    A limit lies SPREAD standard deviations above the mean distance of the
    language's own documents from their sum. One row a language comes to the
    driver: languages are few, each task sends one row for each.
    """
    own = _eligible(measured, lang_col)
    sums = [F.sum(F.col(c)[i].cast("bigint")).alias(f"{c}{i}") for c, n in (("classes", len(CLASSES) + 1), ("commons", len(WORDS) + 1)) for i in range(n)]
    refs = [
        {"lang": r[0], "classes": [r[f"classes{i}"] for i in range(len(CLASSES) + 1)], "commons": [r[f"commons{i}"] for i in range(len(WORDS) + 1)]}
        for r in own.groupBy(lang_col).agg(*sums).orderBy(lang_col).collect()
    ]
    for ref in refs:
        common = ref["commons"][: len(WORDS)]
        ref["shapes"] = {"char": ref["classes"], "mark": ref["classes"][3:6], "word": common, "share": [sum(common), ref["commons"][len(WORDS)]]}
        ref["limits"] = {}
    if not refs:
        return refs
    stats = []
    for name, (shape, size, least) in _shapes().items():
        mine = F.get(_literal([r["shapes"][name] for r in refs], "array<array<bigint>>"), F.array_position(_literal([r["lang"] for r in refs], "array<string>"), F.col(lang_col).cast("string")).cast("int") - 1)
        d = F.when(size >= least, let(F.struct(shape.cast("array<bigint>").alias("a"), mine.alias("b")), lambda x: distance(x["a"], x["b"])))
        stats += [F.count(d).alias(f"{name}_n"), F.avg(d).alias(f"{name}_mean"), F.stddev_pop(d).alias(f"{name}_std")]
    spread = {r[0]: r for r in own.groupBy(lang_col).agg(*stats).collect()}
    for name in _shapes():
        own_limits = {lang: max(FLOOR, r[f"{name}_mean"] + SPREAD * r[f"{name}_std"]) for lang, r in spread.items() if r[f"{name}_n"] >= ENOUGH}
        for ref in refs:
            ref["limits"][name] = own_limits.get(ref["lang"], max(own_limits.values(), default=1.0))
    return refs


def _literal(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def judge(measured: DataFrame, refs: list[dict]) -> DataFrame:
    """Adds the distances from the nearest reference, base_failed and kept; refs come from references()."""
    out = measured.withColumn("base_failed", F.expr(BASE_FAILED))
    far = F.col("base_failed")
    for name, (shape, size, least) in _shapes().items():
        if not refs:
            out = out.withColumn(f"{name}_distance", F.lit(0.0))
            continue
        against = _literal([{"q": r["shapes"][name], "limit": r["limits"][name]} for r in refs], "array<struct<q:array<bigint>,limit:double>>")
        # bound first: an expression inside a lambda would be evaluated for each element
        ways = let(shape.cast("array<bigint>"), lambda own: F.array_min(F.transform(against, lambda r: let(distance(own, r["q"]), lambda d: F.struct((d / r["limit"]).alias("part"), d.alias("d"))))))  # noqa: B023
        out = out.withColumn(f"_{name}", ways).withColumn(f"{name}_distance", F.col(f"_{name}.d"))
        far = far | ((size >= least) & (F.col(f"_{name}.part") > 1))
    return out.withColumn("kept", ~far)


def assess(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep_columns: list[str] | None = None) -> DataFrame:
    """The columns keep_columns of docs (default: all but the text) with measures and verdict."""
    carried = keep_columns if keep_columns is not None else [c for c in docs.columns if c != text_col]
    names = [f"in{i}" for i in range(len(carried))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carried, names, strict=True)], F.col(text_col).alias("body"), F.col(lang_col).alias("ref"))
    measured = written(measures(source, "body").drop("body"))
    judged = judge(measured, references(measured, "ref"))
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[f"{n}_distance" for n in _shapes()]]
    return judged.select(*[F.col(n).alias(c) for c, n in zip(carried, names, strict=True)], *numbers)


def filtered(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, in all their columns, that keep their place under the rules."""
    names = [f"in{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    # the references need counts only; writing the texts beside them would cost the disk more than counting again costs time
    source = docs.toDF(*names).withColumn("ref", F.col(of[lang_col]))
    counted = written(measures(source.select(of[text_col], "ref"), of[text_col]).drop(of[text_col]))
    # a filter moves below what it reads and then counts anew for each use, but not below a row's number
    measured = measures(source, of[text_col]).withColumn("row", F.monotonically_increasing_id())
    return judge(measured, references(counted, "ref")).where("kept and row >= 0").select(*names).toDF(*docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), keep_columns=["doc_id"])
