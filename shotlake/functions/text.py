"""Scalar functions over ids, texts, boxes and parsed replies; built-in expressions unless Unicode tables are needed."""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

KEYFRAME = r"^(.+)_s(\d+)_f(\d+)$"
VIDEO = r"^[A-Za-z0-9][A-Za-z0-9_-]*$"
STRIP = r"(?U)^\s+|\s+$"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, STRIP, "")


def keyframe_id(video: Column, shot: Column, frame: Column) -> Column:
    made = F.concat(video, F.lit("_s"), shot.cast("string"), F.lit("_f"), frame.cast("string"))
    return F.when(made.rlike(KEYFRAME) & (shot >= 0) & (frame >= 0), made)


def parse_keyframe_id(x: Column) -> Column:
    """struct(video_id, shot_id, frame_idx); null where x is no keyframe id. The video part is greedy."""
    part = lambda i: F.regexp_extract(x, KEYFRAME, i)
    return F.when(x.rlike(KEYFRAME), F.struct(part(1).alias("video_id"), part(2).cast("int").alias("shot_id"), part(3).cast("int").alias("frame_idx")))


def video_of_path(path: Column) -> Column:
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    return F.when(stem.rlike(VIDEO), stem)


def pts_to_ms(pts: Column, num: Column, den: Column) -> Column:
    """Round half up of pts * num / den seconds, in whole numbers."""
    return F.floor((2 * pts * num * 1000 + den) / (2 * den))


@F.pandas_udf(StringType())
def nfc_strip(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s).strip())


@F.pandas_udf(StringType())
def nfc_casefold(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s).casefold())


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(StringType())
def casefold(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else s.casefold())


@F.pandas_udf(StringType())
def fold_diacritics(x: pd.Series) -> pd.Series:
    """Without combining marks; the stroked D has no decomposition and is replaced first."""

    def fold(s: str | None) -> str | None:
        if s is None:
            return None
        plain = unicodedata.normalize("NFD", s.replace("đ", "d").replace("Đ", "D"))
        return "".join(c for c in plain if not unicodedata.combining(c))

    return x.map(fold)


class AnswerRules(NamedTuple):
    """What a language's answers need: number words of one digit, the words for ten and for tens, colours with their variants, and units of each answer type."""

    numbers: dict[str, int] = {}  # noqa: RUF012
    ten: str = ""
    tens: str = ""
    colours: dict[str, list[str]] = {}  # noqa: RUF012
    units: dict[str, list[str]] = {}  # noqa: RUF012


#: Digits only, for a language without settings of its own.
PLAIN_RULES = AnswerRules()
#: The settings that hold where none are given.
DEFAULT_RULES = AnswerRules(
    numbers={"không": 0, "một": 1, "mốt": 1, "hai": 2, "ba": 3, "bốn": 4, "tư": 4, "năm": 5, "lăm": 5, "sáu": 6, "bảy": 7, "bẩy": 7, "tám": 8, "chín": 9},
    ten="mười",
    tens="mươi",
    colours={
        "đỏ": ["đỏ", "red"],
        "cam": ["cam", "orange"],
        "vàng": ["vàng", "yellow"],
        "lục": ["lục", "xanh lá", "xanh lá cây", "green"],
        "lam": ["lam", "xanh dương", "xanh lam", "xanh nước biển", "blue"],
        "tím": ["tím", "purple", "violet"],
        "trắng": ["trắng", "white"],
        "đen": ["đen", "black"],
        "nâu": ["nâu", "brown"],
        "hồng": ["hồng", "pink"],
        "xám": ["xám", "grey", "gray"],
    },
    units={"number": ["người", "cái", "chiếc", "con", "lần", "%", "phần trăm"]},
)


def folded(word: str) -> str:
    return unicodedata.normalize("NFC", word).strip().casefold()


def _lookup(x: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[x] if values else F.lit(None).cast("int")


def parse_number(x: Column, rules: AnswerRules = DEFAULT_RULES) -> Column:
    """Whole number of signed digits or of one to three number words; null for anything else.

    One word stands for ten or a digit; two for ten and a digit, or two to nine
    tens; three for tens and a digit.
    """
    bare = strip(x)
    words = F.split(bare, r"(?U)\s+")
    word = [F.get(words, F.lit(i)) for i in range(3)]
    digit = [_lookup(w, rules.numbers) for w in word]
    ten = (word[0] == rules.ten) if rules.ten else F.lit(False)
    tens = ((word[1] == rules.tens) & digit[0].between(2, 9)) if rules.tens else F.lit(False)
    two = F.when(ten & digit[1].isNotNull(), 10 + digit[1]).when(tens, digit[0] * 10)
    three = F.when(tens, digit[0] * 10 + digit[2])
    spoken = F.when(F.size(words) == 1, F.when(ten, F.lit(10)).otherwise(digit[0])).when(F.size(words) == 2, two).when(F.size(words) == 3, three)
    return F.when(bare.rlike(r"^-?\d+$"), bare.try_cast("bigint")).otherwise(spoken.cast("bigint"))


def canonical_colour(key: Column, rules: AnswerRules = DEFAULT_RULES) -> Column:
    """The first colour that has the folded key among its variants, else null."""
    known: dict[str, str] = {}
    for colour, variants in rules.colours.items():
        for v in variants:
            known.setdefault(folded(v), colour)
    return _lookup(key, known).cast("string")


def without_unit(key: Column, kind: Column, rules: AnswerRules = DEFAULT_RULES) -> Column:
    """Cut one trailing unit of the answer's type from a folded key, the longest that leaves something."""
    out = None
    for name, units in rules.units.items():
        cuts = []
        for unit in [folded(u) for u in sorted(units, key=len, reverse=True)]:
            left = strip(F.substring(key, F.lit(1), F.length(key) - len(unit)))
            cuts.append(F.when((key != unit) & F.endswith(key, F.lit(unit)) & (left != ""), left))
        if cuts:
            out = F.when(kind == name, F.coalesce(*cuts)) if out is None else out.when(kind == name, F.coalesce(*cuts))
    return key if out is None else F.coalesce(out, key)


def answer_key_of(folded_answer: Column, kind: Column, rules: AnswerRules = DEFAULT_RULES) -> Column:
    bare = without_unit(folded_answer, kind, rules)
    number = parse_number(bare, rules).cast("string")
    return F.when(folded_answer == "", "").when(kind == "number", F.coalesce(number, bare)).when(kind == "color", F.coalesce(canonical_colour(bare, rules), bare)).otherwise(bare)


def answer_key(x: Column, kind: Column, rules: AnswerRules = DEFAULT_RULES) -> Column:
    """The key under which answers of a type are compared: NFC, stripped and case-folded, then as the type says."""
    return answer_key_of(nfc_casefold(strip(x)), kind, rules)


def valid_answer(key: Column, kind: Column, rules: AnswerRules = DEFAULT_RULES) -> Column:
    """Whether a key is well formed: a whole number, a known colour, or any other answer that isn't empty."""
    colours = key.isin(*rules.colours) if rules.colours else F.lit(False)
    return (key != "") & F.when(kind == "number", key.rlike(r"^-?\d+$")).when(kind == "color", colours).otherwise(True)


def sentences(x: Column, most: int) -> Column:
    """Sentences without their marks; more than `most` are joined in the last one by '. '."""
    parts = F.filter(F.transform(F.split(x, r"[.!?;…]+|\n+"), strip), lambda s: s != "")
    head = F.slice(parts, 1, most - 1) if most > 1 else F.array().cast("array<string>")
    tail = F.array(F.array_join(F.slice(parts, most, F.greatest(F.size(parts), F.lit(1))), ". "))
    return F.when(F.size(parts) <= 1, F.filter(F.array(strip(x)), lambda s: s != "")).when(F.size(parts) <= most, parts).otherwise(F.concat(head, tail))


def joined(sep: str, *parts: Column) -> Column:
    """Non-empty strings, and elements of string arrays, joined in order."""
    flat = F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])
    return F.array_join(F.filter(flat, lambda s: s.isNotNull() & (s != "")), sep)


def query_text(text: Column, reveals: Column) -> Column:
    return joined("\n", F.array(text), reveals)


def channel_of_label(label: Column) -> Column:
    return F.substring_index(label, ".", -1)


def evidence_block(parts: dict[str, Column], most: int) -> Column:
    """`name: text` lines of the parts that are not empty, cut after `most` characters."""
    rows = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}: "), v)) for k, v in parts.items()]
    return F.substring(F.array_join(F.array_compact(F.array(*rows)), "\n"), 1, most)


def box_of(polygon: Column, width: Column, height: Column) -> Column:
    """array(x0, y0, x1, y1) in 0 to 1 around array<array<double>> points; null if it has no area."""

    def side(i: int, size: Column) -> tuple[Column, Column]:
        values = F.transform(polygon, lambda p: F.get(p, F.lit(i)) / size)
        clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        return clamp(F.array_min(values)), clamp(F.array_max(values))

    (x0, x1), (y0, y1) = side(0, width), side(1, height)
    return F.when((width > 0) & (height > 0) & (x1 > x0) & (y1 > y0), F.array(x0, y0, x1, y1))


def padded_box(box: Column, share: float) -> Column:
    w, h = (box[2] - box[0]) * share, (box[3] - box[1]) * share
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(F.greatest(zero, box[0] - w), F.greatest(zero, box[1] - h), F.least(one, box[2] + w), F.least(one, box[3] + h))


def without_reasoning(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?s)<think>.*?</think>", ""))


def reply_json(x: Column, schema: str) -> Column:
    """A JSON reply, alone or in a code fence; null where it doesn't parse."""
    bare = F.regexp_replace(without_reasoning(x), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    return F.from_json(bare, schema)


def caption_actions(x: Column) -> Column:
    """Comma-separated actions as a list."""
    return F.filter(F.transform(F.split(x, ","), strip), lambda s: s != "")


def clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def cleaned_names(x: Column) -> Column:
    """Stripped, without empty strings, each once in first-seen order."""
    return F.array_distinct(F.filter(F.transform(x, strip), lambda s: s != ""))


def clamp_timestamp(value: Column, anchor: Column) -> Column:
    return F.when(value >= 0, value).otherwise(anchor)


def first_integer(x: Column) -> Column:
    return F.regexp_extract(x, r"\d+", 0).try_cast("int")


def compute_cost(seconds: Column, gpu: float, cores: float, memory_gib: float, per_core: float, per_gib: float) -> Column:
    return seconds * (gpu + cores * per_core + memory_gib * per_gib)


def time_to_target(rank: Column, cost_s: float, penalty: int) -> Column:
    return F.least(F.coalesce(rank, F.lit(penalty)), F.lit(penalty)) * cost_s


def submission(video: Column, timestamp_ms: Column, kind: str) -> Column:
    """One result as json or csv; negative times are an error, so is another kind."""
    if kind not in ("json", "csv"):
        raise ValueError(f"unknown submission format {kind!r}")
    body = F.concat(video, F.lit(","), timestamp_ms.cast("string")) if kind == "csv" else F.concat(F.lit('{"video_id": '), F.to_json(F.array(video)).substr(F.lit(2), F.length(F.to_json(F.array(video))) - 2), F.lit(', "timestamp_ms": '), timestamp_ms.cast("string"), F.lit("}"))
    return F.when(timestamp_ms < 0, F.raise_error(F.lit("timestamp is negative")).cast("string")).otherwise(body)
