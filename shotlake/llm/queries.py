"""The registered queries of this subpackage, and SQL where it can say their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac, language_id, licenses, line_dedup, mixing, pii, quality, sentence_pieces, simhash, suffix_dedup


def _columns(query, *names: str):
    """A query of some columns of an operator's result, those that SQL can say."""

    def run(spark, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir).select("doc_id", *names)

    return run


def _shares(spark, sf_dir: str) -> DataFrame:
    """Documents and last block of each source in the schedule."""
    return mixing.op4(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("mix_block").alias("last_block"))


QUERIES = {
    "op1_sentence_pieces": sentence_pieces.op1,
    "op2_suffix_dedup": suffix_dedup.op2,
    "op3_simhash": simhash.op3,
    "op4_mixing": mixing.op4,
    "op5_pii": pii.op5,
    "op6_licenses": licenses.op6,
    "op7_quality": quality.op7,
    "op8_flac": flac.op8,
    "op9_line_dedup": line_dedup.op9,
    "op10_language_id": language_id.op10,
    "base_personal_data": _columns(pii.op5, *(f"n_{k}" for k in pii.KINDS)),
    "base_licenses": _columns(licenses.op6, "n_words", "n_base", "first_word", "last_word", "base_labels"),
    "base_quality": _columns(quality.op7, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
    "shares_mixing": _shares,
}

_SMALL = "0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_SPACE = r"\x20\x09-\x0D"

ORACLES: dict[str, str] = {
    "base_personal_data": rf"""with t as (select doc_id, coalesce(text, '') as text from documents), m as (select doc_id,
   regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') email, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') ip,
   list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) card, list_transform(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) phone from t)
 select doc_id, len(email) n_email, len(list_filter(ip, lambda x: regexp_full_match(x, '{_SMALL}(\.{_SMALL}){{3}}'))) n_ip,
   len(list_filter(card, lambda x: length(x) between 16 and 19 and list_sum(list_transform(range(1, length(x) + 1), lambda i: case when i % 2 = 1 then substr(x, i, 1)::int else (2 * substr(x, i, 1)::int) % 10 + (2 * substr(x, i, 1)::int) // 10 end)) % 10 = 0)) n_card,
   len(list_filter(phone, lambda x: length(x) between 8 and 15)) n_phone from m""",
    "base_licenses": r"""with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
 p as (select doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' and w[i + 1] = 'by') cc, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' and w[i + 1] = 'public' and w[i + 2] = 'license') gpl, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' and w[i + 1] = 'rights' and w[i + 2] = 'reserved') r from w),
 q as (select doc_id, len(w) n_words, list_concat(list_concat(cc, gpl), r) a, list_filter([case when len(cc) > 0 then 'cc-by' end, case when len(gpl) > 0 then 'gpl' end, case when len(r) > 0 then 'reserved' end], lambda x: x is not null) l from p)
 select doc_id, n_words, len(a) n_base, list_min(a) - 1 first_word, list_max(a) - 1 last_word, array_to_string(l, ',') base_labels from q""",
    "base_quality": rf"""with t as (select doc_id, coalesce(text, '') as text from documents), w as (select doc_id, text, regexp_extract_all(text, '[^{_SPACE}]+') w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) l from t),
 g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) i from w)), d as (select doc_id, s from g group by all having count(*) > 1), c as (select doc_id, count(distinct k) n from (select g.doc_id, unnest(range(i, i + 5)) k from g join d on g.doc_id = d.doc_id and g.s = d.s) group by all)
 select w.doc_id, len(w) n_words, length(regexp_replace(text, '[{_SPACE}]', '', 'g')) word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines, coalesce(n, 0) n_repeat_words, len(w) < 10 or 100 * coalesce(n, 0) > 20 * len(w) base_failed from w left join c on w.doc_id = c.doc_id""",
    "shares_mixing": "select source, count(*) n, (count(*) - 1) // 16 last_block from documents group by source",
}
