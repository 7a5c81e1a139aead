"""Corpus operators against brute force, round trips and odd inputs."""

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from edge_texts import EDGES
from oracle import DATA, bag, expected
from pyspark.sql import functions as F

from shotlake.llm import common, flac, language_id, licenses, line_dedup, mixing, pii, quality, queries, sentence_pieces, simhash, suffix_dedup


def rows_by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1
def test_pieces_equal_the_library(documents, empty):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab  the▁ing\n\té①😀Zx") for _ in range(rng.randrange(60))) for _ in range(80)] + EDGES
    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    got = rows_by_id(sentence_pieces.encode(documents(texts)))
    assert all(list(got[i].ids) == sp.encode(t or "") for i, t in enumerate(texts))
    back = rows_by_id(sentence_pieces.decode(sentence_pieces.encode(documents(texts))))
    assert all(back[i].text == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert sentence_pieces.encode(empty).count() == 0


def test_lattice_folds(spark):
    words = ["▁hello", "▁the", "▁▁▁▁", "①", "▁internationalisation", "é"]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    bpe = sentence_pieces.load()
    assert not bpe.unigram
    assert {r.word: list(r.ids) for r in sentence_pieces.encode_words(table, bpe).collect()} == {w: sentence_pieces.fold_word(w, bpe) for w in words}
    known = {p: (i, s) for i, (p, s) in enumerate([("a", -1.0), ("b", -1.5), ("ab", -2.0), ("ba", -0.4), ("aba", -3.5), ("bb", -2.2)])}
    uni = sentence_pieces.Pieces(known, [-1] * 256, True, 3, 99)
    words = ["aba", "abab", "bbab", "c", "abcba"]
    got = {r.word: list(r.ids) for r in sentence_pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), uni).collect()}

    def score(ids):
        return sum(-100.0 if i == 99 else next(s for j, s in known.values() if j == i) for i in ids)

    assert all(score(got[w]) == pytest.approx(score(sentence_pieces.fold_word(w, uni))) for w in words)


def test_words_fold_at_once_as_one_by_one():
    pieces = sentence_pieces.load()
    rng = random.Random(21)
    words = ["▁" + "".join(rng.choice("abcdeghilnorstuaaa①é😀\n▁") for _ in range(rng.randrange(45))) for _ in range(3000)] + ["▁", "aaaaaaa", "x" * 90, "▁▁▁▁▁▁▁"]
    ids, starts, sizes = sentence_pieces.fold_words(words, pieces, sentence_pieces.merges(pieces))
    assert [ids[a : a + n].tolist() for a, n in zip(starts, sizes, strict=True)] == [sentence_pieces.fold_word(w, pieces) for w in words]


# 2
def brute_repeats(texts, n=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            w = b[s : s + n]
            if w in seen:
                gone[s : s + n] = b"\1" * n
            seen.add(w)
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), len(b) - len(rest), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return out


def test_repeats(documents, empty):
    rng = random.Random(4)
    parts = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice((60, 130, 400)))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(6))) + "z" * rng.choice((0, 5, 250)) for _ in range(40)] + EDGES
    got = rows_by_id(suffix_dedup.dedup(documents(texts)))
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == brute_repeats(texts)
    assert suffix_dedup.dedup(empty).count() == 0


def test_transform_merge():
    rng = np.random.default_rng(3)
    shards = [np.append(rng.integers(97, 100, 700), 0).astype(np.uint8) for _ in range(3)]
    z, place, common = suffix_dedup.merge_transforms(shards, 20)
    strings = [np.roll(shards[s], -p)[:20].tobytes() for s, p in zip(z, place, strict=True)]
    assert strings == sorted(strings)
    same = [False] + [a == b for a, b in zip(strings, strings[1:], strict=False)]
    assert [c >= 20 for c in common] == same


def test_rounds_stay_wide_with_many_kinds():
    """More kinds of byte strings than 16 bits can number don't make rounds narrow; the merge stays exact."""
    rng = np.random.default_rng(4)
    shards = [np.append(rng.integers(1, 256, 45_000), 0).astype(np.uint8) for _ in range(2)]
    shards[1][5_000:9_000] = shards[0][30_000:34_000]
    step, numbers = suffix_dedup._alphabet(shards, 100)
    assert step == 20
    before = [np.roll(s, 20 - p)[:20].tobytes() for s in shards for p in range(0, len(s), 97)]
    picked = np.concatenate([n[::97] for n in numbers])
    assert [before[i] for i in np.argsort(picked, kind="stable")] == sorted(before)
    z, place, common = suffix_dedup.merge_transforms(shards, 100)
    inner = place <= 45_000 - 100
    strings = [shards[s][p : p + 100].tobytes() for s, p in zip(z[inner], place[inner], strict=True)]
    assert strings == sorted(strings) and (common[inner] >= 100).sum() == len(strings) - len(set(strings)) == 3_901


# 3
def test_simhash(documents, empty):
    rng = random.Random(6)
    base = [[rng.choice(["An", "er", "th", "on", "Re", "st"]) + rng.choice(["x", "y", "z"]) for _ in range(80)] for _ in range(6)]
    texts = []
    for words in base:
        for _ in range(6):
            own = list(words)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(80)] = "new"
            texts.append(" ".join(own))
    texts += EDGES

    def fingerprint(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (fp[i] ^ fp[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    docs = documents(texts)
    for bucket in (64, 2):
        simhash.BUCKET, before = bucket, simhash.BUCKET
        got = rows_by_id(simhash.near_duplicates(docs))
        simhash.BUCKET = before
        assert [got[i].fp & (1 << 64) - 1 for i in range(len(texts))] == fp
        assert [got[i].component for i in range(len(texts))] == label
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.filtered(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 0").count() == 1
    assert simhash.filtered(docs.unionAll(docs)).count() == kept.count()


def tails(rng, n, changed, pairs):
    """Pairs of texts with n 5-word shingles each, of which the last `changed` differ."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    out = []
    for _ in range(pairs):
        own = [word() for _ in range(n + 4)]
        out += [" ".join(own), " ".join(own[:-changed] + [word() for _ in range(changed)])]
    return out


@pytest.mark.parametrize("bucket", [32, 1])
def test_filter_finds_pairs_beyond_the_fingerprint(documents, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BAND_BUCKET", bucket)
    texts = tails(random.Random(12), 200, 12, 60)  # similarity 188 / 212
    assert {r.doc_id for r in simhash.filtered(documents(texts)).collect()} == set(range(0, 120, 2))


@pytest.mark.parametrize("bucket", [32, 1])
def test_filter_links_by_exact_similarity(documents, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BAND_BUCKET", bucket)
    rng = random.Random(13)
    texts = tails(rng, 180, 20, 40) + tails(rng, 180, 21, 40)  # 160 / 200 links, 159 / 201 does not
    assert {r.doc_id for r in simhash.filtered(documents(texts)).collect()} == {*range(0, 80, 2), *range(80, 160)}


@pytest.mark.parametrize("bits", [18, 1])
def test_filter_shuffles_no_text_that_stays(documents, bits, monkeypatch):
    """Copies of id and text, near copies and null ids meet whatever the sieve lets through; the other texts stay where they are."""
    monkeypatch.setattr(common, "SIEVE_BITS", bits)
    docs = documents([*tails(random.Random(14), 200, 12, 20), None, None, "", "one of its own"])
    docs = docs.unionAll(docs.where("doc_id < 6")).withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")))
    kept = simhash.filtered(docs)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, *range(0, 6, 2), *range(8, 42, 2), 43]
    plan = kept._jdf.queryExecution().executedPlan().toString().split("\n")
    other = next(i for i, x in enumerate(plan) if ":- " in x and "Union" in plan[i - 1])
    second = next(i for i, x in enumerate(plan) if i > other and x.index("+-" if "+-" in x else x) == plan[other].index(":- "))
    assert not any("Exchange" in x for x in plan[other:second]) and any("Exchange" in x for x in plan[second:])


def test_sieve_holds_for_all_keys_and_few_others(spark):
    keys = spark.range(20000).withColumn("key", F.struct(F.when(F.col("id") > 0, F.col("id")).alias("id"), (F.col("id") * 3).alias("own")))
    held = common.sieve(keys.where("id % 2 = 0"), "key")
    got = keys.groupBy(F.col("id") % 2 == 0).agg(F.count("key"), F.sum(held(F.col("key")).cast("int"))).collect()
    counts = {r[0]: (r[1], r[2]) for r in got}
    assert counts[True] == (10000, 10000) and counts[False][1] < 100
    none = common.sieve(keys.where("false"), "key")
    assert keys.where(none(F.col("key"))).count() == 0


def test_filter_takes_the_links_of_the_fingerprint(documents):
    """Texts of one fingerprint whose shingles are too few alike for the bands: a long run of one word outweighs the rest."""
    run = " ".join(["same"] * 60)
    texts = [f"{run} {' '.join(f'{c}{i}' for i in range(20))}" for c in "abc"] + ["other words of a text of its own that nothing else is like"]
    docs = documents(texts)
    got = rows_by_id(simhash.near_duplicates(docs))
    assert [got[i].component for i in range(4)] == [0, 0, 0, 3]
    assert {r.doc_id for r in simhash.filtered(docs).collect()} == {0, 3}


# 4
def test_mixing(documents, edges, empty):
    sources = ["a"] * 700 + ["b"] * 200 + ["c"] * 100
    docs = documents([str(i) for i in range(1000)], sources=sources)
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = mixing.mix(docs, weights, block=8, cycle=50).orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(1000))
    served, most = dict.fromkeys(weights, 0), dict.fromkeys(weights, 0)
    slots = sorted({(r.mix_slot, r.source, r.mix_block) for r in got})
    assert len({s for s, _, _ in slots}) == len(slots)
    horizon = min(-(-sources.count(s) // 8) * 50 // u for s, u in mixing.shares(weights, 50).items())
    units = mixing.shares(weights, 50)
    for slot, s, b in slots:
        assert b * 50 // units[s] <= slot < -(-(b + 1) * 50 // units[s])
        served[s] += 1
        if slot < horizon:
            most = {k: max(most[k], abs(served[k] - units[k] / 50 * (slot + 1))) for k in units}
    assert max(most.values()) < 1
    assert sorted(r.mix_position for r in mixing.mix(edges).collect()) == list(range(len(EDGES)))
    assert mixing.mix(empty).count() == 0


# 5
def test_personal_data(documents, empty):
    texts = ["a@b.cd@e.fg x_d@e.fg", "1.2.3.4.5.6.7.8.9", "300.1.1.1 10.0.0.1", "4111 1111-1111 1111", "4111111111111112", "+1 (523) 555-1055, +12", "a@b", "4111111111111111 4111111111111111", *EDGES]
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def spans(t):
        out = []
        for k, p in kinds.items():
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m[0])
                good = {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[k]
                if good:
                    out.append(f"{k}:{m.start()}:{m.end()}")
        return out

    got = rows_by_id(pii.find(documents(texts)))
    for i, t in enumerate(texts):
        base = spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(filter(None, got[i].spans.split(",")))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in base) for k in pii.KINDS]
    assert pii.find(empty).count() == 0


def test_tagger_learns_spans():
    texts, spans = pii.labelled(150, seed=99)
    net = pii.Tagger()
    net.p = pii.trained()
    labels, _ = net.decode(np.stack([pii.classes(t) for t in texts]))
    right = total = 0
    for tags, own in zip(labels, spans, strict=True):
        for kind, a, b in own:
            total += 1
            right += bool((tags[a:b] > 0).mean() > 0.8 and ((tags[a:b][tags[a:b] > 0] - 1) // 2 == pii.LABELLED.index(kind)).mean() > 0.8)
    assert right / total > 0.7


def test_added_spans_on_held_out_texts(documents):
    """Precision and recall of what the network adds, on texts of another kind than those it learned from."""
    rng = random.Random(51)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    prose = lambda: " ".join(rng.choice(["The", "river", "garden", "wither", "été", "über", "of", "and", "Stone,"]) for _ in range(rng.randrange(4, 15)))
    texts, want = [], []
    for i in range(200):
        text, own = prose() + " ", None
        if i % 4 == 0:
            piece = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            text += 'token = "'
            own = ("secret", len(text), len(text) + 40)
            text += piece + '" '
        elif i % 4 == 1:
            piece = f"({rng.randrange(2, 10)}{digits(2)}) {rng.randrange(2, 10)}{digits(2)}-{digits(4)}"
            own = ("phone", len(text), len(text) + len(piece))
            text += piece + " "
        elif i % 4 == 2:
            text += f"ref 0{digits(2)}-{digits(3)}-{digits(4)} order 2024-05-17 and 12.11.2023 "
        else:
            text += f"number {digits(24)} version {digits(1)}.{digits(1)} of {digits(3)},{digits(3)} "
        texts.append(text + prose())
        want.append(own)
    got = rows_by_id(pii.find(documents(texts)))
    added = [set(filter(None, got[i].spans.split(","))) for i in range(200)]
    assert all(got[i].n_spans == len(x) for i, x in enumerate(added))
    hits = sum(bool(w) and ":".join(map(str, w)) in x for w, x in zip(want, added, strict=True))
    total = sum(len(x) for x in added)
    assert hits / 100 >= 0.8 and hits / total >= 0.9, (hits, total)


def test_windows_without_digits_give_nothing():
    net = pii.Tagger()
    net.p = pii.trained()
    text = "plain words only " * 40
    assert pii.windows_of(text, pii.classes(text)) == [] and pii.method_spans(net, [text]) == [[]]


# 6
def test_licences(documents, empty):
    texts = ["Released under the MIT License.", "General Public License x general public-license", "CC BY cc by", "Licensed under the Apache License, Version 2.0.", "apache helicopters, licensed pilots", "All rights\nreserved", *EDGES]
    got = rows_by_id(licenses.scan(documents(texts)))
    assert [got[i].labels for i in range(6)] == ["mit", "gpl", "cc-by", "apache-2.0", "", "reserved"]
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].n_words) == (2, 0, 4, 7)
    assert (got[6].n_words, got[6].first_word, got[6].score) == (0, None, 0.0)
    assert licenses.scan(empty).count() == 0


def test_licences_of_several_notices(documents):
    long = {label: wording for label, wording, _ in licenses.TEMPLATES}
    mit, apache, gpl, nc = licenses.TEMPLATES[1][1], licenses.TEMPLATES[2][1], long["gpl-3.0"], long["cc-by-nc"]
    fill = " person charge deal forms copyright redistribution attribution unencumbered mozilla affero lesser "
    texts = [mit + " x " + apache, " x ".join([mit, gpl, apache]), " x ".join([apache, nc, long["mit"], licenses.TEMPLATES[0][1]]), fill * 50 + apache, "\n\n".join(w for _, w, _ in licenses.TEMPLATES)]
    got = rows_by_id(licenses.scan(documents(texts)))
    found = [{x.split(":")[0] for x in got[i].found.split(",")} for i in range(5)]
    assert found[0] == {"mit", "apache-2.0"} and found[1] >= {"mit", "gpl-3.0", "apache-2.0"} and found[2] >= {"mit", "apache-2.0", "cc-by-nc"}
    assert found[3] == {"apache-2.0"} and found[4] == {label for label, _, _ in licenses.TEMPLATES}


def test_templates_against_every_place(documents):
    """The index against all templates at all places of noisy texts."""
    rng = random.Random(61)
    index = licenses.Index()
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            own = list(rng.choice(index.templates)[1])
            for _ in range(rng.randrange(len(own) // 3 + 1)):
                own[rng.randrange(len(own))] = rng.choice([b"x", b"the", b"license"])
            words += [w.decode() for w in own[rng.randrange(3) :]] + [rng.choice(["and", "software", "y"]) for _ in range(rng.randrange(6))]
        texts.append(" ".join(words))
    got = rows_by_id(licenses.scan(documents(texts)))
    for i, t in enumerate(texts):
        words, want = licenses.words_of(t.encode()), {}
        for label, wording, keys in index.templates:
            for at in range(-len(wording), len(words)):
                share = sum(0 <= at + k < len(words) and words[at + k] == w for k, w in enumerate(wording)) / len(wording)
                here = words[max(0, at - 3) : max(0, at + len(wording) + 3)]
                if share >= licenses.MIN_SHARE and all(any(here[j : j + len(k)] == k for j in range(len(here))) for k in keys):
                    want[label] = max(want.get(label, (0.0, 0)), (share, -at))
        assert got[i].found == ",".join(f"{label}:{-at}:{share:.3f}" for label, (share, at) in sorted(want.items()))


# 7
def test_quality(documents, empty):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "and", "anon", "er", "thing", "la", "x1"])
    texts = [" ".join(word() for _ in range(rng.randrange(120))) + rng.choice(["", "\n\na b\nc\na b", " ### $$$"]) for _ in range(40)] + EDGES

    def measured(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        places = {}
        for i in range(len(w) - 4):
            places.setdefault(tuple(w[i : i + 5]), []).append(i)
        cover = {k for v in places.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)

    docs = documents(texts)
    got = rows_by_id(quality.assess(docs))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(t or "")
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert sorted(r.doc_id for r in quality.filtered(docs).collect()) == [i for i in range(len(texts)) if got[i].kept]
    assert quality.assess(empty).count() == 0 and quality.filtered(empty).columns == empty.columns


def test_quality_verdicts_by_each_distance(documents):
    """Limits come from the references' own spread; each odd text is rejected by the distance named, usual ones stay."""
    rng = random.Random(80)
    usual = lambda: " ".join(rng.choice(["the", "of", "and", "to", "in", "a", "is", "house", "river", "Stone", "garden", "winter"]) for _ in range(300)) + "."
    odd = {
        "share": " ".join("".join(rng.choice("bcdfgklmnprst") for _ in range(6)) for _ in range(300)),
        "word": " ".join(rng.choice(["with", "was", "be", "for", "on", "as", "house", "river", "garden", "winter"]) for _ in range(300)),
        "char": " ".join(rng.choice(["THE", "OF", "AND", str(rng.randrange(10**4)), "HOUSE"]) for _ in range(300)),
        "mark": " ".join(rng.choice(["the", "of", "and", "to", "house", "river", "stone", "winter"]) + rng.choice(["***", "###", "%%"]) for _ in range(300)),
    }
    docs = documents([usual() for _ in range(60)] + list(odd.values()), langs=["en"] * 60 + [None] * len(odd))
    measured = quality.measures(docs.withColumnRenamed("text", "body"), "body")
    refs = quality.references(measured)
    judged = rows_by_id(quality.judge(measured, refs))
    assert all(judged[i].kept for i in range(60))
    for i, name in enumerate(odd):
        assert not judged[60 + i].kept and not judged[60 + i].base_failed
        assert judged[60 + i][f"{name}_distance"] > refs[0]["limits"][name]
    got = rows_by_id(quality.assess(docs))
    assert {i for i, r in got.items() if not r.kept} == set(range(60, 64))
    assert {r.doc_id for r in quality.filtered(docs).collect()} == set(range(60))


def test_quality_filter_counts_a_text_once(documents):
    """The filter reads the counts; below them it would count again for each use."""
    docs = documents(["the house of the river and the garden in winter is a stone"] * 30)
    plan = quality.filtered(docs)._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.split("\n") if "Filter" in x]
    assert filters and all("n_repeat_words" in x and "_words AS" not in x and "split(" not in x and "regexp" not in x for x in filters)


def jensen_shannon(p, q):
    p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
    m = (p + q) / 2
    part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    return np.sqrt(max(0, (part(p) + part(q)) / 2))


def test_distances_equal_their_definition(spark):
    rng = random.Random(81)
    pairs = [([rng.randrange(9) for _ in range(5)], [rng.randrange(1, 9) for _ in range(5)]) for _ in range(30)] + [([0] * 5, [1] * 5)]
    got = spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>").select("a", "b", quality.distance(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        assert r.d == pytest.approx(jensen_shannon(r.a, r.b) if sum(r.a) else 1.0, abs=1e-9)


def test_quality_counts_all_classes_and_words(documents):
    text = "Été ÀÉ 9٣ Ωß, das — más was nicht was una su xyzzyxyzzy Was"
    row = quality.measures(documents([text])).first()
    words = text.split()
    kinds = [sum(unicodedata.category(c) == k for c in text) for k in ("Ll", "Lu", "Nd")]
    assert row.classes == [*kinds, 1, 0, len(words) - 1, 1]
    assert row.commons[:-1] == [words.count(w) for w in quality.WORDS] and row.commons[-1] == len(words) - 7
    assert {"is", "that", "was", "mit", "nicht", "una", "pero"} <= set(quality.WORDS)


# 8
def test_flac_round_trip(documents, empty):
    docs = documents([*EDGES, "ab" * 6000, "".join(chr(random.Random(1).randrange(32, 900)) for _ in range(3000))])
    stored = flac.store(docs)
    texts = {r.doc_id: flac.padded((r.text or "").encode()) for r in docs.collect()}
    got = rows_by_id(flac.digests(stored))
    for i, p in texts.items():
        assert got[i].payload_sha256 == hashlib.sha256(p).hexdigest() and got[i].payload_bytes == len(p) and len(p) % 64 == 0
        assert got[i].tail_crc32 == zlib.crc32(p[-64:])
    blocks = {}
    for r in flac.blocks(stored).orderBy("doc_id", "sample_offset").collect():
        assert r.sample_offset == len(blocks.get(r.doc_id, b""))
        blocks[r.doc_id] = blocks.get(r.doc_id, b"") + r.pcm
    assert blocks == texts
    assert flac.digests(flac.store(empty)).count() == 0


def test_flac_predictors_and_damage():
    rng = random.Random(3)
    ramp = [bytes((i * 3 + rng.randrange(3)) % 256 for i in range(n)) for n in (64, 4096, 5000)]
    for lpc in (None, 15, -3):
        streams = flac.encode(ramp, lpc)
        assert [b"".join(b for _, b in s) for s in flac.decode(streams)] == ramp
    bad = bytearray(flac.encode(ramp)[2])
    bad[-40] ^= 1
    with pytest.raises(ValueError, match="CRC"):
        flac.decode([bytes(bad)])
    whole = flac.encode(ramp)[2]
    size = int.from_bytes(whole[43:46], "big")
    unseekable = whole[:4] + b"\x80" + whole[5:42] + whole[46 + size :]
    assert b"".join(b for _, b in flac.decode([unseekable])[0]) == ramp[2]


@pytest.mark.parametrize("method", [0, 1])
def test_flac_partitions_of_other_writers(method):
    """Two partitions a frame, one escaped, with 4-bit and 5-bit parameters."""
    rng = random.Random(31)
    payload = bytes(rng.randrange(256) for _ in range(128))
    samples = [x - 128 for x in payload]
    bits = f"{8 << 1:08b}" + f"{method:02b}" + f"{1:04b}" + f"{5:0{4 + method}b}"
    for v in samples[:64]:
        z = v * 2 if v >= 0 else -2 * v - 1
        bits += "0" * (z >> 5) + "1" + f"{z & 31:05b}"
    bits += "1" * (4 + method) + f"{9:05b}" + "".join(f"{v & 511:09b}" for v in samples[64:])
    bits += "0" * (-len(bits) % 8)
    frame = flac.frame_header(0, 128) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = int(flac.crc16_all(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    whole = flac.encode([payload])[0]
    stream = whole[:4] + b"\x80" + whole[5:42] + frame + crc.to_bytes(2, "big")
    both = flac.decode([stream, whole])
    assert [b"".join(b for _, b in own) for own in both] == [payload, payload]


def test_pcm_blocks_are_seekable(documents):
    texts = ["plain text " * 2000, "", None, "é" * 5000]
    stored = flac.store(documents(texts))
    rows = {}
    for r in flac.blocks(stored).collect():
        rows.setdefault(r.doc_id, []).append((r.sample_offset, r.n_samples, bytes(r.pcm)))
    for i, t in enumerate(texts):
        own = sorted(rows[i])
        assert b"".join(b for _, _, b in own) == flac.padded((t or "").encode())
        assert [o for o, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))]


# 9
def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance(spark):
    rng = random.Random(9)
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randrange(9))), "".join(rng.choice("ab") for _ in range(rng.randrange(9)))) for _ in range(300)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within(F.col("a"), F.col("b"), 2).alias("ok")).collect()
    assert all(r.ok == (edit(r.a, r.b) <= 2) for r in got)


@pytest.mark.parametrize("bucket", [24, 1])
def test_line_dedup(documents, empty, bucket, monkeypatch):
    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    monkeypatch.setattr(line_dedup, "BLOCK", 2)
    rng = random.Random(10)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(22, 60))) for _ in range(12)]

    def near(x):
        x = list(x)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(x))
            x[k : k + rng.randrange(2)] = rng.choice(["", "Z"])
        return "".join(x)

    texts = ["\n".join(near(rng.choice(base)) for _ in range(rng.randrange(6))) for _ in range(30)]
    seen, want = [], []
    for t in texts:
        left = []
        for x in t.split("\n"):
            if len(x) < line_dedup.MIN_CHARS or not any(abs(len(x) - len(y)) <= 2 and edit(x, y) <= 2 for y in seen):
                left.append(x)
            if len(x) >= line_dedup.MIN_CHARS:
                seen.append(x)
        want.append("\n".join(left))
    got = rows_by_id(line_dedup.dedup(documents(texts)))
    assert [got[i].text for i in range(len(texts))] == want
    odd = rows_by_id(line_dedup.dedup(documents(EDGES)))
    assert odd[0].text is None and odd[9].text == "" and odd[6].text == EDGES[6]
    assert line_dedup.dedup(empty).count() == 0


def test_short_lines_that_repeat_go(spark, documents, tmp_path):
    import corpus_pipeline

    texts = ["All rights reserved.\n\na\nAll rights reserved.", "\n \na\nb\nAll rights reserved!", "a", None]
    docs = documents(texts)
    got = rows_by_id(corpus_pipeline.line_repeats(spark, docs, ""))
    assert [got[i].text for i in range(4)] == ["All rights reserved.\n\na", "\n \nb\nAll rights reserved!", "", None]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = rows_by_id(line_dedup.op9(spark, str(tmp_path)))
    assert [(found[i].n_lines, found[i].n_removed, found[i].removed_lines) for i in range(4)] == [(4, 1, "3"), (5, 1, "2"), (1, 1, "0"), (1, 0, "")]


# 10
def test_language(spark, empty):
    rng = random.Random(11)
    parts = {"en": ["the", "ing", "and", "sh", "wh"], "fr": ["eau", "é", "les", "qu", "oi"], "de": ["ung", "sch", "ü", "der", "ß"]}
    rows = [(i, " ".join("".join(rng.choice(parts[x]) for _ in range(3)) for _ in range(30)), x, "s", 0, 0) for i in range(300) for x in [rng.choice(list(parts))]]
    rows += [(1000 + i, t, None, "s", 0, 0) for i, t in enumerate(EDGES)] + [(2000, "123 !!", "en", "s", 0, 0)]
    docs = spark.createDataFrame(rows, empty.schema)
    got = rows_by_id(language_id.identify(docs, language_id.training_sample(docs)))
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.95
    assert got[1000].lang_pred == got[2000].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(empty, language_id.training_sample(empty)).count() == 0


def test_contexts_hold_distributions():
    model = language_id.Model({"a": [b"abracadabra " * 5], "b": [b"xyz"]})
    for _, bits in model.tables:
        assert np.allclose(np.exp2(-bits.astype(np.float64)).sum(1), 1, atol=1e-4)


#: Names that operators use within, that hold a dot, or that differ in case only from none of theirs.
CLASHING = ["a", "n", "j", "at", "before", "_k", "_doc", "_kept", "mix_note", "x.y", "id", "own", "node", "key", "line", "first", "block", "source_", "hash", "kept", "in0", "ref", "body", "classes", "n_words", "rep", "words"]


@pytest.fixture
def clashing(documents):
    """Documents with columns of clashing names, a null id, rows that share an id, and a row given twice."""
    rng = random.Random(90)
    texts = [" ".join(rng.choice(["the", "of", "and", "river", "stone", "winter", "garden"]) + str(rng.randrange(40)) for _ in range(60)) for _ in range(12)] + ["", None]
    docs = documents(texts, sources=["a", "b", None, "a"] * 3 + ["a", "b"])
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") == 3, None).when(F.col("doc_id") == 5, 4).otherwise(F.col("doc_id")))
    docs = docs.unionAll(docs.where("doc_id = 7"))
    return docs.select("*", *[F.lit(i + 70).alias(c) for i, c in enumerate(CLASHING)])


def test_stages_carry_clashing_columns(clashing, spark):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, clashing, "")
        assert got.columns == clashing.columns, name
        rows = got.collect()
        assert all(r[c] == i + 70 for r in rows for i, c in enumerate(CLASHING)), name
        # the twelve texts are unlike each other; a row given twice is one document to near_dedup
        words = [r for r in rows if r.text]
        assert len(words) == (12 if name == "near_dedup" else 13), name
        assert sum(r.doc_id is None for r in words) == 1 and sum(r.doc_id == 4 for r in words) == 2, name
    kept = line_dedup.dedup(clashing.where("doc_id = 4 or doc_id is null or doc_id = 1"))
    assert all(r.text for r in kept.collect())
    mixed = mixing.mix(clashing)
    assert sorted(r.mix_position for r in mixed.collect()) == list(range(clashing.count()))
    assert sentence_pieces.encode(clashing).count() == clashing.count()


def test_mixing_equals_a_plain_schedule(documents):
    """Positions against earliest deadline first, run block by block over all cycles."""
    rng = random.Random(91)
    sizes = {"a": 500, "b": 130, "c": 37, "d": 5}
    weights = {"a": 3.0, "b": 2.0, "c": 1.5, "d": 0.5}
    sources = [s for s, n in sizes.items() for _ in range(n)]
    rng.shuffle(sources)
    got = mixing.mix(documents(["x"] * len(sources), sources=sources), weights, block=4, cycle=20).collect()
    units = mixing.shares(weights, 20)
    q, want, place = sum(units.values()), [], 0
    taken = dict.fromkeys(sizes, 0)
    for slot in range(100_000):
        if all(taken[s] * 4 >= sizes[s] for s in sizes):
            break
        free = [((taken[s] + 1) * q / units[s], s) for s in sizes if taken[s] * q // units[s] <= slot]
        _, s = min((-(-(taken[s] + 1) * q // units[s]), s) for _, s in free)
        n = max(0, min(4, sizes[s] - 4 * taken[s]))
        want += [(place + i, s, taken[s], slot) for i in range(n)]
        place += n
        taken[s] += 1
    assert sorted((r.mix_position, r.mix_source, r.mix_block, r.mix_slot) for r in got) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_columns_that_sql_can_say(spark, name):
    got = queries.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    assert bag(got) == bag(expected(queries.ORACLES[name], "sf0.001"))


def test_code_lengths_against_counts():
    """Code lengths of small texts from dictionaries of contexts."""
    rng = random.Random(101)
    samples = {x: [bytes(rng.choice(letters) for _ in range(rng.randrange(5, 60))) for _ in range(8)] for x, letters in (("a", b"abc ab"), ("b", b"bcd \xc3\xa9 "))}
    model = language_id.Model(samples)
    texts = [bytes(rng.choice(b"abcdzx \xc3") for _ in range(rng.randrange(1, 30))) for _ in range(20)]
    flat = np.full(model.n, 1 / 256)
    flat[0] = max(model.n_rare, 1e-3) / 256
    want = np.zeros((len(texts), 2))
    for j, lang in enumerate(model.langs):
        counts = {}
        for t in samples[lang]:
            sym = [int(model.symbol[b]) for b in b"\n" * model.order + t]
            for i in range(model.order, len(sym)):
                for k in range(model.order + 1):
                    counts.setdefault(tuple(sym[i - k : i]), np.zeros(model.n))[sym[i]] += 1

        def row(context, counts=counts):
            below = flat if not context else row(context[1:])
            if context not in counts:
                return below
            c = counts[context]
            kinds, rest = (c > 0).sum(), np.where(c > 0, 0, below)
            p = c / (c.sum() + kinds) + (rest * kinds / (c.sum() + kinds) / rest.sum() if rest.sum() else 0)
            return p / p.sum()

        for i, t in enumerate(texts):
            sym = [int(model.symbol[b]) for b in b"\n" * model.order + t]
            want[i, j] = sum(-np.log2(row(tuple(sym[k - model.order : k]))[sym[k]]) for k in range(model.order, len(sym)))
    assert np.allclose(model.code_lengths(texts), want, atol=1e-2)


# pipeline
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.columns == docs.columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(after.toPandas(), docs.schema)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == docs.count() > 100


def test_pipeline_equals_plain_python(spark, tmp_path, documents):
    """All stages over planted junk, repeated lines and near copies, against brute force (too few documents for distances)."""
    import corpus_pipeline

    rng = random.Random(77)
    word = lambda: rng.choice(["the", "of", "and", "stone", "river", "winter", "garden"]) + rng.choice("abcdefghij") + str(rng.randrange(90))
    line = lambda n: " ".join(word() for _ in range(n))
    texts = ["\n".join(line(rng.randrange(12, 30)) for _ in range(5)) for _ in range(12)]
    texts += [texts[0], texts[1].replace(texts[1].split()[40], "changed"), "too few words", "again and again " * 20, None]
    texts += [texts[2].split("\n")[1] + "\n" + line(25), texts[3].split("\n")[0][:-1] + "\n" + line(25) + "\nAll rights reserved.", line(30) + "\nAll rights reserved."]
    sources = [rng.choice("ab") for _ in texts]

    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def base_ok(t):
        w, places = words(t), {}
        for i in range(len(w) - 4):
            places.setdefault(tuple(w[i : i + 5]), []).append(i)
        cover = {k for v in places.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
        return len(w) >= 10 and 100 * len(cover) <= 20 * len(w)

    docs = {i: t for i, t in enumerate(texts) if base_ok(t)}
    seen, cleaned = [], {}
    for i, t in docs.items():
        left = []
        for x in t.split("\n"):
            if not x.strip() or not any(x == y or (min(len(x), len(y)) >= line_dedup.MIN_CHARS and abs(len(x) - len(y)) <= 2 and edit(x, y) <= 2) for y in seen):
                left.append(x)
            seen.append(x)
        cleaned[i] = "\n".join(left)
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := [x.lower() for x in words(t)]) else set() for i, t in cleaned.items()}
    label = {i: i for i in cleaned}
    for i in cleaned:
        for j in cleaned:
            a, b = shingles[i], shingles[j]
            if i < j and (len(a & b) / len(a | b) if a or b else 1.0) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    kept = {i: cleaned[i] for i in cleaned if label[i] == i}
    documents(texts, sources=sources).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_by_id(corpus_pipeline.run(spark, str(tmp_path)))
    assert set(got) == set(kept)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    assert all(list(got[i].ids) == sp.encode(t) and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items())
    assert sorted(r.mix_position for r in got.values()) == list(range(len(kept)))


def test_pieces_keep_the_schedule(documents):
    import corpus_pipeline

    docs = documents([f"text {i}" for i in range(300)], sources=["a"] * 240 + ["b"] * 60)
    want = {r.doc_id: r.mix_position for r in mixing.mix(docs).collect()}
    got = corpus_pipeline.pieces(None, docs.repartition(7, "text"), "").collect()
    assert {r.doc_id: r.mix_position for r in got} == want and sorted(want.values()) == list(range(300))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.mix_position)] != list(range(300))
