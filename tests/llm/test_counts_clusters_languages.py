"""Divergence of sources, clusters and languages, against brute force and held-out rows."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import clustering, divergence, language, registry
from codeloom.sources.tables import read_table

SF = "/root/testdata/sf0.01"

# 11. source divergence


def audit_of(rows, min_docs=10, top=10):
    """The same from the definition, one term and one pair at a time."""
    counts, docs_of, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(terms)
        docs_of[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs_of[lang].items() if n >= min_docs)
        names = sorted(s for x, s in groups if x == lang)
        share = lambda count, whole: 1 + 10**9 * (count + 2) // (whole + 2 * len(kept))
        whole = {s: sum(counts[lang, s][t] for t in kept) for s in names}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for s in names:
            p = {t: share(counts[lang, s][t], whole[s]) for t in kept}
            pairs = [(-sum(gap(p[t], share(counts[lang, o][t], whole[o])) for t in kept), o.encode(), o) for o in names if o != s]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            q = {t: share(sum(counts[lang, o][t] for o in names), sum(whole.values())) for t in kept}
            terms = [(-gap(p[t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[t] > q[t]]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def test_audit_of_odd_rows(spark):
    rng = random.Random(1)
    words = ["Éa", "éa", "B", "b", "中文", "x" * 300, "z_z", "q1q", "\x7f", "it's", "𝔘"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "ß", None, "S"])) for _ in range(200)]
    rows += [(None, "fr", "s1"), ("", "fr", "s2"), ("only once", "it", "alone"), (None, None, None)]
    df = spark.createDataFrame([(*r, "x", "x", 1) for r in rows], "text string, lang string, source string, term string, vec string, n int")
    for least, top, piece in ((10, 10, 4096), (1, 2, 2), (10**6, 3, 1)):
        got = sorted(tuple(r) for r in divergence.audit(df, min_docs=least, top=top, piece=piece).collect())
        assert got == audit_of(rows, least, top)
    assert divergence.audit(df.where("false")).count() == 0


def test_audit_counts_long_texts_and_hands_over_in_parts(spark):
    rows = [("word " * 1_200_000 + "end", "en", "a"), ("end other " * 3, "en", "b")] + [("end word", "en", "b")] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    got = {(r.source, r.term): (r.n, r.docs) for r in divergence.count_terms(df, "text", "lang", "source").groupBy("source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()}
    assert got == {("a", "word"): (1_200_000, 1), ("a", "end"): (1, 1), ("b", "end"): (6, 4), ("b", "other"): (3, 1), ("b", "word"): (3, 3)}
    small = divergence.count_terms(df, "text", "lang", "source", entries=1)
    assert small.count() > 5 and small.groupBy().sum("n").first()[0] == 1_200_000 + 13


def test_classes_are_compared_once(spark):
    """Terms with equal counts are one class; many of them neither change sums nor stay in one task."""
    rows = [(" ".join(f"w{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}" for i in range(3000)), "en", s) for s in "ab" for _ in range(10)] + [("extra extra", "en", "a")] * 10
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    vectors = divergence.term_vectors(df)
    classes = divergence.classes_of(vectors, 10).collect()
    assert sorted(r.m for r in classes) == [1, 3000] and max(len(r.terms) for r in classes) == 10
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == audit_of(rows)


@given(st.integers(0, 2**52), st.integers(1, 2**52))
def test_shares_do_not_overflow(count, whole):
    count = min(count, whole)
    assert divergence.share(np.array([count]), whole)[0] == 1 + 10**9 * count // whole


# 12. clusters


def clusters_of(rows, k, rounds, dims=64):
    kept = [(i, [int(np.floor(64 * float(v))) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and np.isfinite(v) for v in x)]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    centroids = [x for _, x in first[:k]]
    distance = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for turn in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda c: (distance(x, centroids[c]), c)) for _, x in kept]
        if turn < rounds:
            for c in range(len(centroids)):
                mine = [x for (_, x), o in zip(kept, own, strict=True) if o == c]
                centroids[c] = [sum(v) // len(mine) for v in zip(*mine, strict=True)] if mine else centroids[c]
    return Counter((i, o, distance(x, centroids[o])) for (i, x), o in zip(kept, own, strict=True)), centroids


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(0)
    vec = lambda: [float(v) for v in rng.integers(-2, 3, 4) / 64]
    rows = [(i if i % 9 else None, vec()) for i in range(300)] + [(7, vec()) for _ in range(40)] + [(8, [0.0, -0.0, 1e-9, -1e-9])] * 30
    rows += [(400, None), (401, [1.0]), (402, [1.0, None, 0.0, 0.0]), (403, [float("nan")] * 4), (404, [float("inf"), 0.0, 0.0, 0.0]), (405, [])]
    df = spark.createDataFrame([(*r, "x", "x", 1.0) for r in rows], "vec_id long, embedding array<double>, id string, x string, upper double")
    for k, rounds in ((16, 3), (5, 6), (1, 2), (16, 0), (2000, 2)):
        found, centroids = clustering.cluster(df, k, rounds, dims=4)
        want, last = clusters_of(rows, k, rounds, 4)
        assert Counter(tuple(r) for r in found.collect()) == want and centroids == last
    found, centroids = clustering.cluster(df.where("false"), dims=4)
    assert found.count() == 0 and centroids == [] and found.columns == ["vec_id", "cluster", "distance"]
    with pytest.raises(Exception, match="2\\^27"):
        clustering.cluster(spark.createDataFrame([(1, [1e300] * 4)], "vec_id long, embedding array<double>"), dims=4)[0].collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 9), st.integers(1, 40))
def test_bounds_give_the_exact_assignment(seed, k, wide):
    """Bounds that persist over many moves, small whole numbers, so that ties are frequent."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-wide, wide + 1, (120, 3))
    centroids = x[rng.permutation(120)[:k]].copy()
    own, least, second = clustering.nearest(x, centroids)
    upper, lower = clustering._bounds(least, second)
    for _ in range(6):
        moved = centroids + rng.integers(-1, 2, centroids.shape)
        drift = np.sqrt(((moved - centroids) ** 2).sum(1).astype(float)) * (1 + clustering.MARGIN)
        centroids = moved
        own, upper, lower, _ = clustering.reassign(x, own, upper, lower, centroids, drift)
        square = ((x[:, None] - centroids) ** 2).sum(2)
        assert (own == square.argmin(1)).all()
        assert (upper**2 >= square[np.arange(120), own]).all()


def test_bounds_save_scans():
    rng = np.random.default_rng(0)
    centre = rng.integers(-500, 500, (16, 64))
    x = np.repeat(centre, 200, 0) + rng.integers(-20, 20, (3200, 64))
    own, least, second = clustering.nearest(x, centre)
    upper, lower = clustering._bounds(least, second)
    moved = centre + rng.integers(-3, 4, centre.shape)
    drift = np.sqrt(((moved - centre) ** 2).sum(1).astype(float))
    assert clustering.reassign(x, own, upper, lower, moved, drift)[3] == 0


# 13. languages


def test_languages_of_held_out_documents(spark):
    docs = {r.doc_id: r for r in read_table(spark, SF, "documents").collect()}
    rows = registry.QUERIES["op13_viterbi_spans"](spark, SF).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 300 and np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.98


WORDS = {
    "en": "the and with of to thing where there another which through would people water little",
    "de": "der und mit von zu dass über nicht auch eine werden haben können straße mädchen",
    "ru": "что это как для все они были может только человек время очень когда другой жизнь",
    "el": "και που για από αυτό είναι στην δεν θα τους μας έχει όλα καλά χρόνια",
    "zh": "我们 今天 中国 可以 没有 时候 什么 知道 现在 一个 他们 人们 这个 大家 工作",
    "ar": "في من على أن إلى هذا كان ذلك بعد حول عند كل وقد بين هذه",
}


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices(words.split(), k=40)), lang) for i in range(30) for lang, words in WORDS.items()] + [(1, None, "en"), (2, "text", None)]
    return language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_spans_of_mixed_texts(spark, model):
    assert set(model.langs) == set(WORDS)
    parts = [("en", "the water would little people"), ("ru", "что это как для все они"), ("de", "straße nicht über werden auch"), ("zh", "我们可以现在工作大家没有时候"), ("ar", "في هذا كان ذلك بعد")]
    text = " 12 -- ".join(t for _, t in parts)
    got = language.label_spans(spark.createDataFrame([(1, text), (2, None), (3, "12 %"), (4, "")], "doc_id long, text string"), model).collect()
    assert [(s.lang, text[s.start : s.end]) for s in got[0].spans] == parts and [r.spans for r in got[1:]] == [[], [], []]


def test_languages_of_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "  12 €—… 🙂 ½ ²"), (4, "И"), (None, "water"), (5, "the water " * 200_000), (6, "wx" * 300_000), (6, "что"), (6, "что"), (7, "ψ"), (8, "हिन्दी भाषा"), (9, "the" + "́")]
    df = spark.createDataFrame([(*r, "x", "x", 1) for r in rows], "doc_id long, text string, lang_pred string, lang string, n_letters int")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(df, model).collect()]
    assert len(got) == 12 and [x[1] for x in got[:6]] == ["und", "und", "und", "ru", "en", "en"] and [x[2] for x in got[:3]] == [0.0] * 3
    assert got[7][1:] == got[8][1:] == ("ru", 1.0) and got[9][1] == "el" and got[10][1] in WORDS and got[6][1] in ("en", "de")
    assert {r.lang_pred for r in language.identify(df, None).collect()} == {"und"}
    assert language.train(df.where("false")) is None and language.identify(df.where("false"), model).count() == 0


def test_samples_are_bounded(spark):
    rows = [(7, "same id " + str(i % 3), "en") for i in range(500)] + [(i, "der und mit " * (1 + 400 * (i % 2)), "de") for i in range(60)] + [(1, "x y", f"l{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, max_docs=10, max_bytes=1000, max_langs=4)
    assert model.langs == ["en", "de", "l0", "l1"]
    assert language.train(df, max_bytes=5).langs == [f"l{i}" for i in range(9)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=6), min_size=1, max_size=5), st.integers(0, 10**6), st.integers(1, 3))
def test_viterbi_against_all_paths(lanes, seed, langs):
    score = np.random.default_rng(seed).integers(-6, 1, (6, langs)).astype(np.float32)
    n = np.array([len(x) for x in lanes])
    words = np.array([w for x in lanes for w in x], np.int64)
    got = language.viterbi(score, words, np.cumsum(n) - n, n, 2.0)
    value = lambda x, path: sum(score[w, p] for w, p in zip(x, path, strict=True)) - 2 * sum(a != b for a, b in itertools.pairwise(path))
    at = 0
    for x in lanes:
        path = got[at : at + len(x)].tolist()
        at += len(x)
        assert value(x, path) == max(value(x, p) for p in itertools.product(range(langs), repeat=len(x)))


def test_pieces_make_up_the_text():
    text = "one two  three\n" * 30
    for size in (5, 64, 1000):
        got = list(language.in_pieces(text, size))
        assert "".join(p for _, p in got) == text and all(text[a : a + len(p)] == p for a, p in got)
        assert sum((language.WORD.findall(p) for _, p in got), []) == text.split()
