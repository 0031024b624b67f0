"""Substring dedup, Jaccard join, decontamination and quality rules against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evtrail.llm import decontaminate, jaccard, quality, rolling, substring


def test_rolling_hash_depends_on_the_words_alone():
    words = [b"a", b"b", b"c", b"a", b"b", b"c", b"d"]
    h = rolling.windows(rolling.word_hashes(words), 3)
    assert len(h) == 5 and h[0] == h[3] and len(set(h.tolist())) == 4
    assert len(rolling.windows(rolling.word_hashes(words[:2]), 3)) == 0
    x = np.array([5, 3, 9, 1, 7, 2], np.uint64)
    for w in range(1, 7):
        assert rolling.window_minima(x, w).tolist() == [min(x[i : i + w]) for i in range(7 - w)]


def brute_substring(texts, window=50):
    words = {i: (t or "").encode().split() for i, t in texts}
    first: dict = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(docs, texts):
    got = substring.substring_dedup(docs).collect()
    want = brute_substring(list(enumerate(texts)))
    assert len(got) == len(texts) + 1
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert any(0 < r.n_removed < r.n_words for r in got)
    for r in got:
        assert sum(s.end - s.start for s in r.intervals) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.intervals, r.intervals[1:], strict=False))


def test_substring_dedup_without_ids_and_without_rows(spark, docs, empty):
    rows = docs.where("length(text) > 500").withColumn("doc_id", F.lit(None).cast("long"))
    assert all(r.n_removed == 0 for r in substring.substring_dedup(rows).collect())
    assert substring.substring_dedup(empty).count() == 0


def brute_components(texts, size=4, percent=85):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    ra, rb = root(a), root(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def brute_links(texts, size=4, percent=85):
    """How many other rows each row links with."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    alike = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    return [sum(1 for j, b in enumerate(sets) if i != j and alike(a, b)) for i, a in enumerate(sets)]


@pytest.mark.parametrize(("few", "part_rows", "part_tokens"), [(32, 256, 1 << 21), (2, 4, 1 << 21), (2, 256, 600)])
def test_jaccard_components(docs, texts, few, part_rows, part_tokens):
    got = jaccard.jaccard_components(docs, few=few, part_rows=part_rows, part_tokens=part_tokens).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(list(enumerate(texts)))
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter(zip([*range(len(texts)), 8], brute_links([*texts, texts[8]]), strict=True))


def test_jaccard_counts_every_link_of_a_chain(spark):
    words = [f"w{i}" for i in range(130)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 30, 2)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for part_rows in (3, 100):
        got = jaccard.jaccard_components(docs, few=2, part_rows=part_rows).collect()
        assert {r.doc_id: r.n_links for r in got} == dict(enumerate(brute_links(texts))) and {r.component_id for r in got} == {0}


def test_jaccard_borders(spark):
    """Sets just at and just below the threshold, in a chain, over many sizes."""
    r, texts = random.Random(5), []
    for n in [1, 2, 3, 4, 5, 7, 9, 10, 12, 17, 23, 40, 43, 44, 80, 131, 200]:
        words = [f"w{r.randint(0, 10**6)}" for _ in range(n)]
        texts.append(" ".join(words))
        for drop in {1, max(1, n * 7 // 100), max(1, n * 15 // 100), max(1, n * 16 // 100)}:
            texts.append(" ".join(words[drop:]))
            texts.append(" ".join(words + [f"x{k}" for k in range(drop)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, few=3, part_rows=3).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_jaccard_without_rows_and_ids(spark, empty):
    assert jaccard.jaccard_components(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (None, "z y x w"), (None, None)], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), (r.component_id or 0)) for r in jaccard.jaccard_components(docs).collect()) == [(0, 0), (0, 0), (0, 7), (7, 7)]


@pytest.mark.parametrize(("heap", "probe"), [(0, 0), (0, 10**9), (10**9, 0), (10**9, 10**9)])
def test_merges_and_look_ups_agree(monkeypatch, heap, probe):
    r = np.random.default_rng(1)
    base = np.sort(r.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[r.random(200) > 0.1], r.integers(0, 2**63, 10).astype(np.uint64)])) for _ in range(30)]
    monkeypatch.setattr(jaccard, "_HEAP", heap)
    monkeypatch.setattr(jaccard, "_PROBE", probe)
    alike = lambda a, b: 100 * (n := len(np.intersect1d(a, b))) >= 70 * (len(a) + len(b) - n)
    weights = np.arange(1, 31)
    want = [sum(int(weights[j]) for j in range(30) if i != j and alike(sets[i], sets[j])) for i in range(30)]
    assert jaccard.links_of(sets, None, 70, weights)[1].tolist() == want
    forest, degree = jaccard.links_of(sets[:12], sets[12:], 70, weights)
    assert degree.tolist() == [sum(int(weights[j]) for j in range(30) if (i < 12) != (j < 12) and alike(sets[i], sets[j])) for i in range(30)]
    assert all(alike(sets[i], sets[j]) for i, j in forest) and len(forest) <= 29


def brute_decontaminate(texts, items, window=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    owners = defaultdict(set)
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            owners[tuple(w[i : i + window])].add(str(item))
    out = {}
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in owners}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in owners:
                    hit.update(range(k, k + n))
                    found |= owners[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("nodes", [2_000_000, 200])
def test_decontaminate(spark, docs, texts, empty, nodes):
    long = texts[-2].split()
    items = [(1, " ".join(long[100:140])), (2, "ONE, two... three!"), (3, None), (4, ""), (5, " ".join(long[105:118]).upper()), (6, "??"), (None, "one")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, hit string")
    got = decontaminate.decontaminate(docs, bench, max_nodes=nodes, carry=("source", "id")).collect()
    want = brute_decontaminate(list(enumerate(texts)), [x for x in items if x[0] is not None])
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
    assert len(got) == len(texts) + 1 and all(r.rest.id == "y" for r in got)
    span = next(r for r in got if r.doc_id == 4).spans
    assert [texts[4][s.start : s.end] for s in span] == ["one two three"]
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_decontaminate_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, "x " + " ".join(f"w{i}" for i in range(5000, 5010)) + " y")], "doc_id long, text string")
    got = decontaminate.decontaminate(docs, spark.createDataFrame([(1, long)], "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit) for r in got} == {1: (200_000, 200_000), 2: (12, 10)}


def brute_quality(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    twice = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(twice) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), len(lines) - len(set(lines)), len(twice), failed


def test_quality_base_rules(spark, docs, texts):
    more = ["a # b\na # b\n\n \n<c> | d", "x y z w v u t s r " * 9, "é b\x1cc " * 30]
    every = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = quality.quality_rules(every, docs.where("doc_id < 30")).collect()
    want = {i: brute_quality(t) for i, t in [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(more))]}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == want
    assert all(not (r.kept and r.base_failed) for r in got)


def test_quality_scores(spark):
    """Text like the trusted rows scores above text unlike them; without trusted rows nothing is judged."""
    good = [(i, "the cat sat on the mat and saw the dog run to the tree near the old house by the sea " * 2) for i in range(20)]
    bad = [(100 + i, " ".join(f"%{k}{i}%" for k in range(40))) for i in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    got = {r.doc_id: r.score for r in quality.quality_rules(docs, trusted).collect()}
    assert min(got[i] for i, _ in good) > max(got[i] for i, _ in bad)
    none = quality.quality_rules(docs, trusted.limit(0)).collect()
    assert all(r.score == 0 for r in none)


def brute_ratio_scores(rows, trusted, buckets):
    """Scores by plain Python, with the hashes that the operator's functions are defined by."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    one = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    raw = lambda x: struct.pack("<q", x)

    def grams(t):
        h = [one(x) for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        return [x % buckets for x in h] + [signed(xxhash.xxh64_intdigest(raw(b), xxhash.xxh64_intdigest(raw(a), 42))) % buckets for a, b in zip(h, h[1:], strict=False)]

    every, good = Counter(), Counter()
    for i, t in rows:
        every.update(grams(t))
        if i in trusted:
            good.update(grams(t))
    ratio = lambda b: math.log((good[b] + 1) / (sum(good.values()) + buckets)) - math.log((every[b] + 1) / (sum(every.values()) + buckets))
    return [sum(map(ratio, grams(t))) / max(1, len(grams(t))) if good else 0.0 for _, t in rows]


def in_ratios(i):
    """Whether a trusted row is not left out for the threshold."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
    return (h - (1 << 64) if h >> 63 else h) % 5 != 0


@pytest.mark.parametrize("max_broadcast", [0, 1000])
def test_quality_scores_against_plain_python(docs, texts, max_broadcast):
    rows = [*enumerate(texts), (8, texts[8])]
    want = brute_ratio_scores(rows, {i for i in range(30) if in_ratios(i)}, 512)
    got = quality.quality_rules(docs, docs.where("doc_id < 30"), buckets=512, threshold=0.01, max_broadcast=max_broadcast).collect()
    assert len(got) == len(rows)
    for r in got:
        score = want[r.doc_id]
        assert abs(r.score - score) < 1e-3 and (abs(score - 0.01) < 1e-3 or r.kept == (not r.base_failed and score >= 0.01))


def test_quality_threshold_from_left_out_rows(spark):
    r = random.Random(3)
    good = [(i, " ".join(r.choice("the cat sat on a mat and saw that dog run".split()) for _ in range(60))) for i in range(400)]
    bad = [(1000 + i, " ".join(f"x{r.randrange(50)}" for _ in range(60))) for i in range(100)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    got = {x.doc_id: x for x in quality.quality_rules(docs, spark.createDataFrame([(i,) for i in range(200)], "doc_id long")).collect()}
    apart = sorted(got[i].score for i in range(200) if not in_ratios(i) and not got[i].base_failed)
    edge = math.floor(apart[int(0.01 * len(apart))] * 10_000) / 10_000
    assert len(apart) > 20 and all(x.kept == (not x.base_failed and x.score >= edge) for x in got.values())
    assert not any(got[i].kept for i, _ in bad) and sum(got[i].kept for i, _ in good) > 350
    scored = spark.createDataFrame([(0.5, False), (0.1, False), (-9.0, True)], "score double, base_failed boolean")
    assert quality.fit_threshold(scored) == 0.1 and quality.fit_threshold(scored, 0.5) == 0.5 and quality.fit_threshold(scored.limit(0)) == 0.0


def test_quality_null_ids_and_long_texts(spark):
    rows = [(None, "a b"), (None, None), (5, "word " * 250_000), (6, " ".join(f"w{i}" for i in range(250_000)))]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5,), (None,)], "doc_id long")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_repeat_words) for r in got) == [(0, 0, 0), (0, 2, 0), (5, 250_000, 250_000), (6, 250_000, 0)]


def test_quality_without_rows(empty):
    assert quality.quality_rules(empty, empty).count() == 0
