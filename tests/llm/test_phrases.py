"""Operator 13 against brute force: counts, scores, containment, a filter of any size, long texts, nulls, ties and empty tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from twinframe.llm import phrases

SCHEMA = "doc_id long, lang string, text string"


def counts(rows, min_count):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    return {p: c for p, c in f.items() if c >= min_count}, +n


def brute(rows, min_count, top=phrases.TOP):
    f, n = counts(rows, min_count)
    out = []
    for lang in n:
        own = {p: c for (g, p), c in f.items() if g == lang}
        found = []
        for p, a in own.items():
            if len(p) < 2:
                continue
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * c >= 80 * a for q, c in own.items()):
                continue
            score, _, left, right = min((2000000 * a // (own[p[:j]] + own[p[j:]]), j, own[p[:j]], own[p[j:]]) for j in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mine(df, min_count, top=phrases.TOP, **kw):
    found = phrases.frequent_phrases(df, min_count, **kw)
    return sorted(map(tuple, phrases.collocations(found, min_count, top).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["The", "cat", "sat", "on", "mat", "é", "Éa", "x", "y2", "-", "w" * 300]
    rows = [(i, rng.choice(["en", "fr", "en", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    return rows + [(200 + i, "en", "in the middle of nowhere") for i in range(9)] + [(300, "en", None), (301, None, ""), (None, "en", "the cat " * 30), (None, None, " . ! ")]


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA + ", phrase string, n int").repartition(3)
    got = mine(df, 6)
    assert got == brute(rows, 6) and len(got) > 30
    assert not any(x[2] == "in the middle" for x in got)  # held by a longer one
    assert mine(df, 6, top=5) == brute(rows, 6, 5)


@pytest.mark.parametrize(("shards", "filter_bits"), [(1, 20), (3, 6), (5, 9)])
def test_counts_are_whole_for_any_filter_and_number_of_shards(spark, rows, shards, filter_bits):
    """A filter of 64 bits lets nearly every phrase be counted, and changes no count."""
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.lang, r.phrase): r.n for r in phrases.frequent_phrases(df, 6, shards, filter_bits).where("k > 0").collect() if r.n >= 6}
    assert got == {(g, " ".join(p)): c for (g, p), c in counts(rows, 6)[0].items()}


def test_late_phrases_get_a_full_cycle(spark):
    """A phrase whose words reach the threshold in the last shard only is counted in a second cycle."""
    rows = [(i, "en", "rare pair of words") for i in range(8)]
    got = {r.phrase: r.n for r in phrases.frequent_phrases(spark.createDataFrame(rows, SCHEMA), 8, 4).where("k > 1").collect()}
    assert got == dict.fromkeys(["rare pair", "pair of", "of words", "rare pair of", "pair of words", "rare pair of words"], 8)


def test_long_texts_in_stretches(monkeypatch, spark):
    rng = random.Random(2)
    text = "".join(rng.choice(["aa", "b", "cc d", "e" * 40]) + rng.choice([" ", "  ", ".", " "]) for _ in range(3000)) + " z" * 3000
    monkeypatch.setattr(phrases, "BLOCK", 500)
    buf = np.frombuffer(text.encode(), np.uint8)
    parts = list(phrases.stretches(buf, np.array([0, len(buf)]), 500))
    assert b"".join(b[:limit].tobytes() for b, _, limit in parts) == text.encode() and len(parts) > 10
    found = Counter()
    big = dict.fromkeys((1, 2, 3), phrases.Bitmap(np.full(1, 2**64 - 1, np.uint64)))
    for b, offsets, limit in parts:
        out, _, plain, begin, end = phrases.occurrences(b, offsets, limit, np.zeros(1, np.uint64), big, {}, (1, 2, 3, 4))
        for k, at, n in out:
            for a, c in zip(at, n, strict=True):
                found[plain[begin[a] : end[a + k - 1]].tobytes().decode()] += int(c)
    assert found == {" ".join(p): c for (_, p), c in counts([(0, "", text)], 1)[0].items()}


def test_exact_arithmetic_beyond_64_bits(spark):
    big = 4 * 10**18
    rows = [("en", 1, "a", big + 1), ("en", 1, "b", big), ("en", 2, "a b", big), ("en", 0, "", big)]
    (r,) = phrases.collocations(spark.createDataFrame(rows, "lang string, k int, phrase string, n long")).collect()
    assert (r.score, r.a, r.l, r.r) == (2000000 * big // (2 * big + 1), big, big + 1, big)


def test_empty(spark):
    assert mine(spark.createDataFrame([], SCHEMA), 2) == []
    assert mine(spark.createDataFrame([(1, "en", None), (2, None, " ;, ")], SCHEMA), 1) == []
