import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkwright.llm import collocations as col

from .helpers import docs_frame

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, longest=4, min_count=30, covered=80, top=2000):
    counts, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f = counts.setdefault(lang, Counter())
            for size in range(1, longest + 1):
                f.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        found, longest_held = [], {}
        for q, b in often.items():
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    longest_held[q[i : i + size]] = max(b, longest_held.get(q[i : i + size], 0))
        for p, a in often.items():
            around = longest_held.get(p, 0)
            if around and 100 * around >= covered * a:
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def run(docs, **kw):
    return sorted(tuple(r) for r in col.collocations(docs, **kw).collect())


def corpus(rng, n=3000):
    vocabulary = ["w%d" % i for i in range(5)] + ["É", "naïve", "한", "\U0001f600", "don't", "x y", "Big", "a\x00b"]
    phrases = ["New York city hall", "et al", "ice cream van", "of the", "Of THE people"]
    rows = []
    for i in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.1 else rng.choice(vocabulary) + rng.choice(["", "", "", "", "", "", ",", ".", "!\n", "\t", "\r"])
                 for _ in range(rng.randrange(60))]
        rows.append((i, " ".join(parts), rng.choice(["en", "en", "de", None, ""])))
    return rows


def test_equals_brute_force(spark):
    rows = corpus(random.Random(1))
    want = brute(rows)
    assert len(want) > 80 and {r[0] for r in want} >= {"en", "und"}
    assert run(docs_frame(spark, rows, SCHEMA).repartition(5)) == want
    assert run(docs_frame(spark, rows, SCHEMA), shard_words=50, segment_words=500) == want
    assert run(docs_frame(spark, rows, SCHEMA), top=7, covered=30, longest=3) == brute(rows, 3, 30, 30, 7)


def test_long_text_in_slices(spark, monkeypatch):
    rows = [(1, "very long text of many words " * 4000 + "x" * 50_000, "en"), (2, "very long", None)]
    assert run(docs_frame(spark, rows, SCHEMA), shard_words=700) == brute(rows)
    text = ("Some words, and more of them; " * 40).encode()
    whole = list(col._slices(text))
    monkeypatch.setattr(col, "SLICE", 17)
    parts = list(col._slices(text))
    assert len(whole) == 1 and len(parts) > 30 and b"".join(parts) == whole[0]


@pytest.mark.parametrize("order,width", [(2, 24), (3, 43), (4, 64), (4, 31)])
def test_filters_lose_nothing(order, width):
    rng = np.random.default_rng(order * width)
    grams = np.unique(rng.integers(0, 1 << min(width, 62), (900, order), np.uint64), axis=0)
    counts = rng.integers(1, 400, len(grams)) ** rng.integers(1, 5, len(grams))
    spread = col.permute(grams, width)
    assert (col.restore(spread, width) == grams).all() and len(np.unique(spread, axis=0)) == len(grams)
    spread, sums = col._sorted(spread, counts)
    segment = (spread[:, 0] >> np.uint64(width - 3)).astype(int)
    for s in range(8):
        mine = segment == s
        blob = col.pack_filter(spread[mine], sums[mine], width, 3, 5)
        back, numbers = col.unpack_filter(blob, s, width, 3, 5)
        assert (back == spread[mine]).all() and (numbers == sums[mine]).all()
        assert len(blob) < 12 + mine.sum() * (order * width - 8 + 3) / 8 + 8 + mine.sum() + 8 * (sums[mine] >= 255).sum()
    assert abs(np.bincount(segment, minlength=8) - len(grams) / 8).max() < 60  # evenly dealt


@pytest.mark.parametrize("order,n_words", [(2, 30), (3, 30), (4, 30), (3, 1 << 21), (4, 1 << 20), (2, 1)])
def test_grams_equal_a_counter(order, n_words):
    rng = np.random.default_rng(order)
    codes = rng.choice([-1, 0, n_words - 1, n_words // 2, n_words // 3], 5000)
    want = Counter(tuple(codes[i : i + order].tolist()) for i in range(len(codes) - order + 1))
    rows, counts = col.count_grams(codes, order, n_words)
    assert dict(zip(map(tuple, rows.tolist()), counts.tolist())) == {g: n for g, n in want.items() if min(g) >= 0}
    assert len(col.count_grams(codes[: order - 1], order, n_words)[0]) == 0


def test_ties_of_the_first_word_are_told_apart():
    spread = np.array([[5, 2], [5, 1], [5, 2], [4, 9]], np.uint64)
    rows, counts = col._sorted(spread, np.array([1, 2, 3, 4]))
    assert rows.tolist() == [[4, 9], [5, 1], [5, 2]] and counts.tolist() == [4, 2, 4]


def test_runs_of_one_first_word_are_dealt_evenly():
    grams = np.stack([np.full(4000, 77, np.uint64), np.arange(4000, dtype=np.uint64)], axis=1)
    top = (col.permute(grams, 40)[:, 0] >> np.uint64(37)).astype(int)
    assert np.bincount(top, minlength=8).max() < 650


def test_ids_stay_apart(spark):
    words = spark.range(3000).selectExpr("'en' AS lang", "cast(id AS string) AS word")
    seed, width = col._injective(words, 10, 1)  # too few bits at first
    assert seed == 0 and 20 < width <= 64
    ids = words.select(col.F.shiftrightunsigned(col._word_hash(seed), 64 - width).alias("i"))
    assert ids.distinct().count() == 3000


def test_counts_beyond_64_bits_in_products(spark, monkeypatch):
    big = 10**13
    single = spark.createDataFrame([("en", "x", b"%08d" % 1, big), ("en", "y", b"%08d" % 2, big + 1)], "lang string, word string, key binary, a long")
    phrases = spark.createDataFrame([("en", b"%08d%08d" % (1, 2), big - 1)], "lang string, key binary, a long")
    totals = spark.createDataFrame([("en", 5 * big)], "lang string, n long")
    monkeypatch.setattr(col, "frequent_phrases", lambda *a: (single, phrases, totals))
    assert run(docs_frame(spark, [(1, "x", "en")], SCHEMA)) == [
        ("en", 1, "x y", big - 1, big, big + 1, 5 * big, 2000000 * (big - 1) // (2 * big + 1))]


def test_edge_rows(spark):
    rows = [(None, None, None), (1, "", "en"), (2, " \t.,;:!?\n\x0b\x0c\r", "en")]
    rows += [(3, "Repeated row, again", None)] * 30 + [(4, "a b", "fr")] * 29 + [(5, "tie one. tie two", "de")] * 30
    names = "key a l r n score rank phrase word h segment filter cut k w".split()
    docs = docs_frame(spark, rows, SCHEMA).selectExpr("*", *(f"1 AS {c}" for c in names))
    assert run(docs) == brute(rows)
    assert run(docs.limit(0)) == []
    assert run(docs.where("doc_id = 2")) == []
