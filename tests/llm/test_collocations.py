"""Counting quotient filters by round trip; phrases against a plain count and, on the tables, against the SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from isotherm.llm import collocations as co

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top, longest=5):
    """[(lang, rank, phrase, a, l, r, n, score)]; rows: [(lang, text)]."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, w[i:i + k]] += 1
    often = {g: c for g, c in f.items() if c >= least}
    out = {}
    for (lang, w), a in often.items():
        if len(w) < 2 or any(x == lang and len(v) > len(w) and b >= a and any(v[i:i + len(w)] == w for i in range(len(v)))
                             for (x, v), b in often.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (often[lang, w[:k]] * often[lang, w[k:]]), k, often[lang, w[:k]], often[lang, w[k:]])
                             for k in range(1, len(w)))
        out.setdefault(lang, []).append((score, a, " ".join(w), l, r))
    return sorted((lang, i + 1, p, a, l, r, n[lang], s) for lang, found in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(found, key=lambda x: (-x[0], -x[1], x[2].encode()))[:top]))


@pytest.mark.parametrize("k,bits", [(2, 1), (2, 17), (3, 20), (4, 16), (5, 12), (5, 17), (5, 25), (5, 31), (2, 31)])
def test_packing_and_filters_lose_nothing(k, bits):
    rng = np.random.default_rng(k * bits)
    grams = rng.integers(0, min(2**bits, 50), (3000, k), dtype=np.int64)
    grams[:50] = rng.integers(0, 2**bits, (50, k))
    p = co.Packing(k, bits)
    assert (p.grams(p.keys(grams)) == grams).all() and all(w <= 64 for w in p.widths)
    counts = rng.choice([1, 2, 254, 255, 256, 10**12], 3000)
    whole = co.CountingQuotientFilter.of(p.keys(grams), counts, p.widths)
    want = Counter()
    for g, c in zip(grams.tolist(), counts.tolist()):
        want[tuple(g)] += c
    got = dict(zip(map(tuple, p.grams(whole.lanes).tolist()), whole.counts.tolist()))
    assert got == dict(want) and len(whole) == len(want)
    range_bits = min(p.widths[0], 5)
    back = [co.CountingQuotientFilter.from_bytes(part.to_bytes(range_bits), p.widths, range_bits, r) for r, part in whole.parts(range_bits)]
    for i, lane in enumerate(whole.lanes):
        assert (np.concatenate([b.lanes[i] for b in back]) == lane).all()
    assert (np.concatenate([b.counts for b in back]) == whole.counts).all()
    twice = co.CountingQuotientFilter.merged([whole, whole])
    assert (twice.counts == 2 * whole.counts).all() and len(twice) == len(whole)
    # one or two bytes of quotient and counter beside the remainder
    if bits == 17 and k == 5:
        assert len(whole.to_bytes()) < len(whole) * (6 + 6 + 4) + 8 * int((whole.counts >= 255).sum()) + 64


def test_filter_of_one_quotient():
    lanes = [np.arange(1000, dtype=np.uint64)]      # all in the first quotient
    f = co.CountingQuotientFilter.of(lanes, np.ones(1000, dtype=np.int64), [60])
    g = co.CountingQuotientFilter.from_bytes(f.to_bytes(), [60])
    assert (g.lanes[0] == lanes[0]).all() and (g.counts == 1).all()


def test_phrases_against_plain_counts(spark, monkeypatch):
    rng = random.Random(4)
    words = ["a", "B", "c", "dé", "É", "f'", "g-h", "ß", "x" * 300]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\v", "!"])
                                                              for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    rows += [("en", "one two three four five six. " * 40), ("en", None), (None, ""), ("fr", "rare words"), ("fr", " ,. \n")] + [("de", "same text here")] * 30
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, word string, f int")
    for shard, least, top in ((100, 12, 1000), (10**6, 12, 20), (10**6, 100, 5)):
        monkeypatch.setattr(co, "SHARD", shard)
        got = sorted(tuple(r) for r in co.collocations(docs, min_count=least, top=top).collect())
        assert got == plain(rows, least, top)
    # products beyond 64 bits
    none = co.collocations(docs, min_count=10**6)
    assert none.count() == 0 and none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert co.collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 10**15
    grams = spark.createDataFrame([([1], big), ([2], big), ([1, 2], big // 3)], "ids array<int>, f bigint")
    words = spark.createDataFrame([("en", "a", big, 1), ("en", "b", big, 2)], "lang string, word string, f bigint, id int")
    totals = spark.createDataFrame([("en", 10**17)], "lang string, n bigint")
    r = co.scored(grams, words, totals).collect()[0]
    assert r.score == 1000 * (big // 3) * 10**17 // (big * big)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(tuple(r) for r in co.op13_collocations(spark, sf).collect()) == sorted(con.execute(co.SQL).fetchall())
