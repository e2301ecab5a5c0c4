"""Periodic runs against a search of every diagonal."""

import hashlib
import random
from zlib import crc32

import pytest

from isotherm.llm import periods

SF = "/root/testdata/sf0.001"


def every_run(w):
    """Every lag, every stretch of equal words, smallest periods only."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            m = i + q - s
            if m >= max(6, 4 * q) and not any(w[s:s + m - p] == w[s + p:s + m] for p in range(1, q)):
                out.append((s, m, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(3000):
        n, letters = rng.randint(0, 120), rng.choice([1, 2, 2, 3, 6])
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 4:
                a = rng.randrange(n)
                p, e = rng.randint(1, max(1, (n - a) // 4)), rng.randint(a, n)
                for x in range(a + p, e):
                    w[x] = w[x - p]
        assert periods.find_runs(w) == every_run(w)


def test_bands_cover_every_period():
    for n in (5, 6, 7, 8, 40, 1000):
        covered = [q for k, a, b in periods.bands(n) for q in range(a, b + 1)]
        assert covered == list(range(1, len(covered) + 1)) and len(covered) >= sum(max(6, 4 * q) <= n for q in range(1, n + 1))
        assert all(max(6 - q, 3 * q) >= k >= 2 * q for k, a, b in periods.bands(n) for q in range(a, b + 1))


@pytest.mark.parametrize("text,runs,kept", [
    ("a a a a a", [], "a a a a a"),
    ("x a a a a a a y", [(1, 6, 1)], "x a y"),
    ("a b a b a b a b", [(0, 8, 2)], "a b"),
    ("a b a b a b a", [], "a b a b a b a"),
    ("a b c a b c a b c a b c a d", [(0, 13, 3)], "a b c d"),
])
def test_small_texts(text, runs, kept):
    words = periods.split(text)
    assert periods.find_runs(words) == runs
    assert b" ".join(periods.kept_words(words, runs)).decode() == kept


def test_one_word_or_one_line_fills_a_long_text():
    assert periods.find_runs([b"a"] * 300_000) == [(0, 300_000, 1)]
    line = [b"%d" % i for i in range(70)]
    assert periods.find_runs(line * 3000) == [(0, 210_000, 70)]
    # a line between random ones: no run, however often it comes
    rng = random.Random(1)
    w = [x for _ in range(3000) for x in (*line, rng.random())]
    assert periods.find_runs(w) == []


def test_longest_takes_smallest_start_then_period():
    assert periods.longest([(0, 8, 2), (4, 9, 1), (2, 9, 2), (2, 9, 1)]) == (2, 9, 1)
    assert periods.longest([]) is None


def expected(key, text):
    w = (text or "").encode().split()
    h, n = crc32(str(key).encode()), len(w)
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = every_run(w)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    s, m, q = top[0] if top else (None, None, None)
    return (key, len(runs), s, m, q, 1000 * m // q if top else None,
            hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest())


def test_query_against_every_diagonal(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in periods.op11_periodic_runs(spark, SF).collect()}
    small = [d for d in docs if len((d.text or "").split()) < 400]
    assert len(got) == len(docs) and len(small) > 50 and sum(got[d.doc_id][1] > 0 for d in small) > 3
    for d in small:
        assert got[d.doc_id] == expected(d.doc_id, d.text)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a a a a a a", "x"), (4, " \t\n", "x"), (5, "one", "x"), (5, "one", "x"), (5, "other", None),
            (6, "w" * 500_000, "x"), (7, "é " * 50, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periods.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(k, t) for k, t, _ in rows), key=str)
    short = periods.collapse_runs(docs)
    assert short.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text), str(r.n_runs)) for r in short.collect()) == sorted(
        (str(k), str({None: None, 7: "é"}.get(k, t) if k != None else "a"), str(x)) for k, t, x in rows)  # noqa: E711
    spans = {tuple(r) for r in periods.run_spans(docs).collect()}
    assert spans == {(None, 0, 6, 1), (7, 0, 50, 1)}
    assert periods.periodic_runs(docs.limit(0)).count() == 0 and periods.collapse_runs(docs.limit(0)).count() == 0
