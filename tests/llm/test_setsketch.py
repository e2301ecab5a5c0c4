"""SetSketch near duplicates against a comparison of all pairs."""

import random

import numpy as np
import pytest

from isotherm.llm import setsketch as ss

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = (text or "").translate(LOW).encode().split()
    return {tuple(w[i:i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def all_pairs(rows):
    """[(id, n, component)] in the order of rows, by comparing every pair; rows: [(id, text)]."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min((x for x in low[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def answers(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 2**63, 700, dtype=np.uint64)) for _ in range(2))
    assert (ss.merge(ss.registers(a), ss.registers(b)) == ss.registers(np.union1d(a, b))).all()
    for j in (0.1, 0.5, 0.8, 0.95):
        found = []
        for _ in range(40):
            x = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
            k = round(2000 * j / (1 + j) / 1)       # common items of two sets of 1,000 with similarity j
            y = np.concatenate([x[:min(k, len(x))], rng.integers(0, 2**63, len(x) - min(k, len(x)), dtype=np.uint64)])
            r, s = ss.registers(x), ss.registers(np.unique(y))
            more, less = (r > s).sum(), (r < s).sum()
            est, may = ss.estimate(*(np.array([float(v)]) for v in (more, less, ss.REGISTERS - more - less, len(x), len(x))))
            found.append(est[0])
            assert may[0] or j < 0.8
        assert abs(np.mean(found) - j) < 0.02, (j, np.mean(found))
    far = ss.estimate(*(np.array([v]) for v in (100.0, 100.0, 52.0, 500.0, 500.0)))
    assert not far[1][0]


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = ss.op12_setsketch_near_dedup(spark, SF)
    assert answers(got) == sorted(all_pairs(rows), key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def chain(rng, n, m):
    """m texts, each a few words from the one before: neighbours are near, the ends are not."""
    words = [f"w{rng.random()}" for _ in range(n)]
    out = [" ".join(words)]
    for _ in range(m - 1):
        for _ in range(4):
            words[rng.randrange(n)] = f"w{rng.random()}"
        out.append(" ".join(words))
    return out


def group(rng, n, m, share):
    """m texts that keep a share of the words of a common one: near to it, less near to each other."""
    base = [f"w{rng.random()}" for _ in range(n)]
    out = [" ".join(base)]
    for _ in range(m - 1):
        own = list(base)
        for i in rng.sample(range(n), round(n * share)):
            own[i] = f"w{rng.random()}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_groups_without_a_common_hub(spark, monkeypatch, block):
    monkeypatch.setattr(ss, "BLOCK", block)
    rng = random.Random(8)
    texts = chain(rng, 120, 40) + group(rng, 200, 50, 0.045) + group(rng, 150, 30, 0.1) + group(rng, 80, 20, 0.3)
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(order[i], t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answers(ss.near_components(docs)) == sorted(all_pairs(rows), key=str)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (None, "one two three four"), (None, None), (3, "One TWO three four"), (4, " \t\n"), (5, "word"), (6, "Word"),
            (7, long), (8, long + " end"), (9, "a b c d e f g h i j k l"), (9, "other words of the same id"), (9, "a b c d e f g h i j k l"),
            (10, "Other words of the same id"), (11, "É è"), (12, "é è"), (None, "only null"), (None, "only null")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, node string, n string")
    assert answers(ss.near_components(docs)) == sorted(all_pairs(rows), key=str)
    empty = ss.near_components(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_exact_at_the_threshold():
    a = np.arange(1000, dtype=np.uint64)
    assert ss.linked(a, a[:800]) and not ss.linked(a, a[:799]) and ss.fits(1000, 800) and not ss.fits(1000, 799)
