"""Operators on documents: against brute force, and the odd cases their docstrings define."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isotherm.llm import decontaminate, langid, lines, mixing, neardup, pii, quality, secrets
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "en", "a"), (2, "", None, None), (None, "some text of a row without any id", "de", "b"),
       (3, "one two three four five six\nOne  two three four fivE six", "en", "a"),
       (3, "one two three four five six\nOne  two three four fivE six", "en", "a"), (4, " \n\t ", "en", "a"),
       (5, "word " * 30_000, "en", "a"), (6, "x" * 100_000, "fr", "b"), (7, "ß é 漢字 👍   end", "de", "b")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    # names that operators use inside
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS doc", "2 AS n", "3 AS key", "4 AS h1", "5 AS stats", "6 AS rest", "7 AS u")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def with_copies(spark, docs, n=40):
    rng, out = random.Random(5), rows(docs)
    for i in range(n):
        _, t = rng.choice(out)
        p, kind = rng.randrange(max(1, len(t))), rng.choice("ids")
        out.append((100_000 + i, t[:p] + ("x" if kind != "d" else "") + t[p + (kind != "i"):]))
    return out, spark.createDataFrame(out, "doc_id long, text string").repartition(5)


# ---- near duplicates -----------------------------------------------------------------------------


def test_jaccard_join_finds_all_links(spark, docs):
    data, df = with_copies(spark, docs)
    assert {r.doc_id: (r.class_id, r.n_links) for r in neardup.join_links(df).collect()} == brute.near_classes(data)


def test_jaccard_join_in_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    data = [(i, " ".join(base[:20 + i % 3] + [f"v{i}"] + base[20 + i % 3:])) for i in range(45)]
    monkeypatch.setattr(neardup, "BLOCK", 10)
    df = spark.createDataFrame(data + data[:3], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.join_links(df).collect()}
    assert got == brute.near_classes(data)


def test_jaccard_join_odd(spark, odd, none):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in neardup.join_links(odd).collect()), key=repr)
    assert len(got) == len(ODD) and (None, None, 0) in got and (1, 1, 0) in got and got.count((3, 3, 0)) == 2
    assert neardup.join_links(none).count() == 0
    assert sorted(neardup.stage(spark, odd, SF).columns) == sorted(odd.columns)


def test_jaccard_join_rows_that_share_an_id(spark):
    """Of two texts under one id each has its own links; in the pipeline the near copy goes and the other text stays."""
    a = " ".join(f"w{i}" for i in range(300))
    b = " ".join(f"v{i}" for i in range(300))
    data = [(1, a), (5, a + " more"), (5, b), (5, b), (7, b + " more"), (9, "c d e f g h"), (9, "c, d, e f g h")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in neardup.join_links(df).collect())
    assert got == [(1, 1, 1), (5, 1, 1), (5, 5, 1), (5, 5, 1), (7, 5, 1), (9, 9, 0), (9, 9, 0)]
    kept = Counter((r.doc_id, r.text) for r in neardup.stage(spark, df, SF).collect())
    assert kept.pop((9, "c d e f g h"), 0) + kept.pop((9, "c, d, e f g h"), 0) == 1
    assert kept == {(1, a): 1, (5, b): 2}


def test_bayes_bounds():
    least = neardup.least_matches()
    # all equal always stays, a pair at the threshold almost surely
    assert all(0 < m < 0.8 * neardup.STEP * k for k, m in enumerate(least, 1)) and least == sorted(least)


# ---- lines -----------------------------------------------------------------------------------------


def test_lines_against_brute_force(spark, docs):
    data, df = with_copies(spark, docs)
    assert {r.doc: set(r.gone) for r in lines.removed_lines(df).collect()} == brute.kept_lines(data)


def test_lines_rows_that_share_an_id(spark):
    line = "a repeated line of the table"
    data = [(1, line), (5, f"{line}\nown words A"), (5, "a unique line that nobody has\nquite another end"), (5, f"x\n{line}\ny"),
            (8, "first said here under eight\nz"), (8, "q\nfirst said here under eight"), (8, "q\nfirst said here under eight")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in lines.drop_lines(df, min_words=1).collect())
    # under one id the smaller line number is earlier; repeated rows are one document
    assert got == {(1, line): 1, (5, "own words A"): 1, (5, data[2][1]): 1, (5, "x\ny"): 1, (8, data[4][1]): 1, (8, "q"): 2}


def test_lines_of_any_length_within_one_edit(spark):
    """near_chars 0 against comparing all pairs."""
    rng = random.Random(4)
    data = [(i, "\n".join("".join(rng.choice("ab ") for _ in range(rng.randint(0, 11))) for _ in range(3))) for i in range(60)]
    seen, gone = [], {}
    for d, t in data:
        for no, line in enumerate(lines.normal(x) for x in t.split("\n")):
            if line:
                if any(lines.within_one(p, line) for p in seen):
                    gone.setdefault(d, set()).add(no)
                seen.append(line)
    got = lines.removed_lines(spark.createDataFrame(data, "doc_id long, text string"), min_words=1, near_chars=0).collect()
    assert {r.doc: set(r.gone) for r in got} == gone


def test_lines_one_edit(spark):
    line = "the quick brown fox jumps over it"
    data = [(1, line), (2, line.replace("quick", "quack")), (3, line.replace("quick", "quik")), (4, line + "s"), (5, "x" + line),
            (6, line.replace("quick", "qack")), (7, "a b c\na b c"), (8, f"{line}\nnew words on a line\n{line.upper()}")]
    got = {r.doc_id: r.text for r in lines.drop_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    # 6 is one edit from 2, which itself goes
    assert [got[i] for i in range(1, 9)] == [line, "", "", "", "", "", "a b c\na b c", "new words on a line"]


def test_lines_of_few_words(spark):
    """Without a minimum: short lines by equality, lines of a script without spaces within one edit too, list marks stay."""
    passage = "这是一个没有空格的重复段落测试"
    data = [(1, f"All rights reserved.\n{passage}\n1.\n\na b c"), (2, f"all  rights reserved.\n{passage}\n2.\n\na b d"),
            (3, f"own\n{passage[:-1]}\n1.\n\nA B C")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc: set(r.gone) for r in lines.removed_lines(df, min_words=1).collect()} == {2: {0, 1}, 3: {1, 2, 4}}
    want = {1: data[0][1], 2: "2.\n\na b d", 3: "own\n"}
    assert {r.doc_id: r.text for r in lines.drop_lines(df, min_words=1).collect()} == want
    made = dict(corpus_pipeline.STAGES)["line_dedup"](spark, df, SF)
    assert {r.doc_id: r.text for r in made.collect()} == want


def test_lines_of_the_tables_without_minimum(spark):
    """Against comparing all pairs of lines of one table."""
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    seen, gone = [], {}
    for d, t in sorted(data, key=lambda r: r[0]):
        for no, line in enumerate(lines.normal(x) for x in (t or "").split("\n")):
            if line:
                if any(p == line or min(len(p), len(line)) >= lines.NEAR_CHARS and lines.within_one(p, line) for p in seen):
                    gone.setdefault(d, set()).add(no)
                seen.append(line)
    got = {r.doc_id: (r.n_removed, r.text) for r in lines.op5_line_dedup(spark, SF).collect()}
    assert got == {d: (len(gone.get(d, ())), t if d not in gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]))
                   for d, t in data}


def test_lines_odd(spark, odd, none):
    got = lines.drop_lines(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r.text for r in got}
    assert by[1] is None and by[2] == "" and by[3] == "one two three four five six" and by[5] == "word " * 30_000
    assert by[None] == ODD[2][1]
    assert lines.drop_lines(none).count() == 0
    assert lines.stage(spark, odd, SF).columns == odd.columns


# ---- decontamination -----------------------------------------------------------------------------


def contamination(data, bench):
    out = []
    for d, text in data:
        w, hit, items = brute.words(text), set(), set()
        for item, b in bench:
            x = brute.words(b)
            n = min(10, len(x))
            wins = {tuple(x[i:i + n]) for i in range(len(x) - n + 1)} if x else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i:i + n]) in wins:
                    hit |= set(range(i, i + n))
                    items.add(item)
        ids = sorted(str(i) for i in items if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [200_000, 400])
def test_decontamination(spark, docs, block):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()] + [(900, "Short, passage"), (901, None), (None, "without an id"), (10, "...")]
    data = rows(docs) + [(9000, "a SHORT passage without an id."), (9001, None), (9001, ""), (9000, "a SHORT passage without an id.")]
    got = decontaminate.find_contamination(spark, spark.createDataFrame(data, "doc_id long, text string"),
                                           spark.createDataFrame(items, "item_id long, text string"), block_windows=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == contamination(data, items)


@pytest.mark.parametrize("block", [200_000, 2])
def test_removal(spark, odd, none, block):
    bench = spark.createDataFrame([(1, "Ten words make one window of the benchmark right here, really yes no")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Before - ten words make one window of the benchmark right here. After", "s", 5), (2, "clean", "s", 5)],
                               "doc_id long, text string, _ string, n_chars long")
    kw = {"block_windows": block}
    assert [r.doc_id for r in decontaminate.decontaminate(spark, df, bench, **kw).collect()] == [2]
    spans = sorted(decontaminate.decontaminate(spark, df, bench, "spans", **kw).collect())
    assert [(r.text, r.n_chars) for r in spans] == [("Before - . After", 16), ("clean", 5)] and spans[0]["_"] == "s"
    got = decontaminate.decontaminate(spark, odd, none.selectExpr("doc_id AS item_id", "text"), **kw)
    assert got.columns == odd.columns and got.count() == len(ODD)
    assert decontaminate.decontaminate(spark, none, bench, **kw).count() == 0


# ---- quality rules -------------------------------------------------------------------------------


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n, cover = Counter(tri), set()
    for i, t in enumerate(tri):
        if n[t] > 1:
            cover |= {i, i + 1, i + 2}
    ls = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(ls) - len(set(ls)), len(cover), failed)


def test_quality_counts(docs, odd, none):
    nothing = quality.DecisionList(())
    for df in (docs, odd):
        got = sorted((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed), r.kept)
                     for r in quality.judge(df.where("doc_id IS NOT NULL"), nothing).collect())
        want = sorted((d, counts(t), not counts(t)[-1]) for d, t in rows(df) if d is not None)
        assert got == want
    assert quality.judge(odd, nothing).count() == len(ODD) and quality.judge(none, nothing).count() == 0
    assert quality.keep_good(odd, nothing).columns == odd.columns


def test_quality_rules_learned(spark):
    good = [(i, " ".join(f"w{(i * 7 + j * j) % 400}" for j in range(80))) for i in range(120)]
    bad = [(1000 + i, " ".join(f"w{(i * 5 + j * j) % 400}###" for j in range(80))) for i in range(120)]
    labels = [(d, 1) for d, _ in good] + [(d, 0) for d, _ in bad] + [(None, 0), (3, None)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    rules = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules.rules
    kept = {r.doc_id: r.kept for r in quality.judge(docs, rules).collect()}
    assert all(kept[d] for d, _ in good) and not any(kept[d] for d, _ in bad)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.learn(docs, empty).rules == ()
    assert quality.learn(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).rules == ()


# ---- language ------------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op3_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.98


def test_language_odd(spark, odd, none):
    learned = langid.fit(spark.createDataFrame([(i, t, c, "s") for i, (t, c) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"),
                         ("le chien et le chat", "fr"), ("привет как дела", "ru")] * 5)], SCHEMA))
    got = langid.predict(spark, odd, learned, [F.col("doc_id")]).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 4)} == {"und"}
    assert {r.lang_pred for r in langid.predict(spark, odd, langid.fit(none), [F.col("doc_id")]).collect()} == {"und"}
    assert langid.predict(spark, none, learned, [F.col("doc_id")]).count() == 0


# ---- secrets -------------------------------------------------------------------------------------


def test_secret_base_spans():
    text = 'é API_key = "abcdef" token: short password:token=abcdefgh ſecret: abcdefgh AKIA' + "A" * 16 + " AKIA" + "B" * 15 + " " + "0a" * 12
    got = [(k, text[a:b]) for k, a, b in secrets.base_spans(text)]
    assert got == [("assign", 'API_key = "abcdef'), ("assign", "password:token=abcdefgh"), ("access", "AKIA" + "A" * 16), ("hex", "0a" * 12)]
    # a short value is consumed by its own match
    assert secrets.base_spans("token: token: abcdefgh") == []


def test_secret_formats(spark, odd, none):
    rng = random.Random(1)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    plain = ["".join(rng.choice(["tion", "ing", "er", "the", "and"]) for _ in range(6)) for _ in range(300)]
    data = [(i, f"{plain[i]} token = \"{hexa(40)}\" {plain[i + 100]}") for i in range(100)] + [(500, f"id {hexa(40).upper()} {plain[250]} end")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    formats = secrets.learn(df)
    got = {r.doc_id: r for r in secrets.scan(spark, df, formats).collect()}
    assert got[500].n_format == 1 and got[500].spans.startswith("format:3:43") and got[500].n_assign == 0
    assert got[1].n_assign == got[1].n_hex == 1 and got[1].n_format == 0
    found = secrets.scan(spark, odd, secrets.learn(odd)).collect()
    assert len(found) == len(ODD) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" for r in found)
    assert secrets.scan(spark, none, secrets.learn(none)).count() == 0


@pytest.mark.parametrize("short", [6, 8, 12, 15])
def test_secret_formats_of_few_characters(spark, short):
    """A bare credential of the length of the labelled ones is found; ordinary words of that length are not."""
    rng = random.Random(short)
    key = lambda: "".join(rng.choice("0123456789" if i % 2 else "GHJKLMNPQRSTVWXZ") for i in range(short))
    word = lambda: "".join(rng.choice(["ti", "on", "in", "ge", "er", "th", "an", "de"]) for _ in range(8))[:short]
    data = [(i, f"{word()} password: {key()} {word()} {word()} {word()}") for i in range(100)] + [(500, f"it is {key()} she said")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(spark, df, secrets.learn(df)).collect()}
    assert got[500].spans == f"format:6:{6 + short}"
    assert all(got[i].n_assign == 1 and got[i].n_format == 0 for i in range(100))


def test_secret_tokens_beside_spans():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abcdefgh1234 ") for _ in range(80))
        taken = [("hex", a, a + rng.randint(1, 12)) for a in rng.sample(range(70), 4)]
        want = [m.span() for m in secrets.TOKEN.finditer(text) if not any(a < m.end() and m.start() < b for _, a, b in taken)]
        assert [m.span() for m in secrets.free_tokens(text, taken)] == want


def test_automaton_prefers_its_language():
    a = secrets.infer(["a7" * 10] * 30 + ["a7" * 12] * 30)
    assert a.log_likelihood("a7" * 11) > a.log_likelihood("aa77" * 5) > a.log_likelihood("zz" * 10)


# ---- pseudonyms ----------------------------------------------------------------------------------


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


VALUES = ["+1 (017) 555-7713", "+49 30 1234567", "4111 1111 1111 1111", "378282246310005", "enpa.90@mail2.example.com", "97.51.17.173",
          "1985-02-28", "28.02.1985", "28/02/1985", "123-45-6789", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
INVALID = ["4111111111111112", "999.1.2.3", "1985-02-30", "000-45-6789", "GB82WEST12345698765433", "no value 12345"]


def test_pseudonyms_keep_format_and_links(spark):
    data = [(i, f"({v}), {v}*** end") for i, v in enumerate(VALUES)] + [(100 + i, v) for i, v in enumerate(INVALID)]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(data, "doc_id long, text string"), "k").collect()}
    shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "9", s)))
    for i, v in enumerate(VALUES):
        a, b = re.fullmatch(r"\((.*)\), (.*)\*\*\* end", got[i].text).groups()
        assert a == b != v and got[i]._pii.n == 2, v
        assert shape(a) == shape(v) or v == "97.51.17.173"
    assert all(luhn(got[i].text.split(")")[0]) for i in (2, 3)) and all(int(x) < 256 for x in got[5].text[1:].split(")")[0].split("."))
    assert [got[100 + i].text for i in range(len(INVALID))] == INVALID
    other = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(data, "doc_id long, text string"), "another").collect()}
    assert all(other[i] != got[i].text for i in range(len(VALUES)))


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.col("id"), pii.feistel(F.col("id"), 25, 40, F.lit("k"), "t").alias("x"))
    assert sorted(r.x for r in df.collect()) == list(range(1000))
    text = spark.range(2600).select(F.concat(F.chr(F.pmod("id", F.lit(26)) + 97), F.lpad(F.floor(F.col("id") / 26).cast("string"), 2, "0")).alias("v"))
    assert text.select(pii.permuted_text(F.col("v"), F.lit("k"), "t").alias("x")).distinct().count() == 2600


def test_pseudonyms_odd(odd, none):
    got = pii.pseudonymise(odd, "k")
    assert [c for c in got.columns if c != "_pii"] == odd.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(rows(odd), key=repr)
    assert pii.pseudonymise(none, "k").count() == 0


@pytest.mark.parametrize("size", [120, 300, 1000, 5000])
def test_pseudonyms_of_long_mail_addresses(spark, size):
    domain = ".".join(["label7"] * (size // 7))
    data = [(1, f"to x1@{domain}.com now"), (2, f"to x1@{domain}.com now"), (3, f"to x2@{domain}.com now"), (4, f"to x1@{domain[:-1]}8.com now")]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(data, "doc_id long, text string"), "k").collect()}
    shape = lambda s: re.sub("[a-z]", "a", re.sub(r"\d", "9", s))
    assert all(shape(got[i]) == shape(t) and got[i] != t for i, t in data)
    assert got[1] == got[2] and len(set(got.values())) == 3


# ---- columns named like helpers -------------------------------------------------------------------


def test_columns_named_like_helpers(spark):
    """Every stage and function keeps columns of any name as they are."""
    names = ["_doc", "_gone", "_lines", "_plan", "_src", "_epoch", "_n", "_doc_key", "_block_key", "_near_copy", "_quality_stats", "_pii", "_mix",
             "mix_epoch", "row", "doc", "th", "gone", "plan", "src", "n", "doc_key", "epoch", "mix", "stats", "made", "left", "key", "node"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    df = spark.createDataFrame(docs.collect(), docs.schema).select("*", *[F.concat(F.lit(f"{x} "), F.col("doc_id")).alias(x) for x in names])
    before = df.columns

    def same(out, but=()):
        for r in out.collect():
            assert all(r[x] == f"{x} {r.doc_id}" for x in names if x not in but)

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == before, name
        same(out)
    out = corpus_pipeline.STAGES[-1][1](spark, df, SF)
    # the place of an earlier mix is replaced
    assert len(set(out.columns)) == len(out.columns) and all(isinstance(r.mix_epoch, int) for r in out.collect())
    same(out, ["mix_epoch"])
    for out in (pii.pseudonymise(df, "k"), lines.drop_lines(df), mixing.mix(df)):
        assert out.columns[:-1] == before and out.columns[-1].startswith("__")
        same(out)


# ---- mixing --------------------------------------------------------------------------------------


def test_mixing_weights(spark):
    totals = spark.createDataFrame([("a", 9000), ("b", 900), ("c", 100)], "source string, tokens long")
    w = {r.source: r for r in mixing.weights(totals, repeats=100.0).collect()}
    assert w["a"].weight < 0.9 and w["c"].weight > 0.01 and sum(r.weight for r in w.values()) == pytest.approx(1, abs=1e-6)
    tight = {r.source: r for r in mixing.weights(totals, repeats=2.0).collect()}
    assert all(r.budget <= 2.001 * r.tokens for r in tight.values()) and tight["a"].exponent > w["a"].exponent
    assert {r.exponent for r in mixing.weights(totals, budget=50_000, repeats=2.0).collect()} == {1.0}
    assert [r.weight for r in mixing.weights(totals.where("source = 'a'")).collect()] == [1.0]


def test_mixing_meets_budgets(spark):
    rng = random.Random(2)
    data = [(i, "w " * rng.randint(1, 40), "abc"[min(2, i % 7)]) for i in range(700)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    plan = {r.source: r for r in mixing.weights(df.withColumn("n", mixing.count_tokens(F.col("text"))).groupBy("source")
                                                .agg(F.sum("n").alias("tokens"))).collect()}
    got = mixing.mix(df).collect()
    used, draws = defaultdict(int), Counter()
    for r in got:
        used[r._mix.source] += r._mix.n_tokens
        draws[r.doc_id, r._mix.epoch] += 1
    assert max(draws.values()) == 1
    for s, p in plan.items():
        assert p.budget - 40 < used[s] <= p.budget


def test_mixing_odd(spark, odd, none):
    got = mixing.mix(odd).collect()
    assert {r._mix.source for r in got} <= {"a", "b"} and not any(r.doc_id in (1, 2, 4) for r in got)
    assert mixing.mix(none).count() == 0 and mixing.mix(odd, budget=0).count() == 0
    assert set(odd.columns) < set(mixing.stage(spark, odd, SF).columns)
