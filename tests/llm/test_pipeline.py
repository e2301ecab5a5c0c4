"""The pipeline's stages on a small table, each against what it promises."""

import corpus_pipeline
from isotherm.llm import decontaminate, lines, neardup
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "mixing"]
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    made = lines.stage(spark, kept, SF)
    assert made.columns == docs.columns
    data = [(r.doc_id, r.text) for r in kept.collect()]
    gone = brute.kept_lines(data)
    want = {}
    for d, t in data:
        text = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ()))
        if text.strip() or d not in gone:
            want[d] = text
    assert {r.doc_id: r.text for r in made.collect()} == want and all(r.n_chars == len(r.text) for r in made.collect())
    single = neardup.stage(spark, made, SF)
    classes = brute.near_classes(sorted(want.items()))
    assert {r.doc_id for r in single.collect()} == {d for d, (c, _) in classes.items() if d == c}
    clean = decontaminate.stage(spark, single, SF)
    dirty = {r.doc_id for r in decontaminate.find_contamination(spark, single, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - dirty


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "mix_epoch", "mix_weight"} <= set(out.columns) and out.count() > 0
