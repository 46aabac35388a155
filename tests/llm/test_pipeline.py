"""The corpus pipeline, stage by stage, against plain Python."""

import corpus_pipeline
from heliosite.llm import decontamination, pii
from heliosite.llm.storage import persisted
from tests.llm.test_corpus import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard_join", "decontamination", "pii", "best_fit_packing"]
    kept = persisted(stages["language_id"](spark, docs, SF))
    assert kept.columns == columns and kept.count() >= 0.99 * docs.count()
    groups = brute_groups([(r.doc_id, r.text) for r in kept.collect()])
    one = persisted(stages["ngram_jaccard_join"](spark, kept, SF))
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {i for i, (_, c) in groups.items() if i == c}
    hit = {r.doc_id for r in decontamination.contaminated(one, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    clean = persisted(stages["decontamination"](spark, one, SF))
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - hit
    hidden = persisted(stages["pii"](spark, clean, SF))
    assert hidden.columns == columns and hidden.count() == clean.count()
    assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in hidden.collect())
    packed = stages["best_fit_packing"](spark, hidden, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in hidden.collect()}
