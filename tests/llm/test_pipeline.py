"""The pipeline against its stages' plain definitions, and the guard of its registration."""

import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
from edge_rows import rows, table
from test_dedup import plain_components, plain_fingerprint

from foliospark.llm import mixing, quality

SF = "/root/testdata/sf0.001"


def test_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    named = dict(corpus_pipeline.STAGES)
    kept = named["quality_rules"](spark, docs, SF)
    judged = quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in judged.filter("kept").collect()}

    unique = named["exact_dedup"](spark, kept, SF)
    last = {}
    for r in kept.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in unique.collect()} == set(last.values())

    near = named["simhash_near_dedup"](spark, unique, SF)
    data = [(r.doc_id, r.text) for r in unique.collect()]
    component, _ = plain_components([i for i, _ in data], [plain_fingerprint(t) for _, t in data])
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(component))

    mixed = named["mix_sources"](spark, near, SF)
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(near).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    assert all(x.columns == columns for x in (kept, unique, near, mixed))

    texts = {r.doc_id: r.text for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter({i: n for i, n in copies.items() if n})
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)


def test_stages_take_awkward_rows(spark):
    docs = table(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema == docs.schema, name
        assert out.count() <= 2 * len(rows()), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_pattern_is_the_libraries():
    assert P.PATTERN.startswith("'s|")
