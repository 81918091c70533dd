"""The pipeline, stage by stage, against the operators' own verdicts and brute force."""

import collections

import corpus_pipeline
from skein.llm import decontamination, near_duplicates, packing, pii, quality_rules
from skein.llm.common import table


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    labels, bench = table(spark, sf, "labels"), table(spark, sf, "benchmark")
    have = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, have, sf)
        path = str(tmp_path / f"{k}")
        out.write.parquet(path)
        new = spark.read.parquet(path)
        before, after = {r.doc_id: r for r in have.collect()}, new.collect()
        if name == "quality_rules":
            want = {r.doc_id for r in quality_rules.op1_quality_rules(have, labels).collect() if r.kept}
        elif name == "ngram_jaccard":
            want = {r.class_id for r in near_duplicates.join(have).collect()}
        elif name == "decontamination":
            want = {r.doc_id for r in decontamination.op4_decontamination(have, bench).collect() if not r.contaminated}
        elif name == "pii":
            want = set(before)
            old = {v for r in before.values() for _, _, _, v in pii.find(r.text)}
            assert not any(v in r.text for r in after for v in old)
        else:
            want = set(before)
            fill = collections.Counter()
            for r in after:
                fill[r.sequence_id] += r.length
            assert max(fill.values()) <= packing.CAPACITY
        assert {r.doc_id for r in after} == want
        if name != "packing":
            assert new.columns == docs.columns
            assert all(r.text == before[r.doc_id].text for r in after) or name == "pii"
        have = new


def test_run(spark, sf):
    packed = corpus_pipeline.run(spark, sf).collect()
    ids = {r.doc_id for r in table(spark, sf, "documents").collect()}
    assert packed and {r.doc_id for r in packed} <= ids and len({(r.doc_id, r.piece) for r in packed}) == len(packed)
    assert all(0 <= r.offset and r.offset + r.length <= packing.CAPACITY for r in packed)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "decontamination", "pii", "packing"]


def test_empty_table_and_nulls(spark, sf):
    docs = table(spark, sf, "documents")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None), (1, None), (2, "")], "doc_id long, text string"), allowMissingColumns=True)
    for start in (docs.limit(0), odd):
        have = start
        for _, stage in corpus_pipeline.STAGES:
            have = stage(spark, have, sf)
        assert have.count() == 0  # none has ten words
