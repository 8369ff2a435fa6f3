"""The pipeline on the smallest tables: each stage against what it promises."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="generated test data not present")
def test_stages(spark):
    import corpus_pipeline as pipeline
    from shelfspark.llm import jaccard, toxicity
    from shelfspark.llm.common import read_table, stored
    docs = read_table(spark, SF, "documents")
    kept = {"documents": docs}
    for name, stage in pipeline.STAGES:
        out = stored(stage(spark, docs, SF), name)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == kept["documents"].columns
        kept[name] = docs = out
    model = toxicity.learn(kept["documents"], read_table(spark, SF, "labels"))
    clean = {r.doc_id for r in toxicity.score(kept["documents"], model).where("not toxic").collect()}
    assert {r.doc_id for r in kept["toxicity"].collect()} == clean
    assert {r.doc_id for r in kept["line_dedup"].collect()} == clean  # no document goes, only lines
    groups = jaccard.jaccard_components(kept["line_dedup"], 5, 80, 100).collect()
    assert {r.doc_id for r in kept["near_duplicates"].collect()} == {r.component_id for r in groups}
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect())
    assert words(kept["mix_sources"]) == pytest.approx(1.5 * words(kept["near_duplicates"]), abs=20)
    pieces = kept["pack"].collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces) >= kept["mix_sources"].count()
