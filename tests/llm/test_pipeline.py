import corpus_pipeline
from tests.llm.fixtures import corpus, frame
from tests.llm.test_operators import components_by_hand


def test_stages(spark):
    docs = frame(spark, corpus()).select("doc_id", "text", "lang", "source", "n_chars").cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixture", "sequences"]
    now, ids = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "").cache()
        if name != "sequences":
            assert now.columns == docs.columns
        ids.append({r.doc_id for r in now.select("doc_id").collect()})
        if name == "lines":
            left = [(r.doc_id, r.text) for r in now.collect()]
    assert {40, 41, 42, 43, 46} & ids[0] == set() and {0, 1, 2} <= ids[0]
    none = 2**63 - 1
    assert {none if i is None else i for i in ids[2]} == {c for _, _, c in components_by_hand(left, 5, 80, 100)}
    assert ids[4] == ids[3] <= ids[2]
    taken = now.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in taken) <= 2048
