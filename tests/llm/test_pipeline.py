"""The corpus pipeline, stage by stage, against brute force."""

import corpus_pipeline as C
from dispatchlens.llm.tables import table

from ..conftest import SF_SMALL
from .test_bag_minhash import brute as classes
from .test_suffix_columns import brute as repeats


def test_stages_take_effect(spark):
    docs, names = table(spark, SF_SMALL, "documents"), None
    before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for name, stage in C.STAGES:
        docs = stage(spark, docs, SF_SMALL).cache()
        names = names or docs.columns
        after = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        if name == "near_dedup":
            head = classes(before)
            assert sorted(after) == sorted((i, t) for i, t in before if head[i] == i)
        if name == "suffix_dedup":
            gone = {r[0]: r[2] for r in repeats(before, 200)}
            old = dict(before)
            for i, t in after:
                assert 0 <= len(old[i].encode()) - gone[i] - len(t.encode()) < 8
            assert {i for i, _ in before} - {i for i, _ in after} <= {i for i, n in gone.items() if n}
        assert len(after) <= len(before)
        assert docs.columns[:len(names)] == names
        before = after
    assert all(r.decoded == r.text and r.pieces for r in docs.collect())


def test_empty_table_and_extra_columns(spark):
    docs = table(spark, SF_SMALL, "documents").selectExpr("*", "1 AS k_id", "'x' AS node", "2 AS pieces", "'s' AS spans")
    for n in (0, 30):
        out = docs.limit(n)
        for _, stage in C.STAGES[:-1]:
            out = stage(spark, out, SF_SMALL)
            assert out.columns == docs.columns
        last = C.STAGES[-1][1](spark, out, SF_SMALL)
        assert last.count() <= n and {"pieces", "decoded", "k_id"} <= set(last.columns)
