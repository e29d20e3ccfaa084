"""The pipeline against the operators' brute-force versions, stage by stage."""

from collections import Counter

from . import brute

SF = "/root/testdata/sf0.01"


def test_pipeline(spark):
    import corpus_pipeline as p
    from tidemark.llm.common import written
    from tidemark.llm.secrets_scan import digests

    assert [n for n, _ in p.STAGES] == ["toxicity", "quality_rules", "jaccard_join", "secret_scans", "packing"] and p.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, after = docs.dtypes, docs, None
    for name, stage in p.STAGES:
        after = written(stage(spark, before, SF), name)
        if name == "packing":
            break
        assert after.dtypes == columns
        old, new = ({r.doc_id: r.text for r in x.collect()} for x in (before, after))
        assert after.count() == len(new) and new.keys() <= old.keys()
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
            gone = old.keys() - new.keys()
            assert len(gone & toxic) > 0.6 * len(toxic & old.keys())
        if name == "quality_rules":
            assert not any(brute.quality(t)[-1] for t in new.values())
            good = {i for i, t in old.items() if not brute.quality(t)[-1]}
            assert len(new) > 0.97 * len(good)
        if name == "jaccard_join":
            want = {c for _, c in brute.jaccard_components(list(old.items())).values()}
            assert new.keys() == want
        if name == "secret_scans":
            assert new.keys() == old.keys() and all(sum(brute.secrets(t)[1:3]) == 0 for t in new.values())
            spans = {r.doc_id: r.spans for r in digests(before).collect()}
            assert all((new[i] == old[i]) == (not spans[i]) for i in old)
        before = after
    pieces = after.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.collect()}
    room = Counter()
    for r in pieces:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048
    assert p.run(spark, SF).count() == len(pieces)
