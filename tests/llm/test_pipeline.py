from collections import defaultdict

import corpus_pipeline as cp
from vetrina.llm import common, exact_dedup, quality_model, simhash, substring_dedup

SF = "/root/testdata/sf0.001"


def test_stages_read_what_the_one_before_kept(spark):
    """Each stage against its operator's own report over the same input."""
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = common.materialize(cp.quality(spark, docs, SF), "test")
    report = quality_model.quality(docs, common.table(spark, SF, "labels"))
    assert kept.columns == columns and ids(kept) == ids(report.where("predicted = 1"))
    one = common.materialize(cp.exact(spark, kept, SF), "test")
    assert one.columns == columns and ids(one) == ids(exact_dedup.dedup(kept).where("kept"))
    near = common.materialize(cp.near(spark, one, SF), "test")
    assert near.columns == columns and ids(near) == ids(simhash.near_duplicates(one).where("doc_id = component_id"))
    left = common.materialize(cp.repeats(spark, near, SF), "test")
    assert left.columns == columns and ids(left) == ids(near)
    texts = {r.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in substring_dedup.remove_repeats(near).collect()}
    assert {r.doc_id: r.text for r in left.collect()} == texts
    packed = cp.pack(spark, left, SF).collect()
    assert sorted({r.doc_id for r in packed}) == ids(left)
    room = defaultdict(int)
    for r in packed:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 4096


def test_stages_on_odd_tables(spark, docs, monkeypatch):
    """No rows at all; null ids and texts, repeated rows, long texts and columns named like those of the stages."""
    prose = " ".join(f"w{i}" for i in range(300))
    odd = [(None, prose), (3, prose), (3, prose), (4, None), (5, ""), (6, " \n"), (7, "x" * 200_000), (8, prose.upper()), (None, None)]
    for rows in ([], odd):
        table = docs(rows, extra="_key0").withColumnsRenamed({"lang": "digest", "source": "_score"}).withColumn("c0", cp.F.lit(1))
        columns = table.columns
        for name, stage in cp.STAGES[:-1]:
            table = common.materialize(stage(spark, table, SF), "test")
            assert table.columns == columns, name
        packed = cp.STAGES[-1][1](spark, table, SF).collect()
        assert len({(r.doc_id, r.piece) for r in packed}) == len(packed) and all(len(r.ids) == r.length for r in packed)
        assert len({r.doc_id for r in packed}) == len({r.doc_id for r in table.select("doc_id").collect()}) == table.count()


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "suffix-array dedup", "best-fit packing"]
    assert cp.run(spark, SF).count() > 0
