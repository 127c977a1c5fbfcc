"""Tables are dealt over tasks by their rows, not by the session's partitions alone."""

from gridloom import util
from gridloom.plans import q_contracts, q_joins, views

SF = "/root/testdata/sf0.01"


def test_cells(spark, monkeypatch):
    before = q_joins.j05_coverage(spark, SF).collect()
    monkeypatch.setattr(util, "SHARE", 2000)
    rows = views.table(spark, SF, "lineitem").count()
    assert views.cells(spark, SF).rdd.getNumPartitions() == -(-rows // 2000) > 4
    assert q_joins.j05_coverage(spark, SF).collect() == before


def test_annotations(spark, monkeypatch):
    """A task's rows are few, and the three kinds of errors are still told apart without a common distinct."""
    before = sorted(map(str, q_contracts.f14_annotation_errors(spark, SF).collect()))
    monkeypatch.setattr(util, "SHARE", 12000)
    got = q_contracts.f14_annotation_errors(spark, SF)
    assert got.rdd.getNumPartitions() > 20
    assert sorted(map(str, got.collect())) == before and len(set(before)) == len(before)
