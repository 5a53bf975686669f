"""The registered queries: names, SQL, and plans."""

import pytest

from plumbline.plans import registry
from plumbline.sources import tables as tb


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_flagship_runs(spark, sf):
    assert registry.flagship(spark, sf).count() > 0


@pytest.mark.parametrize("name", ["e2_faithfulness", "k8_nodes", "t8_trace_stats", "p1_lines", "r7_stage_durations"])
def test_partitioning_does_not_change_results(spark, sf, name, monkeypatch):
    query = registry.queries()[name]
    want = sorted(map(str, query(spark, sf).collect()))
    plain = tb.table
    monkeypatch.setattr(tb, "table", lambda s, d, n: plain(s, d, n).repartition(5))
    assert sorted(map(str, query(spark, sf).collect())) == want


def test_scan_reads_only_what_it_needs(spark, sf):
    plan = registry.queries()["e13_truncated"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
