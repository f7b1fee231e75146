"""Commits of many keys do not send them through the driver."""

import pytest

from corpusmill.sources import versions as V


@pytest.mark.parametrize(("sent", "broadcast"), [(10, False), (1000, True)])
def test_keys_of_a_commit(spark, tmp_path, monkeypatch, sent, broadcast):
    monkeypatch.setattr(V, "SENT", sent, raising=False)
    rows = spark.range(500).selectExpr("id AS k", "id * 2 AS v")
    table = V.Table.create(rows, str(tmp_path / "t"), ["k"], 4)
    plans, write = [], V.Table._write
    monkeypatch.setattr(V.Table, "_write", lambda self, rows, head: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(self, rows, head))
    table.commit(rows.where("k % 3 = 0").selectExpr("k", "v + 1 AS v"), rows.where("k % 50 = 1"))
    assert ("BroadcastHashJoin" in plans[0]) is broadcast
    want = {k: k * 2 + (k % 3 == 0) for k in range(500) if k % 3 == 0 or k % 50 != 1}
    assert {r.k: r.v for r in table.read().collect()} == {k: v for k, v in want.items()}
