import time

import pytest

from accessloom.operators import graph, syncs
from accessloom.sources import star
from accessloom.sources.store import Store


def runs(spark, rows):
    return star.conform(spark.createDataFrame(rows, "sync_id string, parent_sync_id string"), "sync_runs")


def test_components_of_many_nodes_take_linear_time():
    n = 200_000
    successors = {str(i): [str(i + 1)] for i in range(n)}
    successors[str(n)] = [str(n - 1)]
    began = time.perf_counter()
    of = graph.components(successors)
    assert time.perf_counter() - began < 5
    assert of[str(n)] == of[str(n - 1)] and len(set(of.values())) == n


def test_a_run_is_added_once_and_runs_are_not_replaced(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.finish(runs(spark, [("a", None)]))
    store.finish(runs(spark, [("a", None), ("b", "a")]))
    assert sorted(r.sync_id for r in store.runs().collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="finish"):
        store.put("sync_runs", runs(spark, [("c", None)]))
    store.copy("a", f"{tmp_path}/other")
    assert [r.sync_id for r in Store(spark, f"{tmp_path}/other").runs().collect()] == ["a"]


def test_parents_come_first_or_it_is_an_error(spark):
    chain = runs(spark, [(f"r{i}", f"r{i - 1}" if i else None) for i in range(4)])
    assert {r.sync_id: r.level for r in syncs.parent_first(chain).collect()} == {"r0": 0, "r1": 1, "r2": 2, "r3": 3}
    with pytest.raises(ValueError, match="r3"):
        syncs.parent_first(chain, depth=2)
    with pytest.raises(ValueError, match="x, y"):
        syncs.parent_first(runs(spark, [("x", "y"), ("y", "x"), ("z", None)]))
