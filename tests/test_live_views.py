"""Filters that change while a stream runs."""

from warder.operators.audit_filter import AuditFilter, filter_rows
from warder.streaming.live_views import LiveCounts, store_filters


def test_edited_filter_changes_the_next_batch(spark, tmp_path):
    schema = "msg_id long, msg_type string, decision string, stype string, host string"
    batches = [[(10 * n + i, "AVC", "denied" if i % 2 else "granted", f"s{i}", f"h{n}") for i in range(4)] for n in range(4)]
    live = LiveCounts(spark, str(tmp_path / "filters"), str(tmp_path / "views"))
    store = lambda *f: store_filters(filter_rows(spark, [AuditFilter(c, "all", True, name) for name, c in f]), str(tmp_path / "filters"))
    totals = lambda: {r["filter"]: (r["total"], r["denied"]) for r in live.state().collect()}
    step = lambda n: live.step(spark.createDataFrame(batches[n], schema), n)

    step(0)  # no filters yet
    assert totals() == {} and live.redone[0] == []
    store(("a", {"src_type": ["s1", "s2"]}), ("b", {"host": "h9"}))
    step(1)
    assert totals() == {"a": (4, 2), "b": (0, 0)} and live.redone[1] == ["a", "b"]
    store(("a", {"src_type": ["s1"]}), ("b", {"host": "h9"}), ("c", {"host": "h2"}))
    step(2)
    assert totals() == {"a": (3, 3), "b": (0, 0), "c": (4, 2)} and live.redone[2] == ["a", "c"]
    step(2)  # a batch that runs again counts once
    assert totals() == {"a": (3, 3), "b": (0, 0), "c": (4, 2)}
    store(("c", {"host": "h2"}))
    step(3)
    assert totals() == {"c": (4, 2)} and live.redone[3] == []
