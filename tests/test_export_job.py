"""Export as one job: what is published, compared, logged, and left alone."""

from datetime import datetime, timezone

import pytest

from lodestone.operators import export_job as J
from lodestone.sources.catalogue import Snapshots
from lodestone.sources.export import NAMES

SCHEMA = {"definitions": {"item": {"type": "object", "required": ["id", "title"], "properties": {"title": {"type": "string"}, "topics": {"type": "array", "items": {"enum": ["Policy"]}}}}}}


def pages(spark, rows):
    import json

    def page(id_, title, topics):
        text = lambda kind, t: {"type": kind, kind: [{"plain_text": t}]}
        return (json.dumps({NAMES["id"]: text("rich_text", id_), NAMES["title"]: text("title", title), NAMES["topics"]: {"type": "multi_select", "multi_select": [{"name": t} for t in topics]},
                            NAMES["itemUrl"]: {"type": "url", "url": f"https://a.org/{id_}"}}),)

    return spark.createDataFrame([page(*r) for r in rows], "properties string")


def run(spark, store, rows, month, judge=lambda i, p: J.gate(i, p, SCHEMA), **more):
    return J.export(store, pages(spark, rows), "2026-04-01", datetime(2026, month, 1, tzinfo=timezone.utc), f"2026-{month:02}", judge, **more)


def test_export(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/store")
    assert run(spark, store, [("a", "A", []), ("b", "B", ["Policy"]), ("", "none", [])], 1)
    assert sorted(r.id for r in store.read("2026-01").collect()) == ["a", "b"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        J.changes(store)
    assert run(spark, store, [("b", "B2", ["Policy"]), ("c", "C", [])], 2)
    assert sorted((r.id, r.change, r.version) for r in J.changes(store).collect()) == [("a", "removed", "2026-02"), ("b", "updated", "2026-02"), ("c", "added", "2026-02")]
    # judged bad: an unknown topic, a repeated id, a secret; and a dry run
    for bad in ([("d", "D", ["Odd"])], [("d", "D", []), ("d", "E", [])], [("d", "key AKIA" + "A" * 16, [])]):
        assert not run(spark, store, bad, 3)
    assert run(spark, store, [("d", "D", [])], 3, dry_run=True)
    assert store.versions() == ["2026-01", "2026-02"] and store.runs().count() == 2
    # the same month again: compared with the version that it replaces
    assert run(spark, store, [("b", "B2", ["Policy"]), ("c", "C3", [])], 2)
    assert sorted((r.id, r.change) for r in J.changes(store).collect()) == [("a", "removed"), ("b", "updated"), ("c", "added"), ("c", "updated")]
    assert sorted(r.item_count for r in store.runs().collect()) == [2, 2, 2]
