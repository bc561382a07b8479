"""Export as one job: public items of a curated table are staged, compared with the last version, judged, published and logged."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import conformance, quality, snapshots
from lodestone.session import shared_dir
from lodestone.sources.catalogue import Snapshots
from lodestone.sources.export import public_items

# The fields whose change makes an item an updated one.
COMPARED = ["title", "summary", "url", "contentType", "topics", "locations", "croppingSystems", "publishDate"]


def gate(items: DataFrame, previous: DataFrame | None, schema: dict | None = None, part: str = "#/definitions/item") -> DataFrame:
    """The report on staged items: ids, dates, addresses, secrets in any field, the schema document if one is given, and what came
    and went since `previous`, as warnings."""
    rows = items.withColumn("ord", F.monotonically_increasing_id())
    raw = F.to_json(F.struct(*items.columns), {"ignoreNullFields": "false"})
    rules = [quality.ids(rows), quality.dates(items, "publishDate", "createdAt"), quality.urls(items), quality.secrets(items)]
    if schema is not None:
        rules.append(conformance.conformance(rows.withColumn("raw", raw), schema, part=part))
    if previous is not None:
        rules.append(quality.history(items, previous))
    return reduce(DataFrame.unionAll, rules)


def _hashed(items: DataFrame) -> DataFrame:
    return items.select("id", snapshots.content_hash(*[F.col(c) for c in COMPARED]).alias("hash"))


def export(store: Snapshots, pages: DataFrame, today: str, run_at: datetime, version: str, judge: Callable[[DataFrame, DataFrame | None], DataFrame] = gate,
           dry_run: bool = False) -> bool:
    """Publishes the pages' public items as a version, if judge(items, previous) reports no error; whether it found none.

    The source is read once, into the staged version; what changed since the last version, that of the same name included, is
    found on the staged rows before they replace it. Once it is published, changes are appended to the store's `_changes`
    and counters to its log. Without an earlier version there are no changes. A run that is judged bad, and a dry one, leaves
    nothing. One that ends between publishing and the log lacks these rows, nothing else.
    """
    spark = pages.sparkSession
    store.recover()
    previous = store.previous()
    changes_at = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"

    def judged(staged: DataFrame) -> DataFrame:
        if previous is not None:
            snapshots.difference(_hashed(previous), _hashed(staged)).write.parquet(changes_at)
        return judge(staged, previous)

    stamp: Column = F.lit(run_at)
    if not store.publish(public_items(pages, today, stamp), version, judged, dry_run):
        return False
    if dry_run:
        return True
    if previous is not None:
        spark.read.parquet(changes_at).withColumns({"version": F.lit(version), "run_at": stamp}).write.mode("append").parquet(f"{store.root}/_changes")
    store.log(snapshots.run_counters(store.read(version)), run_at, version)
    return True


def changes(store: Snapshots) -> DataFrame:
    """(id, change, version, run_at) of all logged exports; fails where none had an earlier version."""
    return store.spark.read.parquet(f"{store.root}/_changes")
