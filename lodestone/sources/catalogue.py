"""Reading and publishing catalogues: JSON envelopes, paged services, sheets, vocabularies, matrices, pages, snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINK = "struct<url:string,anchorText:string,urlStatus:string>"
ITEM = f"""id string, title string, summary string, url string, urlStatus string, links array<{LINK}>, publishDate string, contentType string,
topics array<string>, locations array<string>, croppingSystems array<string>, people array<string>, sourceNewsletter string, newsletterNo int,
createdAt string, updatedAt string, doi string, publication string, citations string, pageKeywords array<string>, pageKeywordsUpdatedAt string,
pageKeywordsSource string, expired boolean"""
ENVELOPE = f"schemaVersion string, generatedAt string, version string, count int, items array<struct<{ITEM}>>"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON envelope with ord, their place in it. A file that can't be parsed fails the query."""
    doc = spark.read.schema(ENVELOPE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select(F.posexplode("items").alias("ord", "item")).select(F.col("ord").cast("long"), "item.*")


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """Report rows for documents that aren't valid JSON or have no items."""
    schema = ENVELOPE + ", _corrupt string"
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    wrong = F.when(F.col("_corrupt").isNotNull(), "not valid JSON").when(F.col("items").isNull(), "no items")
    return doc.select(F.lit("V2").alias("rule"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("id"), wrong.alias("message")).where("message is not null")


class PagedSource(DataSource):
    """A cursor-paged service: option `pages` names a module:function that maps a cursor (None first) to (rows, next cursor).

    One partition follows the cursor; rows are JSON strings.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "row string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options["pages"])


class _PagedReader(DataSourceReader):
    def __init__(self, where: str):
        self.where = where

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        import importlib

        module, name = self.where.split(":")
        page = getattr(importlib.import_module(module), name)
        cursor = None
        while True:
            rows, cursor = page(cursor)
            for row in rows:
                yield (row,)
            if cursor is None:
                return


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a sheet saved as CSV with a header: ord, url, status, recovery, replacement; rows without URL are skipped."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    named = rows.select(F.monotonically_increasing_id().alias("ord"), F.col("URL").alias("url"), F.col("Status").alias("status"), F.col("Recovery").alias("recovery"), F.col("Replacement URL").alias("replacement"))
    return named.where(F.coalesce("url", F.lit("")) != "")


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """(id, pos, href, url, anchorText) of an extraction file's records."""
    schema = "records array<struct<item_id:string,links array<struct<href:string,url:string,anchor_text:string>>>>".replace("links array", "links:array")
    records = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("records").alias("r"))
    links = records.select(F.col("r.item_id").alias("id"), F.posexplode("r.links").alias("pos", "l"))
    return links.select("id", "pos", "l.href", "l.url", F.coalesce("l.anchor_text", F.lit("")).alias("anchorText"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, token): the line number is the id; one line break at the end ends the last line."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r?\n\z", "").alias("t"))
    return text.select(F.posexplode(F.split("t", r"\r?\n")).alias("token_id", "token"))


def read_token_table(spark: SparkSession, matrix: str, scales: str, dim: int) -> DataFrame:
    """(token_id, q, scale) of an int8 matrix and its float32 scales, files of a model of fixed size."""
    files = spark.read.format("binaryFile").load([matrix, scales]).select("path", "content")
    rows = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in files.collect()}
    import numpy as np

    q = np.frombuffer(rows[matrix.rsplit("/", 1)[-1]], np.int8).reshape(-1, dim)
    s = np.frombuffer(rows[scales.rsplit("/", 1)[-1]], "<f4")
    return spark.createDataFrame([(i, q[i].tolist(), float(s[i])) for i in range(len(q))], "token_id int, q array<tinyint>, scale float")


def fetched(targets: DataFrame, fetch: Callable[[str], tuple[str, str, str]], partitions: int = 8, attempts: int = 3) -> DataFrame:
    """(id, url, kind, payload, final_url, error) of targets (id, url). `fetch` maps a URL to (content type, payload, final
    URL); a PDF of the archive that isn't one yet is tried again; so many partitions bound the load on the services."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, url in zip(batch["id"], batch["url"]):
                row = [id_, url, None, None, None, None]
                try:
                    for n in range(attempts):
                        content, payload, final = fetch(url)
                        pdf = "pdf" in content.lower() or final.lower().endswith(".pdf")
                        if not pdf or payload[:5] == "%PDF-" or "web.archive.org" not in url or n == attempts - 1:
                            break
                    row[2:5] = ["pdf" if pdf else "html", payload, final]
                except Exception as e:  # noqa: BLE001  whatever a service does is that row's result
                    row[5] = f"{type(e).__name__}: {e}"
                out.append(row)
            yield pd.DataFrame(out, columns=["id", "url", "kind", "payload", "final_url", "error"])

    return targets.select("id", "url").repartition(partitions).mapInPandas(run, "id string, url string, kind string, payload string, final_url string, error string")


class Snapshots:
    """A folder of versions. A version is staged, gated, then renamed into place; readers never see a part of one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(n.split("=", 1)[1] for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))) if n.startswith("version="))

    def recover(self) -> list[str]:
        """What a publish that ended halfway left: a version that was set aside and not replaced is put back (its name is returned), one
        that was replaced goes, and so do staged items. For when no other writer is at work; publish() does it first."""
        back = []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))] if self._fs.exists(self._path(self.root)) else []
        for name in names:
            left = self._path(f"{self.root}/{name}")
            if name.startswith("_old-"):
                version = name.removeprefix("_old-").rsplit("-", 1)[0]
                target = self._path(f"{self.root}/version={version}")
                if not self._fs.exists(target) and self._fs.rename(left, target):
                    back.append(version)
                    continue
            if name.startswith(("_old-", "_staging-")):
                self._fs.delete(left, True)
        return back

    def previous(self, excluding: str | None = None) -> DataFrame | None:
        left = [v for v in self.versions() if v != excluding]
        return self.read(left[-1]) if left else None

    def read(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/version={version}")

    def publish(self, items: DataFrame, version: str, report: Callable[[DataFrame], DataFrame], dry_run: bool = False) -> bool:
        """Stage items, judge what was staged, and put it in place if there is no error; a version of that name is replaced. There is one
        writer at a time: what an earlier one left halfway is recovered first."""
        self.recover()
        staged = f"{self.root}/_staging-{uuid.uuid4().hex}"
        items.write.parquet(staged)
        good = report(self.spark.read.parquet(staged)).where("severity = 'error'").isEmpty()
        if not good or dry_run:
            self._fs.delete(self._path(staged), True)
            return good
        target, old = self._path(f"{self.root}/version={version}"), self._path(f"{self.root}/_old-{version}-{uuid.uuid4().hex}")
        # the version that is replaced stays until the new one is in place, whatever ends the run in between
        replaces = self._fs.exists(target)
        if replaces and not self._fs.rename(target, old):
            raise OSError(f"{target} can't be set aside")
        if not self._fs.rename(self._path(staged), target):
            if replaces:
                self._fs.rename(old, target)
            raise OSError(f"{staged} can't be put in place")
        if replaces:
            self._fs.delete(old, True)
        return True

    def log(self, counters: DataFrame, run_at: datetime, note: str = "") -> None:
        counters.withColumns({"run_at": F.lit(run_at), "note": F.lit(note)}).write.mode("append").parquet(f"{self.root}/_log")

    def runs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/_log")


def write_back(items: DataFrame, enriched: DataFrame, columns: list[str]) -> DataFrame:
    """items with new values where there are any; failed items keep what they had."""
    new = enriched.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    return items.join(new, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])
