"""Keyword search by an inverted index: (term, id, tier) rows, written clustered by term, so that a query reads its terms' row groups.

Terms are the runs of ASCII letters, digits and underscores in an item's folded text; of a run that stands in several tiers of an
item the best counts. A query word and its forms with a suffix are keys that lie beside each other in the index. Words of a query
that aren't one run (c++, l'eau) take as candidates the items that have the word's runs, and are verified on the folded text of
these candidates alone.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import SUFFIXES
from lodestone.plans.search import keyword_index, tier
from lodestone.session import shared_dir

#: A run of what a word boundary of ASCII words lies around.
RUN = "[a-z0-9_]+"
#: Bytes of a row group of the index: the least that a query reads of a term.
ROW_GROUP = 1 << 20
#: Tiers by column of the keyword index, the best first.
TIERS = {"_title": 3, "_kind": 2, "_rest": 1}


#: Suffixes that make another run of a word; 's leaves it whole.
ENDINGS = [s for s in SUFFIXES if s.isalnum()]


def runs(text: Column) -> Column:
    """Distinct terms of a folded text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({RUN})")))


def _in_tier(terms: Column, value: int) -> Column:
    return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(value).cast("tinyint").alias("tier")))


def postings(index: DataFrame) -> DataFrame:
    """(term, id, tier) of a keyword index, each term once an item, with its best tier."""
    found = index.select("id", *[runs(F.col(c)).alias(c) for c in TIERS])
    known, tiers = None, []
    for c, value in TIERS.items():
        own = F.col(c) if known is None else F.array_except(F.col(c), known)
        tiers.append(_in_tier(own, value))
        known = F.col(c) if known is None else F.concat(known, F.col(c))
    return found.select("id", F.explode(F.concat(*tiers)).alias("p")).select("p.term", "id", "p.tier")


def write_postings(index: DataFrame, path: str, partitions: int | None = None) -> None:
    """Clustered by term and id: a term's rows lie in few row groups, a frequent term's in several files. The ranges are sampled from
    rows that are written first, so that texts are taken apart once; these rows are removed in the end."""
    spark, loose = index.sparkSession, f"{path.rstrip('/')}-loose-{uuid.uuid4().hex}"
    postings(index).write.parquet(loose)
    rows = spark.read.parquet(loose)
    ranged = rows.repartitionByRange(partitions, "term", "id") if partitions else rows.repartitionByRange("term", "id")
    ranged.sortWithinPartitions("term", "id").write.mode("errorifexists").option("parquet.block.size", ROW_GROUP).parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(loose)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def built(spark: SparkSession, items: DataFrame, label: str = "postings") -> DataFrame:
    """The postings of items, written below the session's shared folder and read back."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    write_postings(keyword_index(items), path)
    return spark.read.schema("term string, id " + dict(items.dtypes)["id"] + ", tier tinyint").parquet(path)


def keys(term: str) -> list[str]:
    """What the index has of a word that is one run: itself and its forms."""
    return [term, *(term + s for s in ENDINGS)]


def candidates(table: DataFrame, term: str) -> DataFrame | None:
    """(id) of items that have all runs of a word, the last perhaps with a suffix; None if it has no run."""
    found = re.findall(RUN, term)
    if not found:
        return None
    wanted = [*([r] for r in found[:-1]), keys(found[-1])]
    has = [F.max(F.col("term").isin(w)).alias(f"r{n}") for n, w in enumerate(wanted)]
    ids = table.where(F.col("term").isin(sorted({k for w in wanted for k in w}))).groupBy("id").agg(*has)
    return ids.where(" AND ".join(f"r{n}" for n in range(len(wanted)))).select("id")


def posting_scores(table: DataFrame, terms: list[str], index: DataFrame | None = None) -> DataFrame:
    """(id, score) of the items in which every term matches, as keyword_scores() scores them: tiers are summed, repeated terms count
    again. Terms that aren't one run need `index`, the keyword index; only its candidates' texts are matched. Terms without any run
    are sought in all of it, as no key leads to them. One aggregate by id intersects the terms."""
    distinct = list(dict.fromkeys(terms))
    of = {t: keys(t) if re.fullmatch(RUN, t) else [t] for t in distinct}
    plain = sorted({k for t, ks in of.items() if re.fullmatch(RUN, t) for k in ks})
    hits = table.where(F.col("term").isin(plain)).select("term", "id", "tier") if plain else None
    for term in (t for t in distinct if not re.fullmatch(RUN, t)):
        if index is None:
            raise ValueError("words with other characters than letters, digits and _ need the keyword index")
        ids = candidates(table, term)
        rows = index if ids is None else index.join(ids, "id", "left_semi")
        own = rows.select(F.lit(term).alias("term"), "id", tier(term).cast("tinyint").alias("tier")).where("tier > 0")
        hits = own if hits is None else hits.unionByName(own)
    best = hits.groupBy("id").agg(*[F.max(F.when(F.col("term").isin(of[t]), F.col("tier"))).alias(f"t{n}") for n, t in enumerate(distinct)])
    score = F.lit(0)
    for n, t in enumerate(distinct):
        score = score + F.col(f"t{n}") * terms.count(t)
    # null if any term is lacking
    return best.select("id", score.cast("long").alias("score")).where("score is not null")
