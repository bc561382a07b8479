"""Exporting a curated table: typed properties of pages, projected to the public fields of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import distinct_ignoring_case, split_list
from lodestone.operators.links import chosen_url, expired

TEXTS = "array<struct<plain_text:string>>"
PROPERTIES = f"map<string,struct<type:string,title:{TEXTS},rich_text:{TEXTS},url:string,select:struct<name:string>,multi_select:array<struct<name:string>>,number:double,date:struct<start:string>>>"
# Names of the properties that become fields.
NAMES = {
    "id": "Item ID", "title": "Title", "summary": "Summary", "itemUrl": "Item URL", "replacement": "Replacement URL", "contentType": "Content Type", "date": "Date",
    "topics": "Topic tags", "locations": "Geography", "croppingSystems": "Cropping systems", "people": "People / orgs", "sourceNewsletter": "Source newsletter",
    "newsletterNo": "Newsletter No.", "doi": "DOI", "publication": "Publication", "citations": "Citations",
}


def property_text(p: Column) -> Column:
    """A property as text by its type; empty texts are none, and other types than text, link, choice and date too."""
    joined = lambda c: F.nullif(F.array_join(F.transform(F.coalesce(p[c], F.array().cast(TEXTS)), lambda x: F.coalesce(x["plain_text"], F.lit(""))), ""), F.lit(""))
    return F.when(p["type"].isin("title", "rich_text"), F.when(p["type"] == "title", joined("title")).otherwise(joined("rich_text"))).when(p["type"] == "url", p["url"]).when(p["type"] == "select", p["select"]["name"]).when(p["type"] == "date", p["date"]["start"])


def property_list(p: Column) -> Column:
    """Names of a multiple choice; no such property: an empty list."""
    return F.coalesce(F.when(p["type"] == "multi_select", F.transform(p["multi_select"], lambda o: o["name"])), F.array().cast("array<string>"))


def property_number(p: Column) -> Column:
    return F.when(p["type"] == "number", p["number"])


def public_items(pages: DataFrame, today: str, run_at: Column) -> DataFrame:
    """The 19 public fields of pages (properties, a JSON string or a map as in PROPERTIES); nothing else gets out. Rows without an
    id are dropped. run_at: the run's time, written as UTC."""
    props = F.from_json("properties", PROPERTIES) if dict(pages.dtypes)["properties"] == "string" else F.col("properties")
    table = pages.select(props.alias("p"))
    p = lambda field: F.try_element_at("p", F.lit(NAMES[field]))
    text = lambda field: property_text(p(field))
    link = chosen_url(text("itemUrl"), text("replacement"))
    stamp = F.date_format(F.to_utc_timestamp(run_at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    out = table.select(
        text("id").alias("id"), text("title").alias("title"), text("summary").alias("summary"), link["url"].alias("url"), link["status"].alias("urlStatus"), text("date").alias("publishDate"),
        text("contentType").alias("contentType"), *[property_list(p(c)).alias(c) for c in ("topics", "locations", "croppingSystems")],
        distinct_ignoring_case(split_list(text("people"))).alias("people"), text("sourceNewsletter").alias("sourceNewsletter"), property_number(p("newsletterNo")).cast("int").alias("newsletterNo"),
        text("doi").alias("doi"), text("publication").alias("publication"), text("citations").alias("citations"), text("date").alias("createdAt"), stamp.alias("updatedAt"),
        expired(text("contentType"), text("date"), today).alias("expired"),
    )
    return out.where(F.coalesce("id", F.lit("")) != "")
