"""V1 by the schema document: a JSON Schema is read as data and compiled to one column over VARIANT, evaluated within the row,
each value and its type once.

Draft 7's rules on types, objects, arrays, strings and numbers, their combinations, and references within the document. Formats
are remarks, as for a validator without format checker, unless they are asked for. A keyword that isn't known, and a schema that
refers to itself, raise ValueError when compiled: nothing is left unchecked silently.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords that say nothing about a value; shapes of formats.
REMARKS = ["$schema", "$id", "$comment", "title", "description", "default", "examples", "definitions", "format", "readOnly", "writeOnly"]
FORMATS = {
    "date": r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])$",
    "date-time": r"(?i)^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?(?:Z|[+\-](?:[01]\d|2[0-3]):[0-5]\d)$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>\"{}|\\^`]*$",
}
FOUND = "array<struct<path:string,rule:string,said:string>>"
NUMBERS = r"^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"
#: Keywords whose rule says one thing of a value; those that may say many.
ONE = frozenset("type enum const anyOf oneOf not minItems maxItems minLength maxLength pattern format minimum maximum exclusiveMinimum exclusiveMaximum".split())
MANY = frozenset("allOf required properties additionalProperties items".split())


def pointed(schema: dict, pointer: str) -> dict:
    """The part of a document that a reference like #/definitions/item names."""
    if not pointer.startswith("#"):
        raise ValueError(f"only references within the document: {pointer}")
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer[1:].split("/")[1:]]
    return reduce(lambda s, p: s[p], parts, schema)


class _Value(NamedTuple):
    """A value and its type, each evaluated once and bound as a variable of a lambda."""

    v: Column
    kind: Column


class _Compiler:
    """Columns of one schema document. A rule gives one struct that is null where it holds, or an array of them where it looks into
    the value. Each rule looks at values of its own type only, so that a wrong type is told once."""

    def __init__(self, document: dict, formats: bool):
        self.document, self.formats = document, formats

    def found(self, v: Column, path: Column, schema: dict | bool, within: tuple[str, ...] = ()) -> Column:
        """An array of what is wrong with the variant v, null where it is absent, at path."""
        if isinstance(schema, dict) and "$ref" in schema:
            if schema["$ref"] in within:
                raise ValueError(f"{schema['$ref']} refers to itself")
            return self.found(v, path, pointed(self.document, schema["$ref"]), (*within, schema["$ref"]))
        if schema is True or schema == {}:
            return _none()
        there = F.filter(F.array(F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind"))), lambda e: e["v"].isNotNull())
        return F.flatten(F.transform(there, lambda e: self._told(_Value(e["v"], e["kind"]), path, schema, within)))

    def _told(self, x: _Value, path: Column, schema: dict | bool, within: tuple[str, ...]) -> Column:
        if schema is False:
            return F.array(_one(F.lit(True), path, "false", "nothing is allowed here"))
        ones, many = [], []
        for keyword, wanted in schema.items():
            if keyword in REMARKS and not (keyword == "format" and self.formats):
                continue
            if keyword not in ONE | MANY:
                raise ValueError(f"the keyword {keyword} isn't known")
            rule = getattr(self, "_" + keyword)
            (ones if keyword in ONE else many).append(rule(x, path, wanted, schema, within))
        plain = [F.array_compact(F.array(*ones))] if ones else []
        return F.concat(_none(), *plain, *many)

    def _fits(self, x: _Value, schema: dict | bool, within: tuple[str, ...]) -> Column:
        return F.size(self.found(x.v, F.lit(""), schema, within)) == 0

    # -- any value --
    def _type(self, x, path, wanted, schema, within):
        names = [wanted] if isinstance(wanted, str) else wanted
        return _one(~_any([_is(x, n) for n in names]), path, "type", " or ".join(names))

    def _enum(self, x, path, wanted, schema, within):
        return _one(~_any([_equals(x, w) for w in wanted]), path, "enum", "not one of the values")

    def _const(self, x, path, wanted, schema, within):
        return _one(~_equals(x, wanted), path, "const", json.dumps(wanted))

    def _allOf(self, x, path, wanted, schema, within):  # noqa: N802  named like their keywords
        return F.concat(*[self.found(x.v, path, s, within) for s in wanted])

    def _anyOf(self, x, path, wanted, schema, within):  # noqa: N802
        return _one(~_any([self._fits(x, s, within) for s in wanted]), path, "anyOf", "none fits")

    def _oneOf(self, x, path, wanted, schema, within):  # noqa: N802
        fitting = reduce(lambda a, b: a + b, [self._fits(x, s, within).cast("int") for s in wanted])
        return _one(fitting != 1, path, "oneOf", "not exactly one fits")

    def _not(self, x, path, wanted, schema, within):
        return _one(self._fits(x, wanted, within), path, "not", "fits what it must not")

    # -- objects --
    def _required(self, x, path, wanted, schema, within):
        each = [_one(_is(x, "object") & _member(x, k).isNull(), path, "required", k) for k in wanted]
        return F.array_compact(F.array(*each).cast(FOUND))

    def _properties(self, x, path, wanted, schema, within):
        each = [self.found(_member(x, k), F.concat(path, F.lit(f"/{k}")), s, within) for k, s in wanted.items()]
        return F.when(_is(x, "object"), F.concat(_none(), *each)).otherwise(_none())

    def _additionalProperties(self, x, path, wanted, schema, within):  # noqa: N802
        if wanted is True:
            return _none()
        known = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
        members = F.coalesce(F.map_entries(_if(x, "object").cast("map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
        others = F.filter(members, lambda e: ~F.array_contains(known, e["key"]))
        if wanted is False:
            names = F.array_join(F.array_sort(F.transform(others, lambda e: e["key"])), ", ")
            return F.array_compact(F.array(_one(names != "", path, "additionalProperties", names)))
        return F.flatten(F.transform(others, lambda e: self.found(e["value"], F.concat(path, F.lit("/"), e["key"]), wanted, within)))

    # -- arrays --
    def _items(self, x, path, wanted, schema, within):
        if isinstance(wanted, list):
            raise ValueError("one schema for all of an array's elements")
        each = F.transform(_elements(x), lambda e, i: self.found(e, F.concat(path, F.lit("/"), i.cast("string")), wanted, within))
        return F.coalesce(F.flatten(each), _none())

    def _minItems(self, x, path, wanted, schema, within):  # noqa: N802
        return _one(F.size(_elements(x)) < wanted, path, "minItems", str(wanted))

    def _maxItems(self, x, path, wanted, schema, within):  # noqa: N802
        return _one(F.size(_elements(x)) > wanted, path, "maxItems", str(wanted))

    # -- strings --
    def _minLength(self, x, path, wanted, schema, within):  # noqa: N802
        return _one(F.length(_string(x)) < wanted, path, "minLength", str(wanted))

    def _maxLength(self, x, path, wanted, schema, within):  # noqa: N802
        return _one(F.length(_string(x)) > wanted, path, "maxLength", str(wanted))

    def _pattern(self, x, path, wanted, schema, within):
        return _one(~_string(x).rlike(wanted), path, "pattern", wanted)

    def _format(self, x, path, wanted, schema, within):
        if wanted not in FORMATS:
            raise ValueError(f"the format {wanted} isn't known")
        return _one(~_string(x).rlike(FORMATS[wanted]), path, "format", wanted)

    # -- numbers --
    def _minimum(self, x, path, wanted, schema, within):
        return _one(_number(x) < wanted, path, "minimum", str(wanted))

    def _maximum(self, x, path, wanted, schema, within):
        return _one(_number(x) > wanted, path, "maximum", str(wanted))

    def _exclusiveMinimum(self, x, path, wanted, schema, within):  # noqa: N802
        return _one(_number(x) <= wanted, path, "exclusiveMinimum", str(wanted))

    def _exclusiveMaximum(self, x, path, wanted, schema, within):  # noqa: N802
        return _one(_number(x) >= wanted, path, "exclusiveMaximum", str(wanted))


def _none() -> Column:
    return F.array().cast(FOUND)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _one(wrong: Column, path: Column, rule: str, said: str | Column) -> Column:
    """Null where it holds, and where the rule doesn't apply."""
    return F.when(wrong, F.struct(path.alias("path"), F.lit(rule).alias("rule"), (F.lit(said) if isinstance(said, str) else said).alias("said")))


def _is(x: _Value, name: str) -> Column:
    """Whether a variant has a type; whole numbers are integers however they are written."""
    tests: dict[str, Callable[[], Column]] = {
        "object": lambda: x.kind.startswith("OBJECT"), "array": lambda: x.kind.startswith("ARRAY"), "string": lambda: x.kind == "STRING",
        "boolean": lambda: x.kind == "BOOLEAN", "null": lambda: F.is_variant_null(x.v), "number": lambda: x.kind.rlike(NUMBERS),
        "integer": lambda: x.kind.rlike(NUMBERS) & (_number(x) == F.floor(_number(x))),
    }
    return tests[name]()


def _if(x: _Value, name: str) -> Column:
    return F.when(_is(x, name), x.v)


def _string(x: _Value) -> Column:
    return _if(x, "string").cast("string")


def _number(x: _Value) -> Column:
    return _if(x, "number").cast("double")


def _elements(x: _Value) -> Column:
    return _if(x, "array").cast("array<variant>")


def _member(x: _Value, key: str) -> Column:
    """Null if it is absent, a variant's null if it is null. Paths have no escapes: keys with both quotes are looked up in a map."""
    for quote in "'\"":
        if key and quote not in key:
            return F.try_variant_get(x.v, f"$[{quote}{key}{quote}]", "variant")
    return F.try_element_at(_if(x, "object").cast("map<string,variant>"), F.lit(key))


def _equals(x: _Value, value) -> Column:
    if value is None:
        return _is(x, "null")
    if isinstance(value, bool):
        return F.coalesce(_if(x, "boolean").cast("boolean") == value, F.lit(False))
    if isinstance(value, (int, float)):
        return F.coalesce(_number(x) == float(value), F.lit(False))
    if isinstance(value, str):
        return F.coalesce(_string(x) == value, F.lit(False))
    raise ValueError("only plain values are compared")


def compiled(v: Column, schema: dict, part: str = "#", formats: bool = False) -> Column:
    """array(struct(path, rule, said)) of all that is wrong with a variant by a part of a schema document; paths start with /."""
    return _Compiler(schema, formats).found(v, F.lit(""), pointed(schema, part))


def violations(items: DataFrame, schema: dict, raw: str = "raw", part: str = "#", formats: bool = False) -> DataFrame:
    """(id, path, rule, said): all that is wrong with each item's JSON. Text that is no JSON, and null, is one row of the rule `json`."""
    v = F.try_parse_json(F.col(raw))
    rows = items.select("id", v.alias("_v"))
    bad = F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("rule"), F.lit("not valid JSON").alias("said")))
    return rows.select("id", F.explode(F.when(F.col("_v").isNull(), bad).otherwise(compiled(F.col("_v"), schema, part, formats))).alias("e")).select("id", "e.*")


def conformance(items: DataFrame, schema: dict, raw: str = "raw", part: str = "#", most: int | None = 25, formats: bool = False) -> DataFrame:
    """V1 as report rows (rule, severity, id, message): the first `most` by ord and path and one that counts the rest, or all."""
    v = violations(items.withColumn("id", F.struct("ord", "id")), schema, raw, part, formats)
    rows = v.select("id.ord", F.col("id.id").cast("string").alias("id"), F.concat_ws(" ", F.concat(F.col("path"), F.lit(":")), "rule", "said").alias("message"))
    told = lambda df, i, m: df.select(F.lit("V1").alias("rule"), F.lit("error").alias("severity"), i.alias("id"), m.alias("message"))
    if most is None:
        return told(rows, F.col("id"), F.col("message"))
    rest = rows.agg((F.count(F.lit(1)) - most).alias("n")).where("n > 0")
    shown = rows.orderBy("ord", "message").limit(most)
    return told(shown, F.col("id"), F.col("message")).unionAll(told(rest, F.lit(None).cast("string"), F.concat(F.col("n").cast("string"), F.lit(" more errors not shown"))))
