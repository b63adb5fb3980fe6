"""Bounds of nested JSON, and what breaks them first.

A description (Text, Items, Record) is compiled to one expression over a VARIANT column, which gives the
first broken rule in the order of the description, as (path, problem), or null. The same description checks a
Python value, for what is held in a task. Both say the same; fields that a description doesn't name are free.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BROKEN = "struct<path:string,problem:string>"


@dataclass(frozen=True)
class Text:
    most: int | None = None  #: characters
    one_of: tuple[str, ...] = ()
    optional: bool = False


@dataclass(frozen=True)
class Items:
    of: "Text | Items | Record"
    least: int = 0
    most: int | None = None
    optional: bool = False


@dataclass(frozen=True)
class Record:
    fields: dict[str, "Text | Items | Record"]
    optional: bool = False


#: What a kind of value is called, and how the type of a VARIANT that has it begins.
KINDS = {Text: ("text", "STRING"), Items: ("a list", "ARRAY<"), Record: ("an object", "OBJECT<")}


def first_problem(spec: Text | Items | Record, value: Column, path: Column | None = None) -> Column:
    """The first broken rule of a VARIANT column; null if it keeps all. A null column (no JSON) is missing."""
    path = F.lit("") if path is None else path
    broken = lambda *parts: F.struct(path.alias("path"), F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)).alias("problem"))
    name, start = KINDS[type(spec)]
    kind = F.schema_of_variant(value)
    found = [F.when(~kind.startswith(start), broken(f"must be {name}"))]
    if isinstance(spec, Text):
        text = F.try_variant_get(value, "$", "string")
        if spec.most is not None:
            found.append(F.when(F.length(text) > spec.most, broken("has ", F.length(text).cast("string"), f" characters, at most {spec.most} may be")))
        if spec.one_of:
            found.append(F.when(~text.isin(*spec.one_of), broken("must be one of: " + ", ".join(spec.one_of))))
    elif isinstance(spec, Items):
        items = F.try_variant_get(value, "$", "array<variant>")
        n = F.size(items)
        if spec.least:
            found.append(F.when(n < spec.least, broken("has ", n.cast("string"), f" items, at least {spec.least} must be")))
        if spec.most is not None:
            found.append(F.when(n > spec.most, broken("has ", n.cast("string"), f" items, at most {spec.most} may be")))
        inner = F.transform(items, lambda x, i: first_problem(spec.of, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.get(F.filter(inner, lambda x: x.isNotNull()), F.lit(0)))
    else:
        for field, own in spec.fields.items():
            below = F.concat(path, F.when(path == "", "").otherwise("."), F.lit(field))
            found.append(first_problem(own, F.try_variant_get(value, f"$['{field}']", "variant"), below))
    missing = F.lit(None).cast(BROKEN) if spec.optional else broken("is missing")
    return F.when(value.isNull(), missing).otherwise(F.coalesce(*found))


MISSING = object()


def problem_of(spec: Text | Items | Record, value, path: str = "") -> tuple[str, str] | None:
    """first_problem() of a value as Python's parser gives it."""
    if value is MISSING:
        return None if spec.optional else (path, "is missing")
    if not isinstance(value, {Text: str, Items: list, Record: dict}[type(spec)]):
        return path, f"must be {KINDS[type(spec)][0]}"
    if isinstance(spec, Record):
        below = ((own, value.get(field, MISSING), f"{path}.{field}" if path else field) for field, own in spec.fields.items())
        return next((p for x in below if (p := problem_of(*x))), None)
    n, unit = len(value), "characters" if isinstance(spec, Text) else "items"
    if n < getattr(spec, "least", 0):
        return path, f"has {n} items, at least {spec.least} must be"
    if spec.most is not None and n > spec.most:
        return path, f"has {n} {unit}, at most {spec.most} may be"
    if isinstance(spec, Items):
        return next((p for k, x in enumerate(value) if (p := problem_of(spec.of, x, f"{path}[{k}]"))), None)
    return (path, "must be one of: " + ", ".join(spec.one_of)) if spec.one_of and value not in spec.one_of else None


def complaint(spec: Text | Items | Record, value) -> str | None:
    """What is wrong with a value, in words."""
    found = problem_of(spec, value)
    return found and f"{found[0] or 'the whole'} {found[1]}"
