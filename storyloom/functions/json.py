"""Column functions on JSON that models write, and walks over typed records."""

from __future__ import annotations

import json as _json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: An escape, or a quote with the first character after it that isn't white space.
_MARKS = re.compile(r'\\.|"(?=\s*(?P<following>\S?))', re.S)


def repair(text: str) -> str:
    """Quotes inside a string value escaped, commas before a closing bracket dropped.

    A fixed rule: a quote closes a string only if the next character that isn't white space is one of
    ``,:}]`` or there is none.
    """
    inside = False

    def mark(m: re.Match) -> str:
        nonlocal inside
        if m[0] != '"':
            return m[0]
        if inside and m["following"] not in ("", ",", ":", "}", "]"):
            return '\\"'
        inside = not inside
        return m[0]

    return re.sub(r",(?=\s*[}\]])", "", _MARKS.sub(mark, text))


def _valid(text: str | None) -> bool:
    try:
        _json.loads(text)
    except (ValueError, TypeError):
        return False
    return True


@F.pandas_udf(T.StringType())
def _repaired(s: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        fixed = repair(text)
        return fixed if _valid(fixed) else None

    return s.map(one)


#: Where the JSON of a reply may be, in the order of trial: as the first group of a pattern, and whether it is
#: mended before it is read. A whole reply, in a fence or not; else from the first brace to the last one.
SPANS = (
    (r"(?s)^\s*(?:```(?:json)?\s*)?(.*?)(?:\s*```)?\s*$", False),
    (r"(?s)^[^{]*(\{.*\})", False),
    (r"(?s)^[^{]*(\{.*\})", True),
)


def spans(reply: str):
    """The texts in a reply that may be its JSON."""
    for pattern, mended in SPANS:
        if found := re.search(pattern, reply):
            yield repair(found[1]) if mended else found[1]


def tolerant_json(reply: Column) -> Column:
    """The JSON in a model's reply as text, or null: the first of its spans that is JSON. Only what the built-in
    parser refuses is handed to the repair, other rows as nulls."""

    def ok(c: Column) -> Column:
        # The parser stops after one value; as an array's only element, it must be the whole text.
        alone = F.concat(F.lit("["), c, F.lit("]"))
        whole = F.try_parse_json(alone).isNotNull() & (F.json_array_length(alone) == 1)
        return F.when(F.try_parse_json(c).isNotNull() & whole, c)

    found = None
    for pattern, mended in SPANS:
        span = F.nullif(F.regexp_extract(reply, "(?U)" + pattern, 1), F.lit(""))
        found = ok(span) if found is None else F.coalesce(found, _repaired(F.when(found.isNull(), span)) if mended else ok(span))
    return found


def leaves(schema: T.StructType, row: Column | None = None) -> Column:
    """Every string in a record as array<struct<path,text>>, in document order, built from the schema.

    Paths read like a.b[0].c; null strings are left out, as are other types.
    """

    def walk(kind: T.DataType, value: Column, path: Column) -> Column | None:
        if isinstance(kind, T.StringType):
            return F.array(F.struct(path.alias("path"), value.alias("text")))
        if isinstance(kind, T.StructType):
            found = [walk(f.dataType, value[f.name], F.concat(path, F.lit(f".{f.name}"))) for f in kind]
            found = [c for c in found if c is not None]
            return F.concat(*found) if found else None
        if isinstance(kind, T.ArrayType):
            if walk(kind.elementType, F.lit(None), path) is None:
                return None
            each = lambda x, i: walk(kind.elementType, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
            return F.coalesce(F.flatten(F.transform(value, each)), F.array().cast("array<struct<path:string,text:string>>"))
        return None

    found = [walk(f.dataType, row[f.name] if row is not None else F.col(f.name), F.lit(f.name)) for f in schema]
    return F.filter(F.concat(*(c for c in found if c is not None)), lambda x: x["text"].isNotNull())


def rewrite(schema: T.StructType, rewrites: str = "rewrites") -> list[Column]:
    """The columns of a record with strings replaced from a map by path; one level of nesting.

    Paths that name no string at the top or one level down are ignored.
    """

    def new(path: str, old: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col(rewrites), F.lit(path)), old)

    out = []
    for f in schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isNotNull(), new(f.name, c))
        elif isinstance(f.dataType, T.StructType):
            for g in f.dataType:
                if isinstance(g.dataType, T.StringType):
                    old = F.col(f.name)[g.name]
                    c = c.withField(g.name, F.when(old.isNotNull(), new(f"{f.name}.{g.name}", old)))
        out.append(c.alias(f.name))
    return out


def set_path(schema: T.StructType, path: str, text: Column) -> Column:
    """The top column of a path like a.b[0].c with the string there replaced."""
    steps = re.findall(r"([^.\[\]]+)|\[(\d+)\]", path)

    def put(value: Column, rest) -> Column:
        if not rest:
            return text
        (name, index), *rest = rest
        if name:
            return value.withField(name, put(value[name], rest))
        return F.transform(value, lambda x, i: F.when(i == int(index), put(x, rest)).otherwise(x))

    return put(F.col(steps[0][0]), steps[1:]).alias(steps[0][0])


def ranked_rows(reply: Column) -> Column:
    """Rows of a triage reply, ``{"ranked": [...]}`` or a bare list, that hold a string id."""
    row = "array<struct<cluster_id:string,score:double,reason:string,explainer_worthy:boolean>>"
    inner = F.from_json(F.get_json_object(reply, "$.ranked"), row)
    bare = F.when(F.ltrim(reply).startswith("["), F.from_json(reply, row))
    rows = F.coalesce(inner, bare, F.array().cast(row))
    return F.filter(rows, lambda r: r.isNotNull() & r["cluster_id"].isNotNull())


def rows_as_json(rows: DataFrame) -> DataFrame:
    """(j): each row as a JSON object that keeps its nulls, in the order of the rows."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
