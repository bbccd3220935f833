"""JSON path functions: every step is an argument, a string for a key or a number for a place in an array.

A dotted string is one key.  A value of another type than the function's is
null, never converted; the first argument is JSON text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernlake.errors import SyntaxRefused
from fernlake.functions.types import split_top

Step = str | int


def path(steps: tuple[Step, ...]) -> str:
    out = "$"
    for step in steps:
        if isinstance(step, int):
            out += f"[{step}]"
        else:
            if "'" in step:
                raise ValueError("a key with a quote cannot be looked up")
            out += f"['{step}']"
    return out


def _variant(doc: Column | str, steps: tuple[Step, ...]) -> Column:
    # Only the part at the path is parsed again as a variant, to see its type.
    return F.try_variant_get(F.try_parse_json(doc), path(steps), "variant")


def _typed(doc: Column | str, steps: tuple[Step, ...], kinds: tuple[str, ...], cast: str) -> Column:
    found = _variant(doc, steps)
    kind = F.schema_of_variant(found)
    ok = F.lit(False)
    for k in kinds:
        ok = ok | kind.startswith(k)
    return F.when(ok, F.try_variant_get(found, "$", cast))


def json_get_int(doc, *steps: Step) -> Column:
    return _typed(doc, steps, ("BIGINT",), "bigint")


def json_get_float(doc, *steps: Step) -> Column:
    return _typed(doc, steps, ("BIGINT", "DOUBLE", "DECIMAL"), "double")


def json_get_str(doc, *steps: Step) -> Column:
    return _typed(doc, steps, ("STRING",), "string")


def json_get_bool(doc, *steps: Step) -> Column:
    return _typed(doc, steps, ("BOOLEAN",), "boolean")


def json_get_json(doc, *steps: Step) -> Column:
    """The JSON text at the path, strings with their quotes."""
    return F.to_json(_variant(doc, steps))


json_get = json_get_json


def json_get_array(doc, *steps: Step) -> Column:
    """The elements of the array at the path, as JSON texts."""
    found = _variant(doc, steps)
    items = F.try_variant_get(found, "$", "array<variant>")
    return F.when(F.schema_of_variant(found).startswith("ARRAY"), F.transform(items, lambda v: F.to_json(v)))


def json_as_text(doc, *steps: Step) -> Column:
    """The value at the path as text, strings without quotes; JSON null is null."""
    found = _variant(doc, steps)
    kind = F.schema_of_variant(found)
    return F.when(kind == "STRING", F.try_variant_get(found, "$", "string")).when(kind != "VOID", F.to_json(found))


def json_length(doc, *steps: Step) -> Column:
    """The number of elements of an array or of keys of an object."""
    found = _variant(doc, steps)
    kind, text = F.schema_of_variant(found), F.to_json(found)
    return F.when(kind.startswith("ARRAY"), F.json_array_length(text)).when(kind.startswith("OBJECT"), F.size(F.json_object_keys(text))).cast("bigint")


def json_contains(doc, *steps: Step) -> Column:
    """Whether there is a value, JSON null included, at the path."""
    return F.when(F.col(doc).isNotNull() if isinstance(doc, str) else doc.isNotNull(), _variant(doc, steps).isNotNull())


def json_object_keys(doc, *steps: Step) -> Column:
    return F.json_object_keys(F.to_json(_variant(doc, steps)))


def json_from_scalar(value) -> Column:
    """A scalar as JSON text."""
    return F.regexp_extract(F.to_json(F.to_variant_object(F.array(value))), "^.(.*).$", 1)


#: SQL text of the functions that can stand in a query: name -> kinds of JSON value, type to read.
_SQL = {
    "json_get_int": (("BIGINT",), "bigint"),
    "json_get_float": (("BIGINT", "DOUBLE", "DECIMAL"), "double"),
    "json_get_str": (("STRING",), "string"),
    "json_get_bool": (("BOOLEAN",), "boolean"),
}
CALL = re.compile(r"\bjson_(?:get_(?:int|float|str|bool|json|array)|get|as_text|length|contains|object_keys|from_scalar)\s*\(", re.IGNORECASE)


def rewrite(sql: str) -> str:
    """A query with calls of these functions replaced by built-in expressions."""
    at = 0
    while m := CALL.search(sql, at):
        if sql[: m.start()].count("'") % 2:  # inside a string
            at = m.end()
            continue
        depth, quote, end = 1, "", m.end()
        while depth:
            if end >= len(sql):
                raise SyntaxRefused("a bracket is not closed")
            ch = sql[end]
            if quote:
                quote = "" if ch == quote else quote
            elif ch in "'\"`":
                quote = ch
            elif ch in "([":
                depth += 1
            elif ch in ")]":
                depth -= 1
            end += 1
        name = m[0].rstrip("( \t\n").lower()
        doc, *steps = split_top(sql[m.end() : end - 1])
        put = _expression(name, rewrite(doc), [s[1:-1].replace("''", "'") if s.startswith("'") else int(s) for s in steps])
        sql, at = sql[: m.start()] + put + sql[end:], m.start() + len(put)
    return sql


def _expression(name: str, doc: str, steps: list[Step]) -> str:
    at = "'" + path(tuple(steps)).replace("'", "\\'") + "'"
    value = f"try_variant_get(try_parse_json({doc}), {at}, 'variant')"
    kind = f"schema_of_variant({value})"
    if name in _SQL:
        kinds, cast = _SQL[name]
        return f"(CASE WHEN {' OR '.join(f'{kind} LIKE {k!r}' for k in (x + '%' for x in kinds))} THEN try_variant_get({value}, '$', '{cast}') END)"
    return {
        "json_get": f"to_json({value})",
        "json_get_json": f"to_json({value})",
        "json_get_array": f"(CASE WHEN {kind} LIKE 'ARRAY%' THEN transform(try_variant_get({value}, '$', 'array<variant>'), v -> to_json(v)) END)",
        "json_as_text": f"(CASE WHEN {kind} = 'STRING' THEN try_variant_get({value}, '$', 'string') WHEN {kind} <> 'VOID' THEN to_json({value}) END)",
        "json_length": f"CAST(CASE WHEN {kind} LIKE 'ARRAY%' THEN json_array_length(to_json({value})) WHEN {kind} LIKE 'OBJECT%' THEN size(json_object_keys(to_json({value}))) END AS BIGINT)",
        "json_contains": f"(CASE WHEN {doc} IS NOT NULL THEN {value} IS NOT NULL END)",
        "json_object_keys": f"json_object_keys(to_json({value}))",
        "json_from_scalar": f"regexp_extract(to_json(to_variant_object(array({doc}))), '^.(.*).$', 1)",
    }[name]
