"""Values and names read from source text, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATOR_MARKS = r"[-+*/%=<>!&|^~?:]"


def parse_float(text: Column) -> Column:
    """Underscores out; garbage gives 0."""
    plain = F.regexp_replace(text, "_", "")
    return F.coalesce(F.when(plain.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double")), F.lit(0.0))


def parse_char(text: Column) -> Column:
    """The first character between quotes; NUL if there is none."""
    first = F.substring(F.regexp_replace(text, "^'+|'+$", ""), 1, 1)
    return F.when(F.length(first) > 0, first).otherwise(F.lit("\0"))


def node_text(source: Column, start: Column, end: Column) -> Column:
    """The bytes from start to end of a source, as text."""
    return F.decode(F.substring(F.encode(source, "UTF-8"), start + 1, span_length(start, end)), "UTF-8")


def span_length(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0))


def span_is_empty(start: Column, end: Column) -> Column:
    return start >= end


def operator_of(children: Column) -> Column:
    """The first child of up to three bytes that holds an operator mark or is a word operator; `?` if there is none."""
    found = F.filter(children, lambda x: ((F.octet_length(x) <= 3) & x.rlike(OPERATOR_MARKS)) | x.isin("and", "or", "not"))
    return F.coalesce(F.get(found, F.lit(0)), F.lit("?"))


def child_text(fields: Column, name: str) -> Column:
    """The text of a named field, empty if there is none."""
    return F.coalesce(F.try_element_at(fields, F.lit(name)), F.lit(""))


def pattern_name(fields: Column) -> Column:
    return F.coalesce(F.try_element_at(fields, F.lit("pattern")), F.try_element_at(fields, F.lit("name")), F.lit(""))


def type_name(fields: Column) -> Column:
    return F.try_element_at(fields, F.lit("type"))


def has_kind(children: Column, kind: str) -> Column:
    return F.exists(children, lambda x: x == kind)


def has_modifier(modifiers: Column, word: str) -> Column:
    return F.coalesce(F.array_contains(modifiers, word), F.lit(False))


def rust_visibility(children: Column) -> Column:
    return F.when(has_kind(children, "visibility_modifier"), "Public").otherwise("Private")


def java_visibility(modifiers: Column) -> Column:
    return F.when(has_modifier(modifiers, "public"), "Public").when(has_modifier(modifiers, "protected"), "Protected").when(has_modifier(modifiers, "private"), "Private").otherwise("Package")


def is_docstring(text: Column) -> Column:
    return text.startswith('"""') | text.startswith("'" * 3)


def signature(fields: Column, modifiers: Column, visibility: Column) -> Column:
    """name, return_type, is_static, is_async, visibility and no parameters, which have nodes of their own."""
    return F.struct(
        child_text(fields, "name").alias("name"), F.coalesce(F.try_element_at(fields, F.lit("return_type")), F.try_element_at(fields, F.lit("type"))).alias("return_type"),
        has_modifier(modifiers, "static").alias("is_static"), has_modifier(modifiers, "async").alias("is_async"), visibility.alias("visibility"), F.array().cast("array<string>").alias("parameters"),
    )


def uri_text(text: Column) -> Column:
    return F.regexp_replace(text, "^`+|`+$", "")


def leading_integer(text: Column) -> Column:
    """The digits that a literal with a suffix begins with; 0 without any."""
    return F.coalesce(F.regexp_extract(text, "^-?[0-9]+", 0).try_cast("bigint"), F.lit(0).cast("bigint"))


def leading_float(text: Column) -> Column:
    return parse_float(F.regexp_extract(text, r"^-?[0-9.]+([eE][+-]?[0-9]+)?", 0))
