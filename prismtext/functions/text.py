"""Text measures and extraction as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def estimate_tokens(text: Column) -> Column:
    """Words times 1.25, cut to a whole number."""
    return F.floor(F.regexp_count(text, F.lit(r"(?U)\S+")) * 1.25).cast("int")


def _some(text: Column) -> Column:
    return F.when(text != "", text)


def user_text(messages: Column, last: Column, query: Column, prompt: Column, given: Column) -> Column:
    """The first that is not empty: the last message, the last statement, query, prompt, input; else the empty text."""
    return F.coalesce(_some(F.try_element_at(messages, F.lit(-1))["content"]), _some(last), _some(query), _some(prompt), _some(given), F.lit(""))


def search_text(messages: Column, last: Column) -> Column:
    """The text to search by: the last statement, else the last message; null if there is neither.

    A payload that is no object is searched by as it is: cast it to a string.
    """
    return F.coalesce(_some(last), _some(F.try_element_at(messages, F.lit(-1))["content"]))


def search_text_of(payload: Column) -> Column:
    """The text to search by of a payload as JSON text: of an object as ``search_text`` has it (null where it has none), else the payload as it stands."""
    value = F.try_parse_json(payload)
    messages = F.try_variant_get(value, "$.messages", "array<struct<role string, content string>>")
    last = F.try_variant_get(value, "$.user_last_statement", "string")
    return F.when(F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)), search_text(messages, last)).otherwise(payload)
