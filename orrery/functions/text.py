"""Column expressions over text: terms, identifiers, snippets, token estimates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Runs of letters and digits in lower case; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda x: x != "")


def split_identifier(name: Column) -> Column:
    """Words of a camel, Pascal, snake, kebab or dotted name, in lower case."""
    spaced = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda x: x != "")


def name_tokens(name: Column, qualified: Column) -> Column:
    """`name word word`, with the words of the qualified name after it."""
    words = F.array_distinct(F.concat(F.array(name), split_identifier(name), F.coalesce(split_identifier(qualified), F.array().cast("array<string>"))))
    return F.array_join(words, " ")


def split_words(text: str) -> list[str]:
    """The splitter of query expansion: underscores, hyphens, camel case and acronyms."""
    out = []
    for part in re.split(r"[_\-\s]+", text):
        out += re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+|[0-9]+", part)
    return [w.lower() for w in out if w]


def snippet(doc: Column, signature: Column, name: Column) -> Column:
    """The first line of the documentation, else at most 120 characters of the signature, else the name."""
    first = F.trim(F.element_at(F.split(doc, "\n"), 1))
    flat = F.trim(F.regexp_replace(signature, r"\s+", " "))
    short = F.when(F.length(flat) > 120, F.concat(F.substring(flat, 1, 120), F.lit("..."))).otherwise(flat)
    return F.coalesce(F.when(first != "", first), F.when(short != "", short), name)


#: A quoted literal (open to the end of the text if not closed), a word, or a sign.
TOKEN = r"\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|`[^`]*(?:`|$)|\w+|[^\s\w]"


def token_estimate(text: Column) -> Column:
    """Words and signs count 1, quoted literals 1 and a quarter of their length, rounded up; null counts 0."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.aggregate(found, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x.rlike("^[\"'`]"), 1 + F.ceil((F.length(x)) / 4)).otherwise(1))


def signature_only(code: Column) -> Column:
    """The text before the first brace, else through the first arrow, else the first line, with white space collapsed."""
    cut = F.when(F.contains(code, F.lit("{")), F.substring_index(code, "{", 1)).when(F.contains(code, F.lit("=>")), F.concat(F.substring_index(code, "=>", 1), F.lit("=>"))).otherwise(F.substring_index(code, "\n", 1))
    return F.trim(F.regexp_replace(cut, r"\s+", " "))
