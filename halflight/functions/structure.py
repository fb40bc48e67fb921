"""Lexical features of line notations for molecules, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token, bracket, ring-label and alphabet patterns.
TOKEN = r"(\[[^\]]+\]|Br|Cl|[BCNOPSFI]|[bcnops])"
BRACKET = r"\[[^\[\]]+\]"
RING_LABEL = r"%[0-9][0-9]|[0-9]"
ALPHABET = r"^[A-Za-z0-9@+\-\[\]()=#$:/\\.%*]+$"
ELEMENT = r"^\[?[0-9]*([A-Z][a-z]?|[a-z]{1,2})"
HALOGENS = ("F", "Cl", "Br", "I")


def _count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def clean_structure(text: Column) -> Column:
    """Trimmed text, or NULL when it is empty or cannot be a well-formed notation."""
    s = F.trim(text)
    bare = F.regexp_replace(s, BRACKET, "")
    wide_labels = F.regexp_count(bare, F.lit("%[0-9][0-9]"))
    narrow = F.regexp_replace(bare, "%[0-9][0-9]", "")
    ok = (
        s.rlike(ALPHABET)
        & ~bare.rlike(r"[\[\]]")
        & (_count_char(bare, "(") == _count_char(bare, ")"))
        & ~bare.rlike(r"^[^(]*\)")
        & (wide_labels % 2 == 0)
    )
    for digit in "0123456789":
        ok = ok & (_count_char(narrow, digit) % 2 == 0)
    return F.when((F.length(s) > 0) & ok, s)


def atom_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def element_of(token: Column) -> Column:
    return F.regexp_extract(token, ELEMENT, 1)


def hetero_count(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: ~F.lower(element_of(t)).isin("c", "h")))


def halogen_count(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: element_of(t).isin(*HALOGENS)))


def ring_count(text: Column) -> Column:
    bare = F.regexp_replace(text, BRACKET, "")
    return (F.regexp_count(bare, F.lit(RING_LABEL)) / 2).cast("int")


def aromatic_count(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t.rlike(r"^(\[[0-9]*)?[bcnops]")))


def branch_count(text: Column) -> Column:
    return _count_char(F.regexp_replace(text, BRACKET, ""), "(")


def component_count(text: Column) -> Column:
    return _count_char(text, ".") + F.lit(1)


def charged_count(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t.rlike(r"^\[.*[+-]")))
