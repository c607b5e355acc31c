"""Alternating tokenisation: the text between matches, and the matches."""

from __future__ import annotations

import re

from .expr import Expr, S, expr


def tokenize(text: str, pattern: str) -> list[str]:
    """Split a rule string on the driver; even items lie between matches, odd items match."""
    pieces, end = [], 0
    for match in re.finditer(pattern, text):
        pieces += [text[end : match.start()], match.group()]
        end = match.end()
    return pieces + [text[end:]]


def tokenized(text: Expr | str, pattern: str) -> Expr:
    """The same for a column, as ``ARRAY<STRING>``.

    The pattern must not match the empty string.
    """
    text = expr(text)
    matches = S.regexp_extract_all(text, pattern, 0)
    between = S.split(text, pattern, -1)
    pairs = S.zip_with(
        between, matches, lambda gap, hit: S.when(hit.is_null(), S.array(gap)).otherwise(S.array(gap, hit))
    )
    return S.flatten(pairs)
