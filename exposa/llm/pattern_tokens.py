"""Which whole tokens a regular expression asks for (of op 2).

The parsed expression is read as alternatives; each is a sequence of token characters (lower-cased), SEPARATOR (a place
where no token goes on: a character that is none of a token's, a word boundary, an end of the text) and UNKNOWN (any text).
A run of token characters between two separators stands as a whole token in every text that this alternative fits.

Defined results: an alternative without such a run gives the empty set, and so does an expression of more than
``MOST`` alternatives: its rule cannot be indexed and always runs.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

MOST = 64
SEPARATOR, UNKNOWN = "|", "*"
#: To lower case: A-Z, and the four other characters that match i, k or s where case is ignored.
LOWER = {**{c: c + 32 for c in range(65, 91)}, 0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}
TOKEN = re.compile("[a-z0-9]+")
_TOKEN_CHARACTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz\u0130\u0131\u017f\u212a"
_CATEGORIES = {C.CATEGORY_DIGIT: r"\d", C.CATEGORY_NOT_DIGIT: r"\D", C.CATEGORY_SPACE: r"\s", C.CATEGORY_NOT_SPACE: r"\S",
               C.CATEGORY_WORD: r"\w", C.CATEGORY_NOT_WORD: r"\W"}


def tokens(text: str) -> set[str]:
    return set(TOKEN.findall(text.translate(LOWER)))


class _TooMany(Exception):
    pass


def needed(pattern: str) -> list[frozenset[str]]:
    """For each alternative of the expression the whole tokens that every text it fits holds."""
    parsed = _parser.parse(pattern)
    try:
        found = _sequences(parsed, parsed.state.flags)
    except _TooMany:
        return [frozenset()]
    return sorted({frozenset(_whole(s)) for s in found}, key=sorted)


def _whole(sequence: str) -> list[str]:
    """Runs of token characters with a separator on both sides."""
    return re.findall(r"(?<=\|)[a-z0-9]+(?=\|)", UNKNOWN + sequence + UNKNOWN)


def _joined(heads: set[str], tails: set[str]) -> set[str]:
    if len(heads) * len(tails) > MOST:
        raise _TooMany
    return {re.sub(r"\*\*+", "*", re.sub(r"\|\|+", "|", h + t)) for h in heads for t in tails}


def _sequences(items, flags: int) -> set[str]:
    out = {""}
    for op, value in items:
        out = _joined(out, _item(op, value, flags))
    return out


def _item(op, value, flags: int) -> set[str]:
    if op is C.LITERAL:
        c = chr(value).translate(LOWER)
        return {c if TOKEN.fullmatch(c) else SEPARATOR}
    if op is C.IN:
        return {UNKNOWN if any(_holds(value, c, flags) for c in _TOKEN_CHARACTERS) else SEPARATOR}
    if op is C.AT:
        if value in (C.AT_BOUNDARY, C.AT_NON_BOUNDARY):
            # beside a letter, a boundary has no letter on its other side; ASCII's rule knows fewer letters
            return {SEPARATOR if value is C.AT_BOUNDARY and not flags & re.ASCII else ""}
        return {SEPARATOR}
    if op is C.BRANCH:
        found = set().union(*(_sequences(b, flags) for b in value[1]))
    elif op is C.SUBPATTERN:
        found = _sequences(value[3], (flags | value[1]) & ~value[2])
    elif op is C.ATOMIC_GROUP:
        found = _sequences(value, flags)
    elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = value
        one = _sequences(inner, flags)
        found = {""} if least == 0 else set()
        if least <= 1 <= most:
            found |= one
        if most >= 2:
            found |= _joined(_joined(one, {UNKNOWN}), one)
    elif op in (C.ASSERT, C.ASSERT_NOT):
        found = {""}
    else:  # any character, all but one, what a group matched
        found = {UNKNOWN}
    if len(found) > MOST:
        raise _TooMany
    return found


def _holds(items, c: str, flags: int) -> bool:
    """Whether a class holds the character as it stands."""
    negated = items[0][0] is C.NEGATE
    for op, value in items[negated:]:
        if (op is C.LITERAL and value == ord(c) or op is C.RANGE and value[0] <= ord(c) <= value[1]
                or op is C.CATEGORY and re.fullmatch(_CATEGORIES[value], c, flags & re.ASCII)):
            return not negated
    return negated
