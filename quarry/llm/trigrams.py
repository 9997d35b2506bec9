"""Boolean trigram queries from regexes: what every match of a regex must hold."""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser as parser

#: More literal alternatives than this aren't followed; the query then asks for less.
MOST_STRINGS = 64

#: A query: all of these must hold; each is a set of strings of which one must be there.
Query = list[frozenset[str]]


def _flush(out: Query, strings: set[str]) -> None:
    if strings and all(len(s) >= 3 for s in strings):
        low = {s.lower() for s in strings}
        # where a string is there, so is one that it holds: the longer asks nothing more
        out.append(frozenset(s for s in low if not any(t in s for t in low - {s})))


def _literals(item) -> set[str] | None:
    """The strings that an element can match, if they are few."""
    kind, arg = item
    if kind is op.LITERAL:
        return {chr(arg)}
    if kind is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= 4:
        return {chr(c) for _, c in arg}
    if kind is op.SUBPATTERN:
        return _sequence_literals(arg[3])
    if kind is op.BRANCH:
        all_strings: set[str] = set()
        for branch in arg[1]:
            if (s := _sequence_literals(branch)) is None:
                return None
            all_strings |= s
        return all_strings if len(all_strings) <= MOST_STRINGS else None
    if kind is op.MAX_REPEAT and arg[1] <= 8 and (one := _literals(arg[2][0]) if len(arg[2]) == 1 else _sequence_literals(arg[2])) is not None:
        strings = {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)} if len(one) ** arg[1] <= MOST_STRINGS else None
        return strings
    return None


def _sequence_literals(items) -> set[str] | None:
    strings = {""}
    for item in items:
        if (more := _literals(item)) is None or len(strings) * len(more) > MOST_STRINGS:
            return None
        strings = {a + b for a, b in product(strings, more)}
    return strings


def query(regex: str) -> Query:
    """What is mandatory for a match, in lower case.  An empty query says nothing: scan in full."""
    out: Query = []
    strings = {""}
    for item in parser.parse(regex):
        more = _literals(item)
        if more is not None and len(strings) * len(more) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, more)}
            continue
        _flush(out, strings)
        strings = more if more is not None else {""}
        kind, arg = item
        if more is None and kind is op.SUBPATTERN:  # what stands in a group that must match
            out += [g for g in _inner(arg[3])]
    _flush(out, strings)
    return out


def _inner(items) -> Query:
    out: Query = []
    strings = {""}
    for item in items:
        more = _literals(item)
        if more is not None and len(strings) * len(more) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, more)}
        else:
            _flush(out, strings)
            strings = more if more is not None else {""}
    _flush(out, strings)
    return out


def trigrams(s: str) -> list[str]:
    """Trigrams that together cover the string: end to end, the last one as far back as it must be."""
    return list(dict.fromkeys(s[i : i + 3] for i in [*range(0, len(s) - 2, 3), len(s) - 3]))
