"""Boolean trigram queries of regular expressions: what every match must hold, on lower-cased text.

An expression is parsed to a tree, and each node gets what is known of its matches: all of them where they are few, else
the sets of their beginnings and ends (two characters at most, which is what a trigram over a joint needs) and a query.
A query is a set of alternatives, each a set of trigrams; no alternative's trigrams are all missing from a match. The
query without any condition is {{}}. Where a product of alternatives would be large, the side with fewer conditions is
left out: a query may always ask for less.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

Query = frozenset[frozenset[str]]
ALL: Query = frozenset([frozenset()])
#: Strings of a set, and alternatives of a query, beyond which less is asked; characters of a class that are told apart.
STRINGS, ALTERNATIVES, CLASS = 32, 48, 8
_CLASSES = {"d": "0123456789", "w": None, "s": None, "D": None, "W": None, "S": None, "h": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "e": "\x1b", "0": "\0"}


@dataclass(frozen=True)
class Known:
    """`exact`: all matches, or None; `first` and `last`: beginnings and ends; `need`: a query; all lower-cased."""

    exact: frozenset[str] | None
    first: frozenset[str]
    last: frozenset[str]
    need: Query = ALL


ANY = Known(None, frozenset([""]), frozenset([""]))


def grams(text: str) -> frozenset[str]:
    return frozenset(text[k : k + 3] for k in range(len(text) - 2))


def least(query: Iterable[frozenset[str]]) -> Query:
    """Without alternatives that another one includes."""
    out: list[frozenset[str]] = []
    for q in sorted(set(query), key=len):
        if not any(o <= q for o in out):
            out.append(q)
    return frozenset(out)


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > ALTERNATIVES:
        return max(a, b, key=lambda q: (min(map(len, q)), -len(q)))
    return least(x | y for x in a for y in b)


def either(a: Query, b: Query) -> Query:
    out = least(a | b)
    return out if len(out) <= ALTERNATIVES else ALL


def of_strings(strings: Iterable[str]) -> Query:
    out = least(map(grams, strings))
    return out if len(out) <= ALTERNATIVES else ALL


def opened(k: Known) -> Known:
    """Beginnings, ends and a query in the place of exact matches."""
    if k.exact is None:
        return k
    return Known(None, _few({s[:2] for s in k.exact}), _few({s[-2:] for s in k.exact}), of_strings(k.exact))


def _few(strings: Iterable[str], end: int | None = None) -> frozenset[str]:
    out = frozenset(strings)
    return out if len(out) <= STRINGS else frozenset([""])


def joined(a: Known, b: Known) -> Known:
    if a.exact is not None and b.exact is not None:
        if len(a.exact) * len(b.exact) <= STRINGS:
            exact = frozenset(x + y for x in a.exact for y in b.exact)
            return Known(exact, frozenset(), frozenset())
    if a.exact == frozenset([""]):
        return b
    if b.exact == frozenset([""]):
        return a
    x, y = opened(a), opened(b)
    # What lies over the joint: whole strings of a side where they are known.
    left, right = a.exact or x.last, b.exact or y.first
    need = both(x.need, y.need)
    if len(left) * len(right) <= STRINGS:
        need = both(need, of_strings(p + q for p in left for q in right))
    first = _few({(p + q)[:2] for p in a.exact for q in y.first}) if a.exact and any(len(p) < 2 for p in a.exact) else x.first
    last = _few({(p + q)[-2:] for p in x.last for q in b.exact}) if b.exact and any(len(q) < 2 for q in b.exact) else y.last
    return Known(None, first, last, need)


def chosen(a: Known, b: Known) -> Known:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= STRINGS:
        return Known(a.exact | b.exact, frozenset(), frozenset())
    x, y = opened(a), opened(b)
    return Known(None, _few(x.first | y.first), _few(x.last | y.last), either(x.need, y.need))


EMPTY = Known(frozenset([""]), frozenset(), frozenset())


def repeated(k: Known, low: int, high: int | None) -> Known:
    """`low` to `high` copies: those that must be there, then what is open at the end."""
    if high == 0:
        return EMPTY
    if (low, high) == (0, 1):
        return chosen(EMPTY, k)
    if low == 0:
        return chosen(EMPTY, joined(joined(k, ANY), k))
    out = EMPTY
    for _ in range(min(low, 4)):
        out = joined(out, k)
    if low == high and low <= 4:
        return out
    end = opened(k)
    return joined(joined(out, ANY), Known(None, frozenset([""]), end.last, ALL))


class Parser:
    """Literals, classes, groups, alternation, repetition, anchors and look-around of the syntax Java and Python share."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, n: int = 1) -> str:
        self.at += n
        return self.text[self.at - n : self.at]

    def alternatives(self) -> Known:
        out = self.sequence()
        while self.peek() == "|":
            self.take()
            out = chosen(out, self.sequence())
        return out

    def sequence(self) -> Known:
        out = EMPTY
        while self.peek() and self.peek() not in "|)":
            out = joined(out, self.quantified(self.atom()))
        return out

    def quantified(self, k: Known) -> Known:
        while (c := self.peek()) and c in "*+?{":
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at + 1 : end].partition(",")
                self.at = end + 1
                k = repeated(k, int(low or 0), (int(high) if high else None) if comma else int(low))
            else:
                self.take()
                k = repeated(k, *{"*": (0, None), "+": (1, None), "?": (0, 1)}[c])
            if self.peek() and self.peek() in "?+":  # reluctant or possessive: the same matches or fewer
                self.take()
        return k

    def atom(self) -> Known:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.letters(self.char_class())
        if c == ".":
            return ANY
        if c in "^$":
            return EMPTY
        if c == "\\":
            return self.escape()
        return self.letters({c})

    def group(self) -> Known:
        empty = False
        if self.peek() == "?":
            self.take()
            if self.peek() == ":":
                self.take()
            elif self.text[self.at : self.at + 2] in ("<=", "<!") or self.peek() in "=!":
                empty = True  # look-around: nothing is asked of what it sees
                self.take(2 if self.peek() == "<" else 1)
            elif self.peek() in "P<":
                self.at = self.text.index(">", self.at) + 1
            else:
                end = min(k for k in (self.text.find(")", self.at), self.text.find(":", self.at)) if k >= 0)
                closed = self.text[end] == ")"
                self.at = end + 1
                if closed:
                    return EMPTY  # flags alone; letters are compared without their case anyway
        k = self.alternatives()
        self.take()
        return EMPTY if empty else k

    def escape(self) -> Known:
        c = self.peek()
        if c in "bBAzZG":
            self.take()
            return EMPTY
        if c == "Q":
            end = self.text.find("\\E", self.at)
            end = len(self.text) if end < 0 else end
            words = self.text[self.at + 1 : end]
            self.at = end + 2
            return Known(frozenset([words.lower()]), frozenset(), frozenset())
        if c in _CLASSES or c in "pP" or c.isdigit():
            self.one()
            return ANY
        return self.letters({self.one()})

    def one(self) -> str | None:
        """The character of an escape after its backslash; None for a class of them."""
        c = self.take()
        if c == "x":
            return chr(int(self.take(2), 16))
        if c == "u":
            return chr(int(self.take(4), 16))
        if c in "pP":
            self.at = self.text.index("}", self.at) + 1 if self.peek() == "{" else self.at + 1
            return None
        if c in _CLASSES:
            return None
        return _ESCAPES.get(c, c)

    def char_class(self) -> set[str] | None:
        """The characters of a class; None if they are not listed."""
        if self.peek() == "^":
            self.take()
            while self.peek() != "]" or self.text[self.at - 1] == "^":
                self.take(2 if self.peek() == "\\" else 1)
            self.take()
            return None
        out: set[str] | None = set()
        begin = self.at
        while self.peek() != "]" or self.at == begin:
            c = self.take()
            if c == "[" or c == "&" and self.peek() == "&":
                raise ValueError("nested classes are not read")
            if c == "\\":
                c = self.one()
            if c is None:
                out = None
            elif self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                to = self.take()
                to = self.one() if to == "\\" else to
                if out is not None and to is not None:
                    out |= {chr(k) for k in range(ord(c), ord(to) + 1)}
            elif out is not None:
                out.add(c)
        self.take()
        return out

    @staticmethod
    def letters(chars: set[str] | None) -> Known:
        lowered = None if chars is None else frozenset(c.lower() for c in chars)
        if lowered is None or len(lowered) > CLASS or not all(c.isascii() for c in lowered):
            return ANY
        return Known(lowered, frozenset(), frozenset())


def query(pattern: str) -> Query:
    """The alternatives of trigrams of which every match of `pattern`, lower-cased, holds one whole; ALL without any.

    A letter that is not ASCII counts as any, as its lower case can differ from one library to another.
    """
    parser = Parser(pattern)
    known = parser.alternatives()
    if parser.at < len(pattern):
        raise ValueError(f"a bracket too many at {parser.at} of {pattern}")
    return opened(known).need
