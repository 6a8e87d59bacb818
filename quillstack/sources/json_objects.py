"""The first JSON object of a text, found in time that grows with the text and not with its braces."""

from __future__ import annotations

import json
import re

_MARKS = re.compile(r'["{}\\]')
#: Objects that nest deeper are no JSON here, as Spark's parser has it.
DEEPEST = 1000


class _Level:
    """Braces that are open at one depth, and how deep what they hold nests."""

    __slots__ = ("inner", "starts")

    def __init__(self, start: int):
        self.starts, self.inner = [start], 0


def _joined(a: list[_Level], b: list[_Level]) -> list[_Level]:
    """Two stacks as one, level by level from the innermost."""
    if len(a) < len(b):
        a, b = b, a
    for n in range(1, len(b) + 1):
        a[-n].starts += b[-n].starts
        a[-n].inner = max(a[-n].inner, b[-n].inner)
    return a


def balanced(text: str) -> dict[int, int]:
    """Of each brace that has a partner, the end of what they enclose; nested too deep doesn't count.

    Each brace is read as if the text began there, so a quote before it is none of its business. Wherever readings that
    began at different braces are, they are outside a string, inside one, or behind a backslash in one; those in the same
    state go on alike. So three stacks of open braces are kept, which change places at quotes, and one pass is enough.
    """
    outside: list[_Level] = []
    inside: list[_Level] = []
    escaped: list[_Level] = []
    after, ends = -1, {}
    for m in _MARKS.finditer(text):
        at, c = m.start(), m.group()
        if escaped and at != after:
            inside, escaped = _joined(inside, escaped), []
        if c == '"':
            outside, inside, escaped = inside, _joined(outside, escaped), []
        elif c == "\\":
            inside, escaped, after = escaped, inside, at + 1
        else:
            inside, escaped = _joined(inside, escaped) if escaped else inside, []
            if c == "{":
                outside.append(_Level(at))
            elif outside:
                level = outside.pop()
                if level.inner < DEEPEST:
                    ends.update(dict.fromkeys(level.starts, at + 1))
                if outside:
                    outside[-1].inner = max(outside[-1].inner, level.inner + 1)
    return ends


def _no_constant(name: str):
    raise ValueError(name)


def _distinct(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key twice")
    return found


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_int=str, object_pairs_hook=_distinct)


def _open_at(text: str, start: int, stop: int) -> set[int]:
    """The braces that are open just before stop, read from start."""
    opened, quoted, skip = [], False, -1
    for m in _MARKS.finditer(text, start, stop):
        at, c = m.start(), m.group()
        if at == skip:
            continue
        if c == '"':
            quoted = not quoted
        elif c == "\\":
            skip = at + 1 if quoted else -1
        elif not quoted:
            opened.append(at) if c == "{" else opened and opened.pop()
    return set(opened)


def first_object(text: str) -> str | None:
    """The text of the first JSON object, from the first brace at which one begins. None without one.

    Where parsing fails at some place, so does every object that is open there; those are not tried again.
    """
    failing: set[int] = set()
    for start in sorted(balanced(text)) if "{" in text else ():
        if start not in failing:
            try:
                return text[start : _DECODER.raw_decode(text, start)[1]]
            except json.JSONDecodeError as e:
                failing |= _open_at(text, start, e.pos)
            except (ValueError, RecursionError):  # a key twice, no number, or nested in arrays too deep
                continue
    return None
