"""One deterministic automaton for anchors and grammars.

Anchors (literal words, letter case folded) and grammars (small regular expressions that begin with an anchor) are
compiled together: the anchors into the goto and failure links of an Aho-Corasick machine, the grammars by subset
construction into one table of states that goes on where an anchor stood. A text is scanned in overlapping chunks;
anchors are absolute and count once, however chunks overlap. From an anchor the table reads as far as any grammar can,
across the ends of chunks, and tells for each grammar its shortest and its longest match. Nothing is read backwards and
no text is sliced, so time grows with the text.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from collections.abc import Iterable

CHUNK, OVERLAP = 1 << 16, 64  # characters; the overlap is longer than the longest anchor
ASCII = [chr(i) for i in range(128)]
#: Stand for all other letters and digits, blanks, and signs.
LETTER, BLANK, SIGN = "\xe9", "\xa0", "\u2014"
UNIVERSE = [*ASCII, LETTER, BLANK, SIGN]


def symbol(c: str) -> str:
    """The sign of the universe a character counts as."""
    return c if c < "\x80" else LETTER if c.isalnum() else BLANK if c.isspace() else SIGN


def _category(kind, c: str) -> bool:
    word, space, digit = c.isalnum() or c == "_", c.isspace(), c.isdigit()
    return {op.CATEGORY_WORD: word, op.CATEGORY_NOT_WORD: not word, op.CATEGORY_SPACE: space, op.CATEGORY_NOT_SPACE: not space, op.CATEGORY_DIGIT: digit, op.CATEGORY_NOT_DIGIT: not digit}[kind]


def _members(items) -> frozenset[str]:
    out: set[str] = set()
    negate = False
    for kind, value in items:
        if kind is op.NEGATE:
            negate = True
        elif kind is op.LITERAL:
            out.add(chr(value))
        elif kind is op.RANGE:
            out.update(c for c in UNIVERSE if value[0] <= ord(c) <= value[1])
        else:
            out.update(c for c in UNIVERSE if _category(value, c))
    return frozenset(c for c in UNIVERSE if c not in out) if negate else frozenset(out)


class Grammars:
    """The table of states of several grammars; step[state] maps a character to the next state."""

    def __init__(self, grammars: dict[str, str]):
        self.edges: list[list[tuple[frozenset[str] | None, int]]] = [[]]
        ends = {}
        for name, pattern in grammars.items():
            start = self._state()
            self.edges[0].append((None, start))
            ends[self._build(parser.parse(pattern), start)] = name
        self._determine(ends)

    def _state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def _build(self, tree, at: int) -> int:
        """Adds the states that read a parsed expression; the state after it."""
        for kind, value in tree:
            if kind is op.BRANCH:
                end = self._state()
                for way in value[1]:
                    self.edges[self._build(way, at)].append((None, end))
                at = end
            elif kind is op.SUBPATTERN:
                at = self._build(value[3], at)
            elif kind is op.MAX_REPEAT:
                low, high, inner = value
                for _ in range(low):
                    at = self._build(inner, at)
                if high is op.MAXREPEAT:
                    loop = self._state()
                    self.edges[at].append((None, loop))
                    self.edges[self._build(inner, loop)].append((None, loop))
                    at = loop
                else:
                    end = self._state()
                    self.edges[at].append((None, end))
                    for _ in range(high - low):
                        at = self._build(inner, at)
                        self.edges[at].append((None, end))
                    at = end
            else:
                signs = frozenset(chr(value)) if kind is op.LITERAL else _members([(op.NEGATE, None), (op.LITERAL, value)]) if kind is op.NOT_LITERAL else frozenset(UNIVERSE) - {"\n"} if kind is op.ANY else _members(value)
                after = self._state()
                self.edges[at].append((signs, after))
                at = after
        return at

    def _closed(self, states: Iterable[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for signs, to in self.edges[todo.pop()]:
                if signs is None and to not in out:
                    out.add(to)
                    todo.append(to)
        return frozenset(out)

    def _determine(self, ends: dict[int, str]) -> None:
        first = self._closed([0])
        number, todo = {first: 0}, [first]
        self.step: list[dict[str, int]] = []
        self.accepts: list[tuple[str, ...]] = []
        while todo:
            some = todo.pop(0)
            self.accepts.append(tuple(ends[s] for s in some if s in ends))
            moves: dict[str, set[int]] = {}
            for s in some:
                for signs, to in self.edges[s]:
                    for c in signs or ():
                        moves.setdefault(c, set()).add(to)
            row, seen = {}, {}
            for c, to in moves.items():
                key = frozenset(to)
                if key not in seen:
                    closed = self._closed(key)
                    if closed not in number:
                        number[closed] = len(number)
                        todo.append(closed)
                    seen[key] = number[closed]
                row[c] = seen[key]
            self.step.append(row)

    def read(self, text: str, at: int, limit: int | None = None) -> dict[str, tuple[int, int]]:
        """(end of the shortest, end of the longest match) at this place and up to the limit, per grammar that matches."""
        out: dict[str, tuple[int, int]] = {}
        state, step, accepts = 0, self.step, self.accepts
        for i in range(at, len(text) if limit is None else limit):
            c = text[i]
            state = step[state].get(c if c < "\x80" else symbol(c))
            if state is None:
                break
            for name in accepts[state]:
                out[name] = (out[name][0] if name in out else i + 1, i + 1)
        return out


def folded(text: str) -> str:
    """In lower case, sign by sign; the few capitals that grow when folded stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Automaton:
    def __init__(self, anchors: dict[str, Iterable[str]], grammars: dict[str, str]):
        """anchors: kind -> words in lower case; grammars: name -> regular expression."""
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        kinds: dict[str, list[str]] = {}
        for kind, words in anchors.items():
            for w in words:
                kinds.setdefault(w, []).append(kind)
        for w, k in kinds.items():
            self.machine.add_word(w, (w, k))
        self.machine.make_automaton()
        self.read = Grammars(grammars).read

    def anchors(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, anchor, kind) in the whole text in order of start, each once."""
        low = folded(text)
        if len(low) <= CHUNK:
            return sorted((end + 1 - len(w), end + 1, w, k) for end, (w, kinds) in self.machine.iter(low) for k in kinds)
        found = set()
        for at in range(0, len(low), CHUNK - OVERLAP):
            found.update((at + end + 1 - len(w), at + end + 1, w, k) for end, (w, kinds) in self.machine.iter(low[at : at + CHUNK]) for k in kinds)
        return sorted(found)
