"""Where a quote stands in a text that has it almost word for word: seeds, diagonals, bit-parallel edit distance.

A quote of n characters (white space aside) aligns with a window of the text that is at most
d = floor(n * (1 - coverage)) edits away. Of d + 1 pieces of the quote one stands unchanged in such a window, so
every window lies on the diagonal of such a seed, give or take d; only there distances are computed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

NUMBERS = re.compile(r"[0-9]+")


class Quote(NamedTuple):
    """A quote without its white space, the edits that are allowed, and its pieces as (offset, piece)."""

    text: str
    edits: int
    seeds: list[tuple[int, str]]
    numbers: list[str]


class Window(NamedTuple):
    """Code points from 0 of the text as it stands, and the edits."""

    start: int
    end: int
    edits: int


def prepared(quote: str | None, coverage: float, min_chars: int) -> Quote | None:
    """None for a quote that is null or too short to be told from others."""
    text = "".join((quote or "").split())
    if len(text) < max(min_chars, 1):
        return None
    edits = int(len(text) * (1 - coverage) + 1e-9)
    size = len(text) // (edits + 1)
    # Seeds have one length; the characters between a seed and the next piece are free.
    return Quote(text, edits, [(len(text) * k // (edits + 1), text[len(text) * k // (edits + 1) :][:size]) for k in range(edits + 1)], NUMBERS.findall(text))


def bare(text: str) -> tuple[str, list[int]]:
    """The text without white space, and where each of its characters stands."""
    at = [k for k, c in enumerate(text) if not c.isspace()]
    return "".join(text[k] for k in at), at


def distances(pattern: str, text: str, anchored: bool) -> Iterator[int]:
    """Edit distance of the whole pattern to a stretch of the text that ends at each character, a column of the matrix in one integer.

    The stretch begins anywhere, or with the text where it is anchored.
    """
    equal: dict[str, int] = {}
    for k, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << k
    full, top, score = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1), len(pattern)
    up, down = full, 0
    for c in text:
        same = equal.get(c, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(horizontal | up)), up & horizontal
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 | anchored, less << 1
        up, down = (less | ~(vertical | more)) & full, more & vertical & full
        yield score


def diagonals(quote: Quote, text: str) -> list[tuple[int, int]]:
    """Stretches of the text that windows can lie in: around the diagonals of the seeds, those that overlap as one."""
    found = set()
    for offset, seed in quote.seeds:
        at = text.find(seed)
        while at >= 0:
            found.add(at - offset)
            at = text.find(seed, at + 1)
    return stretches(quote, sorted(found), len(text))


def stretches(quote: Quote, found: list[int], length: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for d in found:
        a, b = max(d - quote.edits, 0), min(d + len(quote.text) + quote.edits, length)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def candidates(quote: Quote, text: str, within: list[tuple[int, int]]) -> Iterator[Window]:
    """For each end the shortest window of the fewest edits, in the bare text."""
    for a, b in within:
        for k, edits in enumerate(distances(quote.text, text[a:b], False)):
            if edits > quote.edits:
                continue
            end = a + k + 1
            back = text[max(end - len(quote.text) - edits, 0) : end][::-1]
            lengths = distances(quote.text[::-1], back, True)
            yield Window(end - next(n for n, e in enumerate(lengths, 1) if e == edits), end, edits)


def best(quote: Quote, text: str, at: list[int], original: str, within: list[tuple[int, int]], one_line: bool, counted: re.Pattern | None, tail: re.Pattern | None) -> Window | None:
    """The window of the fewest edits, then the first, whose numbers are those of the quote, whole ones.

    one_line: it may not run over a line's end unless the quote does (its line ends are gone by then, so never).
    counted: as many matches in the window, with what ``tail`` matches behind it, as in the quote.
    """
    found = []
    for w in candidates(quote, text, within):
        if NUMBERS.findall(text[w.start : w.end]) != quote.numbers:
            continue
        # A number that goes on outside the window is another number.
        if (w.start and text[w.start - 1].isdecimal() and text[w.start].isdecimal()) or (w.end < len(text) and text[w.end - 1].isdecimal() and text[w.end].isdecimal()):
            continue
        whole = Window(at[w.start], at[w.end - 1] + 1, w.edits)
        if one_line and "\n" in original[whole.start : whole.end]:
            continue
        if counted:
            rest = tail.match(original, whole.end) if tail else None
            said = text[w.start : w.end] + ("".join(rest[0].split()) if rest else "")
            if len(counted.findall(said)) != len(counted.findall(quote.text)):
                continue
        found.append(whole)
    return min(found, key=lambda w: (w.edits, w.end), default=None)
