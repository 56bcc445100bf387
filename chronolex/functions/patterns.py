"""Regular expressions from plain lists of words, so that what a pattern knows can be read in its lists."""

from __future__ import annotations

import re
from collections.abc import Iterable


def loose(phrase: str) -> str:
    """The phrase, its blanks being optional and of any width up to one."""
    return "\\s?".join(map(re.escape, phrase.split(" ")))


def one_of(phrases: Iterable[str], *others: str) -> str:
    """Any of the phrases (the longest that fits) or of other patterns."""
    return f"(?:{'|'.join([*map(loose, sorted(phrases, key=lambda p: (-len(p), p))), *others])})"


def maybe(pattern: str) -> str:
    return f"(?:{pattern})?"


def in_order(*patterns: str, gap: str = "\\s?") -> str:
    return gap.join(patterns)


def word_ending(endings: str, letter: str, least: int = 1, most: int = 40) -> str:
    """A word, from its first letter on, of some letters and one of the endings."""
    return f"(?<!{letter}){letter}{{{least},{most}}}{endings}"


def silent(pattern: str) -> str:
    """The pattern with its capturing groups no longer capturing."""
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)
