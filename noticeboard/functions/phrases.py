"""Many fixed phrases found in one pass over a text: an Aho-Corasick automaton, built once a worker."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache


def readings(template: str) -> list[str]:
    """The phrases that a template stands for: ``[x]`` may be missing, ``{a|b}`` is one of both. Bars at the ends are kept.

    >>> readings("total [number of ]posts")
    ['total posts', 'total number of posts']
    """
    parts = re.split(r"(\[[^\]]*\]|\{[^}]*\})", template)
    choices = [["", p[1:-1]] if p[:1] == "[" else p[1:-1].split("|") if p[:1] == "{" else [p] for p in parts]
    return ["".join(x) for x in itertools.product(*choices)]


def lowered(text: str) -> str:
    """Lower case with each character in its place: the few that would become two stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := ch.lower()) == 1 else ch for ch in text)


def _inside(text: str, at: int) -> bool:
    """Whether a word goes on over this place."""
    return 0 < at < len(text) and all(c.isalnum() or c == "_" for c in text[at - 1 : at + 1])


class Phrases:
    """Occurrences of phrases in lower-case text; a bar before or behind a phrase asks for a word's boundary there.

    With ``whole`` given, bars are characters like others, and all phrases are whole words or none.
    """

    def __init__(self, phrases: Sequence[str], whole: bool | None = None):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, phrase in enumerate(phrases):
            bare = phrase.strip("|") if whole is None else phrase
            if bare:
                told = self.automaton.get(bare, ())
                ends = (phrase[0] == "|", phrase[-1] == "|") if whole is None else (whole, whole)
                self.automaton.add_word(bare, (*told, (i, len(bare), *ends)))
        self.automaton.make_automaton()

    def occurrences(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, index) of all occurrences, overlapping ones too, by end."""
        if not len(self.automaton):
            return
        for last, found in self.automaton.iter(text):
            end = last + 1
            for i, size, before, behind in found:
                if not (before and _inside(text, end - size) or behind and _inside(text, end)):
                    yield end - size, end, i

    def settled(self, text: str) -> list[tuple[int, int, int]]:
        """Occurrences without overlaps: the leftmost first, the longest of one start, the first listed of equal ones."""
        out, at = [], 0
        for start, end, i in sorted(self.occurrences(text), key=lambda o: (o[0], -o[1], o[2])):
            if start >= at:
                out.append((start, end, i))
                at = end
        return out


@lru_cache(maxsize=16)
def automaton(phrases: tuple[str, ...]) -> Phrases:
    """One a worker for each list."""
    return Phrases(phrases)
