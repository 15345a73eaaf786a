"""Many phrases found in one walk over a text's tokens."""

from __future__ import annotations

import re
from collections import Counter

TOKEN = re.compile("[a-z0-9]+")


def words(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


class Phrases:
    """An automaton over tokens: states are prefixes of phrases, a mismatch falls back to the longest suffix that is one. Phrases without tokens never match."""

    def __init__(self, phrases: list[tuple[str, ...]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]
        for number, phrase in enumerate(phrases):
            state = 0
            for token in phrase:
                if token not in self.next[state]:
                    self.next[state][token] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                state = self.next[state][token]
            if phrase:
                self.ends[state] += (number,)
        self.back = [0] * len(self.next)
        row = list(self.next[0].values())
        while row:  # prefixes by length: a shorter one's fallback is known
            later = []
            for state in row:
                for token, after in self.next[state].items():
                    self.back[after] = self._step(self.back[state], token)
                    self.ends[after] += self.ends[self.back[after]]
                    later.append(after)
            row = later

    def _step(self, state: int, token: str) -> int:
        while state and token not in self.next[state]:
            state = self.back[state]
        return self.next[state].get(token, 0)

    def found(self, tokens: list[str]) -> set[int]:
        """The numbers of the phrases that occur."""
        state, out = 0, set()
        for token in tokens:
            after = self.next[state].get(token)
            state = self._step(state, token) if after is None else after
            if self.ends[state]:
                out.update(self.ends[state])
        return out


class Vocabulary:
    """Distinct tokens with numbers, and phrases in groups, looked up together."""

    def __init__(self, terms: list[str], groups: list[list[str]]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.group = [g for g, phrases in enumerate(groups) for _ in phrases]
        self.phrases, self.groups = Phrases([tuple(words(p)) for phrases in groups for p in phrases]), len(groups)

    def read(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[int]]:
        """A text's length in tokens, (term, times) of the terms it holds, and how many phrases of each group."""
        tokens, hits = words(text), [0] * self.groups
        for p in self.phrases.found(tokens):
            hits[self.group[p]] += 1
        times = Counter(map(self.number.get, tokens))
        times.pop(None, None)
        return len(tokens), sorted(times.items()), hits
