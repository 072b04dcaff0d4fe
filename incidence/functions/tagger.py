"""Many words found in a text in one pass, by an automaton over all of them."""

from __future__ import annotations

from collections import defaultdict


def lowered(text: str) -> str:
    """Lower case at the same places: a letter whose lower case is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Tagger:
    """Words with notes under kinds, all found in one pass over a text, however many they are; overlapping hits count."""

    def __init__(self):
        self._notes: dict[str, list[tuple[str, object]]] = defaultdict(list)
        self._automaton = None

    def add(self, kind: str, word: str, note: object) -> None:
        if word:
            self._notes[word.lower()].append((kind, note))

    def close(self) -> Tagger:
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for word, notes in self._notes.items():
            self._automaton.add_word(word, (len(word), notes))
        if self._notes:
            self._automaton.make_automaton()
        return self

    def tags(self, low: str) -> dict[str, list[tuple[int, int, object]]]:
        """Kind -> (from, to, note) of every hit in a lower-cased text, by where it ends."""
        out: dict[str, list[tuple[int, int, object]]] = defaultdict(list)
        if self._notes and low:
            for last, (n, notes) in self._automaton.iter(low):
                for kind, note in notes:
                    out[kind].append((last - n + 1, last + 1, note))
        return out
