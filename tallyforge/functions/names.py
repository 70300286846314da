"""All names of metrics in one automaton: a text is read once, however many names there are."""

from __future__ import annotations

import ahocorasick

from ..registry import ALIASES, METRICS, SPOKEN


def metric_names() -> dict[str, str]:
    """Every name in lower case and its metric: canonical and shown names, headers, and what questions say; the first meaning holds."""
    names: dict[str, str] = {}
    for m in METRICS:
        names.setdefault(m.name.replace("_", " "), m.name)
        names.setdefault(m.display.lower(), m.name)
    for more in (SPOKEN, ALIASES):
        for name, metric in more.items():
            names.setdefault(name.lower(), metric)
    return names


class Matcher:
    """Finds names as whole words, the longest at each place, none within another."""

    def __init__(self, names: dict[str, str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for name, metric in names.items():
            self.automaton.add_word(name, (len(name), metric))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """start, end, metric of each name, in order."""
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        word = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
        found = []
        for last, (length, metric) in self.automaton.iter(low):
            start, end = last + 1 - length, last + 1
            if not (word(start - 1) and word(start)) and not (word(end - 1) and word(end)):
                found.append((start, end, metric))
        out: list[tuple[int, int, str]] = []
        for span in sorted(found, key=lambda s: (s[0], -s[1])):
            if not out or span[0] >= out[-1][1]:
                out.append(span)
        return out
