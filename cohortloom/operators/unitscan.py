"""Finding units beside numbers in short texts with a multi-pattern automaton."""

from __future__ import annotations

import re

import ahocorasick

# Spellings of weight units, lower case, and kilograms of one unit.
ALIASES = {
    "kg": ["kg", "kgs", "kilo", "kilos", "kilogram", "kilograms", "kilogramme", "kilogrammes"],
    "lb": ["lb", "lbs", "pound", "pounds", "#"],
    "oz": ["oz", "ozs", "ounce", "ounces"],
    "g": ["g", "gm", "gms", "gr", "grs", "gram", "grams", "gramme", "grammes"],
}
KG_OF = {"kg": 1.0, "lb": 0.45359237, "oz": 0.45359237 / 16, "g": 0.001}

_NUMBER = re.compile(r"\d+(?:[.,]\d+)?")


def build(aliases: dict[str, list[str]] = ALIASES) -> ahocorasick.Automaton:
    """Automaton of all spellings of all units."""
    a = ahocorasick.Automaton()
    for unit, names in aliases.items():
        for name in names:
            a.add_word(name, (name, unit))
    a.make_automaton()
    return a


def scan(text: str | None, automaton: ahocorasick.Automaton) -> tuple[str | None, float | None]:
    """The unit of a text and, for a value in two units (pounds with ounces), the whole value in the first.

    A spelling counts only as a word of its own: no letter stands directly before or after it, a digit may.
    Of spellings that overlap the longest counts; of several the one nearest to the first number, at equal
    distance the one after it. A text without a number but with a unit (a unit column) gives that unit.
    """
    if not text:
        return None, None
    low = text.lower()
    hits: list[tuple[int, int, str]] = []
    for end, (name, unit) in automaton.iter(low):
        a, b = end - len(name) + 1, end + 1
        if name != "#" and (a and low[a - 1].isalpha() or b < len(low) and low[b].isalpha()):
            continue
        if hits and hits[-1][0] >= a:
            hits.pop()
        if not hits or a >= hits[-1][1]:
            hits.append((a, b, unit))
    if not hits:
        return None, None
    numbers = list(_NUMBER.finditer(low))
    if not numbers:
        return hits[0][2], None
    first = numbers[0]
    a, b, unit = min(hits, key=lambda h: (h[0] - first.end() if h[0] >= first.end() else first.start() - h[1] + 0.5, h[0]))
    if unit == "lb" and a >= first.end() and len(numbers) > 1:
        rest = next((u for s, _, u in hits if s >= numbers[1].end()), None)
        if rest == "oz" and b <= numbers[1].start():
            number = lambda m: float(m.group().replace(",", "."))
            return "lb", number(first) + number(numbers[1]) / 16
    return unit, None
