"""Guess cost of a string: its cheapest segmentation into words, dates, repeats, keyboard walks and brute force.

Costs are common logarithms of the number of guesses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, log10

LEAST_WORD, LONGEST_WORD = 3, 24
KINDS = 5
START = log10(KINDS)  # to name the kind of a segment
THIS_YEAR, YEARS = 2020, 20  # dates are guessed outwards from here
LONGEST_PERIOD = 8

# Rows of a US keyboard, plain and shifted, each row half a key to the right of the one above it.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", "QWERTYUIOP{}|", 'ASDFGHJKL:"', "ZXCVBNM<>?")
INDENT = (0, 1, 1, 1)
# Letters that other signs stand for.
LOOKALIKE = str.maketrans({"4": "a", "@": "a", "3": "e", "1": "l", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t"})

KEY: dict[str, tuple[int, int]] = {}
for _y, (_plain, _shift, _indent) in enumerate(zip(ROWS, SHIFTED, INDENT, strict=True)):
    for _x, _pair in enumerate(zip(_plain, _shift, strict=True)):
        KEY |= {c: (_x + _indent, _y) for c in _pair}
SHIFT = set("".join(SHIFTED))
STEPS = {(-1, 0), (1, 0), (0, 1), (-1, 1), (0, -1), (1, -1)}
KEYS, DEGREE = sum(map(len, ROWS)), 4.6  # keys, and neighbours of a key on average

DATES = (
    (re.compile(r"(?=((?:19|20)\d\d)([-/._]?)(\d\d)\2(\d\d))"), (1, 3, 4)),
    (re.compile(r"(?=(\d\d)([-/._]?)(\d\d)\2((?:19|20)\d\d))"), (4, 3, 1)),
    (re.compile(r"(?=(\d\d)([-/._]?)(\d\d)\2(\d\d))"), (4, 3, 1)),
)
YEAR = re.compile(r"(?=((?:19|20)\d\d))")


@dataclass(frozen=True)
class Segment:
    start: int
    end: int
    kind: str
    cost: float


def brute(c: str) -> float:
    if c.isdigit() and c.isascii():
        return 1.0
    return log10(26) if c.isascii() and c.isalpha() else log10(33) if c.isascii() else 2.0


def case_cost(word: str) -> float:
    """Ways to place as many capitals: none, the first only and all are guessed first."""
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    if upper == len(word) or (upper == 1 and word[0].isupper()):
        return log10(2)
    return log10(sum(comb(len(word), k) for k in range(1, min(upper, len(word) - upper) + 1)) or 2)


def folded(value: str) -> tuple[str, str]:
    """The value in lower case, and with letters in place of signs that look alike; both of its length."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    return low, low.translate(LOOKALIKE)


def spellings(value: str) -> Iterator[str]:
    """All substrings that a dictionary might hold."""
    for text in dict.fromkeys(folded(value)):
        for run in re.finditer(r"[^\W\d_]+", text):
            s = run.group()
            for i in range(len(s) - LEAST_WORD + 1):
                for n in range(LEAST_WORD, min(LONGEST_WORD, len(s) - i) + 1):
                    yield s[i : i + n]


def word_segments(value: str, words: dict[str, float]) -> Iterator[Segment]:
    low, alike = folded(value)
    longest = max(map(len, words), default=0)
    for i in range(len(value) if words else 0):
        for n in range(LEAST_WORD, min(longest, len(value) - i) + 1):
            for text in (low, alike):
                cost = words.get(text[i : i + n])
                if cost is not None:
                    swapped = sum(a != b for a, b in zip(low[i : i + n], text[i : i + n], strict=True))
                    yield Segment(i, i + n, "word", cost + case_cost(value[i : i + n]) + swapped * log10(2))
                if low == alike:
                    break


def date_segments(value: str) -> Iterator[Segment]:
    for pattern, (y, m, d) in DATES:
        for hit in pattern.finditer(value):
            year, month, day = int(hit[y]), int(hit[m]), int(hit[d])
            year += (1900 if year > THIS_YEAR % 100 + 10 else 2000) if year < 100 else 0
            if min(month, day) >= 1 and min(month, day) <= 12 and max(month, day) <= 31:
                length = len(hit[1]) + len(hit[3]) + len(hit[4]) + 2 * len(hit[2])
                cost = log10(365 * max(abs(year - THIS_YEAR), YEARS)) + (log10(4) if hit[2] else 0)
                yield Segment(hit.start(), hit.start() + length, "date", cost)
    for hit in YEAR.finditer(value):
        yield Segment(hit.start(), hit.start() + 4, "date", log10(max(abs(int(hit[1]) - THIS_YEAR), YEARS)))


def repeat_segments(value: str, words: dict[str, float]) -> Iterator[Segment]:
    """Longest repeats of a unit, priced as the unit and the number of times."""
    n = len(value)
    for p in range(1, min(LONGEST_PERIOD, n // 2) + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and value[j] == value[j + p]:
                j += 1
            if j + p - i >= max(2 * p, 3):
                for first in range(i, min(i + p, j - p + 1)):
                    times = (j + p - first) // p
                    if times >= 2 and times * p >= 3:
                        unit = segment(value[first : first + p], words, repeats=False)[0]
                        yield Segment(first, first + times * p, "repeat", unit + log10(times))
            i = max(j, i + 1)


def walk_segments(value: str) -> Iterator[Segment]:
    """Longest runs over neighbouring keys, priced by start, length and turns."""
    i, n = 0, len(value)
    while i < n - 2:
        j, turns, last = i, 0, None
        while j + 1 < n and value[j] in KEY and value[j + 1] in KEY:
            (x, y), (u, v) = KEY[value[j]], KEY[value[j + 1]]
            if (u - x, v - y) not in STEPS:
                break
            turns += (u - x, v - y) != last
            last, j = (u - x, v - y), j + 1
        if j - i >= 2:
            length = j - i + 1
            ways = sum(log10((length - k) / (k + 1)) for k in range(min(turns - 1, length - turns)))
            shifted = sum(c in SHIFT for c in value[i : j + 1])
            case = log10(2) if shifted else 0.0
            yield Segment(i, j + 1, "walk", log10(KEYS * length) + turns * log10(DEGREE) + max(ways, 0) + case)
        i = max(j, i + 1)


def segment(value: str, words: dict[str, float], repeats: bool = True) -> tuple[float, list[Segment]]:
    """(log10 guesses, segments) of the cheapest way to spell the value; ties go to the earliest found.

    `words` gives the cost of known words in lower case. Equal strings cost the same anywhere.
    """
    n = len(value)
    ends: list[list[Segment]] = [[] for _ in range(n + 1)]
    found = [word_segments(value, words), date_segments(value), walk_segments(value)]
    for source in [*found, repeat_segments(value, words)] if repeats else found:
        for s in source:
            ends[s.end].append(s)
    best, back = [0.0] + [float("inf")] * n, [None] * (n + 1)
    open_cost, open_start = float("inf"), 0  # the brute-force span that the last character continues
    for k in range(1, n + 1):
        if best[k - 1] + START < open_cost:
            open_cost, open_start = best[k - 1] + START, k - 1
        open_cost += brute(value[k - 1])
        best[k], back[k] = open_cost, Segment(open_start, k, "brute", open_cost - best[open_start] - START)
        for s in ends[k]:
            cost = best[s.start] + START + s.cost
            if cost < best[k]:
                best[k], back[k] = cost, s
    parts, k = [], n
    while k:
        parts.append(back[k])
        k = back[k].start
    return best[n], parts[::-1]
