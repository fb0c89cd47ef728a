"""Terms nearly in questions: which windows of which questions come near which terms.

A ratio of matching blocks of at least `least` leaves E = T - 2 M signs of both sides unmatched at most (T their lengths,
M = least * T / 2 rounded up), and the blocks are E + 1 at most. So 3 M - T - 1 pairs of signs are the same at least:
Latin windows and terms of as many words are compared by the product of their counts of pairs (in hashed places, which
only adds), block by block. And one of E + 1 segments of a term lies whole in the window, at most as far off as there are
unmatched signs: windows of signs are led to their terms by these. What is left is compared in full.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np

LATIN = re.compile("[a-z0-9]+")
#: Places of the hashed pairs, and terms in one product.
PLACES, AT_ONCE = 256, 4096


def latin_form(text: str) -> str:
    return " ".join(LATIN.findall(text))


def sign_form(text: str) -> str:
    return text.replace(" ", "")


def matched_least(total: int, least: float) -> int:
    return math.ceil(least * total / 2 - 1e-9)


def _pairs(texts: list[str], known: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(texts), PLACES), np.uint8)
    for row, text in zip(out, texts, strict=True):
        for i in range(len(text) - 1):
            pair = text[i : i + 2]
            at = known.get(pair)
            if at is None:
                at = known[pair] = zlib.crc32(pair.encode()) % PLACES
            if row[at] < 255:
                row[at] += 1
    return out


def _letters(texts: list[str]) -> np.ndarray:
    """How often each text of Latin words holds each sign."""
    out = np.zeros((len(texts), 128), np.uint16)
    for row, text in zip(out, texts, strict=True):
        np.add.at(row, np.frombuffer(text.encode("ascii"), np.uint8), 1)
    return out[:, [32, *range(48, 58), *range(97, 123)]]


class Goals:
    """Terms as goals of a search: Latin ones by number of words, all by their signs."""

    def __init__(self, terms: list[str], least: float):
        self.least, self.known = least, {}
        words = defaultdict(list)
        for goal in sorted({latin_form(t) for t in terms} - {""}, key=lambda g: (len(g), g)):
            words[goal.count(" ") + 1].append(goal)
        self.words = {m: (goals, np.array([len(g) for g in goals]), _pairs(goals, self.known), _letters(goals)) for m, goals in words.items()}
        # by length; those without Latin words apart, as a text that has some is compared with these alone
        self.signs: dict[bool, dict[int, list[str]]] = {True: defaultdict(list), False: defaultdict(list)}
        for goal in sorted({sign_form(t) for t in terms}):
            if len(goal) >= 4:
                self.signs[False][len(goal)].append(goal)
                if not LATIN.search(goal):
                    self.signs[True][len(goal)].append(goal)
        self.segments: dict[tuple[bool, int, int], tuple] = {}

    def _segments(self, latin: bool, n: int, k: int) -> tuple[list[int], dict]:
        """Where the k segments of terms of n signs begin, and the terms by number and text of a segment."""
        held = self.segments.get((latin, n, k))
        if held is None:
            cuts, index = [n * j // k for j in range(k + 1)], defaultdict(list)
            for goal in self.signs[latin][n]:
                for j in range(k):
                    index[j, goal[cuts[j] : cuts[j + 1]]].append(goal)
            held = self.segments[latin, n, k] = cuts, index
        return held

    def near_signs(self, asked: str, latin: bool) -> dict[str, float]:
        """Terms of signs nearly in a text; of a text with Latin words, those without."""
        best: dict[str, float] = {}
        for n in self.signs[latin]:
            a = min(n, len(asked))
            total = a + n
            matched = matched_least(total, self.least)
            if matched > a:
                continue
            k = total - 2 * matched + 1
            cuts, index = self._segments(latin, n, k) if k <= n else ([0], {})
            for start in range(max(len(asked) - n, 0) + 1):
                window, found = asked[start : start + a], set(self.signs[latin][n] if k > n else ())
                for j in range(len(cuts) - 1):
                    size = cuts[j + 1] - cuts[j]
                    for p in range(max(cuts[j] - (n - matched), 0), min(cuts[j] + (a - matched), a - size) + 1):
                        found.update(index.get((j, window[p : p + size]), ()))
                for goal in found:
                    ratio = 1.0 if goal == window else SequenceMatcher(None, window, goal).ratio()
                    if ratio >= self.least:
                        best[goal] = max(ratio, best.get(goal, 0.0))
        return best

    def near_words(self, m: int, windows: list[str]) -> Iterator[tuple[str, str, float]]:
        """(window, term, ratio) of windows and terms of m words that are near."""
        goals, lengths, pairs, letters = self.words[m]
        windows = sorted(windows, key=len)
        size, own, signs = np.array([len(w) for w in windows]), _pairs(windows, self.known), _letters(windows)
        reach = self.least / (2 - self.least)  # the shorter one has at least this share of the longer one's signs
        matcher = SequenceMatcher(None)
        for low in range(0, len(goals), AT_ONCE):
            theirs, long = pairs[low : low + AT_ONCE].astype(np.float32), lengths[low : low + AT_ONCE]
            first, last = np.searchsorted(size, long[0] * reach - 1e-6), np.searchsorted(size, long[-1] / reach + 1e-6, "right")
            pairs_found: dict[int, list[int]] = defaultdict(list)
            for at in range(first, last, AT_ONCE):
                part = slice(at, min(at + AT_ONCE, last))
                shared = theirs @ own[part].astype(np.float32).T
                # 3 M - T - 1, a little less for rounding
                shared -= (1.5 * self.least - 1) * (long[:, None] + size[part][None]).astype(np.float32)
                g, w = np.nonzero(shared >= -1.001)
                g, w = g + low, w + at
                alike = np.concatenate([np.zeros(0, bool), *(2 * np.minimum(letters[g[i : i + 100_000]], signs[w[i : i + 100_000]]).sum(axis=1) >= self.least * (lengths[g[i : i + 100_000]] + size[w[i : i + 100_000]]) - 1e-9 for i in range(0, len(g), 100_000))])
                for a, b in zip(g[alike].tolist(), w[alike].tolist(), strict=True):
                    pairs_found[a].append(b)
            for g, found in pairs_found.items():
                goal = goals[g]
                matcher.set_seq2(goal)
                for w in found:
                    window = windows[w]
                    if window == goal:
                        yield window, goal, 1.0
                        continue
                    matcher.set_seq1(window)
                    if (ratio := matcher.ratio()) >= self.least:
                        yield window, goal, ratio

    def search(self, questions: list[str]) -> list[tuple[int, str, float]]:
        """(place of the question, key of the term's form, best ratio): keys are l and the Latin words, or s and the signs."""
        out: list[tuple[int, str, float]] = []
        owners: dict[int, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, question in enumerate(questions):
            asked = LATIN.findall(question)
            out += [(i, "s" + goal, ratio) for goal, ratio in self.near_signs(sign_form(question), bool(asked)).items()]
            for m in self.words if asked else ():
                for window in {" ".join(asked[j : j + m]) for j in range(max(len(asked) - m, 0) + 1)}:
                    owners[m][window].append(i)
        best: dict[tuple[int, str], float] = {}
        for m, held in owners.items():
            for window, goal, ratio in self.near_words(m, list(held)):
                for i in held[window]:
                    best[i, goal] = max(ratio, best.get((i, goal), 0.0))
        return out + [(i, "l" + goal, ratio) for (i, goal), ratio in best.items()]
