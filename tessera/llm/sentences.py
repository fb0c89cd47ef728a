"""Problem 1: sentence units of texts in any language or script.

A line break always ends a unit. Inside a line, a hidden-event language model decides: at
every place where a boundary token could stand (after terminal marks with the marks that
close them, and at the blanks of Thai) it weighs the words around with and without the
token. Its statistics are counted over the whole corpus: line ends show which words before
a period end sentences and how often (an abbreviation never ends a line), line starts show
which words begin them; expectation-maximisation over the counts fills in the rest. The
forward-backward algorithm over the places of a line gives the posterior of each.

Quotations and brackets are matched first; what lies inside a matched pair is no place for
a boundary, and the pair stands in the line as one closing mark that knows whether a colon
introduced it. Look-alike characters count as the character they look like.

Defined cases: null, empty and blank values have no units; a line without any end is one
unit; positions count code points of the stored value, end exclusive; a repeated chunk
counts once.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import SPACE
from tessera.llm.chunks import in_slices, latest
from tessera.llm.lookalike import positional_table
from tessera.plans import sql
from tessera.plans.runtime import cut_lineage, cut_packed, read_table, spread

#: Rows of each table of the model on the driver. Where there are more, the tables stay tables: the same sums and the same
#: formula, by joins (Wide).
MOST_ROWS = 200_000
#: Rows whose contexts are looked up together in such tables.
BLOCK_ROWS = 1000
#: Contexts a task holds before it hands them on.
HELD_PAIRS = 300_000
THRESHOLD, ROUNDS = 0.5, 4
END, START = "$", "^"

_LINE = re.compile("[^\n\r\x0b\x0c\x1c-\x1e\x85  ]+")
_GLYPHS = re.compile(r"[「」『』“”„«»‘’\"'()\[\]【】《》〈〉]")
_CLOSES = {"」": "「", "』": "『", "”": "“„", "»": "«", "’": "‘", ")": "(", "]": "[", "】": "【", "》": "《", "〉": "〈"}
_OPENS = "「『“„«‘([【《〈"
_INSIDE, _CLOSED, _TOLD = "\x01", "\x02", "\x03"
_TERMINAL = ".!?。।…"
_PLACE = re.compile(rf"[{_TERMINAL}{_CLOSED}{_TOLD}]+(?: ?[{_TERMINAL}{_CLOSED}{_TOLD}]+)*[」』”’»\"')\]]*|(?<=[ก-๛]) +(?=[ก-๛A-ZÀ-Þ㐀-鿿぀-ヿ{_INSIDE}])")
_WORD_BEFORE = re.compile(rf"[^\s!?。।…,;:、{_INSIDE}{_CLOSED}{_TOLD}]*$")
_WORD_AFTER = re.compile(r"[^\W\d_]+")
_INITIALS = re.compile(r"(?:[^\W\d_]\.)*[^\W\d_]$")
_DIGITS = re.compile(r"\d[\d.,]*$")


def matched(line: str) -> str:
    """The line with every outermost matched pair of quotes or brackets put out of reach."""
    found = _GLYPHS.search(line)
    if not found:
        return line
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []

    def close(openers: str, at: int) -> bool:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in openers:
                spans.append((stack[k][1], at))
                del stack[k:]
                return True
        return False

    for m in _GLYPHS.finditer(line):
        ch, at = m.group(), m.start()
        before, after = line[at - 1 : at], line[at + 1 : at + 2]
        if ch in "\"'":
            inner = ch == "'" and after.isalnum()
            if not inner and close(ch, at):
                continue
            if (not before or before in " :(：" or ch == '"' and not before.isalnum() or before > "⺀") and after.strip():
                stack.append((ch, at))
        elif ch == "“" and any(s[0] == "„" for s in stack):
            close("„", at)
        elif ch in _OPENS:
            stack.append((ch, at))
        else:
            close(_CLOSES[ch], at)
    if not spans:
        return line
    spans.sort()
    out, done = [], 0
    for a, b in spans:
        if a < done:
            continue  # inside another pair
        inside = line[a + 1 : b].rstrip(" ")
        told = line[:a].rstrip(" ")[-1:] == ":"
        last = _INSIDE if inside[-1:] not in _TERMINAL or not inside else _TOLD if told else _CLOSED
        out += [line[done:a], _INSIDE * (b - a), last]
        done = b + 1
    return "".join(out) + line[done:]


def _left(hidden: str, line: str, i: int, e: int) -> tuple[str, str]:
    """What stands before the place: word or mark, and its class."""
    group = hidden[i:e]
    if group[0] == " ":
        return "TH", "TH"
    group = group.rstrip("」』”’»\"')]")
    if group in (_CLOSED, _TOLD):
        key = ("B" if line[i] in ")]】》〉" else "Q") + ("3" if group == _TOLD else "2")
        return key, key
    group = group.replace(_CLOSED, "").replace(_TOLD, "").replace(" ", "")
    if "。" in group or "।" in group:
        return group[-1], "STRONG"
    if "!" in group or "?" in group:
        return "!", "STRONG"
    if group.count("…") == len(group):
        key = "…" if len(group) == 1 else "……"
        return key, key
    if len(group) > 1:
        return "...", "..."
    word = _WORD_BEFORE.search(hidden, max(0, i - 28), i).group()
    if not word:
        return (")", ")") if hidden[i - 1 : i] in (_INSIDE, "") and i else ("", "...")
    if _DIGITS.fullmatch(word):
        return ("N^", "N^") if not hidden[: i - len(word)].strip() else ("N", "N")
    word = word.lstrip("([-–—/$§")
    if "." in word and max(map(len, word.split("."))) > 3:
        word = word.rsplit(".", 1)[1] or word  # a missing space, not an abbreviation
    if _INITIALS.fullmatch(word):
        return word.casefold(), "I"
    letters = sum(map(str.isalpha, word))
    return word[-12:].casefold(), "L" if letters >= 4 else "S"


def _right(hidden: str, line: str, r: int) -> tuple[str, str]:
    """What follows the place: word or mark, and its class."""
    if r >= len(hidden):
        return END, END
    ch = hidden[r]
    if ch == _INSIDE:
        return ("OB", "OB") if line[r] in "([【《〈" else ("OQ", "OQ")
    if ch.isdigit():
        return "N", "N"
    if "぀" <= ch <= "鿿" or "豈" <= ch <= "﫿":
        return ch, "c"
    if "฀" <= ch <= "๿":
        return hidden[r : r + 3], "th"
    word = _WORD_AFTER.match(hidden, r)
    if word is None:
        return ("P", "P") if ch in ",;:、)]」』”’»%/" else (ch, "s")
    word = word.group()
    if ch.islower():
        return "l", "l"
    return word[:12], "U" if ch.isupper() else "o"


def places(line: str, hidden: str) -> list[tuple[int, int, tuple[str, str], tuple[str, str]]]:
    """(end of the unit if a boundary stands here, start of the next, left, right) of every possible boundary."""
    out = []
    for m in _PLACE.finditer(hidden):
        i, e = m.span()
        r = e
        while r < len(hidden) and hidden[r] == " ":
            r += 1
        right = _right(hidden, line, r)
        if right[1] == "P":
            continue
        group = hidden[i:e]
        if group[0] == " ":
            out.append((i, e, ("TH", "TH"), right))
            continue
        if r == e and r < len(hidden) and "。" not in group and "।" not in group and group[-1] not in "\x02\x03":
            # no blank: never inside numbers, names and addresses; between a small letter and a capital, or before another script
            if right[1] in ("l", "N", "s") or right[1] in ("U", "OQ", "OB") and not (hidden[i - 1 : i].islower() or group != "." or hidden[i - 1 : i] in (_INSIDE, "%")):
                continue
        left = _left(hidden, line, i, e)
        if r < len(hidden):
            out.append((e, r, left, right))
        else:
            out.append((e, r, left, (END, END)))
    return out


def compact(line: str) -> tuple[str, list[int] | None]:
    """Look-alikes folded; invisible characters taken out, with the position of each character that stays."""
    if line.isascii():
        return line.replace("\t", " "), None
    line = line.translate(positional_table())
    if "⁠" not in line:
        return line, None
    kept = [k for k, ch in enumerate(line) if ch != "⁠"]
    return line.replace("⁠", ""), kept


def count_contexts(texts: tuple[str | None, ...], into: Counter) -> None:
    """Counts of the lines of all fields of a row; a line that an earlier field holds is not counted again."""
    done: set[str] = set()
    for text in texts:
        mine = [m.group() for m in _LINE.finditer(text or "")]
        for stored in mine:
            if stored in done:
                continue
            line = compact(stored)[0].strip()
            if not line:
                continue
            hidden = matched(line)
            found = places(line, hidden)
            ended = bool(found) and found[-1][3][0] == END
            if not ended and "฀" <= line[-1] <= "๿":
                into[("TH", "TH", END, END)] += 1
                ended = True
            if ended:  # a line that ends as a sentence does also starts as one does
                into[(START, START, *_right(hidden, line, 0))] += 1
            for _, _, left, right in found:
                into[(*left, *right)] += 1
        done.update(mine)


class Model:
    """Probabilities of a boundary before and after seeing the words around it."""

    #: Share of places that are ends, by class, before any line end is seen. Set by hand once, for regulations, and worth
    #: PRIOR_PLACES places: STRONG marks of one meaning; L words of four letters and more, S shorter ones, I initials; N numbers,
    #: N^ numbers that begin a line; dots; Q and B quotes and brackets with an end inside, 3 where a colon introduced them.
    PRIOR = {"STRONG": 0.98, "TH": 0.98, "L": 0.9, "S": 0.4, "I": 0.1, "N": 0.4, "N^": 0.02, "...": 0.1, "…": 0.4, "……": 0.3, "Q3": 0.9, "Q2": 0.2, "B2": 0.6, "B3": 0.6, ")": 0.9}
    PRIOR_PLACES, PSEUDO, SHARED, FLOOR = 200, 5.0, 10.0, 2e-4
    #: Places of each class of what follows no boundary, before any is seen, and the classes of many words.
    SHAPES, OPEN = {"l": 10, "N": 10, "U": 5, "c": 5, "OQ": 1, "OB": 2, "s": 1, "th": 1, "o": 5}, ("U", "c", "th", "o")
    #: Classes of which most words either end sentences or never do.
    SPLIT = ("STRONG", "L", "S", "I", ")", "Q3", "B2", "B3")

    #: A word that ends sentences in more than SURE of its places does so nearly always (an abbreviation that may also end one
    #: is rarely seen that often), and one below NEVER next to never; what lies between is taken as it is.
    SURE, NEVER, NEARLY_ALWAYS, NEXT_TO_NEVER = 0.45, 0.02, 0.995, 0.002

    def __init__(self, lefts: list[tuple[str, str, int, int]], starts_table: list[tuple[str, str, int]], pairs: list[tuple[str, str, str, int]], classes: list[tuple[str, str, int]]):
        """lefts: word, class, places, ends. starts_table: word, class, places. pairs: left word, right word, class of it, places. classes: left, right, places."""
        total, ends, by_left = Counter(), Counter(), defaultdict(Counter)
        self.of_left: dict[str, str] = {}
        starts, starts_class = Counter(), Counter()
        for left, kind, n, ended in lefts:
            self.of_left[left] = kind
            total[left] += n
            ends[left] += ended
        for right, _, n in starts_table:
            starts[right] += n
        for left, right, shape, n in pairs:
            by_left[left][(right, shape)] += n
        self._classes(classes, starts_class)
        self.before: dict[str, float] = {}
        for left, n in total.items():
            kind = self.of_left[left]
            if kind in ("TH", "N^"):
                self.before[left] = self.PRIOR[kind]
                continue
            base, rho = self.PRIOR[kind] if kind in ("S", "I") else self.prior[kind], self.rate[kind]
            seen = (ends[left] + self.PSEUDO * rho * base) / (rho * (n + self.PSEUDO))
            # most words either end sentences or never do; only what lies between is taken as it is
            sure = kind in self.SPLIT
            self.before[left] = self.NEARLY_ALWAYS if sure and seen > self.SURE else self.NEXT_TO_NEVER if sure and seen < self.NEVER else min(0.99, max(0.001, seen))
        # what follows a boundary, and what follows none: expectation-maximisation over the counts
        after_s, shape_s = Counter(starts), Counter(starts_class)
        after_n: dict[str, Counter] = {}
        shape_n = Counter(self.SHAPES)
        for _ in range(ROUNDS):
            self._set(after_s, shape_s, after_n, shape_n)
            more_s, more_shape = Counter(starts), Counter(starts_class)
            none: dict[str, Counter] = {}
            shapes = Counter(self.SHAPES)
            for left, rights in by_left.items():
                # where nearly every place is an end, the few left over say nothing about what follows none
                mine = none[left] = Counter() if self.before[left] < 0.9 else None
                for (right, shape), n in rights.items():
                    p = 1 / (1 + math.exp(-self.log_odds((left, self.of_left[left]), (right, shape))))
                    more_s[right] += n * p
                    more_shape[shape] += n * p
                    if mine is not None:
                        # what boundaries alone would put here by chance, three times over, is no sign of anything else
                        left_over = max(0.0, n * (1 - p) - 3.0 * total[left] * self.before[left] * self.after_s[right] / self.n_s)
                        mine[right] += left_over
                        shapes[shape] += left_over
            after_s, shape_s, after_n, shape_n = more_s, more_shape, {k: c for k, c in none.items() if c}, shapes
        self._set(after_s, shape_s, after_n, shape_n)

    def _classes(self, classes: list[tuple[str, str, int]], starts_class: Counter) -> None:
        """Rates and priors by class; starts_class takes the places after which a line starts."""
        class_total, class_ends = Counter(), Counter()
        for kind, shape, n in classes:
            if kind == START:
                starts_class[shape] += n
            else:
                class_total[kind] += n
                class_ends[kind] += n * (shape == END)
        # how often a boundary is also a line end, from the classes that are boundaries nearly always
        sure = [k for k in ("STRONG", "L") if class_total[k]]
        rate = {k: min(0.9, max(0.02, class_ends[k] / class_total[k] / self.PRIOR[k])) for k in sure}
        general = sum(rate.values()) / len(rate) if rate else 0.2
        self.rate = {k: rate.get("STRONG" if k in ("STRONG", "Q3", "……") else "L", general) for k in self.PRIOR}
        self.prior: dict[str, float] = {}
        for kind, base in self.PRIOR.items():
            rho, n = self.rate[kind], class_total[kind]
            seen = (class_ends[kind] + self.PRIOR_PLACES * rho * base) / (rho * (n + self.PRIOR_PLACES)) if kind not in ("TH", "N^") else base
            self.prior[kind] = min(0.99, max(0.002, seen))

    def _set(self, after_s: Counter, shape_s: Counter, after_n: dict[str, Counter], shape_n: Counter) -> None:
        self.after_s, self.shape_s, self.after_n, self.shape_n = after_s, shape_s, after_n, shape_n
        self.n_s, self.n_n = sum(shape_s.values()) + 1.0, sum(shape_n.values()) + 1.0
        self.left_n = {k: sum(c.values()) for k, c in after_n.items()}
        self.any_n: Counter = Counter()
        for c in after_n.values():
            self.any_n.update(c)
        self.known: dict[tuple, float] = {}

    def log_odds(self, left: tuple[str, str], right: tuple[str, str]) -> float:
        key = (left, right)  # with the classes: one word may stand in two
        odds = self.known.get(key)
        if odds is None:
            if len(self.known) > 500_000:
                self.known.clear()
            odds = self.known[key] = self._log_odds(left, right)
        return odds

    def _log_odds(self, left: tuple[str, str], right: tuple[str, str]) -> float:
        if right[0] == END:
            return 9.0
        p = self.before.get(left[0], self.prior.get(left[1], 0.5))
        word, shape = right
        general = self.FLOOR * self.shape_s[shape] / self.n_s
        with_event = 0.95 * self.after_s[word] / self.n_s + 0.05 * general + 1e-7
        mine, n = self.after_n.get(left[0], {}), self.left_n.get(left[0], 0.0)
        narrow = self.FLOOR if shape in self.OPEN else 1.0
        other = 0.7 * self.any_n[word] / self.n_n + 0.3 * narrow * self.shape_n[shape] / self.n_n
        without = (mine.get(word, 0.0) + self.SHARED * other) / (n + self.SHARED) + 1e-7
        return math.log(p / (1 - p)) + math.log(with_event / without)

    def boundaries(self, found: list, hidden: str) -> list[tuple[int, int]]:
        """(end, next start) of the places whose posterior of a boundary exceeds one half."""
        if not found:
            return []
        odds = [math.exp(min(30.0, max(-30.0, self.log_odds(left, right)))) for _, _, left, right in found]
        # two boundaries with hardly a sign between them are unlikely; transition of 1 -> 1
        joint = [1.0] + [1.0 if sum(map(str.isalnum, hidden[a[1] : b[0]])) > 1 or _INSIDE in hidden[a[1] : b[0]] else 1e-3 for a, b in zip(found, found[1:], strict=False)]
        forward = []
        f0, f1 = 1.0, 0.0
        for o, t in zip(odds, joint, strict=True):
            f0, f1 = f0 + f1, o * (f0 + f1 * t)
            scale = f0 + f1
            f0, f1 = f0 / scale, f1 / scale
            forward.append((f0, f1))
        out = []
        b0, b1 = 1.0, 1.0
        for k in range(len(found) - 1, -1, -1):
            p0, p1 = forward[k][0] * b0, forward[k][1] * b1
            if p1 > THRESHOLD * (p0 + p1):
                out.append((found[k][0], found[k][1]))
            b0, b1 = b0 + odds[k] * b1, b0 + joint[k] * odds[k] * b1
            scale = b0 + b1
            b0, b1 = b0 / scale, b1 / scale
        out.reverse()
        return out

    def line_units(self, stored: str) -> list[tuple[int, int]]:
        """Units of one line, in positions of the stored line, without white space at the ends."""
        line, kept = compact(stored)
        hidden = matched(line)
        cuts, start, units = self.boundaries(places(line, hidden), hidden), 0, []
        for end, following in [*cuts, (len(line), len(line))]:
            if kept is None:
                a, b = start, end
            else:
                a = kept[start] if start < len(kept) and units else 0 if not units else len(stored)
                b = len(stored) if end >= len(kept) else kept[end]
            piece = stored[a:b]
            a += len(piece) - len(piece.lstrip())
            b -= len(piece) - len(piece.rstrip())
            if a < b:
                units.append((a, b))
            start = following
        return units

    def units(self, text: str | None, known: dict[str, list]) -> list[tuple[int, int]]:
        out = []
        for m in _LINE.finditer(text or ""):
            line = m.group()
            found = known.get(line)
            if found is None:
                found = known[line] = self.line_units(line)
            at = m.start()
            out += [(a + at, b + at) for a, b in found]
        return out


class Looked(Model):
    """Units by log odds that were looked up: those of every context of the texts at hand."""

    def __init__(self, odds: dict[tuple, float]):
        self.odds = odds

    def log_odds(self, left: tuple[str, str], right: tuple[str, str]) -> float:
        return 9.0 if right[0] == END else self.odds[left, right]


class Wide(Model):
    """The model over tables of any size: words and pairs stay tables, the rounds are joins; only the sums by class reach the driver."""

    def __init__(self, lefts: DataFrame, starts: DataFrame, pairs: DataFrame, classes: list[tuple[str, str, int]]):
        """lefts: l, lc, n, ends. starts: r, rc, n. pairs: l, r, rc, n. classes: left, right, places."""
        self.of_left: dict[str, str] = {}
        base_shapes: Counter = Counter()
        self._classes(classes, base_shapes)
        words = lefts.groupBy("l").agg(F.max("lc").alias("lc"), F.sum("n").alias("total"), F.sum("ends").alias("ends"))
        rho, base = self._of(self.rate, "lc"), self._of({k: self.PRIOR[k] if k in ("S", "I") else v for k, v in self.prior.items()}, "lc")
        seen, sure = (F.col("ends") + self.PSEUDO * rho * base) / (rho * (F.col("total") + self.PSEUDO)), F.col("lc").isin(*self.SPLIT)
        before = F.when(F.col("lc").isin("TH", "N^"), self._of(self.PRIOR, "lc")).when(sure & (seen > self.SURE), self.NEARLY_ALWAYS).when(sure & (seen < self.NEVER), self.NEXT_TO_NEVER)
        words = cut_lineage(words.withColumn("before", before.otherwise(F.least(F.lit(0.99), F.greatest(F.lit(0.001), seen)))).select("l", "total", "before"))
        starts = starts.groupBy("r").agg(F.sum("n").cast("double").alias("after_s"))
        pairs = cut_lineage(pairs)
        self.shape_s, self.shape_n = base_shapes, Counter(self.SHAPES)
        self.lefts = words.withColumn("left_n", F.lit(0.0))
        self.rights = starts.withColumn("any_n", F.lit(0.0))
        found = pairs.withColumn("over", F.lit(0.0))
        for _ in range(ROUNDS):
            self.n_s, self.n_n = sum(self.shape_s.values()) + 1.0, sum(self.shape_n.values()) + 1.0
            # a word may follow in two classes; what follows none is counted by word
            mine = found.groupBy("l", "r").agg(F.sum("over").alias("mine"))
            p = 1 / (1 + F.exp(-self._odds()))
            chance = 3.0 * F.col("total") * F.col("before") * F.coalesce("after_s", F.lit(0.0)) / self.n_s
            over = F.when(F.col("before") < 0.9, F.greatest(F.lit(0.0), F.col("n") * (1 - p) - chance)).otherwise(0.0)
            rows = pairs.join(mine, ["l", "r"], "left").join(self.lefts, "l", "left").join(self.rights, "r", "left").withColumn("lc", F.lit(None).cast("string"))
            found = cut_lineage(rows.select("l", "r", "rc", "n", (F.col("n") * p).alias("ended"), over.alias("over")))
            shapes = found.groupBy("rc").agg(F.sum("ended"), F.sum("over")).collect()
            self.shape_s, self.shape_n = base_shapes + Counter({r[0]: r[1] for r in shapes}), Counter(self.SHAPES) + Counter({r[0]: r[2] for r in shapes})
            self.lefts = words.join(found.groupBy("l").agg(F.sum("over").alias("left_n")), "l", "left")
            follows = found.select("r", F.col("ended").alias("after_s"), F.col("over").alias("any_n")).unionByName(starts.withColumn("any_n", F.lit(0.0)))
            self.rights = cut_lineage(follows.groupBy("r").agg(F.sum("after_s").alias("after_s"), F.sum("any_n").alias("any_n")))
        self.n_s, self.n_n = sum(self.shape_s.values()) + 1.0, sum(self.shape_n.values()) + 1.0
        self.lefts = cut_lineage(self.lefts)
        self.pairs = found.groupBy("l", "r").agg(F.sum("over").alias("mine"))

    @staticmethod
    def _of(values: dict[str, float], column: str) -> Column:
        """The value of the class in the column."""
        return F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, float(v))))[F.col(column)] if values else F.lit(None).cast("double")

    def _odds(self) -> Column:
        """As Model._log_odds, over the joined columns of a context."""
        none = F.lit(0.0)
        p = F.coalesce("before", self._of(self.prior, "lc"), F.lit(0.5))
        general = self.FLOOR * F.coalesce(self._of(self.shape_s, "rc"), none) / self.n_s
        with_event = 0.95 * F.coalesce("after_s", none) / self.n_s + 0.05 * general + 1e-7
        narrow = F.when(F.col("rc").isin(*self.OPEN), self.FLOOR).otherwise(1.0)
        other = 0.7 * F.coalesce("any_n", none) / self.n_n + 0.3 * narrow * F.coalesce(self._of(self.shape_n, "rc"), none) / self.n_n
        without = (F.coalesce("mine", none) + self.SHARED * other) / (F.coalesce("left_n", none) + self.SHARED) + 1e-7
        return F.when(F.col("r") == END, 9.0).otherwise(F.ln(p / (1 - p)) + F.ln(with_event / without))

    def scored(self, contexts: DataFrame) -> DataFrame:
        """contexts: l, lc, r, rc and others. With the log odds of each."""
        rows = contexts.join(self.pairs, ["l", "r"], "left").join(self.lefts, "l", "left").join(self.rights, "r", "left")
        return rows.select(*contexts.columns, self._odds().alias("odds"))

    def units(self, text: str | None, known: dict[str, list]) -> list[tuple[int, int]]:
        """Of a single text; segment looks up those of a table."""
        contexts = sorted(contexts_of((text,)))
        if not contexts:
            return Looked({}).units(text, known)
        rows = self.scored(self.lefts.sparkSession.createDataFrame(contexts, "l string, lc string, r string, rc string")).collect()
        return Looked({((r.l, r.lc), (r.r, r.rc)): r.odds for r in rows}).units(text, known)


def contexts_of(texts: tuple[str | None, ...]) -> set[tuple[str, str, str, str]]:
    """(left, class, right, class) of the places of a row at which the line doesn't end."""
    out = set()
    for stored in {m.group() for text in texts for m in _LINE.finditer(text or "")}:
        line = compact(stored)[0]
        out.update((*left, *right) for _, _, left, right in places(line, matched(line)) if right[0] != END)
    return out


def fit(texts: DataFrame) -> Model:
    """texts: string columns, the fields of a row. Counts over all of them; tables of at most MOST_ROWS rows reach the driver, larger ones stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hand_on() -> pa.RecordBatch:
            columns = list(zip(*((*k, n) for k, n in held.items()), strict=True)) if held else [[]] * 5
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.int64())], names=["l", "lc", "r", "rc", "n"])

        held: Counter = Counter()
        for batch in in_slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count_contexts(row, held)
                if len(held) > HELD_PAIRS:
                    yield hand_on()
                    held.clear()
        yield hand_on()

    counted = spread(texts).mapInArrow(run, "l string, lc string, r string, rc string, n long")
    table = cut_lineage(counted.groupBy("l", "lc", "r", "rc").agg(F.sum("n").alias("n")))
    inner = F.col("lc") != START
    lefts = table.where(inner).groupBy("l", "lc").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("rc") == END, F.col("n")).otherwise(0)).alias("ends"))
    starts = table.where(~inner).groupBy("r", "rc").agg(F.sum("n").alias("n"))
    pairs = table.where(inner & (F.col("rc") != END)).groupBy("l", "r", "rc").agg(F.sum("n").alias("n"))
    classes = [tuple(r) for r in table.groupBy("lc", "rc").agg(F.sum("n").alias("n")).orderBy("lc", "rc").collect()]
    if max(rows.count() for rows in (lefts, starts, pairs)) > MOST_ROWS:
        return Wide(lefts, starts, pairs, classes)

    def held_here(rows: DataFrame, *keys: str) -> list[tuple]:
        return [tuple(r) for r in rows.orderBy(*keys).collect()]

    return Model(held_here(lefts, "l", "lc"), held_here(starts, "r", "rc"), held_here(pairs, "l", "r", "rc"), classes)


def _units_of(model: Model, rows: pa.RecordBatch | pa.Table, key: str, fields: tuple[str, ...]) -> list[pa.Array | pa.ChunkedArray]:
    """Key, field, start and end of each unit."""
    texts = [rows.column(k).to_pylist() for k in fields]
    source, field, starts, ends = [], [], [], []
    for i in range(rows.num_rows):
        known: dict[str, list] = {}  # the fields of a row share most lines
        for k in range(len(fields)):
            for a, b in model.units(texts[k][i], known):
                source.append(i)
                field.append(k)
                starts.append(a)
                ends.append(b)
    names = pa.DictionaryArray.from_arrays(pa.array(field, pa.int32()), pa.array(fields)).cast(pa.string())
    return [rows.column(key).take(pa.array(source, pa.int32())), names, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]


def segment(df: DataFrame, model: Model, key: str, *fields: str) -> DataFrame:
    """(key, field, start_pos, end_pos) of the units of each field."""
    names, schema = [key, "field", "start_pos", "end_pos"], f"{key} string, field string, start_pos int, end_pos int"
    if isinstance(model, Wide):
        return _segment_wide(df, model, key, fields, names, schema)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays(_units_of(held.value, batch, key, fields), names=names)

    return df.select(key, *fields).mapInArrow(run, schema)


def _segment_wide(df: DataFrame, model: Wide, key: str, fields: tuple[str, ...], names: list[str], schema: str) -> DataFrame:
    """Each block of rows meets the log odds of its contexts."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            held: dict[int, set] = defaultdict(set)
            for block, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[block] |= contexts_of(tuple(texts))
            for block, mine in held.items():
                columns = list(zip(*mine, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(mine), pa.int64()), *(pa.array(c, pa.string()) for c in columns)], names=["block", "l", "lc", "r", "rc"])

    def units(rows: pa.Table, found: pa.Table) -> pa.Table:
        l, lc, r, rc, odds = (found.column(c).to_pylist() for c in ("l", "lc", "r", "rc", "odds"))
        looked = Looked(dict(zip(zip(zip(l, lc, strict=True), zip(r, rc, strict=True), strict=True), odds, strict=True)))
        return pa.Table.from_arrays(_units_of(looked, rows, key, fields), names=names)

    rows = cut_packed(df.select(key, *fields).withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK_ROWS)))
    asked = rows.select("block", *fields).mapInArrow(contexts, "block long, l string, lc string, r string, rc string")
    # each context is looked up once, however many blocks hold it
    found = model.scored(asked.groupBy("l", "lc", "r", "rc").agg(F.collect_set("block").alias("blocks"))).withColumn("block", F.explode("blocks")).drop("blocks")
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(units, schema)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read by the counts and by the units, so written once
    rows = cut_lineage(latest(read_table(spark, sf_dir, "chunks"), "chunk_id", "text", "retrieval_text"))
    return segment(rows, fit(rows.select("text", "retrieval_text")), "chunk_id", "text", "retrieval_text")


def p1_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units per chunk and field: how many, and their mean length."""
    return p1_found(spark, sf_dir).groupBy("chunk_id", "field").agg(F.count("*").alias("n_units"), F.round(F.avg(F.col("end_pos") - F.col("start_pos")), 2).alias("mean_length"))


def p1_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signs of all units of a field, in order, as a hash: nothing but white space lies outside the units, and nothing is in two."""
    rows = latest(read_table(spark, sf_dir, "chunks"), "chunk_id", "text", "retrieval_text")
    texts = rows.select("chunk_id", F.explode(F.create_map(F.lit("text"), "text", F.lit("retrieval_text"), "retrieval_text")).alias("field", "value"))
    units = p1_found(spark, sf_dir).groupBy("chunk_id", "field").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos"))).alias("u"))
    held = texts.join(units, ["chunk_id", "field"]).withColumn("signs", F.array_join(F.transform("u", lambda u: F.substring(F.col("value"), u["start_pos"] + 1, u["end_pos"] - u["start_pos"])), ""))
    return held.select("chunk_id", "field", F.sha2(F.regexp_replace("signs", f"[{SPACE}]+", ""), 256).alias("signs_hash"))


QUERIES = {"p1_found": p1_found, "p1_sentences": p1_sentences, "p1_rebuilt": p1_rebuilt}
_PLAIN = rf"regexp_replace(value, '[{sql.SPACE}]+', '', 'g')"
ORACLE = {
    "p1_rebuilt": f"""WITH {sql.CHUNKS}, v AS (SELECT chunk_id, 'text' AS field, text AS value FROM c UNION ALL SELECT chunk_id, 'retrieval_text', retrieval_text FROM c)
        SELECT chunk_id, field, sha256({_PLAIN}) AS signs_hash FROM v WHERE value IS NOT NULL AND {_PLAIN} <> ''"""
}
