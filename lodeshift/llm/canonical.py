"""Freely typed values mapped to the entries of a reference list, unmatched ones reported.

A multi-pattern automaton over all names and aliases finds embedded mentions at word borders; the longest
non-overlapping ones win. Values without a mention go to token-set similarity: the words of the value and of a name are
paired off whatever their order, words agreeing up to misspelling or abbreviation, and the share of agreeing letters
decides.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words around a value that say nothing about which one is meant.
FILLERS = frozenset(
    """senior sr junior jr lead head chief principal deputy trainee intern assistant-to basic advanced intermediate expert beginner
    certified skills skill experience with in strong good of the and a an years yrs yr daily use night-shift shift temp m f d x
    i ii iii iv w div permanent part time full knowledge proficient fluent suite platform enterprise pro edition version""".split()
)
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_QUALIFIER = regex.compile(r"\s*(?:@\s.*|\((?:m/f/d|m/w/d|f/m/d|temp|temporary|basic|advanced|expert)\)|\[[^\]]*\]|[-–]\s*night shift|[-–]\s*\d+\s*y(?:ea)?rs?|,?\s*daily use)\s*", regex.IGNORECASE)
THRESHOLD = 0.84


def plain(text: str) -> str:
    """Lower case without accents; marks become blanks."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(_WORD.findall(flat.lower()))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours (optimal string alignment), at most ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            cost = min(previous[j] + 1, row[j - 1] + 1, previous[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before = previous
    return row[-1]


def shortened(short: str, word: str) -> bool:
    """Whether ``short`` abbreviates ``word``: a beginning, or some of its letters in order with the first and a late one."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return False
    if word.startswith(short):
        return True
    at = 0
    for c in short:
        at = word.find(c, at) + 1
        if not at:
            return False
    vowels = sum(c in "aeiou" for c in short[1:])
    return len(short) >= 3 and vowels <= 1 and len(short) * 2 <= len(word) + 2


def agreement(typed: str, word: str) -> float:
    """How far a typed word agrees with a word of a name, 0 to 1."""
    if typed == word:
        return 1.0
    size = max(len(typed), len(word))
    if min(len(typed), len(word)) >= 3 and size >= 4:
        most = 1 if size <= 5 else 2 if size <= 10 else 3
        d = edits(typed, word, most)
        if d <= most:
            return 1.0 - d / size
    if shortened(typed, word):
        return 0.88 if len(typed) > 2 else 0.85
    return 0.0


class Mapper:
    """Maps values to entries; plain Python, made once per worker from a fixed reference list."""

    def __init__(self, names: tuple[tuple[str, str], ...]):
        self.names: dict[str, str] = {}
        for name, entry in names:
            if name and plain(name):
                self.names.setdefault(plain(name), entry)
        self.automaton = ahocorasick.Automaton()
        for name in self.names:
            self.automaton.add_word(name, name)
        if self.names:
            self.automaton.make_automaton()
        self.joined = {name.replace(" ", ""): name for name in self.names}
        self.words = {name: name.split() for name in self.names}
        self.common = {w for name in self.names for w in name.split()}
        self.grams, self.holding = defaultdict(set), defaultdict(set)
        self.flat = {name: (name.replace(" ", ""), self._grams(name.replace(" ", ""))) for name in self.names}
        for name in self.names:
            for g in self.flat[name][1]:
                self.grams[g].add(name)
            for w in self.words[name]:
                self.holding[w].add(name)
        self.near: dict[str, dict[str, float]] = {}
        self.memory: dict[str, str | None] = {}

    @staticmethod
    def _grams(flat: str) -> set[str]:
        return {flat[i : i + 2] for i in range(len(flat) - 1)}

    def agreeing(self, typed: str) -> dict[str, float]:
        """The words of all names that agree with a typed word, with how far."""
        known = self.near.get(typed)
        if known is None:
            if len(self.near) > 100_000:
                self.near.clear()
            known = self.near[typed] = {w: a for w in self.common if (a := agreement(typed, w)) >= 0.6}
        return known

    def run_together(self, flat: str) -> set[str]:
        """All names whose letters may be within a fifth of their length of ``flat``: an edit, swaps of neighbours included,
        takes three pairs of letters away at most, and the lengths must fit."""
        shared = defaultdict(int)
        for g in self._grams(flat):
            for name in self.grams.get(g, ()):
                shared[name] += 1
        out = set()
        for name, (target, grams) in self.flat.items():
            most = max(1, len(target) // 5)
            if abs(len(target) - len(flat)) <= most and len(grams) - shared.get(name, 0) <= 3 * most:
                out.add(name)
        return out

    def mentions(self, text: str) -> list[str]:
        """Names at word borders, longest first where they overlap."""
        found = []
        if self.names:
            for last, name in self.automaton.iter(text):
                a, b = last - len(name) + 1, last + 1
                if (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " "):
                    found.append((b - a, -a, name))
        taken: list[tuple[int, int]] = []
        out = []
        for size, minus, name in sorted(found, reverse=True):
            a = -minus
            if all(a + size <= x or y <= a for x, y in taken):
                taken.append((a, a + size))
                out.append(name)
        return out

    def similarity(self, typed: list[str], name: str) -> float:
        """Token-set similarity: the letters of words that agree, over all letters of both sides."""
        words = list(self.words[name])
        total = sum(map(len, typed)) + sum(map(len, words))
        near = [self.agreeing(t) for t in typed]
        pairs = sorted(((near[i][w] * len(w), i, j) for i in range(len(typed)) for j, w in enumerate(words) if w in near[i]), reverse=True)
        used_t, used_w, hit = set(), set(), 0.0
        for _, i, j in pairs:
            if i in used_t or j in used_w:
                continue
            a = near[i][words[j]]
            used_t.add(i)
            used_w.add(j)
            # An abbreviation counts as the word it stands for.
            size = len(words[j])
            hit += 2 * size * a
            total += size - len(typed[i])
        return hit / total if len(used_w) == len(words) or total == 0 else 0.85 * hit / total

    def slips(self, typed: list[str], name: str) -> float:
        """0.97 less 0.03 an edit where every word of the name was typed with at most one slip, two in all; else 0."""
        words = list(self.words[name])
        if len(typed) != len(words):
            return 0.0
        total = 0
        for t in typed:
            d, w = min((edits(t, w, 1), w) for w in words)
            if d > 1 or d and max(len(t), len(w)) < 5:
                return 0.0
            words.remove(w)
            total += d
        return 0.97 - 0.03 * total if total <= 2 else 0.0

    def closest(self, text: str) -> tuple[str | None, float]:
        typed = text.split()
        if not typed:
            return None, 0.0
        best, top = None, 0.0
        flat = "".join(typed)
        core = [w for w in typed if w not in FILLERS and not w.isdigit() and not regex.fullmatch(r"v?\d+", w)] or typed
        flats = {flat, "".join(core)}
        # Every name that can score: it has a word that agrees with a typed one, or the letters run together.
        options = {name for t in typed for w in self.agreeing(t) for name in self.holding[w]}.union(*(self.run_together(f) for f in flats))
        for name in options:
            target = self.flat[name][0]
            score = max(self.similarity(core, name), self.similarity(typed, name) if core != typed else 0.0)
            for f in flats:  # words run together, or cut apart
                most = max(1, len(target) // 5)
                d = edits(f, target, most)
                if d <= most and len(target) >= 4:
                    score = max(score, 1.0 - d / len(target) - 0.01)
            score = max(score, self.slips(core, name))
            if score > top or score == top and best is not None and name < best:
                best, top = name, score
        return best, top

    def entry(self, raw: str) -> str | None:
        """The entry that is meant, or None."""
        if raw in self.memory:
            return self.memory[raw]
        if len(self.memory) > 200_000:
            self.memory.clear()
        self.memory[raw] = out = self._entry(raw)
        return out

    def _entry(self, raw: str) -> str | None:
        cleaned = _QUALIFIER.sub(" ", raw)
        text = plain(cleaned) or plain(raw)
        if text in self.names:
            return self.names[text]
        if (flat := text.replace(" ", "")) in self.joined:
            return self.names[self.joined[flat]]
        mentions = self.mentions(text)
        if mentions:
            rest = set(text.split()) - set(" ".join(mentions).split())
            rest = {w for w in rest if w not in FILLERS and not w.isdigit()}
            if not rest or len(mentions[0].split()) > 1 or self._side_note(raw, mentions[0]):
                return self.names[mentions[0]]
        best, score = self.closest(text)
        without = regex.sub(r",\s*[^,]*$", "", cleaned)  # a place behind a comma
        if without != cleaned and score < 0.97:
            other, more = self.closest(plain(without))
            if plain(without) in self.names:
                other, more = plain(without), 1.0
            if more > score:
                best, score = other, more
        return self.names[best] if best is not None and score >= THRESHOLD else None

    @staticmethod
    def _side_note(raw: str, name: str) -> bool:
        """Whether what stands beside a one-word name is a note in brackets, behind a comma, a dash or an at."""
        head = regex.split(r"\s*[(\[,@]|\s[-–]\s", raw.strip(), maxsplit=1)[0]
        words = [w for w in plain(head).split() if w not in FILLERS]
        return " ".join(words) == name


@lru_cache(maxsize=4)
def _mapper(names: tuple[tuple[str, str], ...]) -> Mapper:
    return Mapper(names)


def map_values(df: DataFrame, key: str, field: str, names: list[tuple[str, str]], missing: str = "unmatched") -> DataFrame:
    """(match_id, entry) of every row whose ``field`` is neither NULL nor blank; ``missing`` where no entry is meant.

    ``names`` is the fixed reference list as (name, entry), sent with the function; at equal similarity the name first
    in order wins. Repeated rows give repeated results, NULL keys are kept, an empty list gives ``missing``
    everywhere; other columns are not read. No shuffle; a worker remembers the values it has seen.
    """
    pairs = tuple(sorted(set(names)))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mapper = _mapper(pairs)
        for pdf in batches:
            yield pd.DataFrame({"match_id": pdf["match_id"], "entry": [mapper.entry(x) or missing for x in pdf["raw"]]})

    kind = dict(df.dtypes)[key]
    values = df.select(F.col(f"`{key}`").alias("match_id"), F.col(f"`{field}`").alias("raw")).where(r"raw is not null and raw rlike '(?U)\\S'")
    return values.mapInPandas(match, f"match_id {kind}, entry string")
