"""Several values packed in one field: one row per value, with its position.

A multi-pattern automaton over known whole values (the reference list and its aliases) marks where they stand; dynamic
programming over the possible cuts then picks the best cover of the field: known values count for the cover, cuts
inside a known value, a quotation or a bracket are never taken, and a conjunction is a cut only where the cover is the
better for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What stands before a list of skills, tools or methods.
LABELS = (
    "skills", "key skills", "core skills", "technical skills", "core strengths", "strengths", "tools", "tools and methods", "methods",
    "technologies", "also", "languages and methods", "kompetenzen", "kenntnisse", "fähigkeiten", "werkzeuge", "compétences",
    "outils", "competencias", "habilidades", "herramientas", "aptitudes", "competenze", "vaardigheden", "competences",
)
_MARKS = "•▪·●◦‣∙■◆*"
_STRONG = re.compile(rf"\s*(?:[,;|\t\r\n{re.escape(_MARKS)}]|(?<=\s)[/–—-](?=\s))\s*")
_WEAK = re.compile(r"\s+(?:and|und|y|e|et|en|&|\+)\s+", re.IGNORECASE)
_LEAD = re.compile(rf"^\s*(?:[{re.escape(_MARKS)}]|[-–—](?=\s)|\d{{1,2}}[.)](?=\s))\s*")
_LABEL = re.compile(r"^\s*([^\W\d_][^:,;|\t\n•▪·]{2,28}?)(?:\s*:\s*|\s+[–—-]\s+|\s{2,})(?=\S)")
_OPEN, _CLOSE = "([{", ")]}"
_QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "'": "'", "‘": "’"}


class Splitter:
    """Splits fields by the known values of a reference list; plain Python, made once per worker."""

    def __init__(self, known: Iterable[str], labels: Iterable[str] = LABELS):
        self.known = {" ".join(k.lower().split()) for k in known if k and k.strip()}
        self.labels = {x.lower() for x in labels}
        self.near = {x[:i] + x[i + 1 :] for x in self.labels for i in range(len(x)) if len(x) > 4}
        self.automaton = ahocorasick.Automaton()
        for k in self.known:
            self.automaton.add_word(k, len(k))
        if self.known:
            self.automaton.make_automaton()
        # No known value holds more delimiters than this; a mark before it and one behind may be cleaned away.
        self.inner = 2 + max((len(_STRONG.findall(k)) + len(_WEAK.findall(k)) for k in self.known), default=0)

    def spans(self, text: str) -> set[tuple[int, int]]:
        """Where known values stand as whole words."""
        if not self.known:
            return set()
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer stays, else it would shift the places
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out = set()
        for last, size in self.automaton.iter(low):
            a, b = last - size + 1, last + 1
            if (a == 0 or not low[a - 1].isalnum()) and (b == len(low) or not low[b].isalnum()):
                out.add((a, b))
        return out

    def is_label(self, text: str) -> bool:
        t = " ".join(text.lower().split())
        if t in self.known:
            return False
        return t in self.labels or t in self.near or any(t[:i] + t[i + 1 :] in self.near for i in range(len(t)) if len(t) > 4)

    def unlabelled(self, text: str) -> tuple[str, bool]:
        m = _LABEL.match(text)
        if m and self.is_label(m[1].rstrip()):
            return text[m.end() :], True
        return text, False

    def protected(self, text: str) -> list[tuple[int, int]]:
        """Quotations and brackets, outermost, as (begin, end)."""
        out, i, n = [], 0, len(text)
        begins = True  # whether a value may begin here
        while i < n:
            c = text[i]
            if c in _QUOTES and (begins or c not in "'‘"):
                j = i + 1
                while j < n:
                    if text[j] == "\\" and j + 1 < n:
                        j += 2
                        continue
                    if text[j] in _QUOTES[c]:
                        if c == '"' and j + 1 < n and text[j + 1] == '"':
                            j += 2
                            continue
                        if c in "'‘" and j + 1 < n and text[j + 1].isalnum():
                            j += 1
                            continue
                        break
                    j += 1
                if j < n:
                    out.append((i, j + 1))
                    i = j + 1
                    begins = False
                    continue
            elif c in _OPEN:
                depth, j = 0, i
                while j < n:
                    depth += (text[j] in _OPEN) - (text[j] in _CLOSE)
                    if not depth:
                        break
                    j += 1
                if j < n:
                    out.append((i, j + 1))
                    i = j + 1
                    begins = False
                    continue
            begins = c in ",;|\t\n/[(" + _MARKS or c.isspace() and begins
            i += 1
        return out

    def values(self, text: str) -> list[str]:
        """The values of a field in order, without marks, label and outer quotes; empty ones are not counted."""
        return [v for v, _ in self.cover(text)]

    def cover(self, text: str) -> list[tuple[str, bool]]:
        """The values and whether each is known."""
        text, _ = self.unlabelled(text.strip())
        text = text.strip()
        m = re.fullmatch(r"[\[({](.*)[\])}]", text, re.DOTALL)
        if m and any(s == (0, len(text)) for s in self.protected(text)):
            text = m[1].strip()
        guard, spans = self.protected(text), self.spans(text)
        inside = lambda a, b, xs: any(x <= a and b <= y for x, y in xs)
        cuts = [(m.start(), m.end(), True) for m in _STRONG.finditer(text) if not inside(m.start(), m.end(), guard)]
        strong = sum(1 for c in cuts)
        cuts += [(m.start(), m.end(), False) for m in _WEAK.finditer(text) if not inside(m.start(), m.end(), guard) and not any(a < m.end() and m.start() < b for a, b, _ in cuts)]
        cuts.sort()
        last_strong = max((a for a, _, s in cuts if s), default=-1)
        edges = [(0, 0, True), *cuts, (len(text), len(text), True)]
        best: list[tuple[float, int]] = [(0.0, -1)]
        for j in range(1, len(edges)):
            options = []
            skipped = 0.0
            for i in range(j - 1, -1, -1):
                piece = self.clean(text[edges[i][1] : edges[j][0]])
                known = piece.lower() in self.known or (edges[i][1], edges[j][0]) in spans
                inner = j - i - 1
                if known:
                    score = 10.0
                else:
                    score = skipped - (1.0 if piece else 0.0)
                # In a list the last conjunction is a delimiter, too.
                if not edges[j][2] and strong >= 1 and edges[j][0] > last_strong:
                    score += 1.5
                options.append((best[i][0] + score, i))
                if i and edges[i][2]:
                    skipped -= 100.0
                # Beyond a delimiter that must cut, only a known value can begin, and none is so long.
                if skipped < 0 and inner > self.inner:
                    break
            top = max(s for s, _ in options)
            best.append(next(x for x in options if x[0] == top))
        out, j = [], len(edges) - 1
        while j > 0:
            i = best[j][1]
            piece = self.clean(text[edges[i][1] : edges[j][0]])
            if piece:
                out.append((piece, piece.lower() in self.known))
            j = i
        out = out[::-1]
        if out and strong:  # ", and x": the conjunction is no part of its value
            head = re.match(r"(?:and|und|y|e|et|en|&)\s+(?=\S)", out[-1][0], re.IGNORECASE)
            if head and len(out) > 1 and not out[-1][1]:
                rest = out[-1][0][head.end() :]
                out[-1] = (rest, rest.lower() in self.known)
        return out

    @staticmethod
    def clean(piece: str) -> str:
        piece = _LEAD.sub("", piece.strip()).strip()
        if len(piece) > 1 and piece[0] in _QUOTES and piece[-1] in _QUOTES[piece[0]]:
            mark, piece = piece[0], piece[1:-1]
            if mark in "\"'":
                piece = re.sub(r"\\(.)", r"\1", piece)
            if mark == '"':
                piece = piece.replace('""', '"')
        return piece.strip()

    def lists(self, text: str, cover: list[tuple[str, bool]]) -> bool:
        """Whether a line lists known kinds of values: it has such a label, or known values make up
        half of its text, or a third of three or more short values."""
        if self.unlabelled(text.strip())[1]:
            return True
        size, hits = sum(len(v) for v, _ in cover), sum(known for _, known in cover)
        if not hits:
            return False
        short = all(known or len(v) <= 25 for v, known in cover)
        return sum(len(v) for v, known in cover if known) >= 0.5 * size or len(cover) >= 3 and 3 * hits >= len(cover) and short


@lru_cache(maxsize=4)
def _splitter(known: tuple[str, ...]) -> Splitter:
    return Splitter(known)


def split_packed(df: DataFrame, key: str, field: str, known: list[str], only_lists: bool = False) -> DataFrame:
    """(row_key, item_no, item) of the values packed in ``field``, positions from 1.

    ``known`` is the reference list of whole values (a fixed table, sent with the function). NULL, empty and blank
    fields give no rows, nor do empty values; repeated values are kept; repeated rows give repeated results, so pass
    one row per key; a NULL key is kept. With ``only_lists`` rows that list no such values are left out. Only the two
    columns are read, so other columns may have any name.
    """
    names = tuple(sorted(set(known)))

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = _splitter(names)
        for pdf in batches:
            keys, numbers, items = [], [], []
            for k, text in zip(pdf["row_key"], pdf["text"]):
                cover = splitter.cover(text)
                if only_lists and not splitter.lists(text, cover):
                    continue
                for i, (v, _) in enumerate(cover, 1):
                    keys.append(k)
                    numbers.append(i)
                    items.append(v)
            yield pd.DataFrame({"row_key": pd.Series(keys, dtype=object), "item_no": pd.Series(numbers, dtype="int32"), "item": pd.Series(items, dtype=object)})

    fields = df.select(F.col(f"`{key}`").cast("string").alias("row_key"), F.col(f"`{field}`").cast("string").alias("text"))
    return fields.where(r"text is not null and text rlike '\\S'").mapInPandas(explode, "row_key string, item_no int, item string")
