"""Personal information in free text, found by a linear-chain conditional random field and replaced by placeholders.

The field is trained here, on a small labelled table that ``pii_table`` draws from marked-up lines; its features are
words, shapes, beginnings and endings of a token and its neighbours and the look of the whole line. Type sizes and
places on the page are not used. Decoding is Viterbi in numpy over batches of lines of similar length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeshift.llm.pii_table import LINES, Table

TYPES = ("email", "phone", "id_number", "address", "name")
TAGS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
WIDTH = 1 << 17  # hashed features
SEEN = 5  # rows of the labelled table that make a word known
HIDDEN = 0.4
REACH = 3  # neighbours on each side that a token sees
_TOKEN = regex.compile(r"\s{2,}|\p{N}+|[\p{L}\p{M}†]+|[^\s]")

_SHAPES = ((regex.compile(r"\p{N}"), "9"), (regex.compile(r"\p{Ll}"), "x"), (regex.compile(r"\p{Lu}"), "X"), (regex.compile(r"x{3,}"), "x+"), (regex.compile(r"X{3,}"), "X+"))


def shape(word: str) -> str:
    for pattern, sign in _SHAPES:
        word = pattern.sub(sign, word)
    return word


def tokens(text: str) -> list[tuple[str, int, int]]:
    return [("  " if m[0].isspace() else m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]


# Patterns whose tokens are told to the model; it decides what they are worth.
_EMAIL = regex.compile(r"[\p{L}\p{N}.+_†-]+\s?(?:@|\(at\)|\[at\]|\b(?:AT|at)\b)\s?[\p{L}\p{N}-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\b(?:DOT|dot)\b)\s?[\p{L}\p{N}-]+)*\s?(?:\.|\(dot\)|\[dot\]|\b(?:DOT|dot)\b)\s?[\p{L}†]{2,}")
_DATE = regex.compile(r"(?<![\p{N}-])(?:(?:19|20)\p{N}{2}[-/.]\p{N}{1,2}(?:[-/.]\p{N}{1,2})?|\p{N}{1,2}[-/.]\p{N}{1,2}[-/.](?:19|20)?\p{N}{2}|\p{N}{1,2}[-/.](?:19|20)\p{N}{2}|(?:19|20)\p{N}{2}\s?[-–/]\s?(?:19|20)?\p{N}{2})(?![\p{N}-])")
_DIGITS = regex.compile(r"(?<![\p{L}\p{N}])(?:\(?\+)?\(?\p{N}(?:[\s()./–-]{0,3}\p{N})*(?![\p{L}\p{N}])")
_CODE = regex.compile(r"(?<![\p{L}\p{N}])(?=\S*\p{N}\S*\p{N}\S*\p{N})(?:\p{Lu}{1,6}[ -]?)?\p{N}[\p{Lu}\p{N}]*(?:[ -][\p{Lu}\p{N}]+)*(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\p{Lu}+\p{N}[\p{Lu}\p{N}]{4,}")
_AMOUNT = regex.compile(r"\p{N}{1,3}(?:[.,]\p{N}{3})+(?!\p{N})|\p{N}+[.,]\p{N}{1,2}(?!\p{N})|\p{N}{1,2}:\p{N}{2}|(?<!\p{N})(?:19|20)\p{N}{2}(?!\p{N})|\p{N}+\s?%")
_ROAD = regex.compile(r"(?i)\p{L}*(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig)(?!\p{L})|\b(?:street|road|lane|avenue|close|drive|square|terrace|court|way|gardens|crescent|boulevard|rue|quai|place|impasse|chemin|calle|c/|avda|avenida|plaza|paseo|via|viale|rua|box|postfach|(?:am|an der|im|auf der) \p{Lu}\p{Ll}+)(?!\p{L})")


def codes(text: str, toks: list[tuple[str, int, int]]) -> list[str]:
    """What each token is part of: an address on the net, a run of digits (how many, how it begins), letters and digits
    mixed, an amount, time, date or year, the word of a road."""
    marks: list[tuple[int, int, str]] = []
    if any(c.isdigit() for c in text):
        for m in _DIGITS.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if n >= 4:
                begin = "+" if "+" in m[0][:2] else "00" if m[0].startswith("00") else m[0][0] if m[0][0] in "0(" else "d"
                marks.append((m.start(), m.end(), f"n{min(n, 16)}{begin}{'-' if '-' in m[0] else ''}"))
        marks += [(m.start(), m.end(), f"c{shape(m[0])[:12]}") for m in _CODE.finditer(text) if any(c.isalpha() for c in m[0])]
        marks += [(m.start(), m.end(), "a") for m in _AMOUNT.finditer(text)]
        marks += [(m.start(), m.end(), "d") for m in _DATE.finditer(text)]
        marks += [(m.start(), m.end(), "r") for m in _ROAD.finditer(text)]
    if "@" in text or "at" in text or "AT" in text:
        marks += [(m.start(), m.end(), "e") for m in _EMAIL.finditer(text)]
    if not marks:
        return [""] * len(toks)
    return ["".join(sorted({k for x, y, k in marks if x < b and a < y})) for _, a, b in toks]


@lru_cache(maxsize=50_000)
def _features(word: str, known: bool = True) -> list[str]:
    low = word.lower()
    out = [f"w={low}" if known or not word[0].isalpha() else "w=?", f"s={shape(word)}", f"n={min(len(word), 9)}"]
    if word[0].isalpha():
        out += [f"p={low[:2]}", f"e={low[-3:]}", f"e2={low[-2:]}", f"e4={low[-4:]}"]
        case = "lower" if word.islower() else "upper" if word.isupper() else "title" if word[0].isupper() else "mixed"
        out += [case, f"{case}{known}", f"{case}{min(len(word), 4)}"]
    elif word.isdigit():
        out.append(f"d={len(word)}")
    else:
        out.append("mark")
    return out


def _line_features(words: list[str]) -> list[str]:
    letters = [w for w in words if w[0].isalpha()]
    big, size = sum(w[0].isupper() for w in letters) == len(letters), min(len(words), 7)
    return [
        f"size={size}", f"big={big}{min(len(letters), 5)}", f"digits={any(w.isdigit() for w in words)}", f"bar={'|' in words}{big}", f"first={words[0].lower()}", f"last={words[-1].lower()}{size}",
        f"caps={all(w.isupper() for w in letters)}{size}", f"ends={words[-1] if not words[-1][0].isalnum() else ''}{big}",
    ]


def _slot(feature: str, place: int) -> int:
    return crc32(f"{place}{feature}".encode()) % WIDTH


@lru_cache(maxsize=200_000)
def _word_slots(word: str, place: int, known: bool) -> list[int]:
    """The slots of a word's features at a place relative to the token that sees it; the empty word is the edge. Words that
    the labelled table has less than ``SEEN`` times are one unknown word, so that the model learns what to make of those."""
    features = _features(word, known) if word else ["edge"]
    return [_slot(f, place) for f in (features if abs(place) < REACH else features[:2])]


_BARS = ("|", "·", ";", "•", "  ")


class Crf:
    """Emissions from hashed features of tokens, neighbours and the line; transitions between tags."""

    def __init__(self):
        self.weights = np.zeros((WIDTH, len(TAGS)), "float32")
        self.steps = np.zeros((len(TAGS), len(TAGS)), "float32")
        self.start = np.zeros(len(TAGS), "float32")
        for i, a in enumerate(TAGS):  # an inside tag only follows its own kind
            for j, b in enumerate(TAGS):
                if b[0] == "I" and a[2:] != b[2:]:
                    self.steps[i, j] = -1e4
        self.start[[i for i, t in enumerate(TAGS) if t[0] == "I"]] = -1e4
        self.memory: dict[str, np.ndarray] = {}
        self.coded: dict[str, np.ndarray] = {}
        self.known: frozenset[str] = frozenset()

    def ids(self, words: list[str], coded: list[str], hidden: frozenset[int] = frozenset()) -> list[list[int]]:
        line = [_slot(f, 99) for f in _line_features(words)]
        out = []
        for i in range(len(words)):
            here = list(line)
            for k in range(-REACH, REACH + 1):
                word = words[i + k] if 0 <= i + k < len(words) else ""
                here += _word_slots(word, k, word.lower() in self.known and i + k not in hidden)
            here += [_slot(f"c={coded[i + k]}", 50 + k) for k in (-1, 0, 1) if 0 <= i + k < len(words)]
            out.append(here)
        return out

    def train(self, rows: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 5, rate: float = 0.25, keep: float = 2e-7, seed: int = 7) -> Crf:
        """Maximum likelihood by AdaGrad over batches of lines of equal length."""
        data = []
        counts = Counter(w.lower() for text, _ in rows for w, _, _ in tokens(text))
        self.known = frozenset(w for w, n in counts.items() if n >= SEEN)
        r = np.random.default_rng(seed)
        for text, spans in rows:
            toks = tokens(text)
            if not toks:
                continue
            # In every other line words are hidden, so that none is relied on too much.
            hidden = frozenset(np.flatnonzero(r.random(len(toks)) < HIDDEN).tolist()) if r.random() < 0.5 else frozenset()
            tags = []
            for _, a, b in toks:
                hit = next(((x, kind) for x, y, kind in spans if x <= a and b <= y), None)
                tags.append("O" if hit is None else ("B-" if a == hit[0] else "I-") + hit[1])
            data.append((self.ids([w for w, _, _ in toks], codes(text, toks), hidden), [TAGS.index(t) for t in tags]))
        seen_w, seen_t = np.full(self.weights.shape, 1e-6, "float32"), np.full(self.steps.shape, 1e-6, "float32")
        seen_s = np.full(self.start.shape, 1e-6, "float32")
        by_size: dict[int, list[int]] = {}
        for i, (x, _) in enumerate(data):
            by_size.setdefault(len(x), []).append(i)
        batches = []
        for group in by_size.values():
            group = r.permutation(group)
            batches += [self._prepared([data[i] for i in group[k : k + 48]]) for k in range(0, len(group), 48)]
        for _ in range(rounds):
            for k in r.permutation(len(batches)):
                flat, counts, touched, order, starts, owner, gold = batches[k]
                n, size = gold.shape
                emit = np.add.reduceat(self.weights[flat], counts).reshape(n, size, -1)
                grad_e, grad_t = self._gradient(emit, gold)
                g = np.add.reduceat(grad_e.reshape(n * size, -1)[owner[order]], starts) / n - keep * len(data) * self.weights[touched]
                seen_w[touched] += g * g
                self.weights[touched] += rate * g / np.sqrt(seen_w[touched])
                grad_t /= n
                seen_t += grad_t * grad_t
                self.steps += np.where(self.steps < -1e3, 0, rate * grad_t / np.sqrt(seen_t))
                s = grad_e[:, 0].sum(0) / n
                seen_s += s * s
                self.start += np.where(self.start < -1e3, 0, rate * s / np.sqrt(seen_s))
        return self

    @staticmethod
    def _prepared(rows: list) -> tuple:
        """A batch of lines of one length as arrays: features by token, and the same ordered by feature."""
        each = [t for x, _ in rows for t in x]
        flat = np.concatenate([np.array(t) for t in each])
        sizes = np.array([len(t) for t in each])
        owner = np.repeat(np.arange(len(each)), sizes)
        order = np.argsort(flat, kind="stable")
        touched, starts = np.unique(flat[order], return_index=True)
        return flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), touched, order, starts, owner, np.array([y for _, y in rows])

    def _gradient(self, emit: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected counts: of tags by place, and of tag pairs."""
        n, size, tags = emit.shape
        ahead = np.empty_like(emit)
        ahead[:, 0] = emit[:, 0] + self.start
        for i in range(1, size):
            ahead[:, i] = emit[:, i] + _logsum(ahead[:, i - 1, :, None] + self.steps, 1)
        behind = np.zeros_like(emit)
        for i in range(size - 2, -1, -1):
            behind[:, i] = _logsum(self.steps + (emit[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
        total = _logsum(ahead[:, -1], 1)[:, None, None]
        grad = -np.exp(ahead + behind - total)
        pair = np.zeros_like(self.steps)
        for i in range(1, size):
            pair -= np.exp(ahead[:, i - 1, :, None] + self.steps + (emit[:, i] + behind[:, i])[:, None, :] - total).sum(0)
            np.add.at(pair, (gold[:, i - 1], gold[:, i]), 1)
        grad[np.arange(n)[:, None], np.arange(size), gold] += 1
        return grad, pair

    def _word(self, word: str) -> np.ndarray:
        """The summed weights of a word's features at each place relative to the token that sees it."""
        known = self.memory.get(word)
        if known is None:
            known = np.stack([self.weights[_word_slots(word, k, word.lower() in self.known)].sum(0) for k in range(-REACH, REACH + 1)]).astype("float32")
            if len(self.memory) > 60_000:
                self.memory.clear()
            self.memory[word] = known
        return known

    def _code(self, code: str) -> np.ndarray:
        """The weights of a pattern at the token before it, its own and the one behind it."""
        known = self.coded.get(code)
        if known is None:
            if len(self.coded) > 20_000:
                self.coded.clear()
            known = self.coded[code] = np.stack([self.weights[_slot(f"c={code}", 50 + k)] for k in (-1, 0, 1)]).astype("float32")
        return known

    def decode(self, lines: list[list[str]], coded: list[list[str]]) -> list[np.ndarray]:
        """The best tags of each line: Viterbi over batches of lines of similar length."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(lines)
        order = sorted((i for i in range(len(lines)) if lines[i]), key=lambda i: len(lines[i]))
        at = 0
        while at < len(order):
            longest = len(lines[order[at]])
            count = max(1, min(512, 60_000 // (longest + 4)))
            batch = order[at : at + count]
            at += count
            size = len(lines[batch[-1]])
            vocabulary: dict[str, int] = {"": 0}
            ids = np.zeros((len(batch), size + 2 * REACH), int)
            mask = np.zeros((len(batch), size), bool)
            extra = np.zeros((len(batch), len(TAGS)), "float32")
            patterns: dict[str, int] = {}
            marked = np.full((len(batch), size + 2), -1)
            for row, i in enumerate(batch):
                words = lines[i]
                ids[row, REACH : REACH + len(words)] = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
                mask[row, : len(words)] = True
                marked[row, 1 : 1 + len(words)] = [patterns.setdefault(c, len(patterns)) for c in coded[i]]
                extra[row] = self.weights[[_slot(f, 99) for f in _line_features(words)]].sum(0)
            tables = np.stack([self._word(w) for w in vocabulary])
            emit = extra[:, None, :] + sum(tables[ids[:, REACH + k : REACH + k + size], k + REACH] for k in range(-REACH, REACH + 1))
            told = np.concatenate([np.stack([self._code(c) for c in patterns]), np.zeros((1, 3, len(TAGS)), "float32")])  # -1 is the edge
            emit += sum(told[marked[:, 1 + k : 1 + k + size], 1 + k] for k in (-1, 0, 1))
            bars = np.isin(ids[:, REACH : REACH + size], [vocabulary[w] for w in _BARS if w in vocabulary])
            emit[..., 1:] -= 1e4 * bars[..., None]  # what parts items belongs to none
            score = emit[:, 0] + self.start
            back = np.zeros((len(batch), size, len(TAGS)), "int8")
            for i in range(1, size):
                step = score[:, :, None] + self.steps
                best = step.argmax(1)
                fresh = np.take_along_axis(step, best[:, None, :], 1)[:, 0] + emit[:, i]
                live = mask[:, i, None]
                back[:, i] = np.where(live, best, np.arange(len(TAGS)))
                score = np.where(live, fresh, score)
            tag = score.argmax(1)
            path = np.empty((len(batch), size), "int8")
            for i in range(size - 1, -1, -1):
                path[:, i] = tag
                tag = back[np.arange(len(batch)), i, tag]
            for row, i in enumerate(batch):
                out[i] = path[row, : len(lines[i])]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


@lru_cache(maxsize=2)
def trained(lines: int = LINES, seed: int = 11) -> Crf:
    return Crf().train(Table(seed).rows(lines))


# Labels, forms of address and titles that don't belong to an item.
_BEFORE = regex.compile(
    r"(?:(?:e-?mail|mail|courriel|correo|tel|tél|phone|mobil|mobile|fon|fax|address|adresse|anschrift|wohnhaft|name|nom|passport|steuer-id|ni|national id|id card|personalausweis|dni|ssn|carte d'identité|nif"
    r"|herrn?|frau|mrs|mr|ms|mme|mlle|dr|prof|sra|sr|signed|von|of|by|no|n°|nr)\b[.:]*|[✉☎:;,|·•\s])+", regex.IGNORECASE)
_AT = regex.compile(r"@|\bat\b|\(at\)|\[at\]", regex.IGNORECASE)



def _checked(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The exact bounds of an item, or None where it can't be one."""
    item = text[a:b]
    if kind != "address" and (m := _BEFORE.match(item)) and m.end() < len(item):
        if not (kind == "name" and regex.match(r"(?i)(von|of|de)\b", item)):
            a += m.end()
    if kind == "email":
        for m in _EMAIL.finditer(text):
            if m.start() < b and a < m.end():
                a, b = m.span()
                break
    if kind == "phone":
        if a and text[a - 1] == "(" and ")" in text[a:b] and "(" not in text[a : text.index(")", a)]:
            a -= 1
        if a and text[a - 1] == "+":
            a -= 1
        if text[a] == "(" and text[a:b].count("(") > text[a:b].count(")"):
            a += 1
    while b > a and text[b - 1] in " \t,;:|·•":
        b -= 1
    while b > a and text[a].isspace():
        a += 1
    item = text[a:b]
    digits = sum(c.isdigit() for c in item)
    if kind == "email":
        good = _AT.search(item) is not None and len(item) > 5 and ("." in item or regex.search(r"(?i)dot", item) is not None)
    elif kind == "phone":
        good = digits >= 6
    elif kind == "id_number":
        good = digits >= 5 and len(item) >= 7
    elif kind == "address":
        good = digits >= 1 and len(regex.findall(r"\p{L}{3,}", item)) >= 1
    else:
        good = any(len(w) > 1 for w in regex.findall(r"\p{L}[\p{L}'’†@0-9]+", item)) and digits <= 2
    return (a, b) if good else None


def find_items(texts: list[str], model: Crf) -> list[list[tuple[int, int, str]]]:
    """The personal items (begin, end, type) of each line."""
    cut = [tokens(t) for t in texts]
    paths = model.decode([[w for w, _, _ in c] for c in cut], [codes(t, c) for t, c in zip(texts, cut)])
    out = []
    for text, toks, path in zip(texts, cut, paths):
        found, i = [], 0
        while i < len(toks):
            tag = TAGS[path[i]]
            if tag[0] == "O":
                i += 1
                continue
            j = i + 1
            while j < len(toks) and TAGS[path[j]] == f"I-{tag[2:]}":
                j += 1
            if span := _checked(text, toks[i][1], toks[j - 1][2], tag[2:]):
                found.append((*span, tag[2:]))
            i = j
        out.append(found)
    return out


def _lines(df: DataFrame, key: str, field: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{field}`").alias("text"))


def find_pii(df: DataFrame, key: str, field: str) -> DataFrame:
    """(block_id, pii_type, start_pos, end_pos) of every personal item in ``field``, in code points.

    NULL, empty and blank texts give no rows; long texts are read whole; repeated rows give repeated results; NULL keys
    are allowed; other columns are not read. The model is trained once on the driver from the labelled table (``LINES``
    rows) and sent to the workers; its size is fixed by ``WIDTH``.
    """
    model = df.sparkSession.sparkContext.broadcast(trained())
    kind = dict(df.dtypes)[key]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = find_items(list(pdf["text"]), model.value)
            rows = [(k, t, a, b) for k, items in zip(pdf["id"], found) for a, b, t in items]
            if rows:
                yield pd.DataFrame(rows, columns=["block_id", "pii_type", "start_pos", "end_pos"])

    texts = _lines(df, key, field).where(r"text is not null and text rlike '\\S'")
    return texts.mapInPandas(search, f"block_id {kind}, pii_type string, start_pos int, end_pos int")


def redact_pii(df: DataFrame, key: str, field: str) -> DataFrame:
    """(block_id, text) with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and ``[NAME]`` in place of the items.

    Every row stays, everything else in its text as it was; NULL and blank texts stay as they are. Else as ``find_pii``.
    """
    model = df.sparkSession.sparkContext.broadcast(trained())
    kind = dict(df.dtypes)[key]

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = find_items([t or "" for t in pdf["text"]], model.value)
            out = []
            for text, items in zip(pdf["text"], found):
                for a, b, t in reversed(items):
                    text = f"{text[:a]}[{t.upper()}]{text[b:]}"
                out.append(text)
            yield pd.DataFrame({"block_id": pdf["id"], "text": out})

    return _lines(df, key, field).mapInPandas(replace, f"block_id {kind}, text string")
