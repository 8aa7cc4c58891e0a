"""Sentence boundaries across languages and scripts.

The terminators, closers and letters of all scripts come from the standard Sentence_Break property; the standard rules
decide at every terminator (numbers, upper and lower case, continuations), with three additions: language-specific
abbreviations that don't end a sentence, quotations and brackets that are closed before they end one, and the layout
of pages (headings, list items and lines of their own are units; hard wrapping is none).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that never end a sentence, whatever follows.
NEVER = frozenset(
    """mr mrs ms dr drs prof capt col gen lt sgt rev hon gov sen st mt messrs attn vs v cf viz al eg ie e.g i.e approx ca
    hr hrn fr frl fa vgl bzw inkl exkl sog z b z.b d.h u.a i.d.r z.t ggf evtl gem lt tel str dipl ing
    sra srta dña d dn sres dtor dra avda av ee ee.uu uu aprox p.ej ej pág págs núm art arts cap ref
    m mm mme mmes mlle pr me p pp chap ex p.ex boul env
    т т.е т.к им ул просп пер пл д кв стр руб тыс млн млрд см рис гл ред проф акад
    डॉ श्री प्रो रु सुश्री कु
    د أ م ص sig sigg dott ing""".split()
)
# Abbreviations that don't end a sentence before a number (or a name after "г.", "vol." and the like).
BEFORE_NUMBER = frozenset("no nr nos fig figs sec vol vols ch chap para pos abs art arts kap bd s st p pp pág jan feb mar apr jun jul aug sep sept oct nov dec fri mon tue wed thu sat sun eq ref ext approx ca h n т № ст пп".split())
# Abbreviations before a name.
BEFORE_NAME = frozenset("г гор с пос дер обл р sec vol sr jr".split())
# After an ordinal number and a dot these go on with the sentence.
GERMAN_MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jahrhundert stock platz klasse etage".split())
# Words after "a.m." and "p.m." that go on with the sentence.
ZONES = frozenset("eastern pacific central mountain greenwich gmt utc cet cest est pst edt pdt bst".split())
# How a sentence goes on after a closed quotation, where the script has no case to show it.
GO_ON = (
    "然后", "随后", "接着", "于是", "说", "问", "答", "道", "喊", "主管", "经理问", "经理说", "经理道", "的", "是", "就", "便", "并", "而", "也", "這", "這樣", "然後", "說", "問",
    "と", "って", "は", "が", "を", "に", "の", "も", "で", "という", "とは",
    "और", "फिर", "कहा", "बोले", "बोला", "ने", "पूछा", "कहकर", "यह", "तथा",
    "ثم", "وقال", "قال", "فقال", "قالت", "سأل", "سألت", "صاح", "وغادر", "وسأل", "هكذا",
)

_LINE = regex.compile(r"[^\r\n\x0b\x0c\x85  ]*(?:\r\n|[\r\n\x0b\x0c\x85  ]|$)")
_BULLET = regex.compile(r"\s*(?:[•▪·●◦‣∙■◆*]\s*(?=\S)|[-–—]\s+(?=\S)|\(?\d{1,3}\)\s*(?=\S)|\(?\p{Ll}\)\s+)")
_NUMBERED = regex.compile(r"\s*(\d{1,3})\.\s+(?=\S)")
# Terminators of all scripts, with what may stand between them: "?!", "...", "……".
_STOP = regex.compile(r"(?:[\p{SB=ST}\p{SB=AT}…⋯]\s?(?=[!?…]))*[\p{SB=ST}\p{SB=AT}…⋯]+(?<!\s)")
_CLOSERS = regex.compile(r"[\p{Pe}\p{Pf}\"'”’“»«›‹*_]*")
_ORDINAL = regex.compile(r"\b\d{1,2}\.\s*$")
_BROKEN = regex.compile(r"[\p{SB=ST}…\n\p{Thai}]")
_FINAL = regex.compile(r"[\p{SB=ST}\p{SB=AT}…:][\p{Pe}\p{Pf}\"'”]*\s*$")
_THAI_BLANK = regex.compile(r"(?<=[\u0e01-\u0e3a\u0e40-\u0e4e])[^\S\r\n]+(?=[\u0e01-\u0e3a\u0e40-\u0e4e])")
_PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "‚": "‘’", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "(": ")", "[": "]", "【": "】", "‹": "›", "〝": "〞", "‘": "’", '"': '"', "'": "'"}
_MARKS = re.compile("[" + re.escape("".join(sorted({*_PAIRS, *"".join(_PAIRS.values())}))) + "]")
_WORDS, _NUMBERS, _GLUED = regex.compile(r"[\p{L}\p{M}.º№]+"), regex.compile(r"[\p{L}\p{M}\p{N}.]+"), regex.compile(r"\S+")
_NET = regex.compile(r"[@/\\]|www\.")
_FIRST = regex.compile(r"[^\s-]+-?")
_SHUT = regex.compile(r"[\p{Pe}\p{Pf}]*")
_COLON = regex.compile(r"[:：]\s*$")
_LETTERS = regex.compile(r"\p{L}+")
_DOTTED = regex.compile(r"(?:\p{L}\.)+\p{L}")
_HIRAGANA = regex.compile(r"\p{Hiragana}")
COLUMNS = 130  # no hard wrapping is as wide; a longer line is a paragraph of its own
_IDEOGRAPHIC = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_CASELESS = regex.compile(r"\p{SB=LE}")


def _quotations(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Outermost matched quotations and brackets in text[a:b], as (begin, end). One pass: each kind of mark has a stack of
    what is open, so a mark that nothing closes costs nothing and hides nothing, however far the next one is."""
    open_: dict[str, list[int]] = {}
    waiting: dict[str, list[str]] = {}  # by closing mark: the kinds it may close
    found = []
    for m in _MARKS.finditer(text, a, b):
        i, c = m.start(), m[0]
        before, after = text[i - 1] if i > a else " ", text[i + 1] if i + 1 < b else " "
        closed = False
        for kind in waiting.get(c, ()):
            stack = open_.get(kind)
            if not stack:
                continue
            if kind == "'" and (after.isalnum() or before not in ".!?,…") or kind == '"' and before.isspace() or c == "‘" and after.isalpha():
                continue
            found.append((stack.pop(), i + 1))
            closed = True
            break
        close = None if closed else _PAIRS.get(c)
        if close is None:
            continue
        plain = c in "\"'"
        if plain or c in "»‘“":
            # One mark for both sides, or one that closes elsewhere: it opens after a blank, an opener or a dash.
            opens = (before.isspace() or before in "([{¿¡—–-：:，。、；！？" or not plain and _IDEOGRAPHIC.match(before)) and not after.isspace()
            if c == '"' and not opens and i > a and before in ".!?…।。" and after.isupper():
                opens = True
            if not opens and not (c == "“" and (_IDEOGRAPHIC.match(after) or after.isupper() and before in ".!?")):
                continue
        if plain and open_.get(c):
            open_[c][-1] = i  # two in a row open: the first is unmatched
            continue
        open_.setdefault(c, []).append(i)
        for d in close:
            kinds = waiting.setdefault(d, [])
            if c not in kinds:
                kinds.append(c)
    out: list[tuple[int, int]] = []
    for x, y in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or x >= out[-1][1]:
            out.append((x, y))
    return out


class _Runs:
    """The runs of token letters and of non-blanks in a paragraph, found once: what stands before a terminator."""

    def __init__(self, text: str, a: int, b: int):
        self.text, self.a, self.b = text, a, b
        self.runs: list[list[tuple[int, int]]] = [[], [], []]
        self.begins: list[list[int]] = [[], [], []]
        self.sign: dict[int, int] = {}

    def _begin(self, kind: int, stop: int) -> int:
        if not self.runs[kind]:
            self.runs[kind] = [m.span() for m in (_WORDS, _NUMBERS, _GLUED)[kind].finditer(self.text, self.a, self.b)]
            self.begins[kind] = [x for x, _ in self.runs[kind]]
        k = bisect_left(self.begins[kind], stop) - 1
        return self.runs[kind][k][0] if k >= 0 and stop <= self.runs[kind][k][1] else stop

    def token(self, stop: int) -> str:
        return self.text[min(self._begin(0, stop), self._begin(1, stop)) : stop]

    def on_the_net(self, stop: int) -> bool:
        """Whether what stands before ``stop`` without a blank is an address on the net or a path."""
        begin = self._begin(2, stop)
        if begin not in self.sign:
            end = self.runs[2][bisect_left(self.begins[2], stop) - 1][1] if begin < stop else stop
            m = _NET.search(self.text, begin, end)
            self.sign[begin] = m.end() if m else len(self.text) + 1
        return self.sign[begin] <= stop


def _paragraphs(text: str) -> Iterator[tuple[int, int, bool]]:
    """Runs of lines that belong together, as (begin, end, whether it is one unit whatever it holds)."""
    lines = []
    for m in _LINE.finditer(text):
        if m.end() == m.start():
            break
        lines.append((m.start(), m.end(), len(m[0].rstrip())))
    # The width of the wrapping is that of the longest line no wider than ``COLUMNS``; wider lines aren't wrapped. Where such
    # lines stand beside, most lines of a text that goes on in the next must come near it, else each is a paragraph.
    width = max((n for _, _, n in lines if n <= COLUMNS), default=0)
    inner = [n for (_, _, n), (_, _, m) in zip(lines, lines[1:]) if 0 < n <= COLUMNS and m]
    wrapped = all(n <= COLUMNS for _, _, n in lines) or width >= 40 and len(inner) >= 4 and 3 * sum(n >= 0.75 * width for n in inner) >= 2 * len(inner)
    begin, item = None, False
    for k, (a, b, n) in enumerate(lines):
        if not n:
            if begin is not None:
                yield begin, a, item
            begin = None
            continue
        line = text[a:b]
        mark = _BULLET.match(line)
        goes_on = False
        if begin is not None:
            pa, _, pn = lines[k - 1]
            head = line.lstrip()
            word = _FIRST.match(head)
            size = word.end() if word else 0
            # A line break is a hard wrap where the next word would not have fitted into the line. Some slack: widths
            # are measured on lines in which something may have been put in later.
            ended = _FINAL.search(text, pa, pa + pn) is not None
            goes_on = wrapped and 30 <= pn <= COLUMNS and (pn + 1 + size > width - 6 or pn >= 40 and not ended and pn >= 0.55 * width)
            numbered = _NUMBERED.match(line)
            if mark and not (goes_on and line.lstrip()[:1] in "-–—" and not item):
                goes_on = False
            elif numbered and not goes_on:
                mark = numbered
            if not mark and pn >= 20 and _ORDINAL.search(text, pa, pa + pn) and head.split(maxsplit=1)[0].lower().strip(".,") in GERMAN_MONTHS:
                goes_on = True
            if goes_on and _COLON.search(text, pa, pa + pn) and pn < 30:
                goes_on = False
        else:
            mark = mark or _NUMBERED.match(line)
        if not goes_on:
            if begin is not None:
                yield begin, a, item
            begin, item = a, bool(mark)
    if begin is not None:
        yield begin, len(text), item


def _ends(text: str, a: int, stop: int, after: int, b: int, one_dot: bool, runs: _Runs) -> bool:
    """Whether the terminator text[stop:after] (closers included) ends a sentence that began at or after a."""
    nxt = after
    while nxt < b and text[nxt].isspace():
        nxt += 1
    if nxt >= b:
        return True
    blank = nxt > after
    c = text[nxt]
    closed = after > stop + 1 and text[after - 1] not in ".!?…。！？।؟۔｡"
    if c in ",;:،؛，；：、%)]}»”’」』）》":  # standard rule 8a: continuation
        return False
    # What a dash or an opener hides: case decides (rule 8).
    k, dashed = nxt, False
    while k < b and (text[k] in "—–-" or text[k].isspace() or text[k] in "\"'“„«»‘([¿¡"):
        dashed = dashed or text[k] in "—–-"
        k += 1
    first = text[k] if k < b else ""
    if first.islower():
        return text[nxt] in "¿¡" or first in "ªº" and blank
    term = text[stop]
    if closed and text[nxt : nxt + 8].startswith(GO_ON) and _CASELESS.match(c):
        return False
    if closed and not blank and _IDEOGRAPHIC.match(c) and _HIRAGANA.match(c):
        return False
    if closed and dashed and text[nxt] in "—–-" and not first.isupper():
        return False
    if term not in ".․﹒．" or not one_dot:
        return blank or term != "." or not first.isalnum() or first.isupper() or bool(_CASELESS.match(first))
    word = runs.token(stop)
    low = word.lower().strip(".")
    if not blank:
        if c.isdigit() or not (c.isupper() or _CASELESS.match(c) or c in "\"“„«»¿¡—([‘'•"):
            return False  # rule 6
        # Rule 7 keeps "S.A" and file names together; a word in small letters, a number or a closer before is an end.
        if closed:
            return True
        if runs.on_the_net(stop) or "." in word and not regex.fullmatch(r"[\d.]+|\p{Ll}+\.\p{Ll}\.?|v?[\d.]+", word):
            return False
        if low in NEVER or low in BEFORE_NUMBER and len(low) < 3:
            return False
        last = word[-1:]
        if last.isdigit() or text[stop - 1] in "%)]\"”»":
            return c not in "(["
        return len(low) >= 2 and (word.islower() or word.istitle() and len(word) > 3 or word.isupper() and len(word) > 2 or not word.isascii())
    if closed:
        return True
    if low in ("a.m", "p.m"):
        follow = _LETTERS.match(text, nxt, b)
        return not (follow and follow[0].lower() in ZONES)
    if low in NEVER or word.lower() in NEVER:
        if low in ("p", "m", "z", "b", "d", "v", "t") and word.isupper() and len(word) == 1:
            return False
        return False
    digit = c.isdigit() or c == "#"
    if low in BEFORE_NUMBER and digit:
        return False
    if low in BEFORE_NAME and (c.isupper() or digit):
        return low == "г" and regex.search(r"\d\s*$", text[max(a, stop - 8) : stop - len(word)]) is not None
    if len(low) == 1 and word.isalpha() and (word.isupper() or not word.islower()) and not digit:
        return False  # an initial
    if len(low) == 1 and word.islower() and word not in ("т",):
        return False
    if _DOTTED.fullmatch(word) and len(low) == 3 and word.islower() and low not in ("т.д", "т.п", "a.m", "p.m"):
        return False
    if low.isdigit():
        follow = _LETTERS.match(text, nxt, b)
        if follow and follow[0].lower() in GERMAN_MONTHS:
            return False
        if stop - len(word) <= a:
            return False  # the number of a list item
    return True


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """The units of a text as (begin, end) in code points; none of a NULL, empty or blank text."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []

    def put(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    for a, b, whole in _paragraphs(text):
        while b > a and text[b - 1].isspace():
            b -= 1
        if whole or b - a <= 45 and _FINAL.search(text, a, b) is None and _BROKEN.search(text, a, b) is None:
            put(a, b)  # a list item, or a line of its own that isn't written as a sentence
            continue
        cuts = [m.end() for m in _THAI_BLANK.finditer(text, a, b)]
        stops = list(_STOP.finditer(text, a, b))
        if stops:
            quotes = _quotations(text, a, b)
            begins = [x for x, _ in quotes]
            runs = _Runs(text, a, b)
        for m in stops:
            stop, after = m.start(), m.end()
            k = bisect_right(begins, stop) - 1
            if k >= 0 and stop < quotes[k][1]:
                # Inside a quotation: only its end can end the sentence, and only if the terminator is its last part.
                if _CLOSERS.fullmatch(text, after, quotes[k][1]) is None:
                    continue
                after = quotes[k][1]
                while after < b and text[after] in "”’»」』）)]\"" and not any(x == after for x in begins):
                    after += 1
            else:
                closers = _SHUT.match(text, after, b)
                after = closers.end()
            one_dot = m.end() - m.start() == 1
            if _ends(text, a, stop, after, b, one_dot, runs):
                cuts.append(after)
        last = a
        for c in sorted(set(cuts)):
            put(last, c)
            last = c
        put(last, b)
    return out


def sentences(df: DataFrame, key: str, field: str) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence unit, in code points, ends exclusive.

    NULL, empty and blank texts give no rows; a text of any length is read whole; repeated rows give repeated
    results; a NULL key is kept; other columns are not read. No shuffle: each text is cut where it lies.
    """

    def cut_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, begins, ends = [], [], []
            for k, text in zip(pdf["doc_id"], pdf["text"]):
                for a, b in sentence_spans(text):
                    ids.append(k)
                    begins.append(a)
                    ends.append(b)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=pdf["doc_id"].dtype), "start_pos": pd.Series(begins, dtype="int32"), "end_pos": pd.Series(ends, dtype="int32")})

    kind = dict(df.dtypes)[key]
    texts = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{field}`").alias("text")).where("text is not null and text != ''")
    return texts.mapInPandas(cut_texts, f"doc_id {kind}, start_pos int, end_pos int")
