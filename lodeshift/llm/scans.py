"""Noise in text from scanned pages: page furniture, words broken over lines, misrecognised characters.

Words that no clean text knows are looked up in a vocabulary: a Levenshtein automaton is intersected with the trie of the
vocabulary and gives every word within a distance that grows with the word (``reach``), any edit allowed; a walk over
look-alike edits gives besides every word up to ``MOST_EDITS`` look-alikes away, which may be twice as many plain edits.
What is retrieved is only ranked after that: by look-alikes, other edits, context and frequency. The vocabulary is split
into parts of a fixed size, each with its own trie, the unknown words into blocks, and each block meets the parts whose
word lengths it can reach, so nothing has to fit one machine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeshift.operators.graph import connected_components
from lodeshift.session import cut, is_bounded, shuffle_width, stored

# What scanning makes of characters: (printed, read).
LOOKALIKES = (
    ("o", "0"), ("l", "1"), ("i", "1"), ("i", "!"), ("i", "í"), ("i", "l"), ("l", "i"), ("l", "!"), ("s", "5"), ("s", "$"), ("g", "9"), ("t", "†"), ("a", "@"), ("e", "c"), ("c", "e"), ("h", "b"), ("b", "h"), ("b", "6"), ("b", "8"), ("i", "|"), ("l", "|"), ("z", "2"),
    ("n", "ri"), ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("w", "vv"), ("ü", "ii"), ("é", "e"), ("ö", "o"), ("q", "9"), ("y", "v"), ("f", "t"), ("li", "h"), ("h", "li"),
)
MARKS = "-­¬‐‑"
SHARD = 100_000  # words in one trie
ASKED = 50_000  # unknown words that one task looks up in a trie
MOST_EDITS = 3  # look-alikes in one word, and the largest distance of the automaton
OTHER = 3  # what an edit that no look-alike explains weighs, in look-alikes
_WORD = re.compile(r"(?:(?<!\S)\|(?=[^\W\d_]{2}))?[^\W_†@!$'’]*[\w†@!$][\w†@!$'’]*")  # a bar at the begin of a word is an I
_BROKEN = regex.compile(rf"([\p{{L}}\p{{M}}†@!$0-9'’]+(?:[-][\p{{L}}\p{{M}}†@!$0-9'’]+)*)[{MARKS}]\s*$")
_HEAD = regex.compile(r"\s*((?![A-Z])[\p{L}\p{M}†@!$0-9'’]+(?:-[\p{L}\p{M}†@!$0-9'’]+)*)")
_NUMBER = r"(?i)^[\W_]*(page|seite|página|pagina|pág\.?|p\.|s\.|blatt)?[\W_]*[0-9lO]+[\W_]*((of|von|de|sur|/)[\W_]*[0-9lO]+)?[\W_]*$"
_TAIL = regex.compile(r"@[^@.]*\W*")
_SKIP = regex.compile(r"\S*(?:@[\p{L}\p{N}-]+\.|\bwww\.|@\d|\(at\)|\[at\])\S*|(?<!\S)@\S+")


_READ: dict[str, list[str]] = {}
for _printed, _read in LOOKALIKES:
    _READ.setdefault(_read, []).append(_printed)


_NET = re.compile(r"[(\[]at[)\]]")


def reach(size: int) -> int:
    """The distance within which a word of ``size`` letters is looked up, whatever the edits."""
    return 1 if size < 5 else 2 if size < 12 else 3


@lru_cache(maxsize=4)
def levenshtein_states(most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(next, cells, start) of the universal Levenshtein automaton for up to ``most`` edits.

    A state is the row of distances in the band around the diagonal, clipped at ``most`` + 1; it is the same for every
    word, for it reads no letters but which of the 2 * most + 1 letters around the diagonal equal the one that is read:
    ``next[state, bits]``. State 0 is dead. ``cells[state]`` are the distances.
    """
    width, over = 2 * most + 1, most + 1
    equal = (np.arange(1 << width)[:, None] >> np.arange(width)) & 1
    rows = [(over,) * width, (*(over,) * most, *range(most + 1))]
    index = {r: i for i, r in enumerate(rows)}
    steps: list[np.ndarray] = []
    while len(steps) < len(rows):
        old = np.array((*rows[len(steps)], over))
        new = np.empty((1 << width, width), int)
        for t in range(width):
            best = np.minimum(old[t + 1] + 1, old[t] + 1 - equal[:, t])
            new[:, t] = np.minimum(best if t == 0 else np.minimum(best, new[:, t - 1] + 1), over)
        distinct, which = np.unique(new, axis=0, return_inverse=True)
        for r in map(tuple, distinct.tolist()):
            if r not in index:
                index[r] = len(rows)
                rows.append(r)
        steps.append(np.array([index[tuple(r)] for r in distinct.tolist()], "int32")[which.ravel()])
    return np.array(steps), np.array(rows), 1


class LetterTrie:
    """A vocabulary's trie as arrays, level by level, intersected with Levenshtein automata for many words at once."""

    def __init__(self, words):
        self.words = sorted(words)
        self.letters: list[np.ndarray] = []  # by depth: the letter of each node, in order of its parent
        self.children: list[np.ndarray] = []  # by depth: where each node's children begin in the next level
        self.ends: list[np.ndarray] = []  # by depth: the word that ends in each node, or -1
        runs = [(0, len(self.words))] if self.words else []  # the words below each node of the level
        depth = 0
        while runs:
            letters, ends, below, first = [], [], [], []
            for a, b in runs:
                end = a if len(self.words[a]) == depth else -1
                ends.append(end)
                first.append(len(below))
                k = a + (end >= 0)
                while k < b:
                    c, begin = self.words[k][depth], k
                    while k < b and self.words[k][depth] == c:
                        k += 1
                    letters.append(ord(c))
                    below.append((begin, k))
            self.ends.append(np.array(ends))
            self.children.append(np.array([*first, len(below)]))
            self.letters.append(np.array(letters, "int32"))
            runs, depth = below, depth + 1

    def within(self, asked: list[str], most: int) -> Iterator[tuple[str, str, int]]:
        """(word, known, distance) of every vocabulary word at most ``most`` edits from an asked word, any edits."""
        if not self.words or not asked:
            return
        steps, cells, start = levenshtein_states(most)
        bits = 1 << np.arange(2 * most + 1)
        for low in range(0, len(asked), 256):
            block = asked[low : low + 256]
            sizes = np.array([len(w) for w in block])
            # All words one behind the other; what stands between them equals no letter.
            flat = np.full(int(sizes.sum()) + len(block) * (3 * most + 2), -1, "int32")
            offset = np.concatenate([[0], np.cumsum(sizes + 3 * most + 2)[:-1]]) + most
            for o, w in zip(offset, block):
                flat[o : o + len(w)] = [ord(c) for c in w]
            who, node, state = np.arange(len(block)), np.zeros(len(block), int), np.full(len(block), start)
            for depth in range(len(self.letters)):
                end = self.ends[depth][node]
                place = sizes[who] - depth + most
                hit = (end >= 0) & (place >= 0) & (place <= 2 * most)
                if hit.any():
                    distance = cells[state[hit], place[hit]]
                    for w, e, d in zip(who[hit], end[hit], distance):
                        if d <= most:
                            yield block[w], self.words[e], int(d)
                begin, count = self.children[depth][node], self.children[depth][node + 1] - self.children[depth][node]
                total = int(count.sum())
                if not total:
                    break
                child = np.arange(total) + np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
                who, state = np.repeat(who, count), np.repeat(state, count)
                letter, at = self.letters[depth][child], offset[who] + depth - most
                seen = np.zeros(total, "int32")
                for t, bit in enumerate(bits):
                    seen += (flat[at + t] == letter) * bit
                state = steps[state, seen]
                live = (state > 0) & (depth + 1 <= sizes[who] + most)
                who, node, state = who[live], child[live], state[live]
                if not len(who):
                    break


class Trie:
    """A vocabulary as nested dicts, walked by an automaton whose edits are the look-alikes."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, word: str, most: int) -> dict[str, int]:
        """All vocabulary words that ``most`` look-alikes or fewer can have turned into ``word``, with the fewest edits.

        The automaton's states are (place in the word, edits so far); it reads the trie from its root, so every branch
        that no edit can reach is left at once, and no word within reach is missed.
        """
        out: dict[str, int] = {}
        n = len(word)
        stack = [(self.root, 0, 0)]
        while stack:
            node, i, edits = stack.pop()
            if i == n:
                known = node.get("")
                if known is not None and edits < out.get(known, most + 1):
                    out[known] = edits
                continue
            child = node.get(word[i])
            if child is not None:
                stack.append((child, i + 1, edits))
            if edits < most:
                for size in (1, 2):
                    for printed in _READ.get(word[i : i + size], ()) if i + size <= n else ():
                        child = node
                        for c in printed:
                            child = child.get(c)
                            if child is None:
                                break
                        if child is not None:
                            stack.append((child, i + size, edits + 1))
        return out


def weighed(read: str, printed: str) -> tuple[tuple[int, int, str], ...]:
    """The wrong stretches on the lightest way from ``printed`` to ``read`` by any edits, as (begin, end, what was printed
    there). A letter that was not read at all is told with the letter beside it."""
    n, m = len(read), len(printed)
    best: dict[tuple[int, int], tuple[int, tuple]] = {(0, 0): (0, ())}
    for i in range(n + 1):
        for j in range(m + 1):
            here = best.get((i, j))
            if here is None:
                continue
            weight, spans = here
            steps = [(i + 1, j + 1, (weight, spans))] if i < n and j < m and read[i] == printed[j] else []
            for size in (1, 2):
                for p in _READ.get(read[i : i + size], ()) if i + size <= n else ():
                    if printed.startswith(p, j):
                        steps.append((i + size, j + len(p), (weight + 1, (*spans, (i, i + size, p)))))
            if i < n:
                steps.append((i + 1, j, (weight + OTHER, (*spans, (i, i + 1, "")))))
                if j < m:
                    steps.append((i + 1, j + 1, (weight + OTHER, (*spans, (i, i + 1, printed[j])))))
            if j < m and n:
                lost = (i - 1, i, read[i - 1] + printed[j]) if i else (0, 1, printed[j] + read[0])
                steps.append((i, j + 1, (weight + OTHER, (*spans, lost))))
            for a, b, new in steps:
                if (a, b) not in best or new[0] < best[a, b][0]:
                    best[a, b] = new
    return best.get((n, m), (0, ()))[1]


def explain(read: str, printed: str) -> list[tuple[int, int]] | None:
    """The stretches (begin, end) of ``read`` that look-alikes turned wrong, fewest first; None if anything else differs."""
    found = aligned(read, printed)
    return None if found is None else [(a, b) for a, b, _ in found]


def aligned(read: str, printed: str) -> list[tuple[int, int, str]] | None:
    """As ``explain``, each stretch with what was printed there."""
    n, m = len(read), len(printed)
    best: dict[tuple[int, int], tuple[int, tuple]] = {(0, 0): (0, ())}
    for i in range(n + 1):
        for j in range(m + 1):
            here = best.get((i, j))
            if here is None:
                continue
            cost, spans = here
            steps = []
            if i < n and j < m and read[i] == printed[j]:
                steps.append((i + 1, j + 1, cost, spans))
            for size in (1, 2):
                for p in _READ.get(read[i : i + size], ()) if i + size <= n else ():
                    if printed.startswith(p, j):
                        steps.append((i + size, j + len(p), cost + 1, (*spans, (i, i + size, p))))
            for a, b, c, s in steps:
                if (a, b) not in best or c < best[a, b][0]:
                    best[a, b] = (c, s)
    end = best.get((n, m))
    return list(end[1]) if end and 0 < end[0] <= MOST_EDITS else None


@lru_cache(maxsize=100_000)
def _changes(word: str, known: str | None) -> tuple[tuple[int, int, str], ...]:
    """The wrong stretches of a word with what was printed there; ``known`` is None for numbers."""
    if known is None:
        return tuple((a, b, "1" if word[a] == "l" else "0") for a, b in as_number(word) or ())
    return tuple(aligned(word, known) or weighed(word, known))


def repaired(text: str, fixes) -> str:
    """The line with the printed characters in place of the misread ones. Of a word that is broken over lines its part
    here is mended; a stretch over the break goes to the head. Capitals stay."""
    edits = []
    for f in fixes:
        low, high = f["offset"], f["offset"] + f["size"]
        here = text[f["begin"] : f["begin"] + f["size"]]
        for a, b, printed in _changes(f["word"], f["known"]):
            x, y = max(a, low), min(b, high)
            if x >= y:
                continue
            old = here[x - low : y - low]
            rest = [c for c in here[: x - low] + here[y - low :] if c.isalpha()]
            new = "" if a < low else printed
            if old[:1].isupper() and (x == 0 or not old[-1:].islower()) or not old[:1].islower() and len(rest) > 1 and all(c.isupper() for c in rest):
                new = new.upper() if all(c.isupper() for c in rest) and (rest or len(old) > 1) else new[:1].upper() + new[1:]
            edits.append((f["begin"] + x - low, f["begin"] + y - low, new))
    for a, b, new in sorted(set(edits), reverse=True):
        text = text[:a] + new + text[b:]
    return text


def words_of(text: str, tail: bool = False) -> list[tuple[str, int]]:
    """Lower-case words with their places; addresses on the net are left out, but not the ``tail`` of a broken word at the
    line's begin whose first letter was read as @."""

    def hide(m) -> str:
        return m[0] if tail and not text[: m.start()].strip() and _TAIL.fullmatch(m[0]) else " " * len(m[0])

    hidden = _SKIP.sub(hide, text) if "@" in text or "www" in text or "at" in text and _NET.search(text) else text
    out = []
    for m in _WORD.finditer(hidden):
        w, a = m[0], m.start()
        while w and w[-1] in "!'’":
            w = w[:-1]
        while w and w[0] in "!'’" and not (w[0] == "!" and w[1:2].islower()):  # the mark before a small letter is an I
            w, a = w[1:], a + 1
        if w:
            out.append((w.lower(), a))
    return out


def as_number(word: str) -> list[tuple[int, int]] | None:
    """The wrong places of a number in which letters stand for digits."""
    if regex.fullmatch(r"[0-9lo]+", word) and sum(c.isdigit() for c in word) >= 1 and not word.isdigit():
        return [(i, i + 1) for i, c in enumerate(word) if not c.isdigit()]
    return None


def mark_lines(deliveries: DataFrame) -> DataFrame:
    """One row per block, in the order of its page: kind (running_line, page_number, NULL for body lines), before and after
    (the ends of the body lines next to it on the page), first and last (whether it borders the page's body).

    Furniture are the outer lines of a page that stand apart from its body: set in from the margin that the body keeps,
    in small type or type of unknown size, or in small type and repeated on half of the pages of the papers. All rows
    move once, by page; an owner of any size is many pages, and lines without a page are spread by block.
    """
    key = F.regexp_replace(F.lower("text"), r"[^\p{L}]+", "")
    # Repetition over pages is counted on the lines in small type alone, which the scan filters out.
    tiny = deliveries.where("font_size <= 9 and page is not null and candidate_id is not null").select("candidate_id", "page", key.alias("key")).where("key <> ''").distinct()
    pages = tiny.groupBy("candidate_id").agg(F.count_distinct("page").alias("pages"))
    often = tiny.groupBy("candidate_id", "key").agg(F.count("*").alias("n")).where("n > 1").join(pages, "candidate_id").where("n * 2 >= pages").select("candidate_id", "key")
    again = tiny.join(often, ["candidate_id", "key"]).groupBy("candidate_id", "page").agg(F.collect_set("key").alias("again"))
    base = deliveries.where(r"text is not null and text rlike '\\S'").select("block_id", "candidate_id", "page", "line_no", "text", "x0", "top", "font_size", "method", "loaded_at")
    salt = F.when(F.col("page").isNull() | F.col("candidate_id").isNull(), F.col("block_id")).otherwise(F.lit(0))
    keys = ["candidate_id", "page", "_salt"]
    # Join and windows have the same keys, so one exchange serves them all.
    placed = base.withColumn("_salt", salt).join(again.withColumn("_salt", F.lit(0).cast(dict(base.dtypes)["block_id"])), keys, "left")
    newest = Window.partitionBy(*keys, "block_id").orderBy(F.desc_nulls_last("loaded_at"), "text")
    placed = placed.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    page = Window.partitionBy(*keys)
    placed = placed.withColumn("_up", F.row_number().over(page.orderBy("line_no", "block_id"))).withColumn("_down", F.count(F.lit(1)).over(page) + 1 - F.col("_up")).withColumn("_margin", F.min("x0").over(page))
    small = F.coalesce(F.col("font_size") <= 9, F.lit(True))
    edge = (F.least("_up", "_down") <= 3) & small & F.col("page").isNotNull()
    repeated = F.coalesce((F.col("font_size") <= 9) & F.array_contains("again", key), F.lit(False))
    apart = edge & (F.coalesce(F.col("x0") > F.col("_margin") + 100, F.lit(False)) | repeated)
    kind = F.when(apart, F.when(F.col("text").rlike(_NUMBER), F.lit("page_number")).otherwise(F.lit("running_line")))
    body = F.col("kind").isNull() & F.col("page").isNotNull() & F.col("candidate_id").isNotNull()
    lines = placed.withColumn("kind", kind).withColumn("_body", body)
    inside = Window.partitionBy(*keys, "_body").orderBy("line_no", "block_id")
    lines = lines.withColumn("before", F.when(F.col("_body"), F.lag(_ending("text")).over(inside))).withColumn("after", F.when(F.col("_body"), F.lead(_heading("text")).over(inside)))
    return lines.select(
        "block_id", "candidate_id", "page", "line_no", "text", "top", "method", "kind", F.col("_body").alias("body"), "before", "after",
        (F.col("_body") & F.lag("block_id").over(inside).isNull()).alias("first"), (F.col("_body") & F.lead("block_id").over(inside).isNull()).alias("last"),
    )


_BLANKS = " \t\r\n\v\f\u00a0"


def _ending(c: str):
    """What follows the last blank of a line: all that a word broken at its end can hold."""
    return F.substring_index(F.rtrim(c, F.lit(_BLANKS)), " ", -1)


def _heading(c: str):
    """What precedes the first blank of a line."""
    return F.substring_index(F.ltrim(c, F.lit(_BLANKS)), " ", 1)


def chain_lines(marked: DataFrame) -> DataFrame:
    """Body lines with before and after filled in over page borders: the border lines of a page meet those of its
    neighbour by an equal join of pages; the others pass as they are."""
    columns = ["block_id", "candidate_id", "page", "line_no", "text", "method", "before", "after"]
    body = marked.where("body")
    border = body.where("first or last")
    tails = border.where("last").select("candidate_id", (F.col("page") + 1).alias("page"), _ending("text").alias("_before"))
    heads = border.where("first").select("candidate_id", (F.col("page") - 1).alias("page"), _heading("text").alias("_after"))
    joined = border.join(tails, ["candidate_id", "page"], "left").join(heads, ["candidate_id", "page"], "left")
    joined = joined.withColumn("before", F.coalesce("before", F.when(F.col("first"), F.col("_before")))).withColumn("after", F.coalesce("after", F.when(F.col("last"), F.col("_after"))))
    return body.where("not first and not last").select(*columns).unionByName(joined.select(*columns))


def break_of(text: str, after: str | None) -> tuple[str, str, int] | None:
    """(head, tail, place of the head) of a word that goes on in the next line."""
    if not after or text.rstrip()[-1:] not in MARKS or not text.rstrip():
        return None
    m, n = _BROKEN.search(text), _HEAD.match(after)
    if not m or not n or not regex.search(r"\p{L}", m[1]) or not regex.search(r"[\p{L}†@]", n[1]):
        return None
    return m[1], n[1], m.start()


def _pieces(lines: DataFrame) -> DataFrame:
    """(block_id, word, begin, offset, size, left): the words of each line; ``word`` is whole where a line breaks it,
    ``offset`` and ``size`` say which part of it stands in the line, at ``begin``; ``left`` is the word before."""

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for block, text, before, after in zip(pdf["block_id"], pdf["text"], pdf["before"], pdf["after"]):
                if not text:
                    continue
                ends, starts = break_of(text, after), break_of(before, text) if before else None
                left = ""
                found = words_of(text, starts is not None)
                for k, (w, a) in enumerate(found):
                    whole, offset = w, 0
                    if starts and k == 0:
                        head = starts[0].lower().rsplit("-", 1)[-1]
                        whole, offset = head + w, len(head)
                    if ends and k == len(found) - 1:
                        whole = whole + ends[1].lower().split("-", 1)[0]
                    rows.append((block, whole, a, offset, len(w), left))
                    left = whole
            if rows:
                yield pd.DataFrame(rows, columns=["block_id", "word", "begin", "offset", "size", "left"])

    kind = dict(lines.dtypes)["block_id"]
    return lines.mapInPandas(tokenize, f"block_id {kind}, word string, begin int, offset int, size int, left string")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts in the column ``text``; compounds count whole and by their parts.

    In the JVM, with partial counts before the shuffle; equal texts are counted once and multiplied.
    """
    same = texts.where("text is not null").groupBy("text").agg(F.count("*").alias("n"))
    net = F.contains("text", F.lit("@")) | F.contains("text", F.lit("www.")) | F.contains("text", F.lit("at)")) | F.contains("text", F.lit("at]"))
    shown = F.regexp_replace(F.lower("text"), r"\S*(?:@[\p{L}\p{N}-]+\.|\bwww\.|@\d|\(at\)|\[at\])\S*|(?<!\S)@\S+", " ")
    hidden = F.when(net, shown).otherwise(F.lower("text"))
    single = F.regexp_extract_all(hidden, F.lit(r"([\p{L}\p{M}\p{N}†@$](?:[\p{L}\p{M}\p{N}†@!$'’]*[\p{L}\p{M}\p{N}†@$])?)"), 1)
    compound = F.when(F.contains("text", F.lit("-")), F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{2,}(?:-\p{L}{2,})+)"), 1)).otherwise(F.array().cast("array<string>"))
    words = same.select("n", F.explode(F.concat(single, compound)).alias("word"))
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def candidates(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, known, n, looks, edits): for each unknown word every other vocabulary word within ``reach`` of its length,
    whatever the edits, and every one that up to ``MOST_EDITS`` look-alikes can have turned into it; ``edits`` is the
    distance, NULL beyond the reach, ``looks`` the look-alikes, NULL where they alone don't explain the word. Words and
    known words of any length.

    Vocabulary words are sharded by length and hash, ``SHARD`` words a trie. An edit changes the length by one at most,
    so an unknown word goes to the shards of the lengths up to ``MOST_EDITS`` away, ``ASKED`` words a task.
    """
    spark = vocabulary.sparkSession
    sizes = {r["size"]: r["count"] for r in vocabulary.groupBy(F.length("word").alias("size")).count().collect()}  # one row a length
    asking = {r["size"]: r["count"] for r in unknown.groupBy(F.length("word").alias("size")).count().collect()}
    plan, blocks = [], {}
    for size, n in sizes.items():
        parts = -(-n // SHARD)
        heard = sum(asking.get(size + d, 0) for d in range(-MOST_EDITS, MOST_EDITS + 1))
        blocks[size] = max(1, -(-heard // ASKED))
        plan += [(size, parts, i, blocks[size]) for i in range(parts)]
    plan = spark.createDataFrame(plan or [(0, 1, 0, 1)], "size int, parts int, part int, blocks int")
    known = vocabulary.select(F.col("word").alias("known"), "n").withColumn("size", F.length("known")).join(F.broadcast(plan.where("part = 0").select("size", "parts", "blocks")), "size")
    known = known.withColumn("part", F.pmod(F.xxhash64("known"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("size", "part", "block", "known", "n")
    span = F.explode(F.sequence(F.length("word") - MOST_EDITS, F.length("word") + MOST_EDITS)).alias("size")
    asked = unknown.select("word", span).join(F.broadcast(plan), "size").select("size", "part", F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int").alias("block"), "word")

    def look_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(right["known"], right["n"]))
        rows, asked = [], sorted(set(left["word"]))
        if asked and counts:
            trie, letters = Trie(counts), LetterTrie(counts)
            looks = {(w, k): n for w in asked for k, n in trie.near(w, MOST_EDITS).items() if n}
            edits = {}
            for most in sorted({reach(len(w)) for w in asked}):
                edits |= {(w, k): d for w, k, d in letters.within([w for w in asked if reach(len(w)) == most], most) if d}
            rows = [(w, k, counts[k], looks.get((w, k)), edits.get((w, k))) for w, k in looks.keys() | edits.keys()]
        return pd.DataFrame(rows, columns=["word", "known", "n", "looks", "edits"]).astype({"n": "int64", "looks": "Int32", "edits": "Int32"})

    width = shuffle_width(spark)  # asked for by number, else little data of much work is put into one task
    keys = ["size", "part", "block"]
    asked, known = asked.repartition(width, *keys), known.repartition(width, *keys)
    return asked.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInPandas(look_up, "word string, known string, n long, looks int, edits int")


def find_noise(deliveries: DataFrame, clean: DataFrame) -> dict[str, DataFrame]:
    """The noise of scanned lines.

    ``deliveries`` has block_id, candidate_id, page, line_no, text, x0, top, font_size, method, loaded_at, blocks perhaps
    delivered again; ``clean`` has texts without scan noise in the column ``text``. Gives ``kinds`` (block_id, kind),
    ``wrong`` (block_id, begin, end: the wrong characters), ``repairs`` (block_id, begin, offset, size, word, known:
    corrected words, whole where a line breaks them; known is NULL for numbers), ``marked`` (every block once), ``lines`` (body lines in their chain) and ``breaks`` (block_id, head, tail, kind). NULL
    and blank texts have no noise; lines without owner, page or number are not put in order; an empty table gives empty
    results.
    """
    marked = stored(mark_lines(deliveries))
    lines = chain_lines(marked)
    furniture = marked.where("not body").select("block_id", "text", F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"), "method")
    ocr = lines.select("block_id", "text", "before", "after", "method").unionByName(furniture).where("lower(method) = 'ocr'")
    pieces = stored(_pieces(ocr.select("block_id", "text", "before", "after")))
    sound = word_counts(clean.select("text").unionByName(marked.where("lower(method) <> 'ocr'").select("text")))
    scanned = pieces.groupBy("word").agg(F.count("*").alias("m"))
    known = cut(sound.join(scanned, "word", "full").select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m")))
    letters = F.length(F.regexp_replace("word", r"[^\p{L}]", ""))
    vocabulary = known.where((F.col("n") > 0) | (F.col("m") >= 6)).where(r"word rlike '^[\\p{L}\\p{M}]+$'").select("word", (F.col("n") + F.col("m")).alias("n"))
    odd = F.col("word").rlike("[†@!$0159í]")  # two letters are enough only with a sign that no word has
    unknown = known.where((F.col("n") == 0) & (letters >= 1) & ((F.length("word") >= 3) | (F.length("word") == 2) & odd)).where("m > 0").select("word", "m")
    options = cut(candidates(unknown.select("word"), vocabulary).where("length(known) >= 2")).join(unknown, "word")
    # Context: how often a candidate stands after the word before, over clean and scanned lines.
    beside = pieces.groupBy("left", "word").agg(F.count("*").alias("times"))
    context = options.select("word", "known").join(beside.withColumnRenamed("times", "seen"), "word").join(beside.select("left", F.col("word").alias("known"), "times"), ["left", "known"]).groupBy("word", "known").agg(F.sum(F.col("seen") * F.col("times")).alias("fits"))
    # A frequent word needs no context, a rare one does; an edit without a look-alike stands alone, in a word of some length,
    # and only where the word that is meant goes on from the word before far more often: else it is a name or a typist's slip.
    fits = F.coalesce("fits", F.lit(0))
    often = F.col("n") > 4 * F.col("m")
    likely = F.when(F.col("looks").isNotNull(), often | (F.col("n") > F.col("m")) & (fits > F.col("m"))).otherwise((F.col("edits") == 1) & (F.length("word") >= 6) & often & (fits > 4 * F.col("m")))
    weight = F.coalesce("looks", OTHER * F.col("edits"))
    ranked = options.join(context, ["word", "known"], "left").where(likely).groupBy("word").agg(F.max_by("known", F.struct(-weight, fits, F.col("n"), F.col("known"))).alias("known"))
    ranked = cut(ranked)
    numbers = pieces.where(r"word rlike '^[0-9lo]+$' and word rlike '[0-9]' and word rlike '[lo]'")

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for block, word, begin, offset, size, good in zip(pdf["block_id"], pdf["word"], pdf["begin"], pdf["offset"], pdf["size"], pdf["known"]):
                for a, b, _ in _changes(word, good):
                    a, b = max(a, offset), min(b, offset + size)
                    if a < b:
                        rows.append((block, begin + a - offset, begin + b - offset))
            if rows:
                yield pd.DataFrame(rows, columns=["block_id", "begin", "end"])

    few = is_bounded(ranked, 300_000)  # then under 20 MB: sent to the pieces, which else meet it by a shuffle
    fixed = pieces.join(F.broadcast(ranked) if few else ranked, "word")
    kind = dict(pieces.dtypes)["block_id"]
    suspect = fixed.select("block_id", "word", "begin", "offset", "size", "known").unionByName(numbers.select("block_id", "word", "begin", "offset", "size", F.lit(None).cast("string").alias("known")))
    # A number is repaired as one only where no word was found for it.
    left = numbers.join(F.broadcast(ranked) if few else ranked, "word", "left_anti").select("block_id", "begin", "offset", "size", "word", F.lit(None).cast("string").alias("known"))
    repairs = fixed.select("block_id", "begin", "offset", "size", "word", "known").unionByName(left)
    wrong = suspect.mapInPandas(places, f"block_id {kind}, begin int, end int")

    def breaks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for block, text, after in zip(pdf["block_id"], pdf["text"], pdf["after"]):
                if text and (b := break_of(text, after)):
                    head, tail = b[0].lower(), b[1].lower()
                    inner = head.rsplit("-", 1)[-1] + tail.split("-", 1)[0]
                    dashed = text.rstrip()[-1] in "-‐‑"
                    rows.append((block, head, tail, f"{head}-{tail}", inner, head.rsplit("-", 1)[-1], tail.split("-", 1)[0], dashed))
            if rows:
                yield pd.DataFrame(rows, columns=["block_id", "head", "tail", "compound", "joined", "h", "t", "dashed"])

    cuts = lines.where(f"text rlike '[{MARKS}]\\\\s*$'").mapInPandas(breaks_of, f"block_id {kind}, head string, tail string, compound string, joined string, h string, t string, dashed boolean")
    usual = known.select("word", F.when(F.col("n") > 0, F.col("n") + F.col("m")).otherwise(F.col("m") / 8).alias("n"))
    of = lambda c, name: usual.select(F.col("word").alias(c), F.col("n").alias(name))
    mended = ranked.select(F.col("word").alias("joined"), F.lit(True).alias("mended"))
    judged = cuts.join(of("compound", "nc"), "compound", "left").join(of("joined", "nj"), "joined", "left").join(of("h", "nh"), "h", "left").join(of("t", "nt"), "t", "left").join(mended, "joined", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    parts = (zero("nh") >= 1) & (zero("nt") >= 1)
    sort = F.when(zero("nc") > zero("nj"), F.lit("split_compound")).when((zero("nj") >= 1) | F.col("mended"), F.lit("split_word")).when(F.col("dashed") & parts, F.lit("split_compound")).otherwise(F.lit("split_word"))
    breaks = cut(judged.select("block_id", "head", "tail", sort.alias("kind")))

    def page_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(block, m.start() + i, m.start() + i + 1) for block, text in zip(pdf["block_id"], pdf["text"]) for m in regex.finditer(r"(?<![\p{L}\p{N}])[0-9lO]+(?![\p{L}\p{N}])", text) for i, c in enumerate(m[0]) if not c.isdigit()]
            if rows:
                yield pd.DataFrame(rows, columns=["block_id", "begin", "end"])

    paged = marked.where("kind = 'page_number' and lower(method) = 'ocr' and text rlike '[lO]'").select("block_id", "text")
    wrong = cut(wrong.unionByName(paged.mapInPandas(page_places, f"block_id {kind}, begin int, end int")).distinct())
    kinds = marked.where("kind is not null").select("block_id", "kind").unionByName(breaks.select("block_id", "kind")).unionByName(wrong.select("block_id", F.lit("misread").alias("kind"))).distinct()
    return {"kinds": kinds, "wrong": wrong, "repairs": repairs, "marked": marked, "lines": lines, "breaks": breaks}


def wrong_glyphs(glyphs: DataFrame, blocks: DataFrame, wrong: DataFrame) -> DataFrame:
    """(glyph_id) of the characters that stand wrongly: a line's glyphs in order are its text without blanks; glyphs
    drawn twice at one place are one character. Windows are by line."""

    def spots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for c, p, t, text, begin, end in zip(pdf["candidate_id"], pdf["page"], pdf["line"], pdf["text"], pdf["begin"], pdf["end"]):
                blanks = sum(x.isspace() for x in text[:begin])
                rows += [(c, p, t, k - blanks + 1) for k in range(begin, end)]
            if rows:
                yield pd.DataFrame(rows, columns=["candidate_id", "page", "line", "place"])

    line = F.round(F.col("top") * 10).cast("long").alias("line")
    at = blocks.select("block_id", "candidate_id", F.col("page").cast("int").alias("page"), line, "text").join(wrong, "block_id")
    spotted = at.mapInPandas(spots, "candidate_id string, page int, line long, place int").distinct()
    order = Window.partitionBy("candidate_id", "page", "line").orderBy("spot")
    drawn = glyphs.select("glyph_id", "candidate_id", F.col("page").cast("int").alias("page"), line, F.round(F.col("x0") * 10).cast("long").alias("spot")).withColumn("place", F.dense_rank().over(order))
    return drawn.join(spotted, ["candidate_id", "page", "line", "place"]).select("glyph_id").distinct()


# Words that no sentence ends with; what follows them over a page border goes on even in capitals.
_OPEN = (
    r"(?iU)\b(?:a|an|and|at|by|for|from|in|into|of|on|or|over|the|their|to|under|using|which|while|with|without|als|am|an|auf|bei|das|dem|den|der|des|die|durch|ein|eine|einem|einen|einer|für|im|mit|oder|ohne|und|unter|von|vom|zu|zum|zur|al|con|de|del|el|en|la|las|los|para|por|sin|una|y|au|aux|avec|dans|du|et|le|les|ou|par|pour|sans|sur|une)$"
)
_RESUMED = r"^[\p{Ll},;)]"


def reflow(noise: dict[str, DataFrame]) -> DataFrame:
    """(candidate_id, page, paragraph, text): the body as continuous paragraphs, words corrected and joined, furniture gone.

    A paragraph ends where a line ends a sentence and the next begins a new one, or at a list mark or heading. It goes on
    over a page border where a word is broken there, or the next page resumes in small letters within a sentence or after a word
    that ends none; it is then given once, with the page on which it begins. ``paragraph`` counts the pieces of a page, so a
    page that begins within a paragraph has no number 1.
    """
    repairs = noise["repairs"].groupBy("block_id").agg(F.collect_list(F.struct("begin", "offset", "size", "word", "known")).alias("fixes"))
    broken = noise["breaks"].select("block_id", F.col("kind").alias("broken"))
    lines = noise["lines"].join(repairs, "block_id", "left").join(broken, "block_id", "left")

    def join_lines(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["line_no", "block_id"])
        out, current, glue = [], "", " "
        for text, fixes, kind in zip(pdf["text"], pdf["fixes"], pdf["broken"]):
            fixes = [] if fixes is None or isinstance(fixes, float) else list(fixes)
            text = " ".join(repaired(text, fixes).split())
            starts = regex.match(r"[•▪*–-]\s|[\p{Lu}\p{N}\"“(]", text) is not None
            if current and glue == " " and starts and regex.search(r"[.!?:]$|^.{0,40}$", current.rsplit("\n", 1)[-1]):
                out.append(current)
                current = text
            else:
                current = current + glue + text if current else text
            glue = " "
            if isinstance(kind, str):
                current = regex.sub(rf"[{MARKS}]$", "-" if kind == "split_compound" else "", current)
                glue = ""
        if current:
            out.append(current)
        head, n = pdf.iloc[0], len(out)
        frame = pd.DataFrame({"candidate_id": head["candidate_id"], "page": head["page"], "paragraph": range(1, n + 1), "text": out})
        frame["glue"] = [None] * (n - 1) + [glue] if n else []  # of the last piece alone
        return frame

    kind = dict(lines.dtypes)["page"]
    pieces = stored(lines.groupBy("candidate_id", "page").applyInPandas(join_lines, f"candidate_id string, page {kind}, paragraph int, text string, glue string"))
    # The last piece of a page meets the first of the next by an equal join of pages; chains of pieces become one paragraph.
    place = F.struct("candidate_id", "page", "paragraph")
    tails = pieces.where("glue is not null").select("candidate_id", (F.col("page") + 1).alias("page"), place.alias("a"), "glue", F.col("text").rlike("[.!?:]$").alias("ended"), F.col("text").rlike(_OPEN).alias("open"))
    heads = pieces.where("paragraph = 1").select("candidate_id", "page", place.alias("b"), F.col("text").rlike(_RESUMED).alias("resumed"), F.col("text").rlike(r"^[•▪*–-]\s").alias("listed"))
    chains = connected_components(tails.join(heads, ["candidate_id", "page"]).where("glue = '' or (resumed and not ended) or (open and not listed)").select("a", "b"))
    chains = chains.select("node.*", F.col("component").alias("root"))
    keys = ["candidate_id", "page", "paragraph"]
    run = F.array_sort(F.collect_list(F.struct("page", "paragraph", F.concat("text", F.coalesce("glue", F.lit(""))).alias("text"))))
    joined = pieces.join(chains, keys).groupBy("root").agg(F.rtrim(F.array_join(F.transform(run, lambda r: r["text"]), "")).alias("text")).select("root.*", "text")
    return pieces.join(chains, keys, "left_anti").select(*keys, "text").unionByName(joined.select(*keys, "text"))
