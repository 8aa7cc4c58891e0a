"""Variant spellings of the names of organisations, linked by merge-and-rematch.

Each spelling is taken apart into the words of its proper name and its trade or kind; equal parts are one profile. Profiles
that share a blocking key merge, and the merged profile enters blocking again with what its members bring together: a
word in one spelling takes the place of its variant in another, the initials and the acronym stand for all of them. This
goes on until no profile finds another. Keys are of two sorts. Sharing a strong one is the match itself (the words are
equal but for slips, the trades agree), so every block is linked to its smallest member and never expanded into pairs.
An open key (initials, an acronym, a name without a trade) counts only where a single organisation answers to it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeshift.llm.canonical import edits, shortened
from lodeshift.operators.graph import FEW, components_of
from lodeshift.session import cut, cut_counted, shuffle_width, stored

# Entries that name no organisation.
NOBODY = frozenset(
    """n a|na|none|nil|null|unknown|various|diverse|several|own business|own company|freelance|freelancer|freelancing|self employed|selfemployed|self employment
    |confidential|private|private employer|private person|private household|not stated|not disclosed|undisclosed|tbd|tba|to be announced|anonymous|see cv|see above|x|xx|xxx|xxxx
    |unemployed|family|family business|home|home schooled|homeschooled|n n|test|dummy|employer|company|school|university|college|high school|self taught|self|me|other|misc|no degree|abroad|online""".replace("\n", "").split("|")
) - {""}
# Trades of employers and kinds of schools, each with its other wordings.
TRADES = {
    "employer": {
        "logistics": ["log", "logist"], "systems": ["sys", "syst", "system"], "foods": ["food", "fds"], "health services": ["hlth serv", "health serv", "hlth services", "health svcs", "health service", "hs"],
        "engineering": ["eng", "engrg", "engg", "engr", "engin"], "technologies": ["tech", "technol", "technology"], "manufacturing": ["mfg", "manuf", "manufact"], "consulting": ["cons", "consult", "consultants", "consultancy"],
        "energy partners": ["enrg partners", "energy ptnrs", "enrg ptnrs", "energy partner", "en partners", "energy part"], "insurance": ["ins", "insur", "insurances"], "transport": ["trans", "transp", "transports", "tpt"],
        "laboratories": ["lab", "labs", "laboratory", "labor"], "construction": ["const", "constr", "constructions"], "publishing": ["publ", "pub", "publishers"], "retail": ["rtl", "ret"], "works": ["wks", "work"],
    },
    "institution": {
        "university": ["univ", "uni", "u of", "univ of", "uni of", "university of", "universitat", "universität", "universidad", "universite", "universidad de", "universite de", "u"],
        "college": ["coll", "college of", "coll of"], "polytechnic": ["polytech", "polytechnical", "poly", "polytechnic of", "polytechnic institute"],
        "institute of technology": ["inst of tech", "inst technology", "inst of technology", "institute technology", "inst tech", "institute of tech", "tech institute", "it"],
        "school of business": ["business school", "bus school", "sch of business", "school of bus", "business sch", "sch of bus", "school business"],
        "academy of arts": ["acad of arts", "arts academy", "academy arts", "acad arts", "art academy", "academy of art", "arts acad"],
    },
}
# Words that belong to no name.
LOOSE = frozenset("the group and und et y of de der di co company holding international von".split())


def flat(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _slipped(typed: str, word: str) -> bool:
    """Whether a word of a trade was typed, perhaps with a slip, or two in a long one."""
    return typed == word or len(word) > 3 and edits(typed, word, 1) <= 1 or len(word) > 8 and edits(typed, word, 2) <= 2


class Parser:
    """Takes a spelling apart into proper name and trade; plain Python, made once per worker."""

    def __init__(self, field: str, suffixes: list[str]):
        self.trades = TRADES[field]
        self.phrases = {tuple(p.split()): t for t, ps in self.trades.items() for p in [t, *ps]}
        self.longest = max(map(len, self.phrases))
        self.parts = sorted({w for p in self.phrases for w in p})
        self.memory: dict[str, tuple[frozenset[str], frozenset[str]]] = {}
        self.single = [(p[0], t) for p, t in self.phrases.items() if len(p) == 1 and len(p[0]) > 5]
        spelt = [regex.findall(r"[\p{L}\p{N}]+", s.lower()) for s in suffixes]
        self.suffixes = {" ".join(w) for w in spelt} | {"".join(w) for w in spelt if all(len(x) == 1 for x in w)}

    def _meant(self, word: str) -> tuple[frozenset[str], frozenset[str]]:
        """The words of trades that ``word`` may stand for, typed with a slip, and cut short."""
        known = self.memory.get(word)
        if known is None:
            if len(self.memory) > 100_000:
                self.memory.clear()
            known = self.memory[word] = (frozenset(p for p in self.parts if _slipped(word, p)), frozenset(p for p in self.parts if word == p or shortened(word, p)))
        return known

    def trade_at(self, words: list[str], i: int) -> tuple[str, int] | None:
        for n in range(min(self.longest, len(words) - i), 0, -1):
            t = self.phrases.get(tuple(words[i : i + n]))
            if t:
                return t, n
        near = [self._meant(w) for w in words[i : i + self.longest]]
        for k, full in ((0, False), (1, True)):  # words with a slip; whole names of trades with words cut short
            if not near[0][k]:
                continue
            for phrase, t in self.phrases.items():
                n = len(phrase)
                if n <= len(near) and phrase[0] in near[0][k] and (not full or n > 1 and phrase == tuple(t.split())) and all(p in x[k] for p, x in zip(phrase, near)):
                    return t, n
        return None

    def parse(self, name: str) -> tuple[list[str], str | None] | None:
        """The words of the proper name and the trade; None where no organisation is named."""
        text = flat(name).strip()
        plain = " ".join(regex.findall(r"[\p{L}\p{N}]+", text.lower()))
        if not plain or plain in NOBODY:
            return None
        text = regex.sub(r"[(\[][^)\]]*[)\]]?", " ", text)
        text = regex.sub(r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})", " ", text)
        parts = [p for p in regex.split(r"\s[-–—/|]\s", text) if p.strip()]
        text = parts[0] if parts else text
        pieces = [p.strip() for p in text.split(",") if p.strip()]
        best: tuple[list[str], str | None] = ([], None)
        if len(pieces) > 1:
            head, tail = self.split(pieces[0]), self.split(" ".join(pieces[1:2]))
            if not head[0] and head[1]:  # "Trade, Proper Name"
                best = (tail[0], head[1])
            else:
                best = head if len(head[0]) >= 2 or head[1] else self.split(" ".join(pieces))
        else:
            best = self.split(text)
        return best if best[0] or best[1] else None

    def split(self, text: str) -> tuple[list[str], str | None]:
        low = regex.sub(r"(?<=\b\p{L})\.(?=\p{L}\b)", "", text.lower())  # g.m.b.h. -> gmbh
        words = regex.findall(r"[\p{L}\p{N}]+", low)
        while words:
            for n in (2, 1):
                if len(words) > n and " ".join(words[-n:]) in self.suffixes:
                    words = words[:-n]
                    break
            else:
                break
        core, trade, i = [], None, 0
        while i < len(words):
            t = self.trade_at(words, i) if trade is None else None
            if t:
                trade, i = t[0], i + t[1]
                continue
            if words[i] not in LOOSE and words[i] not in self.suffixes:
                core.append(words[i])
            i += 1
        return core, trade


def slips(word: str) -> list[str]:
    """The word and all it becomes by leaving out one letter: two words that share one differ by at most one slip."""
    return [word, *{word[:i] + word[i + 1 :] for i in range(len(word))}] if len(word) > 4 else [word]


def strong_keys(core: list[str], wide: bool = True, traded: bool = False) -> set[str]:
    """Keys of the words of a name, whatever their order: names that share one are equal but for a slip in one word, in each
    of two words (``wide``), or but for blanks (``wide``). A short word alone must be equal, shorter still with a trade."""
    if len(core) == 1:
        return set(slips(core[0]) if len(core[0]) > (5 if traded else 7) else core)
    out = set()
    for i, word in enumerate(core):
        rest = core[:i] + core[i + 1 :]
        out |= {"+".join(sorted((x, *rest))) for x in slips(word)}
    if wide and len(core) == 2:
        a, b = core
        out |= {"+".join(sorted((x, y))) for x in slips(a) for y in slips(b)}
        out |= {v for joined in (a + b, b + a) for v in slips(joined)}
    return out


def initial_keys(core: list[str], trade: str | None) -> set[str]:
    """What may stand for a whole name: one of its words by its initial, all of them with the trade, its acronym."""
    if len(core) < 2 or any(len(w) < 2 for w in core):
        return set()
    out = {"~" + w[0] + "+" + "+".join(sorted(core[:i] + core[i + 1 :])) + "|" + (trade or "") for i, w in enumerate(core)}
    if trade:
        out |= {"~" + "+".join(sorted(w[0] for w in core)) + "|" + trade, "acronym|" + "".join(w[0] for w in [*core, *trade.split()])}
    return out


def open_keys(core: list[str], trade: str | None, capitals: bool) -> set[str]:
    """The same keys, as a spelling by initials or an acronym asks for them."""
    letters, words = [w for w in core if len(w) == 1], [w for w in core if len(w) > 1]
    if letters and len(core) > 1:
        if len(letters) == 1:
            return {"~" + letters[0] + "+" + "+".join(sorted(words)) + "|" + (trade or "")}
        return {"~" + "+".join(sorted(letters)) + "|" + trade} if trade and not words else set()
    return {"acronym|" + core[0]} if capitals and not trade and len(core) == 1 and len(core[0]) >= 3 else set()


def crossed(cores: list[list[str]]) -> list[list[str]]:
    """Names that no member of a profile has, but its members together do: a word of one replaced by its variant in another."""
    by_slip: dict[str, set[str]] = {}
    for w in {w for c in cores for w in c}:
        for x in slips(w):
            by_slip.setdefault(x, set()).add(w)
    have, out = {tuple(sorted(c)) for c in cores}, {}
    for c in cores:
        for i, word in enumerate(c):
            for v in sorted(set().union(*(by_slip[x] for x in slips(word))) - {word}):
                new = [*c[:i], v, *c[i + 1 :]]
                if tuple(sorted(new)) not in have:
                    out[tuple(sorted(new))] = new
    return [out[k] for k in sorted(out)]


def _profiles(names: DataFrame, aliases: list[tuple[str, str]], suffixes: list[str]) -> DataFrame:
    """One row per spelling: (field, name, core, trade, capitals); known names of an organisation carry its ``known`` key."""
    known = {field: {} for field in TRADES}
    for alias, canonical in aliases:
        known["employer"][" ".join(regex.findall(r"[\p{L}\p{N}]+", flat(alias).lower()))] = canonical

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsers = {field: Parser(field, suffixes) for field in TRADES}
        for pdf in batches:
            rows = []
            for field, name in zip(pdf["field"], pdf["name"]):
                p = parsers[field].parse(name)
                if p is None:
                    continue
                core, trade = p
                whole = " ".join([*core, *(trade.split() if trade else [])])
                loose = " ".join(regex.findall(r"[\p{L}\p{N}]+", flat(name).lower()))
                said = known[field].get(loose) or known[field].get(whole) or known[field].get(" ".join(core))
                rows.append((field, name, core, trade, regex.fullmatch(r"[\p{Lu}.]{3,}", name.strip()) is not None, said))
            if rows:
                yield pd.DataFrame(rows, columns=["field", "name", "core", "trade", "capitals", "known"])

    return names.mapInPandas(parse, "field string, name string, core array<string>, trade string, capitals boolean, known string")


def _keys(units: DataFrame) -> DataFrame:
    """(field, unit, sort, mark, key): sort is ``strong``, ``open`` or ``closed``; ``mark`` the trade of strong keys."""

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for field, unit, cores, trade, capitals in zip(pdf["field"], pdf["unit"], pdf["cores"], pdf["trade"], pdf["capitals"]):
                rows += [(field, unit, "strong", trade or "", k) for k in strong_keys(list(cores[0]), traded=bool(trade))]
                for core in cores:  # in every order in which the words stand
                    rows += [(field, unit, "closed", "", k) for k in initial_keys(list(core), trade)]
                    rows += [(field, unit, "open", "", k) for k in open_keys(list(core), trade, bool(capitals))]
            if rows:
                yield pd.DataFrame(rows, columns=["field", "unit", "sort", "mark", "key"])

    return units.select("field", "unit", "cores", "trade", "capitals").mapInPandas(spell, KEYS)


KEYS = "field string, unit string, sort string, mark string, key string"


def _crossed_keys(profiles: DataFrame) -> DataFrame:
    """The keys that the merged profiles (field, unit, cores, trades) bring beyond those of their members."""

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for field, unit, cores, trades in zip(pdf["field"], pdf["unit"], pdf["cores"], pdf["trades"]):
                for core in crossed([list(c) for c in cores]):
                    for trade in list(trades) or [""]:
                        rows += [(field, unit, "strong", trade, k) for k in strong_keys(core, False, bool(trade))]
                        rows += [(field, unit, "closed", "", k) for k in initial_keys(core, trade or None)]
            if rows:
                yield pd.DataFrame(rows, columns=["field", "unit", "sort", "mark", "key"])

    return profiles.mapInPandas(spell, KEYS)


def _merge(units: DataFrame, links: DataFrame, few: bool) -> DataFrame:
    """The units with the ids of their components, and whether those have ``grown``; links are distinct (a, b) of ids, a <> b."""
    components = components_of(links, few)
    merged = units.drop("grown").join(components, units.id == components.node, "left")
    return cut(merged.withColumn("id", F.coalesce("component", "id")).withColumn("grown", F.col("component").isNotNull()).drop("node", "component"))


def _stars(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Each block's members linked to its smallest one, by one exchange; a link comes once a block."""
    sets = blocks.groupBy(*by).agg(F.collect_set("id").alias("ids")).where("size(ids) > 1")
    return sets.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")).where("a <> b")


def _answers(rows: DataFrame, by: list[str]) -> DataFrame:
    """(a, b): each profile b that ``asks`` with the one organisation a that has its keys; none where several have. Rows are
    (sort, id, asks) and the columns ``by`` of the keys; each sort is answered by itself."""
    held = F.when(~F.col("asks"), F.col("id"))
    single = rows.groupBy("sort", *by).agg(F.min(held).alias("a"), F.max(held).alias("top"), F.collect_set(F.when(F.col("asks"), F.col("id"))).alias("ids"))
    found = single.where("a is not null and size(ids) > 0").select("sort", "a", "top", F.explode("ids").alias("b")).where("not (a = b and top = b)")
    return found.groupBy("sort", "b").agg(F.min("a").alias("a"), F.max("top").alias("top")).where("a = top and a <> b").select("a", "b")


def _asked(keys: DataFrame, extra: DataFrame | None, units: DataFrame) -> DataFrame:
    """(sort, field, key, id, asks) of all keys: initials and acronyms ask for whole names, those without a trade for the rest."""
    sure = F.max(F.col("trade").isNotNull() | F.col("known").isNotNull()).over(Window.partitionBy("id"))
    rows = keys.withColumn("own", F.lit(True))
    if extra is not None:
        rows = rows.unionByName(extra.withColumn("own", F.lit(False)))
    rows = rows.select("unit", "sort", "field", "key", "own").join(units.select("unit", "id", sure.alias("sure")), "unit")
    rows = rows.where("sort = 'closed' or (sort = 'open' and (not sure or key like '~%')) or (sort = 'strong' and (own or sure))")
    asks = F.expr("sort = 'open' or (sort = 'strong' and not sure)")
    return rows.select(F.expr("if(sort = 'strong', sort, 'short')").alias("sort"), "field", "key", "id", asks.alias("asks"))


def resolve_names(names: DataFrame, aliases: list[tuple[str, str]], suffixes: list[str]) -> DataFrame:
    """(field, name, organisation) of every spelling that names an organisation; equal organisations have equal keys.

    ``names`` has the columns field (``employer`` or ``institution``) and name; repeated rows count once. NULL, empty,
    blank and dummy names belong to no organisation and give no row, nor does an empty table. ``aliases`` and
    ``suffixes`` are the fixed reference lists. Names without a trade, initials and acronyms join an organisation only
    where one alone answers to them.
    """
    distinct = names.where("field is not null and name is not null").select("field", "name").distinct()
    parsed = _profiles(distinct, aliases, suffixes)
    known = names.sparkSession.createDataFrame(
        [("employer", x, None) for pair in aliases for x in pair] or [("employer", "", None)], "field string, name string, origin string"
    ).select("field", "name").distinct()
    seeds = _profiles(known, [*aliases, *((c, c) for _, c in aliases)], suffixes)
    unit = F.concat_ws("|", "field", F.coalesce("trade", F.lit("")), F.array_join(F.array_sort("core"), "+"))
    spelt = cut(parsed.withColumn("real", F.lit(True)).unionByName(seeds.withColumn("real", F.lit(False))).withColumn("unit", unit))
    units = spelt.groupBy("field", "unit").agg(F.sort_array(F.collect_set("core")).alias("cores"), F.max("trade").alias("trade"), F.max("capitals").alias("capitals"), F.max("known").alias("known"), F.collect_set("known").alias("said"))
    units = cut(units.withColumn("id", F.col("unit")).withColumn("grown", F.lit(False)))
    keys = stored(_keys(units.repartition(shuffle_width(names.sparkSession), "unit")))
    base = keys.where("sort = 'strong'")
    # First round: known names and strong keys at once.
    said = units.select("field", F.lit(None).cast("string").alias("mark"), F.explode("said").alias("key"), "id")
    strong = base.select("field", "mark", "key", F.col("unit").alias("id"))
    links, found = cut_counted(_stars(said.unionByName(strong), ["field", "mark", "key"]).distinct())
    units = units.drop("said", "capitals")
    extra = None
    while True:
        # Rematch: merged profiles bring the words and initials of all their members, until none finds another.
        while found:
            units = _merge(units, links, found <= FEW)
            grown = units.where("grown").groupBy("field", F.col("id").alias("unit")).agg(F.sort_array(F.collect_set(F.element_at("cores", 1))).alias("cores"), F.sort_array(F.collect_set("trade")).alias("trades"))
            fresh = stored(_crossed_keys(grown.where("size(cores) > 1")))
            extra = fresh if extra is None else extra.unionByName(fresh)
            named = fresh.where("sort = 'strong'").select("field", "mark", "key", F.col("unit").alias("id"))
            held = base.join(named.drop("id"), ["field", "mark", "key"], "left_semi").join(units.select("unit", "id"), "unit").select("field", "mark", "key", "id")
            links, found = cut_counted(_stars(held.unionByName(named), ["field", "mark", "key"]).distinct())
        # Spellings by initials and acronyms, and those without a trade, where a single organisation answers.
        links, found = cut_counted(_answers(_asked(keys, extra, units), ["field", "key"]).distinct())
        if not found:
            break
    return spelt.where("real").join(units.select("unit", "id"), "unit").select("field", "name", F.col("id").alias("organisation"))


def variant_pairs(resolved: DataFrame) -> DataFrame:
    """All pairs (field, name_a, name_b) of spellings of one organisation, name_a < name_b in binary order."""
    a = resolved.select("field", "organisation", F.col("name").alias("name_a"))
    b = resolved.select("field", "organisation", F.col("name").alias("name_b"))
    return a.join(b, ["field", "organisation"]).where("name_a < name_b").select("field", "name_a", "name_b")


def with_variants(resolved: DataFrame) -> DataFrame:
    """Each spelling with the number of other spellings of its organisation; counts are aggregated before they are joined."""
    sizes = resolved.groupBy("organisation").agg((F.count("*") - 1).alias("variants"))
    return resolved.join(sizes, "organisation").select("field", "name", "organisation", "variants")
