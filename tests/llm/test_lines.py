import random
import sys
from collections import Counter
from pathlib import Path

import pytest

from lodeshift.llm.pii import find_items, find_pii, redact_pii, trained
from lodeshift.llm.pii_table import LINES, Table, unmark
from lodeshift.llm.scans import MOST_EDITS, LetterTrie, Trie, candidates, explain, find_noise, levenshtein_states, reach, reflow, repaired, weighed, wrong_glyphs


sys.path.insert(0, str(Path(__file__).parent))
from pii_lines import LATER, SEEN, UNSEEN  # noqa: E402


def _measure(rows):
    hit, wrong, missed = Counter(), Counter(), Counter()
    for (_, spans), found in zip(rows, find_items([r[0] for r in rows], trained(LINES))):
        gold, got = {(a, k) for a, _, k in spans}, {(a, k) for a, _, k in found}
        for count, items in ((hit, gold & got), (wrong, got - gold), (missed, gold - got)):
            count.update(k for _, k in items)
            count["all"] += len(items)
    return {k: (hit[k] / (hit[k] + missed[k]), hit[k] / (hit[k] + wrong[k])) for k in hit}


def test_new_draws_of_the_table():
    recall, precision = _measure(Table(4242).rows(900))["all"]
    assert recall > 0.95 and precision > 0.95


def test_hand_written_lines():
    # The lines are apart from the table; see there which were looked at while it was made.
    unseen, later, seen = (_measure([unmark(x) for x in lines]) for lines in (UNSEEN, LATER, SEEN))
    print("unseen", unseen, "later", later, "seen", seen)
    assert min(later["all"]) > 0.88 and min(seen["all"]) > 0.86 and min(unseen["all"]) > 0.8
    assert all(min(later[k]) > 0.9 for k in ("email", "phone", "id_number")) and all(min(later[k]) > 0.8 for k in ("name", "address"))


def test_pii_tables(spark):
    rows = [(1, "Tel. +49 30 23125 755 | E-mail: anna.belovic@post.test", 14.0, 0), (2, None, None, 0), (3, "", 1.0, 0), (4, "Budget 2019: EUR 5529.79 per site.", 10.0, 0), (5, "x " * 30_000, None, 0)]
    df = spark.createDataFrame(rows, "block_id long, text string, font double, start_pos int")
    got = {(r.block_id, r.pii_type, r.start_pos) for r in find_pii(df, "block_id", "text").collect()}
    assert got == {(1, "phone", 5), (1, "email", 32)}
    clean = {r.block_id: r.text for r in redact_pii(df, "block_id", "text").collect()}
    assert clean[1] == "Tel. [PHONE] | E-mail: [EMAIL]" and clean[2] is None and clean[4] == rows[3][1] and clean[5] == rows[4][1]
    assert find_pii(df.limit(0), "block_id", "text").count() == 0


def test_trie_gives_every_word_that_lookalikes_explain():
    r = random.Random(2)
    words = {"".join(r.choice("dclrnmiou") for _ in range(r.randrange(1, 7))) for _ in range(700)}
    trie = Trie(words)
    for _ in range(300):
        asked = "".join(r.choice("dclrnmiou10!") for _ in range(r.randrange(1, 8)))
        near = trie.near(asked, MOST_EDITS)
        assert {w: n for w, n in near.items() if n} == {w: len(s) for w in words if (s := explain(asked, w))}


@pytest.mark.parametrize(("read", "printed", "spans"), [("c1ear", "clear", [(1, 2)]), ("programrnes", "programmes", [(7, 9)]), ("clear", "clear", None), ("cxear", "clear", None), ("tr@ined", "trained", [(2, 3)]), ("bclow", "below", [(1, 2)])])
def test_explained(read, printed, spans):
    assert explain(read, printed) == spans


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_levenshtein_automaton_is_complete(most):
    r = random.Random(most)
    words = {"".join(r.choice("abcd") for _ in range(r.randrange(1, 9))) for _ in range(400)} | {"x" * 60 + "abc", "é" * 30}
    asked = ["".join(r.choice("abcde") for _ in range(r.randrange(0, 10))) for _ in range(150)] + ["x" * 59 + "abcb", "é" * 28]
    assert sorted(set(LetterTrie(words).within(asked, most))) == sorted({(a, w, d) for a in asked for w in words if (d := _distance(a, w)) <= most})
    assert list(LetterTrie([]).within(asked, most)) == [] and levenshtein_states(most)[1].shape[1] == 2 * most + 1


def test_candidates_equal_brute_force(spark):
    r = random.Random(5)
    words = {"".join(r.choice("dclrnmioes") for _ in range(r.randrange(2, 12))) for _ in range(500)} | {"rnrnrna", "hello", "x" * 57 + "end"}
    asked = {w[:k] + e + w[k + s :] for w in list(words)[:120] for k, s, e in [(r.randrange(len(w)), r.choice((0, 1)), r.choice(("", "x", "1", "rn", "cl")))]} - {""}
    asked |= {"mmma", "helo", "hallo", "helllo", "x" * 57 + "cnd", "x" * 56 + "end"}
    got = {(a.word, a.known): (a.looks, a.edits, a.n) for a in candidates(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")).collect()}
    want = {}
    for a in asked:
        for w in words - {a}:
            d, looks = _distance(a, w), explain(a, w)
            if d <= reach(len(a)) or looks:
                want[a, w] = (len(looks) if looks else None, d if d <= reach(len(a)) else None, len(w))
    assert got == want and ("mmma", "rnrnrna") in got and {("helo", "hello"), ("hallo", "hello")} <= got.keys() and ("x" * 57 + "cnd", "x" * 57 + "end") in got


@pytest.mark.parametrize(("read", "printed", "stretches"), [("helo", "hello", ((1, 2, "el"),)), ("elow", "below", ((0, 1, "be"),)), ("hxllo", "hello", ((1, 2, "e"),)), ("helllo", "hello", ((2, 3, ""),)), ("c1ear", "clear", ((1, 2, "l"),))])
def test_stretches_of_any_edit(read, printed, stretches):
    got = weighed(read, printed)
    assert len(got) == len(stretches)
    for a, b, p in reversed(got):
        read = read[:a] + p + read[b:]
    assert read == printed


def test_long_words_and_far_lines(spark):
    word = "donaudampfschifffahrtsgesellschaftskapitaenswitwe"  # longer than 40 letters
    far = "x" * 150
    pages = [[f"the {word[:-1]}c and the {word} of {far}-", f"{far} and the {word} here", f"over the {word[:30]}-", f"{word[30:]} was there"]]
    rows = [(10 * p + k, "c", p, k, text, 50.0, 10.0 * k, 10.0, "ocr", None) for p, lines in enumerate(pages, 1) for k, text in enumerate(lines, 1)]
    clean = spark.createDataFrame([(f"the {word} and {far}{far} was here",)] * 20, "text string")
    noise = find_noise(spark.createDataFrame(rows, SCHEMA), clean)
    assert {(r.block_id, r.kind) for r in noise["kinds"].collect()} == {(11, "split_word"), (13, "split_word"), (11, "misread")}
    text = " ".join(r.text for r in reflow(noise).collect())
    assert text == f"the {word} and the {word} of {far}{far} and the {word} here over the {word} was there"


SCHEMA = "block_id long, candidate_id string, page int, line_no int, text string, x0 double, top double, font_size double, method string, loaded_at timestamp"


def test_noise_of_pages(spark):
    pages = [
        ["Registry copy", "We managed the regu-", "latory 1aboratory in the night-", "shift with refri9er¬", "[ 1 ]"],
        ["Registry copy", "ated goods and programmes", "Old line.", None, "[ 2 ]"],
    ]
    rows, n = [], 0
    for p, lines in enumerate(pages, 1):
        for k, text in enumerate(lines, 1):
            n += 1
            edge = k in (1, 5)
            rows.append((n, "c", p, k, text, 250.0 if edge else 50.0, 10.0 * k, 8.0 if edge else 10.0, "ocr", None))
    rows += [(99, None, None, None, "lost line", None, None, None, None, None), rows[1]]
    clean = spark.createDataFrame([("we managed the regulatory laboratory in the night-shift with refrigerated goods and programmes old line",)] * 9 + [(None,)], "text string")
    noise = find_noise(spark.createDataFrame(rows, SCHEMA), clean)
    kinds = {(r.block_id, r.kind) for r in noise["kinds"].collect()}
    assert kinds == {(1, "running_line"), (6, "running_line"), (5, "page_number"), (10, "page_number"), (2, "split_word"), (3, "split_compound"), (4, "split_word"), (3, "misread"), (4, "misread")}
    assert {(r.block_id, r.begin, r.end) for r in noise["wrong"].collect()} == {(3, 7, 8), (4, 16, 17)}
    text = " ".join(r.text for r in reflow(noise).orderBy("page", "paragraph").collect())
    assert "regulatory laboratory in the night-shift" in text and "Registry" not in text
    glyphs = spark.createDataFrame([(i, "c", 1, c, 5.0 * i, 30.0) for i, c in enumerate("latory1aboratory")] + [(99, "c", 1, "1", 30.0, 30.0)], "glyph_id long, candidate_id string, page int, text string, x0 double, top double")
    assert {r.glyph_id for r in wrong_glyphs(glyphs, spark.createDataFrame(rows, SCHEMA), noise["wrong"]).collect()} == {6, 99}


def test_paragraphs_over_page_borders(spark):
    pages = [
        ["Earlier work.", "We planned the delivery of refrigerated goods with a group of partici-"],
        ["pating towns and cared for"],
        ["Jolvex users in the region.", "• First aid courses for all members of the night shift and their"],
        ["• Second list entry stands for itself here", "It went on well and so did all the other work of the year"],
        ["Ines Varnmere", "All of it is done here, with printed checklists."],
        ["jolvex systems works"],
    ]
    rows = [(10 * p + k, "c", p, k, text, 50.0, 10.0 * k, 10.0, "text", None) for p, lines in enumerate(pages, 1) for k, text in enumerate(lines, 1)]
    rows += [(90, "d", 2, 1, "small letters of another owner", 50.0, 10.0, 10.0, "text", None)]
    got = {(r.candidate_id, r.page, r.paragraph): r.text for r in reflow(find_noise(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("participating",)], "text string"))).collect()}
    assert got == {
        ("c", 1, 1): "Earlier work.", ("c", 1, 2): "We planned the delivery of refrigerated goods with a group of participating towns and cared for Jolvex users in the region.",
        ("c", 3, 2): pages[2][1], ("c", 4, 1): " ".join(pages[3]), ("c", 5, 1): "Ines Varnmere", ("c", 5, 2): pages[4][1], ("c", 6, 1): "jolvex systems works", ("d", 2, 1): "small letters of another owner",
    }


def test_broken_words_and_numbers_are_repaired(spark):
    pages = [["Reviewed by l23 lab0ratory staff in 2l7 refri9er-", "@ted stores, LAB0RATORY and Lab0ratory of 4O4 partici-"], ["p@ting towns."]]
    rows = [(10 * p + k, "c", p, k, text, 50.0, 10.0 * k, 10.0, "ocr", None) for p, lines in enumerate(pages, 1) for k, text in enumerate(lines, 1)]
    clean = spark.createDataFrame([("reviewed by laboratory staff in refrigerated stores and of participating towns",)] * 20, "text string")
    got = [r.text for r in reflow(find_noise(spark.createDataFrame(rows, SCHEMA), clean)).collect()]
    assert got == ["Reviewed by 123 laboratory staff in 217 refrigerated stores, LABORATORY and Laboratory of 404 participating towns."]


@pytest.mark.parametrize(("parts", "known", "mended"), [(("prograr", "nmes"), "programmes", ("program", "mes")), (("particip", "@ting"), "participating", ("particip", "ating")), (("PROGRARN", "MES"), "programmes", ("PROGRAM", "MES")), (("RN", "odern"), "modern", ("M", "odern"))])
def test_parts_of_a_word(parts, known, mended):
    word, offset, got = "".join(parts).lower(), 0, []
    for part in parts:
        got.append(repaired(part, [{"begin": 0, "offset": offset, "size": len(part), "word": word, "known": known}]))
        offset += len(part)
    assert tuple(got) == mended


def test_no_lines(spark):
    noise = find_noise(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string"))
    assert noise["kinds"].count() == 0 and reflow(noise).count() == 0
