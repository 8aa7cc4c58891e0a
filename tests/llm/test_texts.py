import base64
import random

import pytest

from lodeshift.llm.canonical import Mapper, map_values
from lodeshift.llm.sentences import sentence_spans, sentences
from lodeshift.llm.tokens import PATTERN, TOKENIZERS, VOCABULARY, encode_corpus, tokenizer

NAMES = [("first aid", "first aid"), ("emergency first aid", "first aid"), ("data modelling", "data modelling"), ("quorvane", "quorvane"), ("light design", "stage lighting")]


@pytest.mark.parametrize(
    ("raw", "entry"),
    [
        ("First Aid", "first aid"), ("frist  aid", "first aid"), ("aid (first)", "first aid"), ("emergency first aid", "first aid"), ("datamodelling", "data modelling"),
        ("basic data_modelling", "data modelling"), ("modelling, data", "data modelling"), ("data mdlng", "data modelling"), ("Qourvane v4", "quorvane"), ("quor-vane", "quorvane"),
        ("liight deisgn", "stage lighting"), ("my own car", None), ("chess", None), ("!!", None), ("first " * 2000, None),
    ],
)
def test_entries(raw, entry):
    assert Mapper(tuple(NAMES)).entry(raw) == entry


def test_map_values_edges(spark):
    df = spark.createDataFrame([(1, "first aid", 1), (1, "first aid", 1), (2, None, 1), (3, " ", 1), (None, "x", 1)], "id long, v string, entry int")
    assert sorted((r.match_id or 0, r.entry) for r in map_values(df, "id", "v", NAMES).collect()) == [(0, "unmatched"), (1, "first aid"), (1, "first aid")]
    assert map_values(df.limit(0), "id", "v", NAMES).count() == 0
    assert {r.entry for r in map_values(df, "id", "v", []).collect()} == {"unmatched"}


@pytest.mark.parametrize(
    ("text", "units"),
    [
        (None, []), ("", []), (" \n ", []), ("ok", ["ok"]),
        ("Dr. Ash came at 6 p.m. He left. It was 3.5 km.", ["Dr. Ash came at 6 p.m.", "He left.", "It was 3.5 km."]),
        ("He said: “Done. Go.” Then rain.", ["He said: “Done. Go.”", "Then rain."]),
        ("„Voll. Warten.“, rief er. Am 3. Mai kam er.", ["„Voll. Warten.“, rief er.", "Am 3. Mai kam er."]),
        ("经理说：“完成。没有。”然后走了。谢谢！好", ["经理说：“完成。没有。”然后走了。", "谢谢！", "好"]),
        ("「本当？」と言った。はい。", ["「本当？」と言った。", "はい。"]),
        ("यह है। वह है।", ["यह है।", "वह है।"]),
        ("ผมดูแล ทีมมี 3 คน งาน", ["ผมดูแล", "ทีมมี 3 คน", "งาน"]),
        ("Notes\nOne. Two.\n\n• a. b\n• c", ["Notes", "One.", "Two.", "• a. b", "• c"]),
        ("left the room.Her Ph.D. thesis. See plan.final.xlsx now.", ["left the room.", "Her Ph.D. thesis.", "See plan.final.xlsx now."]),
        ("В 2010 г. отдел вырос. Мы и т. д. в г. Омск.", ["В 2010 г. отдел вырос.", "Мы и т. д. в г. Омск."]),
        ("The deadline for every pallet in the northern\ndepot passed quietly for all of the people\nthere.", ["The deadline for every pallet in the northern\ndepot passed quietly for all of the people\nthere."]),
        ("😀 a! b", ["😀 a! b"]),
    ],
)
def test_sentence_units(text, units):
    assert [text[a:b] for a, b in sentence_spans(text)] == units


def test_units_hold_every_character_once():
    r = random.Random(5)
    for _ in range(400):
        text = "".join(r.choice("aB1.!?\"“”()。 \n\r•-é") for _ in range(r.randrange(90)))
        spans = sentence_spans(text)
        assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())


def test_sentences_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "A. B c.", 0), (2, None, 0), (3, "", 0), (4, "x " * 50_000, 0), (None, "Hi.", 0)], "id long, t string, start_pos int")
    got = {(r.doc_id, r.start_pos, r.end_pos) for r in sentences(df, "id", "t").collect()}
    assert got == {(1, 0, 7), (4, 0, 99_999), (None, 0, 3)}
    assert sentences(df.limit(0), "id", "t").count() == 0


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{TOKENIZERS}/{VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(reference):
    r, bpe = random.Random(1), tokenizer()
    for _ in range(1500):
        text = "".join(r.choice("aAbe inst-ering\n\tœé你はไ😀0129'\"<|>") for _ in range(r.randrange(80)))
        assert bpe.encode(text) == reference.encode_ordinary(text)
    for text in ["<|endoftext|>", "a" * 5000, " " * 3000, "的" * 3000, "​draft"]:
        assert bpe.encode(text) == reference.encode_ordinary(text)


def test_ids_of_odd_tables(spark, reference):
    df = spark.createDataFrame([(1, "Hello world", 0), (2, None, 0), (3, "", 0)], "id long, t string, ids int")
    got = {r.doc_id: r.ids for r in encode_corpus(df, "id", "t").collect()}
    assert got == {1: reference.encode_ordinary("Hello world"), 2: [], 3: []}
    assert encode_corpus(df.limit(0), "id", "t").count() == 0


def test_no_switches_by_width():
    wrapped = "The committee met in the town hall and agreed that the plan should be\nfollowed without any change. It was then signed by all of its members and\nsent to the printer, who had been waiting for it since the early morning,\nand who set it in type at once. Nothing else was done that day in the hall\nor outside."
    long_line = "A paragraph on one line. " * 20
    units = [wrapped[a:b] for a, b in sentence_spans(wrapped)]
    both = long_line.strip() + "\n\n" + wrapped
    assert [both[a:b] for a, b in sentence_spans(both)] == ["A paragraph on one line."] * 20 + units and len(units) == 3
    unwrapped = "\n".join(["This paragraph stands on a line of its own and is short enough.", "So does this one, it is shorter.", long_line.strip()])
    assert [unwrapped[a:b] for a, b in sentence_spans(unwrapped)][:2] == unwrapped.split("\n")[:2]


def test_quotations_of_any_length():
    inner = "It rained all day. " * 60
    text = f"They wrote “{inner.strip()}” and left. Then (an unmatched bracket. The end."
    assert [text[a:b] for a, b in sentence_spans(text)] == [f"They wrote “{inner.strip()}” and left.", "Then (an unmatched bracket.", "The end."]
    text = "See www.example.org/" + "a/" * 100 + "x.Y for more. Done."
    assert [text[a:b] for a, b in sentence_spans(text)] == [text[:-6], "Done."]
