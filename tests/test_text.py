import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import chunks, perturb


def sentences(text, min_chars=20):
    """One piece after the other: what ends in an abbreviation takes the next, and a short one goes to the last."""
    pieces = [p for p in re.split(r"(?<=[.!?]) ", " ".join((text or "").split())) if p]
    found = []
    for piece in pieces:
        if found and found[-1][1].rsplit(" ", 1)[-1].lower() in T.ABBREVIATIONS:
            found[-1] = (f"{found[-1][0]} {piece}", piece)
        else:
            found.append((piece, piece))
    out = []
    for whole, _ in found:
        if out and len(whole) < min_chars:
            out[-1] += f" {whole}"
        else:
            out.append(whole)
    return out



def each(spark, values, expr, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
    return [r.v for r in rows.select("i", expr(F.col("c")).alias("v")).orderBy("i").collect()]


def test_sentences(spark):
    texts = [
        "Dr. Smith wrote the first report. It was a long one indeed. Ok. End of the text here.",
        "", None, "   ", "One line without a mark", "Ends in etc. and goes on for a while. Short. x! Another full sentence follows.",
    ]
    assert each(spark, texts, T.sentences) == [
        ["Dr. Smith wrote the first report.", "It was a long one indeed. Ok.", "End of the text here."], [], [], [],
        ["One line without a mark"], ["Ends in etc. and goes on for a while. Short. x!", "Another full sentence follows."],
    ]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["Dr.", "etc.", "word", "longer-word-here", "end.", "what?", "e.g."]), max_size=25).map(" ".join), min_size=1, max_size=8))
def test_sentences_equal_a_fold(spark, texts):
    assert each(spark, texts, T.sentences) == [sentences(t) for t in texts]


def test_windows(spark):
    lines = "\n".join(f"line number {i}" for i in range(10))
    docs = spark.createDataFrame([(1, [lines, None, "ab\nc", lines]), (2, ["short"])], "doc_id long, pages array<string>")
    got = chunks.chunk_passages(docs, F.col("pages"), 4, 3, 30).orderBy("doc_id", "idx").collect()
    first = [" ".join(f"line number {i}" for i in range(s, min(s + 4, 10))) for s in (0, 3, 6)]
    assert [(r.page, r.text) for r in got] == [(1, t) for t in first]  # the repeated page adds nothing
    with pytest.raises(ValueError):
        chunks.chunk_passages(docs, F.col("pages"), 0, 1)


def test_sentence_groups_share_one(spark):
    text = " ".join(f"This is the sentence number {i}." for i in range(6))
    docs = spark.createDataFrame([(1, text), (2, "Only one sentence is here."), (3, "")], "doc_id long, text string")
    got = chunks.sentence_groups(docs, F.col("text"), 3).orderBy("doc_id", "idx").collect()
    s = sentences(text)
    assert [r.text for r in got] == [" ".join(s[0:3]), " ".join(s[2:5]), " ".join(s[4:6]), "Only one sentence is here.", ""]


def test_citations(spark):
    assert [[tuple(x) for x in v] for v in each(spark, ["A [2]. B [0]! C [10][3]? D", None, ""], T.citations)] == [[(0, 1), (2, 9)], [], []]
    marks = ["x [2]", "[1, 2]", "[1-4]", "[4-1]", "[sic]", "[1-99] [3] [3,1]", None]
    assert each(spark, marks, T.citation_markers) == [[2], [1, 2], [1, 2, 3, 4], [], [], [1, 3], []]


def test_names_and_lines(spark):
    names = ["/a/b/../c d\t.md", "", None, "x" * 200, "bad\u0000‮name.txt"]
    assert each(spark, names, T.display_name) == ["c d .md".replace(" .", ".") if False else "c d.md", "document", "document", "x" * 128, "badname.txt"]
    assert each(spark, ["1. What?\n\n- Why?\n* How?\n• Who?"], lambda c: T.question_lines(c, 3)) == [["What?", "Why?", "How?"]]
    assert each(spark, ["Context: It is here.", "This chunk tells much about it all and more than forty: x", "plain: text", " ".join(["w"] * 70)], T.situating_sentence)[:3] == [
        "It is here.", "This chunk tells much about it all and more than forty: x", "plain: text",
    ]
    sections = each(spark, ["intro\n## One\ntext\n##  Two \n", "no heading ", "## \n"], T.markdown_sections)
    assert sections == [["One\ntext", "Two"], ["no heading"], []]
    assert each(spark, ["Café au lait, 2x!"], T.tokens) == [["caf", "au", "lait", "2x"]]
    assert each(spark, ["Café café 2x!"], T.word_set) == [["café", "2x"]]


def test_control_characters_cut_no_sentence(spark):
    texts = ["First one is a sentence\u0001with a control character in it. The second one is a sentence, too.", "\u0001\u0002a\u0002b. And here \u0002\u0001\u0001 are more of them, yes! Short.", "\u0001", "a\u0002"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.sentences(F.col("t")).alias("s")).collect()
    assert {r.i: r.s for r in rows} == {i: sentences(t) for i, t in enumerate(texts)}


def test_numbers_of_any_length_are_edited(spark):
    texts = ["Pi is 3.14159265358979323846264338327950288 or so.", "\u0001There are 12345678901234567890123456789012345678901234567890 of \u0002them.", "Zero 0000000000000000000.000 it is.", "Plain 42 here\u0001."]
    df = spark.createDataFrame([(i, t, [], []) for i, t in enumerate(texts)], "qid long, answer string, passages array<string>, distractors array<string>")
    got = {}
    for r in perturb.apply_all(df, seeds=tuple(range(8))).filter("operator = 'number_corruption'").collect():
        got.setdefault(int(r.qid), []).append(r.text)
    for i, t in enumerate(texts):
        old = re.search(r"[0-9]+(?:\.[0-9]+)?", t)
        assert len(got[i]) == 8
        for text in got[i]:
            assert text.startswith(t[: old.start()]) and text.endswith(t[old.end() :])
            new = text[old.start() : len(text) - len(t) + old.end()]
            assert new != old[0] and re.fullmatch(r"(0|[1-9][0-9]*)(\.[0-9]+)?", new), new
            assert len(new.partition(".")[2]) == len(old[0].partition(".")[2])
