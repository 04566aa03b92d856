"""Sentence ends: titles and units, open quotations, chunks of one text over many tasks."""

import pytest

from siftspark.llm import sentences


def cut(text):
    clean, at, out = sentences.normalise(text), 0, []
    for e in sentences.ends(text):
        out.append(clean[at:e].strip())
        at = e
    return out


CASES = [
    ("It takes 42.94 ms. Nobody waits.", ["It takes 42.94 ms.", "Nobody waits."]),
    ("Ms. Smith and Dr. J. K. Wolf left. They met St. Paul.", ["Ms. Smith and Dr. J. K. Wolf left.", "They met St. Paul."]),
    ("It is 3 m. The rest is 12 mm. Then 8 h. Done.", ["It is 3 m.", "The rest is 12 mm.", "Then 8 h.", "Done."]),
    ("It holds vitamin C. Next came plan B. He left.", ["It holds vitamin C.", "Next came plan B.", "He left."]),
    ("Written by J. Smith. See p. 12 of it.", ["Written by J. Smith.", "See p. 12 of it."]),
    ("Das gilt z. B. hier. M. Petit a lu env. 3 pages.", ["Das gilt z. B. hier.", "M. Petit a lu env. 3 pages."]),
    ('He said "stop. Then he left. It was late.\n\nNew one. Two.', ['He said "stop.', "Then he left.", "It was late.", "New one.", "Two."]),
    ('He said "stop. Then go." and left. It was late.', ['He said "stop. Then go." and left.', "It was late."]),
    ("Version 2\n\nMr. Smith left.", ["Version 2", "Mr. Smith left."]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_ends(text, want):
    assert cut(text) == want


LONG = [
    "word " * 400 + "Dr." + " " * 700 + "Smith left. " + "x" * 900 + ". Next one. 'q " * 3 + "\n\n",
    '"' + "Yes. " * 300 + '" he said. ' + "No. " * 200 + "\n\n# " + "head " * 300 + "\n- " + "item. " * 200 + "\n",
    "ระบบดี " * 400 + "\n\n```\n" + "a. B\n" * 300 + "```\nEnd. " + "“空的吗？是。" * 200 + "\n",
    'An "open mark. ' + "No end. " * 300 + "\n\nHe said: “it. " + "Still. " * 300 + "” Then. " + "more " * 300 + ".",
]


@pytest.mark.parametrize("text", LONG)
@pytest.mark.parametrize("size", [1, 17, 64, 500])
def test_cuts_do_not_matter(text, size):
    assert sentences.ends_by_chunks(text, size) == sentences.ends(text)


def test_one_text_over_many_tasks(spark):
    text = "".join(LONG) * 4
    docs = [(i, text[i * 37 :]) for i in range(4)] + [(9, "A. B"), (9, "A. B"), (3, text)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = sorted(tuple(r) for r in sentences.units(df, size=256).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted({(i, e) for i, t in docs for e in sentences.ends(t)})
