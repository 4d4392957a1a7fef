import os
import sys

from corpusloom.llm import residue

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import heldout_residue as held  # noqa: E402


def test_residue(spark):
    cases = {
        "# Title\n\n404 Not Found\n\nReference 12": True,
        "Home\nYou need to enable JavaScript to run this app.\nContact": True,
        "Dear {{ owner_name }},\n\nreal text": True,
        "Report for (DD.MM.YYYY), unit 5.": True,
        "Lorem ipsum dolor sit amet orci nulla vexil.": True,
        "dummy dummy dummy dummy dummy dummy": True,
        "此处为占位文字": True,
        "When the mirror answers 404 Not Found, the fetcher notes the address and goes on; 9 of 12 were lost that way.": False,
        "2024-01-01 10:00:00 ERROR [web] 503 Service Temporarily Unavailable after 4 tries": False,
        'greeting: "Hello {{ owner_name }}"': False,
        "The page template prints `{{ serial }}` and `${unit_id}`; the build fills both.": False,
        "```sh\ncp ${SRC}/a /b && echo __init__\n```": False,
        "path: ${HOME}/report": False,
        "Write the name of operator in field [3] and leave <PROFILE> to the office.": False,
        "We tested the viewer with JavaScript switched off, and the table stayed readable.": False,
        "": False,
        "  \n ": False,
    }
    filler = [(1000 + i, f"ordinary text of the unit number {i} near the gate, which the crew checks", "x") for i in range(200)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)] + filler + [(999, None, "x")], "id bigint, t string, labels string")
    found = {r.id for r in residue.residue(df, "id", "t").collect()}
    assert found == {i for i, bad in enumerate(cases.values()) if bad}
    assert residue.residue(df.where("false"), "id", "t").count() == 0


def test_texts_that_are_no_exemplars(spark):
    """With the document frequencies of a small corpus of ordinary text."""
    ordinary = [(10_000 + i, f"The crew of unit {i} checks the page of the report at the gate, and your text is not shown again before the server is open.") for i in range(300)]
    texts = [*held.RESIDUE, *held.UNSEEN, *held.CONTENT]
    df = spark.createDataFrame([*enumerate(texts), *ordinary], "id bigint, t string")
    found = {r.id for r in residue.residue(df, "id", "t").collect()}
    hit = [i in found for i in range(len(texts))]
    n, m = len(held.RESIDUE), len(held.RESIDUE) + len(held.UNSEEN)
    assert sum(hit[:n]) >= 0.9 * n, [t for t, h in zip(texts[:n], hit) if not h]
    assert sum(hit[n:m]) >= 0.8 * (m - n), [t for t, h in zip(texts[n:m], hit[n:]) if not h]
    assert not [t for t, h in zip(texts[m:], hit[m:]) if h]
    assert not [i for i in found if i >= 10_000]


def test_windows_and_very_long_texts(spark):
    notice = "Sorry, your browser\ndoes not support\nJavaScript."
    plain = "The crew reads the gauge at noon and the clerk writes the value down. " * 5000
    texts = [f"{plain}\n\n{notice}\n\n{plain}", f"{plain} This page could not be found. {plain}", plain, "x" * 200_000, "foo " * 9, "1 1 1 1 1 1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, texts[0])], "id bigint, t string")
    got = {r.id: r for r in residue.residue(df, "id", "t").collect()}
    assert set(got) == {0, 1, 4, 9} and got[0].labels == ["notice"] and got[1].labels == ["error"] and got[4].labels == ["filler"]
