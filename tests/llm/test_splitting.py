import pytest
from pyspark.sql import functions as F

from strataloom.llm import splitting as S

SCHEMA = "chunk_uid string, content string, section string, heading_path string, content_type string, h int, c int, sec_no int"


def split(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    sections = S.split_sections(df, "chunk_uid", "content", "section", "heading_path", F.col("content_type") == "code")
    return sections.collect(), S.pieces(sections, "chunk_uid").orderBy("chunk_uid", "sec_no", "piece_no").collect()


@pytest.mark.parametrize(
    "text, starts",
    [
        ("a\n===\n", [0]),
        ("a\nb\n---", [0]),
        ("p\n---\n\n---\nx", [0]),
        ("p\n\n---\nx", []),
        ("> # h\n", [0]),
        ("- # h\n  foo\n  ---\n", [0, 6]),
        ("- a\n---\n", []),
        ("1. a\n\n   # b\n", [6]),
        ("> a\nb\n===\n", []),
        ("```\n# a\n```\n# b", [12]),
        ("~~~\n```\n# x\n~~~\n# y\n", [16]),
        ("    # a\n# b", [8]),
        ("\t# a\n# b", [5]),
        ("   # a", [0]),
        ("p\n    # a", []),
        ("<!-- \n# a\n-->\n# b", [14]),
        ("<div>\n<h2>x</h2>\n\n# t", [6, 18]),
        ("<h1>x</h1>", [0]),
        ("<pre>\n<h1>x</h1>\n</pre>\n", []),
        ("`<h1>` is an element", []),
        ("#a\n#\n####### x\n## ", [3, 15]),
        ("#tag #other\n", []),
        ("\\# a", []),
        ("a\r\n# b\r\n", [3]),
        ("[a]: /x\n===\n", []),
        ("", []),
    ],
)
def test_headings(text, starts):
    assert [h[0] for h in S.headings(text)] == starts


def texts():
    para = "The note keeps what was left. It was moved last week!\n"
    return {
        "plain": "x" * 2500,
        "sections": "start " * 30 + "\n\n# One\n\n" + para * 30 + "\nTwo\n---\n\n" + para * 10 + "\n### Three ##\n" + "語" * 1500,
        "code": "# one\n" * 400,
        "emoji": "👩‍💻" * 500,
        "exact": "a" * 1001,
        "crlf": (para.strip() + "\r\n\r\n") * 40,
        "blank": " \n" * 800,
    }


def test_round_trip(spark):
    t = texts()
    rows = [(k, v, "Intro", "Title,Intro", "code" if k == "code" else "prose") for k, v in t.items()]
    sections, pieces = split(spark, rows)
    by = {}
    for r in sections:
        by.setdefault(r["chunk_uid"], []).append((r["sec_start"], r["text"]))
    for k, v in t.items():
        assert "".join(x for _, x in sorted(by[k])) == v
        assert all(v[s : s + len(x)] == x for s, x in by[k])
    at = {}
    for p in pieces:
        v, k = t[p["chunk_uid"]], (p["chunk_uid"], p["sec_no"])
        assert p["n_chars"] <= S.LIMIT and v[p["start_pos"] : p["start_pos"] + p["n_chars"]] == p["piece"]
        if p["piece_no"]:
            assert p["start_pos"] == at[k] - S.OVERLAP
        at[k] = p["start_pos"] + p["n_chars"]
    assert {(r["chunk_uid"], r["sec_no"]): r["sec_start"] + len(r["text"]) for r in sections} == at


def test_sections_named(spark):
    _, pieces = split(spark, [("k", texts()["sections"], "Intro", "Title,Intro", None)])
    named = {r["sec_no"]: (r["section"], r["heading_path"]) for r in pieces}
    assert named[0] == ("Intro", "Title,Intro")
    assert named[2] == ("Two", "Title,Intro,One,Two") and named[3] == ("Three", "Title,Intro,One,Two,Three")


def test_natural_boundaries(spark):
    _, pieces = split(spark, [("k", ("word " * 100).strip() + "\n\n" + "other " * 300, "", None, "prose")])
    assert pieces[0]["piece"].endswith("\n\n")
    assert all(p["piece"].endswith(" ") for p in pieces[1:])


def test_no_rows(spark):
    sections, pieces = split(spark, [("a", None, None, None, None), ("b", "", None, None, None), ("c", "x" * 1000, None, None, None)])
    assert sections == [] and pieces == []
