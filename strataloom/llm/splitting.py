"""Oversized contents into pieces under a limit, cut at natural boundaries, with overlap.

Method: bounded-quantifier regex extraction in SQL. One pattern, its alternatives ordered by boundary
strength (rest of the section, paragraph, line, sentence, blank, any character), consumes a section
piece by piece, each alternative up to the limit. ``regexp_extract_all`` gives the fresh parts;
array functions add up their lengths, and each piece looks back by the overlap.
Only where sections start is found in Python, by a block parser, and only for oversized contents.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 1000, 100

ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"(=+|-+)[ \t]*$")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$")
FENCE = re.compile(r"(`{3,})(?=[^`]*$)|(~{3,})")
MARKER = re.compile(r"([-+*]|(\d{1,9})[.)])(?=[ \t]|$)")
DEFINITION = re.compile(r"\[(?:[^\[\]\\]|\\.)+\]:[ \t]*\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
HEADING_ELEMENT = re.compile(r"<h([1-6])(?=[\s>/])[^>]*>(.*?)(?:</h\1\s*>|$)", re.I)
#: The names of HTML elements that start a block in CommonMark.
BLOCK_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main "
    "menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
#: (start, end or None for a blank line, may hold headings, may end a paragraph)
HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?=[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), False, True),
    (re.compile(r"<!--"), re.compile(r"-->"), False, True),
    (re.compile(r"<\?"), re.compile(r"\?>"), False, True),
    (re.compile(r"<![A-Za-z]"), re.compile(r">"), False, True),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), False, True),
    (re.compile(rf"</?(?:{'|'.join(BLOCK_NAMES.split())})(?=[\s>]|/>|$)", re.I), None, True, True),
    (re.compile(r"""<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>\s*$|</[A-Za-z][A-Za-z0-9-]*\s*>\s*$"""), None, True, False),
]


def _indent(line: str, at: int, column: int) -> tuple[int, int]:
    """Columns of white space from ``at``, and where it ends; a tab reaches the next multiple of 4."""
    start = column
    while at < len(line) and line[at] in " \t":
        column += 4 - column % 4 if line[at] == "\t" else 1
        at += 1
    return column - start, at


def _skip(line: str, at: int, column: int, spare: int, columns: int) -> tuple[int, int, int]:
    """Move over so many columns of white space; of a half-used tab the rest is spare."""
    while columns > 0:
        if spare:
            used = min(spare, columns)
            spare, columns, column = spare - used, columns - used, column + used
        elif at < len(line) and line[at] in " \t":
            spare = 4 - column % 4 if line[at] == "\t" else 1
            at += 1
        else:
            break
    return at, column, spare


def headings(text: str) -> list[tuple[int, int, str]]:
    """(start of the line, level, title) of every heading, by CommonMark's block structure and h1-h6 of HTML blocks.

    Quotes and list items are followed; code, comments and raw text hold no headings.
    """
    found: list[tuple[int, int, str]] = []
    boxes: list[tuple[str, int]] = []  # ("quote", 0) or ("item", columns its content is indented by)
    leaf, fence, html_end, html_open = "", "", None, False
    para: list[tuple[int, str]] = []
    item_empty = False
    for m in re.finditer(r"([^\r\n]*)(\r\n|\r|\n|$)", text):
        line, start = m.group(1), m.start()
        if start == len(text):
            break
        at = column = spare = 0
        blank = not line.strip(" \t")

        def indent() -> tuple[int, int]:
            more, to = _indent(line, at, column + spare)  # noqa: B023
            return more + spare, to  # noqa: B023

        matched = 0
        for kind, width in boxes:
            deep, to = indent()
            if kind == "quote":
                if deep <= 3 and to < len(line) and line[to] == ">":
                    column += deep + 1
                    at, spare = to + 1, 0
                    at, column, spare = _skip(line, at, column, spare, 1)
                else:
                    break
            elif to >= len(line):
                if item_empty:
                    break
                at, column, spare = _skip(line, at, column, spare, min(width, deep))
            elif deep >= width:
                at, column, spare = _skip(line, at, column, spare, width)
            else:
                break
            matched += 1
        whole = matched == len(boxes)
        deep, to = indent()
        if whole and leaf == "fence":
            rest = line[to:]
            if deep <= 3 and rest.startswith(fence) and not rest.strip(fence[0] + " \t"):
                leaf = ""
            continue
        if whole and leaf == "html":
            if html_end is None and to >= len(line):
                leaf = ""
                continue
            if html_open:
                found += [(start, int(h.group(1)), h.group(2)) for h in list(HEADING_ELEMENT.finditer(re.sub(r"<!--.*?-->", "", line)))[:1]]
            if html_end is not None and html_end.search(line[at:]):
                leaf = ""
            continue
        if whole and leaf == "code":
            if deep >= 4 or to >= len(line):
                continue
            leaf = ""
        if not whole and leaf != "para":
            boxes, leaf = boxes[:matched], ""
        new_box = done = False
        while True:
            deep, to = indent()
            rest = line[to:]
            lazy = len(boxes) > matched and not new_box
            if not rest:
                break
            if deep >= 4:
                if leaf != "para" or new_box:
                    boxes = boxes[:matched] if lazy else boxes
                    leaf, para, done, item_empty = "code", [], True, False
                break
            if rest[0] == ">":
                if lazy:
                    boxes = boxes[:matched]
                boxes.append(("quote", 0))
                matched, new_box, leaf, para, item_empty = len(boxes), True, "", [], False
                column += deep + 1
                at, spare = to + 1, 0
                at, column, spare = _skip(line, at, column, spare, 1)
                continue
            if h := ATX.match(rest):
                boxes = boxes[:matched] if lazy else boxes
                found.append((start, len(h.group(1)), (h.group(2) or "").strip()))
                leaf, para, done, item_empty = "", [], True, False
                break
            if h := FENCE.match(rest):
                boxes = boxes[:matched] if lazy else boxes
                leaf, fence, para, done, item_empty = "fence", h.group(1) or h.group(2), [], True, False
                break
            if rest[0] == "<":
                kind = next((k for k in HTML if k[0].match(rest) and (k[3] or leaf != "para" or new_box)), None)
                if kind:
                    boxes = boxes[:matched] if lazy else boxes
                    leaf, html_end, html_open, para, done, item_empty = "html", kind[1], kind[2], [], True, False
                    if html_open:
                        found += [(start, int(h.group(1)), h.group(2)) for h in list(HEADING_ELEMENT.finditer(re.sub(r"<!--.*?-->", "", rest)))[:1]]
                    if html_end is not None and html_end.search(rest, 2):
                        leaf = ""
                    break
            if leaf == "para" and whole and not new_box and SETEXT.match(rest):
                while para and DEFINITION.match(para[0][1].strip()):
                    para.pop(0)
                if para:
                    found.append((para[0][0], 1 if rest[0] == "=" else 2, " ".join(p.strip() for _, p in para)))
                    leaf, para, done = "", [], True
                    break
            if RULE.match(rest):
                boxes = boxes[:matched] if lazy else boxes
                leaf, para, done, item_empty = "", [], True, False
                break
            if h := MARKER.match(rest):
                after = rest[h.end() :]
                if not (leaf == "para" and not new_box and (not after.strip() or h.group(2) not in (None, "1"))):
                    boxes = boxes[:matched] if lazy else boxes
                    column += deep + h.end()
                    at, spare = to + h.end(), 0
                    gap, end = indent()
                    pad = 1 if end >= len(line) or gap > 4 else gap
                    boxes.append(("item", deep + h.end() + pad))
                    at, column, spare = _skip(line, at, column, spare, pad)
                    matched, new_box, leaf, para = len(boxes), True, "", []
                    item_empty = end >= len(line)
                    continue
            break
        if done:
            continue
        deep, to = indent()
        if to >= len(line) or blank:
            boxes = boxes[:matched] if not new_box else boxes
            leaf, para = "", []
            continue
        if leaf == "para" and not new_box:
            para.append((start, line[to:]))  # also a lazy line of an outer paragraph
            continue
        boxes = boxes[:matched] if not new_box else boxes
        leaf, para, item_empty = "para", [(start, line[to:])], False
    return found


HEADINGS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType())]))


@F.pandas_udf(HEADINGS)
def _parsed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"start": s, "level": k, "title": re.sub(r"<[^>]+>", "", h).strip()} for s, k, h in headings(t)] if t else [])


# not to be copied into each expression that uses its result
_headings = _parsed.asNondeterministic()


def _pattern(limit: int, fresh: int) -> str:
    """First piece up to ``limit``, each later one up to ``fresh`` code points."""

    def consume(n: int) -> str:
        least = max(1, n // 2)
        ends = [r"(?<=\n\n|\n\r\n|\r\r)", r"(?<=\n|\r(?!\n))", r"(?<=[.!?;:]\s|[。！？；])", r"(?<=\s)"]
        return "|".join([rf".{{1,{n}}}\z", *(rf".{{{least},{n}}}{e}" for e in ends), rf".{{1,{n}}}"])

    return rf"(?s)\A(?:{consume(limit)})|(?:{consume(fresh)})"


def split_sections(
    df: DataFrame,
    key: str,
    content: str,
    section: str,
    heading_path: str,
    is_code: Column,
    limit: int = LIMIT,
) -> DataFrame:
    """(key, sec_no, sec_start, text, section, heading_path): the sections of every content longer than ``limit``.

    The first section keeps the record's own section and path; one that starts with a heading has its title,
    and the titles above it within the content are added to the path. Code is one section. Null,
    empty and shorter contents give no rows. Lengths and positions are in code points.
    """
    long = df.select(
        F.col(f"`{key}`").alias(key),
        F.col(f"`{content}`").alias("c"),
        F.coalesce(F.col(f"`{section}`"), F.lit("")).alias("s0"),
        F.coalesce(F.col(f"`{heading_path}`"), F.lit("")).alias("p0"),
        F.coalesce(is_code, F.lit(False)).alias("code"),
    ).where(F.length("c") > limit)
    none = F.array().cast(HEADINGS)
    marked = long.withColumn("h", _headings(F.when(~F.col("code"), F.col("c")))).withColumn("h", F.when(F.col("code"), none).otherwise(F.col("h")))
    first = F.struct(F.lit(0).alias("start"), F.lit(0).alias("level"), F.col("s0").alias("title"))
    heads = F.when((F.size("h") > 0) & (F.col("h")[0]["start"] == 0), F.col("h")).otherwise(F.concat(F.array(first), F.col("h")))
    rows = marked.withColumn("h", heads).select(key, "c", "s0", "p0", "h", F.posexplode("h").alias("sec_no", "x"))
    end = F.coalesce(F.try_element_at(F.col("h")["start"], F.col("sec_no") + 2), F.length("c"))
    # titles above: of each smaller level the last one before, as long as levels fall going back
    above = F.aggregate(
        F.reverse(F.slice("h", F.lit(1), F.col("sec_no"))),
        F.struct(F.col("x.level").alias("level"), F.array().cast("array<string>").alias("t")),
        lambda a, y: F.when((y["level"] < a["level"]) & (y["level"] > 0), F.struct(y["level"].alias("level"), F.concat(F.array(y["title"]), a["t"]).alias("t"))).otherwise(a),
    )["t"]
    path = F.when(F.col("x.level") == 0, F.col("p0")).otherwise(
        F.array_join(F.filter(F.concat(F.array("p0"), above, F.array("x.title")), lambda t: t != ""), ",")
    )
    return rows.select(
        key,
        F.col("sec_no").cast("bigint").alias("sec_no"),
        F.col("x.start").cast("bigint").alias("sec_start"),
        F.expr("substring(c, x.start + 1)").substr(F.lit(1), end - F.col("x.start")).alias("text"),
        F.col("x.title").alias("section"),
        path.alias("heading_path"),
    )


def pieces(sections: DataFrame, key: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, sec_no, piece_no, start_pos, n_chars, piece, section, heading_path) of split_sections' rows.

    No piece is longer than ``limit`` or spans two sections; consecutive pieces of a section share
    ``overlap`` code points. ``start_pos`` counts from the start of the content.
    """
    cut_up = sections.withColumn("f", F.regexp_extract_all("text", F.lit(_pattern(limit, limit - overlap)), F.lit(0)))
    starts = F.aggregate(
        "f",
        F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("a")),
        lambda a, p: F.struct((a["n"] + F.length(p)).alias("n"), F.concat(a["a"], F.array(a["n"])).alias("a")),
    )["a"]
    rows = cut_up.withColumn("f", F.arrays_zip(F.col("f").alias("p"), starts.alias("at"))).select("*", F.posexplode("f").alias("piece_no", "x"))
    back = F.when(F.col("piece_no") > 0, F.least(F.lit(overlap), F.col("x.at"))).otherwise(F.lit(0))
    rows = rows.withColumn("b", back).withColumn("piece", F.col("text").substr(F.col("x.at") - F.col("b") + 1, F.length("x.p") + F.col("b")))
    return rows.select(
        key,
        "sec_no",
        F.col("piece_no").cast("bigint").alias("piece_no"),
        (F.col("sec_start") + F.col("x.at") - F.col("b")).alias("start_pos"),
        F.length("piece").cast("bigint").alias("n_chars"),
        "piece",
        "section",
        "heading_path",
    )
