"""Several values packed in one field: one row per value, whatever the notation.

Method: selection of dialects by minimum description length. Every distinct string is
parsed under each delimiter-and-quote dialect its characters allow. A parse costs the bits of
its dialect plus the code lengths of its values. A value's code length has two parts: the bits of
its frequency over the whole corpus, counted distributed and combined before the shuffle, and
its share of the code book, where every distinct value spells its characters once.
The cheapest dialect parses the field.
Two rounds: first every parse of a string counts with equal weight, then only the cheapest.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.skew import lookup
from strataloom.session import cut

# The notations that are tried.
SINGLE = [",", ";", "|", "\t", "\n", "，", "；", "、", "·", "•", "｜", "‧", "・"]
SPACED = ["/", "-", "–", "—", "·", "•", "+", "&", "→", ">"]  # only with blanks on both sides
MIXED = ",;|\n，；、｜\t"  # one field may use several of these
EMPTY = {"__extraction_failed__"}
BULLET = re.compile(r"^\s*(?:[-*+•·‣◦–—]|\d{1,3}[.)])\s+")
BRACKETS = {"[": "]", "{": "}", "(": ")", "【": "】", "「": "」"}
PAIRS = {'"': '"', "'": "'", "“": "”", "«": "»", "‘": "’", "`": "`"}

CHAR_BITS = 6.0  # of a character of a value in the code book
VALUE_BITS = 4.0  # of one more value in a list
DIALECT_BITS = {"list": 1.0, "single": 2.0, "spaced": 3.0, "hash": 2.0, "bullet": 2.0, "mixed": 5.0, "plain": 9.0, "whole": 2.0}


def _clean(value: str) -> str:
    """A value without outer blanks, whole quotes, their escapes and a leading ``#``."""
    v = value.strip(" \t\r\n 　﻿")
    if len(v) >= 2 and v[0] in PAIRS and v[-1] == PAIRS[v[0]]:
        q, inner = v[0], v[1:-1]
        bare = inner.replace("\\" + q, "").replace(q + q, "")
        if q not in bare:
            v = inner.replace("\\" + q, q).replace(q + q, q).replace("\\\\", "\\").strip()
    if len(v) > 1 and v[0] == "#":
        v = v.lstrip("#").strip()
    return v


def _split(text: str, delimiters: str, quotes: str) -> list[str]:
    """Split outside quotes; a quote opens only at the start of a value and must close before a delimiter."""
    out: list[str] = []
    start, i, n = 0, 0, len(text)
    fresh = True
    while i < n:
        ch = text[i]
        if fresh and ch in quotes:
            close, j = PAIRS[ch], i + 1
            while j < n:
                if text[j] == "\\" and j + 1 < n:
                    j += 2
                    continue
                if text[j] == close:
                    if j + 1 < n and text[j + 1] == close and close == ch:
                        j += 2
                        continue
                    rest = text[j + 1 :].lstrip(" \r" if "\t" in delimiters or "\n" in delimiters else " \t\r\n")
                    if not rest or rest[0] in delimiters:
                        break
                j += 1
            if j < n:
                i, fresh = j + 1, False
                continue
        if ch == "\\" and i + 1 < n and text[i + 1] in delimiters:
            i, fresh = i + 2, False
            continue
        if ch in delimiters:
            out.append(text[start:i])
            start, fresh = i + 1, True
        elif not ch.isspace():
            fresh = False
        i += 1
    out.append(text[start:])
    return [re.sub(r"\\([,;|])", r"\1", x) if "\\" in x else x for x in out]


def _as_list(text: str) -> list[str] | None:
    """The values of a JSON or literal list, else None."""
    if not (text.startswith("[") and text.endswith("]")) and not (text.startswith("(") and text.endswith(")")):
        return None
    for load in (json.loads, ast.literal_eval):
        try:
            found = load(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            continue
        if isinstance(found, (list, tuple)):
            return [x if isinstance(x, str) else "" if x is None else str(x) for x in found]
    return None


def parses(text: str) -> list[tuple[str, list[str]]]:
    """(dialect, values) of every distinct parse; the first dialect of equal parses is kept."""
    body = text.strip(" \r\n 　﻿")
    if not body.strip() or body.strip() in EMPTY:
        return [("whole", [])]
    literal = _as_list(body.strip())
    if literal is not None:
        return [("list", [v for v in map(_clean, literal) if v])]
    if len(body) > 1 and body[0] in BRACKETS and body[-1] == BRACKETS[body[0]] and body[0] not in body[1:-1]:
        body = body[1:-1]
    found: list[tuple[str, list[str]]] = []

    def add(dialect: str, values: Sequence[str]) -> None:
        kept = [v for v in map(_clean, values) if v]
        if kept and all(kept != known for _, known in found):
            found.append((dialect, kept))

    lines = [x for x in re.split(r"\r\n|\r|\n", body) if x.strip()]
    if lines and all(BULLET.match(x) for x in lines):
        add("bullet", [BULLET.sub("", x) for x in lines])
    if re.match(r"\s*#\S", body) and re.search(r"\s#\S", body):
        add("hash", re.split(r"[,;|]?\s+(?=#\S)", body))
    present = [d for d in SINGLE if d in body]
    for d in present:
        add(f"single {d}", _split(body, d, '"“«'))
    if "'" in body:
        for d in present:
            add(f"single' {d}", _split(body, d, "'"))
    for d in SPACED:
        if re.search(rf"\s{re.escape(d)}\s", body):
            add(f"spaced {d}", re.split(rf"\s+{re.escape(d)}\s+", body))
    mixed = "".join(d for d in MIXED if d in body)
    for k in range(len(mixed)):
        for j in range(k + 1, len(mixed)):
            add(f"mixed {mixed[k]}{mixed[j]}", _split(body, mixed[k] + mixed[j], '"“«'))
    if len(mixed) > 2:
        add(f"mixed {mixed}", _split(body, mixed, '"“«'))
    if any(q in body for q in '"“«'):
        for d in present:
            add(f"plain {d}", body.split(d))
    add("whole", [body])
    return found or [("whole", [])]


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: list[tuple[str, int, int, str, list[str]]] = []
        for text, n in zip(pdf["raw"], pdf["n"]):
            all_of = parses(text)
            rows.extend((text, n, len(all_of), dialect, values) for dialect, values in all_of)
        yield pd.DataFrame(rows, columns=["raw", "n", "k", "dialect", "values"])


def _cheapest(amb: DataFrame, counts: DataFrame, total: float) -> DataFrame:
    """(raw, dialect, values) of the cheapest parse of every ambiguous string."""
    word = amb.select("sid", "dialect", F.posexplode("values").alias("p", "v")).withColumn("v", F.lower("v"))
    bits = (
        word.join(counts, "v", "left")
        .select(
            "sid",
            "dialect",
            (
                -F.log2(F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(1e-3)) / F.lit(total))
                + F.lit(CHAR_BITS) * F.length("v") / F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(1.0))
                + F.lit(VALUE_BITS)
            ).alias("b"),
        )
        .groupBy("sid", "dialect")
        .agg(F.sum("b").alias("b"))
    )
    kind = F.regexp_extract("dialect", r"^([a-z]+)", 1)
    price = F.element_at(F.create_map(*[F.lit(x) for kv in DIALECT_BITS.items() for x in kv]), kind)
    best = bits.groupBy("sid").agg(F.min_by("dialect", F.struct(F.round(F.col("b") + price, 6), "dialect")).alias("dialect"))
    return amb.join(best, ["sid", "dialect"], "left_semi")


def unpack(df: DataFrame, key: str, fields: Sequence[str], least: int = 1) -> DataFrame:
    """(key, field, pos, item): every value of the named string fields in reading order, pos from 0.

    Values keep case and inner blanks; notation, empty values and ``__extraction_failed__`` give
    nothing; repeated values stay. Only fields with at least ``least`` values give rows. Null,
    empty and blank fields and null keys give none. Equal strings are parsed once, wherever they are.
    """
    packs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("raw")) for f in fields])
    long = (
        df.select(F.col(f"`{key}`").alias(key), F.explode(packs).alias("x"))
        .select(key, "x.field", "x.raw")
        .where(F.col(key).isNotNull() & (F.length(F.trim("raw")) > 0))
    )
    texts = long.groupBy("raw").agg(F.count("*").alias("n"))
    cand = texts.mapInPandas(_candidates, "raw string, n bigint, k int, dialect string, values array<string>").where("size(values) > 0")
    cand = cut(cand.withColumn("sid", F.xxhash64("raw", F.lit(7))))
    seen = cand.select((F.col("n") / F.col("k")).alias("w"), F.explode("values").alias("v"))
    first = seen.groupBy(F.lower("v").alias("v")).agg(F.sum("w").alias("c"))
    sure, amb = cand.where("k = 1"), cand.where("k > 1")
    for _ in range(2):
        counts = cut(first)
        total = counts.agg(F.sum("c")).first()[0] or 1.0
        chosen = cut(sure.unionByName(_cheapest(amb, counts, float(total))))
        first = chosen.select(F.col("n").cast("double").alias("w"), F.explode("values").alias("v")).groupBy(F.lower("v").alias("v")).agg(F.sum("w").alias("c"))
    several = chosen.where(F.size("values") >= least)
    rows = lookup(long, several.select("raw", "values"), "raw", key, counts=several)
    return rows.select(key, "field", F.posexplode("values").alias("pos", "item")).withColumn("pos", F.col("pos").cast("bigint"))
