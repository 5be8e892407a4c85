"""Prompts as Column expressions, for a whole table of texts at once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _prompt(task: str, **parts: Column) -> Column:
    sections = [x for name, col in parts.items() for x in (F.lit(f"\n\n{name.capitalize()}:\n"), F.coalesce(col, F.lit("")))]
    return F.concat(F.lit(task), *sections)


def answer(question: Column, context: Column) -> Column:
    return _prompt("Answer the question from the context alone; cite the tags in brackets; say so where the context has no answer.", context=context, question=question)


def expand(question: Column, n: int = 3) -> Column:
    return _prompt(f"Write {n} other ways to ask this, as a JSON list of strings.", question=question)


def rerank(question: Column, passages: Column) -> Column:
    return _prompt("Rate how well each passage answers the question, 0 to 10, as a JSON list of numbers in their order.", question=question, passages=passages)


def extract(text: Column) -> Column:
    return _prompt("Give a JSON object with summary, keywords, questions, entities and importance (low, medium, high) of the text.", text=text)


def pairs(text: Column, n: int = 5) -> Column:
    return _prompt(f"Write {n} questions that the text answers, as a JSON list of objects with question and answer.", text=text)


def label(texts: Column) -> Column:
    return _prompt("Name the topic that these texts share in a few words.", texts=texts)


def topics(question: Column, reply: Column) -> Column:
    return _prompt("List up to 5 topics of this exchange as a JSON list of strings.", question=question, reply=reply)


def summarize_diff(diff: Column) -> Column:
    return _prompt("Say in one line what this change does.", diff=F.substring(diff, 1, 3000))
