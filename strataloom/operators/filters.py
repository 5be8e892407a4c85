"""Predicates: where-dictionaries and search filters compiled to Columns, so that they reach the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions import text as X


def _one(field: Column, op: str, value: Any) -> Column:
    as_text = F.coalesce(field.cast("string"), F.lit(""))
    if op == "$in":
        return as_text.isin([str(v) for v in value])
    tests = {
        "$eq": lambda v: as_text == v,
        "$ne": lambda v: as_text != v,
        "$contains": as_text.contains,
        "$gte": lambda v: as_text >= v,
        "$lte": lambda v: as_text <= v,
        "$gt": lambda v: as_text > v,
        "$lt": lambda v: as_text < v,
    }
    return tests[op](str(value)) if op in tests else F.lit(True)


def where(condition: Mapping[str, Any] | None, columns: Mapping[str, Column] | None = None) -> Column:
    """A where-dictionary as a predicate over string forms; a missing value is the empty string.

    ``$and`` and ``$or`` combine; a plain value means equality; unknown operators match, and so does
    an empty dictionary. ``columns`` gives the column of a name, by default the one of that name.
    """
    if not condition:
        return F.lit(True)
    parts: list[Column] = []
    for name, test in condition.items():
        if name in ("$and", "$or"):
            inner = [where(c, columns) for c in test]
            parts.append(reduce(lambda a, b: a & b if name == "$and" else a | b, inner, inner.pop(0)) if inner else F.lit(True))  # noqa: B023
            continue
        col = (columns or {}).get(name, F.col(f"`{name}`") if columns is None else F.lit(""))
        parts.extend(_one(col, op, v) for op, v in (test if isinstance(test, Mapping) else {"$eq": test}).items())
    return reduce(lambda a, b: a & b, parts)


def pad_date(value: str, end: bool = False) -> str:
    """A bare date as the first or last second of that day, UTC; times stay as they are."""
    value = value.strip()
    return value if "T" in value else value + ("T23:59:59+00:00" if end else "T00:00:00+00:00")


@dataclass(frozen=True)
class SearchFilter:
    """Up to six dimensions that must all hold; unset ones don't restrict."""

    source_id: str | None = None
    workspace: str | None = None
    document_type: str | None = None
    tag: str | None = None
    created_after: str | None = None
    created_before: str | None = None

    def is_empty(self) -> bool:
        return not any(asdict(self).values())

    def to_where(self) -> dict[str, Any] | None:
        spec = [
            (self.source_id, "doc_id", "$eq", self.source_id),
            (self.workspace, "workspace", "$eq", self.workspace),
            (self.document_type, "document_type", "$eq", self.document_type),
            (self.tag, "tags", "$contains", self.tag),
            (self.created_after, "created_time", "$gte", pad_date(self.created_after or "")),
            (self.created_before, "created_time", "$lte", pad_date(self.created_before or "", end=True)),
        ]
        found = [{name: {op: value}} for given, name, op, value in spec if given]
        return None if not found else found[0] if len(found) == 1 else {"$and": found}

    def summary(self) -> str:
        short = {"source_id": "source", "document_type": "type", "created_after": "after", "created_before": "before"}
        return "  ·  ".join(f"{short.get(k, k)}={v}" for k, v in asdict(self).items() if v) or "off"


def effective(search_filter: SearchFilter | None, doc_id: str | None) -> dict[str, Any] | None:
    """A filled search filter goes before a document id; without either, no restriction."""
    if search_filter is not None and not search_filter.is_empty():
        return search_filter.to_where()
    return {"doc_id": {"$eq": doc_id}} if doc_id else None


def repo_filter(repo_ids: Sequence[str]) -> dict[str, Any]:
    return {"repo_id": {"$eq": repo_ids[0]}} if len(repo_ids) == 1 else {"repo_id": {"$in": list(repo_ids)}}


def normalize_ids(ids: Sequence[Any]) -> list[str]:
    """Trimmed, filled ids in order, each once."""
    return list(dict.fromkeys(s for i in ids if i is not None and (s := str(i).strip())))


def merge_filters(base: Mapping[str, Any] | None, extra: Mapping[str, Any] | None) -> dict[str, Any] | None:
    """Both filters, flat where either is already a conjunction."""
    parts = [p for f in (base, extra) if f for p in (f["$and"] if set(f) == {"$and"} else [dict(f)])]
    return None if not parts else parts[0] if len(parts) == 1 else {"$and": parts}


def has_value(csv: Column, value: str) -> Column:
    return F.array_contains(X.list_of(csv), value)


def knowledge_facets(text: str = "", **facets: str) -> Column:
    """Conjunction of facets of the chunk browser: list fields hold the value, others equal it, text is in one of five."""
    lists = {"tags", "topics", "ka_keywords"}
    parts = [has_value(F.col(k), v) if k in lists else F.coalesce(F.col(k), F.lit("")) == v for k, v in facets.items() if v]
    if text:
        fields = ("content", "page_title", "tags", "topics", "ka_keywords")
        parts.append(reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower()) for c in fields]))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def in_scope(scope: str, source_type: Column) -> Column:
    """Rows of ``all``, ``document`` or ``code``."""
    code = F.coalesce(source_type == "code", F.lit(False))
    return {"all": F.lit(True), "code": code, "document": ~code}[scope]


def source_files(df_path: Column) -> Column:
    """Files of a known language that are neither tests nor generated."""
    return (X.path_language(df_path) != "") & ~X.is_test_path(df_path) & ~X.is_generated_path(df_path)
