"""Python sources as tables: chunks by syntax, dependency edges, symbols and index texts."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as X

#: Bases that mean an interface.
INTERFACES = {"Protocol", "ABC", "ABCMeta"}
CHUNK = "chunk_id string, repo_id string, file_path string, language string, chunk_type string, name string, start_line bigint, end_line bigint, content string, docstring string, parent_name string, content_hash string"
EDGE = "edge_id string, src_id string, dst_id string, edge_type string, repo_id string, file_path string, line_no bigint"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _tree(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _scopes(tree: ast.Module) -> Iterator[tuple[ast.AST, list[str], list[str]]]:
    """Class and function definitions with the classes and functions around them, children first."""
    stack: list[tuple[ast.AST, list[str], list[str], bool]] = [(c, [], [], False) for c in reversed(list(ast.iter_child_nodes(tree)))]
    while stack:
        node, classes, functions, seen = stack.pop()
        if seen:
            yield node, classes, functions
            continue
        inner_c, inner_f = classes, functions
        if isinstance(node, ast.ClassDef):
            inner_c = [*classes, node.name]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            inner_f = [*functions, node.name]
        if inner_c is not classes or inner_f is not functions:
            stack.append((node, classes, functions, True))
        stack.extend((c, inner_c, inner_f, False) for c in reversed(list(ast.iter_child_nodes(node))))


def chunks_of(source: str, path: str, repo: str) -> list[tuple]:
    """The module, then its classes, functions and methods; nothing of a source with a syntax error."""
    tree = _tree(source)
    if tree is None:
        return []
    lines = source.splitlines(keepends=True)

    def row(kind: str, name: str, first: int, last: int, content: str, doc: str | None, parent: str | None) -> tuple:
        return (f"{repo}::{path}::{kind}::{name}", repo, path, "python", kind, name, first, last, content, doc, parent, _sha(content))

    rows = [row("module", "<module>", 1, source.count("\n") + 1, source, ast.get_docstring(tree, clean=False), None)]
    for node, classes, functions in _scopes(tree):
        names = [*classes, *functions, node.name]
        if isinstance(node, ast.ClassDef):
            kind, names = "class", [*classes, node.name]
        else:
            kind = "method" if classes and not functions else "function"
        parent = ".".join(names[:-1]) or None
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        content = "".join(lines[first - 1 : node.end_lineno])
        rows.append(row(kind, ".".join(names), first, node.end_lineno, content, ast.get_docstring(node, clean=False), parent))
    return rows


def _dotted(node: ast.AST) -> str:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, node.id])) if isinstance(node, ast.Name) else ""


def edges_of(source: str, path: str, repo: str) -> list[tuple]:
    """Imports, bases of classes and calls of imported names, each edge once with its first line.

    Relative and star imports are left out. A name resolves through the imports that come before it.
    """
    tree = _tree(source)
    if tree is None:
        return []
    module = f"{repo}::{path}::module::<module>"
    known: dict[str, str] = {}
    found: dict[str, tuple] = {}

    def add(src: str, target: str, kind: str, line: int) -> None:
        dst = f"import::{target}"
        key = _sha(f"{src}|{kind}|{dst}|{path}")
        found.setdefault(key, (key, src, dst, kind, repo, path, line))

    def resolve(name: str) -> str:
        root, dot, rest = name.partition(".")
        return known.get(root, root) + dot + rest

    def visit(node: ast.AST, classes: tuple[str, ...]) -> None:
        if isinstance(node, ast.Import):
            for a in node.names:
                known[a.asname or a.name.split(".")[0]] = a.name
                add(module, a.name, "IMPORTS", node.lineno)
        elif isinstance(node, ast.ImportFrom) and not node.level:
            for a in node.names:
                if a.name != "*":
                    full = f"{node.module}.{a.name}" if node.module else a.name
                    known[a.asname or a.name] = full
                    add(module, full, "IMPORTS", node.lineno)
        elif isinstance(node, ast.Call) and (name := _dotted(node.func)) and name.split(".")[0] in known:
            add(module, resolve(name), "CALLS", node.lineno)
        inner = (*classes, node.name) if isinstance(node, ast.ClassDef) else classes
        for child in ast.iter_child_nodes(node):
            visit(child, inner)
        if isinstance(node, ast.ClassDef):
            for base in node.bases:
                if name := _dotted(base):
                    kind = "IMPLEMENTS" if name.split(".")[-1] in INTERFACES else "EXTENDS"
                    add(f"{repo}::{path}::class::{'.'.join(inner)}", resolve(name), kind, node.lineno)

    try:
        visit(tree, ())
    except RecursionError:
        return []
    return list(found.values())


def _rows(df: DataFrame, repo: str, path: str, source: str, parse, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for s, p, g in zip(pdf["s"], pdf["p"], pdf["r"]) for r in parse(s or "", p, g)]
            yield pd.DataFrame(rows, columns=names)

    some = df.where(F.col(source).isNotNull()).select(F.col(repo).cast("string").alias("r"), F.col(path).cast("string").alias("p"), F.col(source).alias("s"))
    return some.mapInPandas(run, schema)


def chunks(df: DataFrame, repo: str = "repo_id", path: str = "file_path", source: str = "source") -> DataFrame:
    """The syntax chunks of every source, a narrow pass."""
    return _rows(df, repo, path, source, chunks_of, CHUNK)


def edges(df: DataFrame, repo: str = "repo_id", path: str = "file_path", source: str = "source") -> DataFrame:
    return _rows(df, repo, path, source, edges_of, EDGE)


def symbols(code: DataFrame) -> DataFrame:
    """(symbol_id, symbol_name, symbol_type, repo_id, file_path, start_line, end_line, parent_symbol, visibility), without modules.

    A parent is a symbol of the same file that has the parent's name and starts before.
    """
    s = code.where("chunk_type != 'module'").withColumn("symbol_id", X.composite_id(F.col("repo_id"), F.col("file_path"), F.col("chunk_type"), F.col("name")))
    p = s.select("repo_id", "file_path", F.col("name").alias("parent_name"), F.col("symbol_id").alias("pid"), F.col("start_line").alias("pl"))
    j = s.join(p, ["repo_id", "file_path", "parent_name"], "left")
    ok = F.col("pl") <= F.col("start_line")
    return j.groupBy("symbol_id", F.col("name").alias("symbol_name"), F.col("chunk_type").alias("symbol_type"), "repo_id", "file_path", "start_line", "end_line").agg(
        F.coalesce(F.min_by("pid", F.when(ok, F.struct("pl", "pid"))), F.lit("")).alias("parent_symbol"), X.visibility(F.first("name")).alias("visibility")
    )


def symbol_texts(symbols_: DataFrame, code: DataFrame) -> DataFrame:
    """(symbol_id, text): kind and name of every symbol and, where its chunk has one, the docstring; of several chunks of a name in a file the last one's."""
    docs = code.groupBy("repo_id", "file_path", F.col("name").alias("symbol_name")).agg(F.max_by("docstring", "start_line").alias("doc"))
    j = symbols_.join(docs, ["repo_id", "file_path", "symbol_name"], "left")
    return j.select("symbol_id", F.concat_ws("\n", F.concat_ws(" ", "symbol_type", "symbol_name"), F.nullif(F.trim("doc"), F.lit(""))).alias("text"))


def file_texts(code: DataFrame) -> DataFrame:
    """(repo_id, file_path, text): a row a file, its symbols in order of their lines."""
    label = F.concat_ws(" ", "chunk_type", "name")
    rows = code.where("chunk_type != 'module'").groupBy("repo_id", "file_path").agg(F.sort_array(F.collect_list(F.struct("start_line", label.alias("l")))).alias("x"))
    return rows.select("repo_id", "file_path", F.concat_ws("\n", F.concat(F.lit("File: "), F.col("file_path")), F.array_join(F.transform("x", lambda s: s["l"]), "\n")).alias("text"))


def manifest_hash(files: DataFrame) -> DataFrame:
    """(repo_id, content_hash, n_files): SHA-256 of the file hashes in order of their paths."""
    x = F.sort_array(F.collect_list(F.struct("file_path", F.coalesce("content_hash", F.lit("")).alias("h"))))
    return files.groupBy("repo_id").agg(F.sha2(F.array_join(F.transform(x, lambda s: s["h"]), ""), 256).alias("content_hash"), F.count("*").alias("n_files"))


def languages(files: DataFrame, path: str = "file_path") -> DataFrame:
    """(repo_id, language, n, rank): source files of each language, most first."""
    from strataloom.operators.filters import source_files

    g = files.where(source_files(F.col(path))).groupBy("repo_id", X.path_language(F.col(path)).alias("language")).agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n"), "language")).cast("bigint"))


def parse_stats(sources: DataFrame, found: DataFrame, links: DataFrame) -> DataFrame:
    """(repo_id, files, parsed, failed, chunks, edges): what parsing the sources of each repository gave."""
    n = sources.groupBy("repo_id").agg(F.count("source").alias("files"))
    c = found.groupBy("repo_id").agg(F.countDistinct("file_path").alias("parsed"), F.count("*").alias("chunks"))
    e = links.groupBy("repo_id").agg(F.count("*").alias("edges"))
    j = n.join(c, "repo_id", "left").join(e, "repo_id", "left").na.fill(0)
    return j.select("repo_id", "files", "parsed", (F.col("files") - F.col("parsed")).alias("failed"), "chunks", "edges")
