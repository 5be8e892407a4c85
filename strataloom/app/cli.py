"""Command lines: ``python -m strataloom.app.cli repository PATH ID`` and ``… edges ID``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from strataloom.app.config import Config
from strataloom.app.engine import Engine
from strataloom.session import session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="task", required=True)
    repo = sub.add_parser("repository", help="index a folder of sources")
    repo.add_argument("path")
    repo.add_argument("repo_id")
    repo.add_argument("--branch", default="")
    edges = sub.add_parser("edges", help="count or list the edges of an indexed repository")
    edges.add_argument("repo_id")
    edges.add_argument("--format", choices=["summary", "json"], default="summary")
    docs = sub.add_parser("documents", help="index text and Markdown files")
    docs.add_argument("path")
    docs.add_argument("--workspace", default="")
    for q in (repo, edges, docs):
        q.add_argument("--store", default=Config.store)
        q.add_argument("--master", default=None)
    a = p.parse_args(args)
    engine = Engine(session("strataloom", a.master), Config(store=a.store))
    if a.task == "repository":
        print(json.dumps({"repo_id": a.repo_id, "status": "ok", **engine.add_repository(a.path, a.repo_id, a.branch)}))
    elif a.task == "documents":
        print(json.dumps(engine.add_documents(a.path, a.workspace)))
    else:
        df = engine.store.read(f"edges_{a.repo_id}")
        if a.format == "summary":
            df = df.groupBy("edge_type").agg(F.count("*").alias("n")).orderBy("edge_type")
        for row in df.toLocalIterator():
            print(json.dumps(row.asDict()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
