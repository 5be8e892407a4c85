"""Links between documents, topics and what models extract."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.operators import knn


def link_chunks(chunks: DataFrame, key: str, doc: str, vector: str, queries: DataFrame | None = None, k: int = 5, least: float = 0.75) -> DataFrame:
    """(key, neighbour, score, rank): the k most similar chunks of other documents, by cosine, at ``least`` or more.

    ``queries`` are the chunks to link, all by default; each block of them is set against every row.
    """
    asked = (chunks if queries is None else queries).select(F.col(key).alias("query_id"), F.col(vector).alias("vector"), doc)
    found = knn.search(chunks, asked, key, vector, k, metric="cosine", least=least, group=doc)
    return found.select(F.col("query_id").alias(key), F.col(key).alias("neighbour"), "score", "rank")


def link_docs(chunks: DataFrame, doc: str, vector: str, k: int = 5, least: float = 0.70) -> DataFrame:
    """(doc, neighbour, score, rank): the same for the mean vectors of documents."""
    c = knn.centroids(chunks, doc, vector)
    found = knn.search(c, c.select(F.col(doc).alias("query_id"), F.col("centroid").alias("vector"), doc), doc, "centroid", k, metric="cosine", least=least, group=doc)
    return found.select(F.col("query_id").alias(doc), F.col(doc).alias("neighbour"), "score", "rank")


def related(links: DataFrame, chunks: DataFrame, key: str, text: str, most: int = 200) -> DataFrame:
    """Links with the text of the linked chunk, cut to ``most`` characters; links to missing chunks disappear."""
    t = chunks.select(F.col(key).alias("neighbour"), F.substring(F.coalesce(text, F.lit("")), 1, most).alias("text"))
    return links.join(t, "neighbour").select(key, "neighbour", "score", "rank", "text")


def first_links(chunks: DataFrame, doc: str, order: list[str], ids: str, scores: str | None = None) -> DataFrame:
    """(doc, place, linked, score): the links stored as lists in the first chunk of each document, in their order from 0.

    A score that is missing or no number is null; a document whose first chunk has no links has no row.
    """
    some = [F.col(ids).alias("i"), *([F.col(scores).alias("s")] if scores else [F.lit("").alias("s")])]
    first = chunks.where(F.col(doc).isNotNull()).groupBy(doc).agg(F.min_by(F.struct(*some), F.struct(*order)).alias("x"))
    rows = first.select(doc, F.split(X.text_of(F.col("x.s")), ",").alias("s"), F.posexplode(X.list_of(F.col("x.i"))).alias("p", "linked"))
    return rows.select(doc, F.col("p").cast("bigint").alias("place"), "linked", F.expr("try_cast(trim(try_element_at(s, p + 1)) as double)").alias("score"))


def topics(df: DataFrame, key: str, vector: str, n: int = 8, seed: int = 42) -> DataFrame:
    """(key, topic, centroid): k-means with at most as many clusters as rows."""
    rows = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    count = rows.count()
    if count == 0:
        return rows.select(key, F.lit(0).alias("topic"), F.array().cast("array<double>").alias("centroid"))
    model = KMeans(k=max(1, min(n, count)), seed=seed, maxIter=20).fit(rows)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    return model.transform(rows).select(key, F.col("prediction").alias("topic")).withColumn("centroid", F.element_at(centres, F.col("topic") + 1))


def topic_label(label: Column, cluster: Column) -> Column:
    """The slug of a model's label; without one, ``topic_cluster_`` and the cluster's number."""
    return F.when(F.length(F.trim(X.text_of(label))) > 0, X.slug(label)).otherwise(F.concat(F.lit("topic_cluster_"), cluster.cast("string")))


Generator = Callable[[pd.Series], pd.Series]


def generate(df: DataFrame, key: str, text: str, model: Generator, out: str = "answer", most: int | None = None) -> DataFrame:
    """(key, out): what a model says to each text, Arrow batches at a time; a failing batch gives nulls."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                said = model(pdf["t"])
            except Exception:  # noqa: BLE001  a model's failure must not end the job
                said = pd.Series([None] * len(pdf), dtype=object)
            yield pd.DataFrame({key: pdf["k"], out: said.to_numpy()})

    t = X.text_of(F.col(text))
    return df.select(F.col(key).alias("k"), (F.substring(t, 1, most) if most else t).alias("t")).mapInPandas(run, f"{key} {kind}, {out} string")


ARTIFACT = "summary string, keywords array<string>, questions array<string>, entities array<string>, importance string"


def extracted(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """The five fields of an extraction answer as ka_ columns; an answer that can't be read gives empty strings."""
    got = F.from_json(X.unfence(F.col(answer)), ARTIFACT)
    flat = lambda f: F.coalesce(F.array_join(got[f], ","), F.lit(""))
    return answers.withColumns(
        {
            "ka_summary": F.coalesce(got["summary"], F.lit("")),
            "ka_keywords": flat("keywords"),
            "ka_questions": flat("questions"),
            "ka_entities": flat("entities"),
            "ka_importance": F.coalesce(got["importance"], F.lit("")),
        }
    ).drop(answer)


def is_enriched() -> Column:
    return (F.coalesce("ka_summary", F.lit("")) != "") | (F.coalesce("ka_keywords", F.lit("")) != "")


def enrich_stored(chunks: DataFrame, key: str, answers: DataFrame, answer: str = "answer", overwrite: bool = False) -> DataFrame:
    """``chunks`` with the ka_ fields of their answers written in, and ``status``: enriched, skipped or failed.

    A chunk that has a summary or keywords is skipped unless ``overwrite``; an answer without a summary, or none at all, has failed and changes nothing.
    """
    fields = ["ka_summary", "ka_keywords", "ka_questions", "ka_entities", "ka_importance"]
    have = chunks.withColumns({f: F.lit("") for f in fields if f not in chunks.columns})
    new = extracted(answers.select(key, F.col(answer).alias("answer"))).select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    j = have.join(new, key, "left")
    status = F.when(F.lit(not overwrite) & is_enriched(), "skipped").when(F.coalesce("__ka_summary", F.lit("")) == "", "failed").otherwise("enriched")
    j = j.withColumn("status", status)
    return j.withColumns({f: F.when(F.col("status") == "enriched", F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}).drop(*[f"__{f}" for f in fields])


def assign_topics(chunks: DataFrame, key: str, assigned: DataFrame, labels: DataFrame, column: str = "topics") -> DataFrame:
    """``chunks`` with the slug of their cluster's label in ``column``; one without a cluster keeps what it had.

    ``assigned(key, topic)``, ``labels(topic, label)``; a cluster without a label is named by its number.
    """
    named = assigned.select(key, "topic").join(F.broadcast(labels.select("topic", "label")), "topic", "left").select(key, topic_label(F.col("label"), F.col("topic")).alias("__t"))  # a row a cluster
    return chunks.join(named, key, "left").withColumn(column, F.coalesce("__t", F.col(column))).drop("__t")


def qa_pairs(answers: DataFrame, key: str, answer: str = "answer", n: int = 5) -> DataFrame:
    """(key, pos, question, answer): pairs of a JSON list with both fields filled, at most n a text."""
    got = F.from_json(X.unfence(F.col(answer)), "array<struct<question:string,answer:string>>")
    full = F.filter(got, lambda p: (F.length(F.trim(F.coalesce(p["question"], F.lit("")))) > 0) & (F.length(F.trim(F.coalesce(p["answer"], F.lit("")))) > 0))
    rows = answers.select(key, F.posexplode(F.slice(full, 1, n)).alias("pos", "x"))
    return rows.select(key, F.col("pos").cast("bigint").alias("pos"), F.trim("x.question").alias("question"), F.trim("x.answer").alias("answer"))
