"""Memory of conversations: sequence numbers, interests, timelines, research sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decay of an interest and how many topics and questions a session keeps.
DECAY, SESSION_TOPICS, SESSION_QUESTIONS = 0.9, 10, 20


def number_turns(turns: DataFrame, session: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Turns with ``seq`` from 1 within their session, after the highest one that ``existing`` has."""
    w = Window.partitionBy(session).orderBy(*order)
    n = F.row_number().over(w)
    if existing is None:
        return turns.withColumn("seq", n.cast("bigint"))
    top = existing.groupBy(session).agg(F.max("seq").alias("__top"))
    return turns.join(top, session, "left").withColumn("seq", (n + F.coalesce("__top", F.lit(0))).cast("bigint")).drop("__top")


def last_turns(turns: DataFrame, session: str, n: int = 20) -> DataFrame:
    """The n latest turns of each session."""
    w = Window.partitionBy(session).orderBy(F.desc("seq"))
    return turns.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def merged_topics(new: Column, old: Column, most: int = SESSION_TOPICS) -> Column:
    """New topics before old ones, one of each lower-cased form, at most so many."""
    both = F.filter(F.concat(new, old), lambda t: F.length(F.trim(t)) > 0)
    first = F.filter(both, lambda t, i: F.array_position(F.transform(both, lambda x: F.lower(F.trim(x))), F.lower(F.trim(t))) == i + 1)
    return F.slice(first, 1, most)


def session_topics(turns: DataFrame, session: str, order: str, topics: str, most: int = SESSION_TOPICS) -> DataFrame:
    """(session, topics): the topics of each session after its last turn, latest first.

    A topic's place is that of its latest turn and within it the first position; only one row a topic is
    sorted per session.
    """
    t = turns.select(session, F.col(order).alias("o"), F.posexplode(F.col(topics)).alias("p", "t")).where(F.length(F.trim("t")) > 0)
    one = t.groupBy(session, F.lower(F.trim("t")).alias("k")).agg(F.max_by(F.struct("o", (-F.col("p")).alias("p"), "t"), F.struct("o", -F.col("p"))).alias("x"))
    w = Window.partitionBy(session).orderBy(F.desc("x.o"), F.desc("x.p"), "k")
    few = one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return few.groupBy(session).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", F.col("x.t").alias("t")))), lambda x: x["t"]).alias("topics"))


def interest_step(weight: Column) -> Column:
    return F.round(weight * DECAY + 1, 4)


def interests(seen: DataFrame, topic: str, time: str) -> DataFrame:
    """(topic, n, weight, first_seen, last_seen): the weight w -> round(0.9 w + 1, 4) folded over the occurrences.

    The fold depends only on their number and reaches its fixed point within 200 steps, so occurrences are
    counted, combined before the shuffle, and the fold runs over that count.
    """
    g = seen.groupBy(topic).agg(F.count("*").alias("n"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))
    weight = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(200)).cast("int")), F.lit(0.0), lambda w, _: interest_step(w))
    return g.select(topic, "n", weight.alias("weight"), "first_seen", "last_seen")


def timeline(turns: DataFrame, time: str, order: list[str], topics: str, docs: str) -> DataFrame:
    """(date, topics, doc_ids, n): each day's topics and documents in order of their first occurrence, and its turns."""
    day = turns.withColumn("date", F.to_date(time))

    def firsts(col: str) -> DataFrame:
        v = day.select("date", F.struct(*order).alias("o"), F.posexplode(F.col(col)).alias("p", "v")).where("v != ''")
        one = v.groupBy("date", "v").agg(F.min(F.struct("o", "p")).alias("f"))
        return one.groupBy("date").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "v"))), lambda x: x["v"]).alias(col))

    n = day.groupBy("date").agg(F.count("*").alias("n"))
    none = F.array().cast("array<string>")
    out = n.join(firsts(topics), "date", "left").join(firsts(docs), "date", "left")
    return out.select("date", F.coalesce(topics, none).alias("topics"), F.coalesce(docs, none).alias("doc_ids"), "n")


def recent(days: DataFrame, today: Column, n: int) -> DataFrame:
    """Days from n days before today to today, both included."""
    return days.where(F.col("date").between(F.date_sub(today, n), today))


def yearly_topics(days: DataFrame, year: int) -> DataFrame:
    """(topic, days): on how many days of the year each topic came up."""
    return days.where(F.year("date") == year).select("date", F.explode(F.array_distinct("topics")).alias("topic")).groupBy("topic").agg(F.countDistinct("date").alias("days"))


def research_sessions(queries: DataFrame, session: str, order: list[str], query: str, docs: str, time: str) -> DataFrame:
    """(session, queries, doc_ids, updated_at): all queries in order, documents each once."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, F.col(query).alias("__q"), F.col(docs).alias("__d"))))
    g = queries.groupBy(session).agg(ordered.alias("x"), F.max(time).alias("updated_at"))
    return g.select(session, F.transform("x", lambda r: r["__q"]).alias("queries"), F.array_distinct(F.flatten(F.transform("x", lambda r: r["__d"]))).alias("doc_ids"), "updated_at")


def profile_block(top: DataFrame) -> DataFrame:
    """One row: the interests, heaviest first, as a line of a prompt."""
    parts = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("topic"))))
    return top.agg(F.concat(F.lit("Interests: "), F.array_join(F.transform(parts, lambda x: x["topic"]), ", ")).alias("block"))


def timeline_block(days: DataFrame, most_days: int = 5, most_topics: int = 5) -> DataFrame:
    """One row: the last active days ``(date, topics, n)`` in order, a line each with their first topics and the number of questions; empty without any."""
    last = days.orderBy(F.desc("date")).limit(most_days)
    asked = F.concat(F.lit("("), F.col("n").cast("string"), F.when(F.col("n") == 1, " question)").otherwise(" questions)"))
    line = F.concat(F.lit("  "), F.col("date").cast("string"), F.lit(": "), F.array_join(F.slice("topics", 1, most_topics), ", "), F.lit(" "), asked)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("date", line.alias("l")))), lambda x: x["l"])
    return last.agg(F.when(F.count("*") > 0, F.array_join(F.concat(F.array(F.lit("Recent Activity:")), lines), "\n")).otherwise("").alias("block"))


def research_block(sessions: DataFrame, notes: DataFrame, most: int = 5) -> DataFrame:
    """(research, block): each session's status, its last queries and its last notes as lines of a prompt.

    ``sessions(research, status, queries)`` with queries in order, ``notes(research, note, created_at)``.
    """
    kept = notes.groupBy("research").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("created_at", "note")), asc=False), 1, most), lambda x: x["note"]).alias("notes"))
    tail = lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - most + 1), F.lit(most))
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(title), F.array_join(F.transform(c, lambda x: F.concat(F.lit("  - "), x)), "\n")))
    head = F.concat(F.lit("Research: "), F.col("research"), F.lit(" ("), F.col("status"), F.lit(")"))
    return sessions.join(kept, "research", "left").select("research", F.concat_ws("\n", head, part("Queries:\n", tail(F.col("queries"))), part("Notes:\n", F.col("notes"))).alias("block"))
