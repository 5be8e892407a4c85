"""Memory scopes behind one gateway: conversation, user_profile, timeline and research.

State lives in the tables of a Store; every call takes or gives DataFrames, so a batch of turns is one call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import memory as M
from strataloom.operators.index import Store, upsert

TURNS = "session_id string, id bigint, turn_time timestamp, question string, answer_summary string, topics array<string>, doc_ids array<string>, project string, research string, seq bigint"
SESSIONS = "research string, status string, tags array<string>, updated_at timestamp"
CLEARED = "scope string, seen timestamp"
NOTES = "research string, note string, created_at timestamp"


class Gateway:
    """``store(scope, key, rows)``, ``retrieve(scope, key)`` and ``clear(scope)``; unknown scopes and keys raise KeyError."""

    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.tables = spark, store
        self.get = {
            ("conversation", "turns"): self.turns,
            ("conversation", "sessions"): self.sessions,
            ("conversation", "current_topics"): lambda **_: M.session_topics(self.turns(), "session_id", "seq", "topics"),
            ("conversation", "active_project"): lambda **_: self.turns().where("project is not null").groupBy("session_id").agg(F.max_by("project", "seq").alias("project")),
            ("user_profile", "top_interests"): self.top_interests,
            ("user_profile", "profile_block"): lambda n=5: M.profile_block(self.top_interests(n)),
            ("timeline", "days"): lambda **_: self.days(),
            ("timeline", "recent"): lambda today, n=30: M.recent(self.days(), F.lit(today).cast("date"), n),
            ("timeline", "year"): lambda year: M.yearly_topics(self.days(), year),
            ("research", "sessions"): lambda status=None: self._read("research", SESSIONS) if status is None else self._read("research", SESSIONS).where(F.col("status") == status),
            ("research", "queries"): lambda **_: M.research_sessions(self.turns().where("research is not null"), "research", ["id"], "question", "doc_ids", "turn_time"),
            ("research", "notes"): lambda **_: self._read("notes", NOTES).orderBy("created_at"),
        }

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.tables.read(name) if self.tables.exists(name) else self.spark.createDataFrame([], schema)

    def turns(self, n: int | None = None) -> DataFrame:
        t = self._read("turns", TURNS)
        return M.last_turns(t, "session_id", n) if n else t

    def sessions(self) -> DataFrame:
        return self.turns().groupBy("session_id").agg(F.count("*").alias("turns"), F.min("turn_time").alias("created_at"), F.max("turn_time").alias("updated_at")).orderBy(F.desc("updated_at"))

    def _since_cleared(self, scope: str) -> DataFrame:
        """Turns that came after the scope was last cleared: interests and days are folds of turns, so clearing one leaves the others."""
        last = self._read("cleared", CLEARED).where(F.col("scope") == scope).agg(F.max("seen").alias("m")).first()["m"]
        return self.turns() if last is None else self.turns().where(F.col("turn_time") > F.lit(last))

    def top_interests(self, n: int = 10) -> DataFrame:
        seen = self._since_cleared("user_profile").select("turn_time", F.explode("topics").alias("topic"))
        return M.interests(seen, "topic", "turn_time").orderBy(F.desc("weight"), "topic").limit(n)

    def days(self) -> DataFrame:
        none = F.array().cast("array<string>")
        t = self._since_cleared("timeline").withColumns({"topics": F.coalesce("topics", none), "doc_ids": F.coalesce("doc_ids", none)})
        return M.timeline(t, "turn_time", ["id"], "topics", "doc_ids")

    def store(self, scope: str, key: str, rows: DataFrame) -> None:
        if (scope, key) == ("conversation", "turns"):
            names = [x.split()[0] for x in TURNS.split(", ")][:-1]
            kinds = dict(x.split(" ", 1) for x in TURNS.split(", "))
            full = rows.select(*[F.col(c).cast(kinds[c]) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names])
            old = self.turns()
            new = M.number_turns(full.join(old.select("id"), "id", "left_anti"), "session_id", ["turn_time", "id"], old)
            self.tables.replace("turns", old.unionByName(new.select(*old.columns)))
        elif (scope, key) == ("research", "sessions"):
            self.tables.replace("research", upsert(self._read("research", SESSIONS), rows, "research"))
        elif (scope, key) == ("research", "notes"):
            self.tables.replace("notes", self._read("notes", NOTES).unionByName(rows))
            # a note touches its session
            touched = rows.groupBy("research").agg(F.max("created_at").alias("__t"))
            old = self._read("research", SESSIONS)
            self.tables.replace("research", old.join(touched, "research", "left").withColumn("updated_at", F.greatest("updated_at", "__t")).select(*old.columns))
        else:
            raise KeyError(f"{scope}.{key}")

    def retrieve(self, scope: str, key: str, **options) -> DataFrame:
        if (scope, key) not in self.get:
            raise KeyError(f"{scope}.{key}")
        return self.get[scope, key](**options)

    def clear(self, scope: str, session: str | None = None) -> int:
        """Turns of a session, or all of a scope, removed; their number. Interests and days start anew, and turns stay."""
        if scope in ("user_profile", "timeline"):
            t = self._since_cleared(scope)
            seen = t.agg(F.max("turn_time").alias("m"), F.count("*").alias("n")).first()
            if seen["n"]:
                mark = self.spark.createDataFrame([(scope, seen["m"])], CLEARED)
                self.tables.replace("cleared", upsert(self._read("cleared", CLEARED), mark, "scope"))
            return seen["n"]
        if scope == "conversation":
            return self.tables.delete("turns", F.lit(True) if session is None else F.col("session_id") == session)
        if scope == "research":
            own = F.lit(True) if session is None else F.col("research") == session
            return self.tables.delete("research", own) + self.tables.delete("notes", own)
        raise KeyError(scope)

    def delete_note(self, research: str, note: str) -> int:
        return self.tables.delete("notes", (F.col("research") == research) & (F.col("note") == note))

    def delete_session(self, session: str) -> int:
        """A conversation and its turns; the number of these."""
        return self.clear("conversation", session)
