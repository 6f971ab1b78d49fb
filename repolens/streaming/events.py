"""Repository events: routing, changed files, micro-batches that maintain a collection, windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.collections import latest

#: Push events of either host; fields a host doesn't send stay null.
PUSH = "event_id string, kind string, ref string, after string, project string, at timestamp, commits array<struct<added:array<string>,modified:array<string>,removed:array<string>>>"


def route(kind: Column) -> Column:
    """Where an event goes: push, merge_request, issue, ping or ignored."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    return (
        F.when(k.isin("push", "push hook"), "push").when(k.isin("merge_request", "merge request hook", "pull_request"), "merge_request")
        .when(k.isin("issue", "issues", "issue hook"), "issue").when(k == "ping", "ping").otherwise("ignored")
    )


def changed_files(commits: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct changed (added or modified) and removed paths of all commits a key; null lists count as empty."""
    none = F.array().cast("array<string>")
    rows = commits.select(*keys, F.explode(F.concat(
        F.transform(F.concat(F.coalesce("added", none), F.coalesce("modified", none)), lambda p: F.struct(p.alias("file_path"), F.lit("changed").alias("change"))),
        F.transform(F.coalesce("removed", none), lambda p: F.struct(p.alias("file_path"), F.lit("removed").alias("change"))),
    )).alias("x"))
    return rows.select(*keys, "x.file_path", "x.change").filter("file_path IS NOT NULL").distinct()


def push_changes(events: DataFrame) -> DataFrame:
    """Push events -> (event_id, project, branch, sha, at, changed, removed); pushes without changes give no row. Works on streams too."""
    flat = lambda f: F.flatten(F.transform(F.coalesce("commits", F.array().cast("array<struct<added:array<string>,modified:array<string>,removed:array<string>>>")), f))
    none = F.array().cast("array<string>")
    changed = F.array_distinct(flat(lambda c: F.concat(F.coalesce(c["added"], none), F.coalesce(c["modified"], none))))
    removed = F.array_distinct(flat(lambda c: F.coalesce(c["removed"], none)))
    return events.select(
        "event_id", "project", F.regexp_replace("ref", "^refs/heads/", "").alias("branch"), F.col("after").alias("sha"), "at", changed.alias("changed"), removed.alias("removed")
    ).filter((F.size("changed") > 0) | (F.size("removed") > 0))


def last_change(changes: DataFrame) -> DataFrame:
    """One row a file: its last change in a batch. changes(project_id, file_path, change, at)."""
    return latest(changes, ["project_id", "file_path"], F.col("at"), F.col("change") == "changed")


def plan_batch(pushes: DataFrame) -> DataFrame:
    """(project_id, file_path, change, at) of supported files for a micro-batch of push_changes, the last event a file winning."""
    each = pushes.select(
        F.col("project").alias("project_id"), "at",
        F.explode(F.concat(
            F.transform("changed", lambda p: F.struct(p.alias("file_path"), F.lit("changed").alias("change"))),
            F.transform("removed", lambda p: F.struct(p.alias("file_path"), F.lit("removed").alias("change"))),
        )).alias("x"),
    ).select("project_id", "x.file_path", "x.change", "at")
    return last_change(each.filter(X.language("file_path").isNotNull()))


def maintain(pushes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Starts the stream that hands each micro-batch's plan to `apply`; the sink is idempotent, so a batch that runs again after a
    failure leaves the same state. Duplicated events are dropped within the watermark."""
    deduped = pushes.withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    writer = push_changes(deduped).writeStream.foreachBatch(lambda df, n: apply(plan_batch(df), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()


def tumbling(events: DataFrame, every: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Counts and sums an event type in tumbling windows; on a stream, state is dropped `late` behind the newest event."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions a user: events less than `gap` apart."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
        .select("user_id", F.col("s.start").alias("session_start"), "n")
    )


def answer_events(answers: DataFrame, words: int = 5) -> DataFrame:
    """(thread_id, seq, kind, text): an answer as a stream of events: thinking, chunks of `words` words, then its sources and metadata, if answers
    have these columns (JSON texts), an error instead of all that, if they have one that isn't null, and done."""
    w = F.split("answer", " ")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(w) / words).cast("int") - 1, F.lit(0))), lambda i: F.array_join(F.slice(w, i * words + 1, F.lit(words)), " "))
    item = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    more = [F.array(item(c, F.col(c))) for c in ("sources", "metadata") if c in answers.columns]
    told = F.concat(F.transform(chunks, lambda c: item("chunk", c)), *more)
    if "error" in answers.columns:
        told = F.when(F.col("error").isNotNull(), F.array(item("error", F.col("error")))).otherwise(told)
    events = F.concat(F.array(item("thinking", F.lit(""))), told, F.array(item("done", F.lit(""))))
    return answers.select("thread_id", F.posexplode(events).alias("seq", "e")).select("thread_id", "seq", "e.kind", "e.text")


# Least characters of a discussion's text, seconds regeneration waits, symbols it takes at most.
REGENERATE_AFTER, REGENERATE_MOST = 60, 50


def threads(events: DataFrame) -> DataFrame:
    """Merge-request and issue events(kind, project, number, title, text, state, author) -> threads for `chunking.discussion_chunks`; other
    kinds give none. The last event of a thread in a batch wins."""
    e = events.withColumn("_r", route(F.col("kind"))).filter(F.col("_r").isin("merge_request", "issue"))
    none = F.array().cast("array<struct<author:string,body:string>>")
    rows = e.select(
        F.col("project").alias("project_id"), F.when(F.col("_r") == "issue", "issue").otherwise("merge_request").alias("context_type"), F.col("number").alias("context_id"),
        "title", "state", "author", F.col("text").alias("body"), none.alias("comments"), "at",
    )
    return latest(rows, ["project_id", "context_type", "context_id"], F.col("at")).drop("at")


def regeneration(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project_id, due, name, file_path): the first 50 distinct symbols of a batch's changed files by name, due a minute after the last change of
    their project; documents are made anew then."""
    from pyspark.sql import Window as W

    changed = changes.filter("change = 'changed'")
    due = changed.groupBy("project_id").agg((F.max("at") + F.make_dt_interval(secs=F.lit(REGENERATE_AFTER))).alias("due"))
    hit = symbols.select("project_id", "file_path", "name").join(changed.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_semi").distinct()
    top = hit.withColumn("_n", F.row_number().over(W.partitionBy("project_id").orderBy("name", "file_path"))).filter(F.col("_n") <= REGENERATE_MOST).drop("_n")
    return top.join(due, "project_id").select("project_id", "due", "name", "file_path")


def refresh_due(last: DataFrame, now: Column) -> DataFrame:
    """last(project_id, at) -> projects whose static documents were last refreshed a day or more before now, or never."""
    return last.filter(F.col("at").isNull() | (F.col("at") <= now - F.make_dt_interval(days=F.lit(1)))).select("project_id")


def retried(apply: Callable[[DataFrame, int], None], dead_letter: Callable[[DataFrame, int, str], None] | None = None, times: int = 3, wait: float = 60.0):
    """A batch function that is tried again up to `times` times, waiting a multiple of `wait` seconds longer each time. A batch that still fails
    goes to the dead letters, if there are any, else the error ends the stream; its checkpoint then brings the batch again."""
    import time

    def run(df: DataFrame, n: int) -> None:
        for k in range(times + 1):
            try:
                return apply(df, n)
            except Exception as e:  # noqa: BLE001 - whatever a sink raises
                if k < times:
                    time.sleep(wait * (k + 1))
                elif dead_letter is None:
                    raise
                else:
                    dead_letter(df, n, str(e))

    return run
