"""Task dependencies and the session-event journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.cycles import reachable_pairs
from loomgraph.operators.tables import filtered
from loomgraph.session import cut_lineage

EVENT_TYPES = ["signal", "task_complete", "decision", "blocked", "handoff", "info"]


def blockers(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Per task with known blockers: how many, and whether all are done."""
    b = tasks.select(F.col("id").alias("blocked_by"), (F.col("status") == "done").alias("done"))
    return deps.join(b, "blocked_by").groupBy(F.col("task_id").alias("id")).agg(
        F.count("*").alias("n_blockers"), F.min("done").alias("all_done"))


def ready_status(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    return tasks.select("id").join(blockers(tasks, deps), "id", "left").select(
        "id", F.coalesce("n_blockers", F.lit(0).cast("bigint")).alias("n_blockers"),
        F.when(F.coalesce("all_done", F.lit(True)), "ready").otherwise("backlog").alias("resolved"))


def complete(tasks: DataFrame, deps: DataFrame, done: DataFrame) -> DataFrame:
    """Status changes after the tasks of ``done`` (id) finish: they, and the backlog they free."""
    closed = done.select("id", F.lit(True).alias("closing"))
    after = tasks.join(closed, "id", "left").withColumn(
        "status", F.when(F.coalesce("closing", F.lit(False)), "done").otherwise(F.col("status"))).drop("closing")
    waiting = deps.join(done.select(F.col("id").alias("blocked_by")), "blocked_by", "left_semi").select(
        F.col("task_id").alias("id")).distinct()
    freed = (after.where("status = 'backlog'").join(waiting, "id", "left_semi").select("id")
             .join(blockers(after, deps).where("all_done"), "id", "left_semi").select("id", F.lit("ready").alias("new_status")))
    return done.select("id", F.lit("done").alias("new_status")).unionAll(freed)


def dependents(deps: DataFrame, start: DataFrame, hops_per_round: int = 4) -> DataFrame:
    """Every task that waits, directly or not, for a start task (root, id), by breadth-first joins.

    A round walks a few hops before it is written and compared with what is
    known, so a deep chain costs a quarter of the rounds. It ends when a round finds nothing new.
    """
    seen = cut_lineage(start.select("root", "id"))
    frontier = seen
    while True:
        hop, found = frontier, None
        for i in range(hops_per_round):
            hop = hop.join(deps, hop["id"] == deps["blocked_by"]).select("root", F.col("task_id").alias("id"))
            hop = hop.distinct() if i == 1 else hop  # parallel ways are folded halfway and at the end
            found = hop if found is None else found.unionAll(hop)
        frontier = cut_lineage(found.distinct().join(seen, ["root", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def cycle_edges(deps: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed dependencies (task_id, blocked_by) that would close a cycle: the blocker already waits for the task."""
    waits = deps.select(F.col("blocked_by").alias("u"), F.col("task_id").alias("v"))
    closed = reachable_pairs(waits, proposed.select(F.col("task_id").alias("x"), F.col("blocked_by").alias("y")))
    return proposed.join(closed.select(F.col("x").alias("task_id"), F.col("y").alias("blocked_by")), ["task_id", "blocked_by"], "left_semi")


def query_tasks(tasks: DataFrame, deps: DataFrame, limit: int | None = 10, status: str = "", **equal) -> DataFrame:
    """Open tasks in order of priority and age, one row per blocker (null where there is none)."""
    rows = filtered(tasks, status=status or ["ready", "in_progress"], **equal)
    if limit:
        rows = rows.orderBy("priority", "created_at", "id").limit(limit)
    return rows.join(deps.withColumnRenamed("task_id", "id"), "id", "left").select(
        "id", "title", "project", "status", "priority", "blocked_by")


def next_lines(tasks: DataFrame, project: str = "", limit: int = 10) -> DataFrame:
    """Ready tasks as list lines in order of priority and age."""
    rows = filtered(tasks, status="ready", project=project).orderBy("priority", "created_at", "id").limit(limit)
    return rows.select("id", F.concat(F.lit("- [P"), F.col("priority").cast("string"), F.lit("] "), F.col("title"),
                                      F.lit(" ("), F.col("project"), F.lit(")")).alias("line"))


# --- events ----------------------------------------------------------------

def checked_events(events: DataFrame) -> DataFrame:
    """Every event with whether its type is one of the known ones; an unknown one is refused with the list of those."""
    ok = F.coalesce(F.col("event_type").isin(EVENT_TYPES), F.lit(False))
    refusal = F.concat(F.lit("unknown event type, expected: "), F.lit(", ".join(EVENT_TYPES)))
    return events.select("event_id", "event_type", ok.alias("accepted"), F.when(~ok, refusal).alias("error"))


def first_arrivals(events: DataFrame) -> DataFrame:
    """One row per event id; a repeated message changes nothing."""
    return events.dropDuplicates(["event_id"])


def poll(events: DataFrame, own_session: str, since: str = "", target: str = "", event_type: str = "", limit: int = 50) -> DataFrame:
    """Active events of other sessions, newest first."""
    rows = filtered(events, since=since, status="ACTIVE", event_type=event_type).where(F.col("session_id") != own_session)
    if target:
        rows = rows.where(F.col("target").isin(target, "all", ""))
    return rows.orderBy(F.desc("created_at"), "event_id").limit(limit)


def latest_state(changes: DataFrame) -> DataFrame:
    """Current status per event from a log of status rows (event_id, status, created_at)."""
    rank = F.when(F.col("status") == "RESOLVED", 1).otherwise(0)
    return changes.groupBy("event_id").agg(F.max_by("status", F.struct(rank, F.col("created_at"))).alias("status"))


def completion_event_id(session: Column, task: Column) -> Column:
    key = F.concat_ws(":", session, F.lit("task_complete"), task)
    return F.substring(F.sha2(key, 256), 1, 16)
