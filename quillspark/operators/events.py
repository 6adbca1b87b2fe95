"""Ordered events and ledgers: order checks, the run state machine, streaks, due dates, imports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

STATES = ("intake", "clarifying", "awaiting_product_confirmation", "ready_to_build", "candidate_built", "evaluation_failed", "local_delivered")
# State, intent, next state and status.
TRANSITIONS = (
    ("intake", "clarify", "clarifying", "active"),
    ("intake", "propose", "awaiting_product_confirmation", "active"),
    ("clarifying", "answer", "clarifying", "active"),
    ("clarifying", "propose", "awaiting_product_confirmation", "active"),
    ("awaiting_product_confirmation", "confirm", "ready_to_build", "active"),
    ("awaiting_product_confirmation", "revise", "clarifying", "active"),
    ("ready_to_build", "build", "candidate_built", "active"),
    ("candidate_built", "approve", "candidate_built", "visual_approved"),
    ("candidate_built", "revise", "ready_to_build", "renderer_revision_required"),
    ("candidate_built", "evaluate_pass", "local_delivered", "delivered"),
    ("candidate_built", "evaluate_fail", "evaluation_failed", "active"),
    ("evaluation_failed", "build", "candidate_built", "active"),
)
HISTORY = 100


def order_errors(events: DataFrame, run: str = "run_id", event: str = "event_id", turn: str = "turn_index", text: str = "raw_text") -> DataFrame:
    """``run, event, code``: repeated ids, turns that don't ascend, empty texts, and hashes that aren't the text's."""
    before = F.max(turn).over(W.partitionBy(run).orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    seen = events.withColumn("_before", before)
    twice = events.groupBy(run, event).count().where("count > 1").select(run, event, F.lit("event_id_duplicate").alias("code"))
    order = seen.where(F.col(turn) <= F.col("_before")).select(run, event, F.lit("turn_index_not_increasing"))
    empty = events.where(F.trim(T.text(text)) == "").select(run, event, F.lit("raw_text_empty"))
    out = twice.union(order).union(empty)
    if "raw_text_sha256" in events.columns:
        out = out.union(events.where(F.col("raw_text_sha256").isNotNull() & (F.sha2(F.trim(T.text(text)), 256) != F.col("raw_text_sha256"))).select(run, event, F.lit("raw_text_hash_mismatch")))
    return out


def fold(intents: Iterable[str], state: str = "intake", status: str = "active") -> tuple[str, str, int, int, list[str]]:
    """State, status, moves, refusals and the last states after a run's intents; an intent a state doesn't know is refused."""
    table = {(s, i): (n, t) for s, i, n, t in TRANSITIONS}
    moves = refused = 0
    history: list[str] = []
    for i in intents:
        to = table.get((state, i))
        if to is None:
            refused += 1
            continue
        state, status = to
        moves += 1
        history.append(state)
    return state, status, moves, refused, history[-HISTORY:]


#: Intents of a run that are folded at once.
CHUNK = 1000


def run_states_native(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``run_id, state, status, moves, refused``: final state of each run from events (run_id, pos, intent), in order.

    A run is cut into chunks of ``chunk`` events. Each chunk is folded once for every state that it may begin in, so
    chunks don't wait for each other and no array holds a whole run; then each run folds over its chunks.
    """
    table = F.create_map(*[F.lit(x) for s, i, n, t in TRANSITIONS for x in (f"{s}|{i}", f"{n}|{t}")])
    nth = F.row_number().over(W.partitionBy("run_id").orderBy("pos")) - 1
    parts = events.select("run_id", "pos", "intent", F.floor(nth / chunk).alias("chunk")).groupBy("run_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "intent"))), lambda x: x["intent"]).alias("i"))

    def after(start: str) -> Column:
        zero = F.struct(F.lit(start).alias("state"), F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("moves"), F.lit(0).cast("long").alias("refused"))

        def step(a: Column, i: Column) -> Column:
            to = F.element_at(table, F.concat_ws("|", a["state"], i))
            ok = to.isNotNull()
            return F.struct(F.when(ok, F.substring_index(to, "|", 1)).otherwise(a["state"]).alias("state"), F.when(ok, F.substring_index(to, "|", -1)).otherwise(a["status"]).alias("status"), (a["moves"] + ok.cast("long")).alias("moves"), (a["refused"] + (~ok).cast("long")).alias("refused"))

        return F.aggregate("i", zero, step)

    folded = parts.select("run_id", "chunk", F.create_map(*[x for s in STATES for x in (F.lit(s), after(s))]).alias("to"))
    ordered = folded.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.map_entries("to").alias("to")))), lambda x: x["to"]).alias("c"))
    zero = F.struct(F.lit("intake").alias("state"), F.lit("active").alias("status"), F.lit(0).cast("long").alias("moves"), F.lit(0).cast("long").alias("refused"))

    def join(a: Column, c: Column) -> Column:
        to = F.element_at(F.map_from_entries(c), a["state"])
        return F.struct(to["state"].alias("state"), F.coalesce(to["status"], a["status"]).alias("status"), (a["moves"] + to["moves"]).alias("moves"), (a["refused"] + to["refused"]).alias("refused"))

    return ordered.select("run_id", F.aggregate("c", zero, join).alias("s")).select("run_id", "s.*")


def streaks(days: DataFrame, user: str, day: str) -> DataFrame:
    """``user, streak, last_day``: consecutive days up to each user's last one."""
    d = days.select(user, F.to_date(day).alias("_d")).distinct()
    w = W.partitionBy(user).orderBy("_d")
    islands = d.withColumn("_i", F.date_sub("_d", F.row_number().over(w))).groupBy(user, "_i").agg(F.count("*").alias("streak"), F.max("_d").alias("last_day"))
    return islands.groupBy(user).agg(F.max_by("streak", "last_day").alias("streak"), F.max("last_day").alias("last_day"))


def due(records: DataFrame, due_col: str, today: str, by: list[str]) -> DataFrame:
    """Open records due by a day, and how many are overdue. The day is given, never the clock's."""
    t = F.lit(today).cast("date")
    rows = records.where((F.to_date(due_col) <= t) & ~F.coalesce("completed", F.lit(False)))
    return rows.groupBy(*by).agg(F.count("*").alias("due"), F.count_if(F.to_date(due_col) < t).alias("overdue"))


def binding_errors(presented: DataFrame, locks: DataFrame) -> DataFrame:
    """Runs whose presented candidate, lock and current hash aren't all equal."""
    met = presented.join(locks, "run_id", "left")
    return met.where(~(F.col("presented_sha256").eqNullSafe(F.col("locked_sha256")) & F.col("locked_sha256").eqNullSafe(F.col("current_sha256")))).select("run_id")


def import_records(records: DataFrame, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Typed records and a quarantine: values (map) cast by field; a value that won't cast, or an unknown field, quarantines."""
    kinds = {"number": "double", "date": "date", "boolean": "boolean"}
    typed = {f: F.element_at("values", F.lit(f)).try_cast(kinds.get(k, "string")) for f, k in fields.items()}
    failed = F.lit(False)
    for f, c in typed.items():
        failed = failed | (F.element_at("values", F.lit(f)).isNotNull() & c.isNull())
    unknown = F.size(F.array_except(F.map_keys("values"), F.array(*[F.lit(f) for f in fields]))) > 0
    marked = records.withColumn("_bad", failed | unknown)
    good = marked.where(~F.col("_bad")).select("id", *[c.alias(f) for f, c in typed.items()])
    return good, marked.where("_bad").drop("_bad")


def filter_records(records: DataFrame, query: str) -> DataFrame:
    return records.where(F.lower(F.concat_ws(" ", F.map_values("values"))).contains(query.lower()))


def retry_outcome(attempts: DataFrame) -> DataFrame:
    """Last attempt of each row, with the delay before it: half a second, doubled each time, up to four."""
    out = attempts.groupBy("row_id").agg(F.count("*").alias("attempts"), F.max_by("output", "attempt").alias("output"), F.max("attempt").alias("last"))
    return out.withColumn("delay", F.when(F.col("last") > 1, F.least(F.lit(4.0), 0.5 * F.pow(F.lit(2.0), F.col("last") - 2))).otherwise(0.0)).drop("last")


def clone_confirmed(runs: DataFrame, new_id: Column) -> DataFrame:
    return runs.where(F.col("state").isin("ready_to_build", "candidate_built", "local_delivered")).withColumn("superseded_from", F.col("run_id")).withColumn("run_id", new_id).withColumn("state", F.lit("ready_to_build")).withColumn("status", F.lit("active"))
