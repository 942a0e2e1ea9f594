"""The review clock: schedules, grades, sweeps of neglect, the live cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.decay import retrievability
from ..functions.predicates import FORGETTABLE, UNREVIEWED

#: Defaults, steps of difficulty, a day's seconds, the live cap of a workspace.
STABILITY, DIFFICULTY, EASE, DAY, CAP = 1.0, 5.0, 2.5, 86_400, 20_000
REVIEW = ("stability", "difficulty", "reps", "recalls", "interval_s", "ease", "last", "neglected", "used")


def _or(value: Column, default: float) -> Column:
    """0 counts as missing."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)


def scheduled(grade: str, stability: Column, difficulty: Column, reps: Column, recalls: Column, elapsed: Column, interval: Column | None = None) -> dict[str, Column]:
    """stability, difficulty, reps, recalls and interval_s after a grade; elapsed: days since the last review.

    lapsed halves stability (0.1 at least) and clears reps; recalled lowers difficulty first, then raises stability by what was
    about to be forgotten (0.9 ^ (t / S)); initial keeps what there is.
    """
    s, d = _or(stability, STABILITY), _or(difficulty, DIFFICULTY)
    reps, recalls = F.coalesce(reps, F.lit(0)), F.coalesce(recalls, F.lit(0))
    clamp = lambda v, lo, hi: F.least(F.greatest(v, F.lit(lo)), F.lit(hi))
    if grade == "initial":
        span = F.coalesce(interval, F.lit(DAY)) if interval is not None else F.lit(DAY)
        return {"stability": s, "difficulty": d, "reps": reps, "recalls": recalls, "interval_s": span.cast("long")}
    if grade == "lapsed":
        d, s, reps = clamp(d + 0.2, 1.0, 10.0), F.greatest(s / 2, F.lit(0.1)), F.lit(0)
    elif grade == "recalled":
        r = clamp(F.pow(F.lit(0.9), F.coalesce(elapsed, F.lit(0.0)) / s), 0.01, 0.99)
        d = clamp(d - 0.15, 1.0, 10.0)
        s = s * (F.lit(1.0) + F.exp(F.lit(1.0) - d / 10) * (F.lit(1.0) - r))
        reps, recalls = reps + 1, recalls + 1
    else:
        raise ValueError(f"unknown grade: {grade}")
    return {"stability": s, "difficulty": d, "reps": reps, "recalls": recalls, "interval_s": (F.greatest(s, F.lit(1.0)) * DAY).cast("long")}


def graded(atoms: DataFrame, grade: str, now: Column, interval: Column | None = None) -> DataFrame:
    """atoms with review (struct of REVIEW) and due_at after a grade at now (stamps)."""
    r = lambda c: F.col(f"review.{c}")
    elapsed = F.when(F.coalesce(r("last"), F.lit("")) == "", 0.0).otherwise(clock.elapsed_days(r("last"), now))
    recalls = F.coalesce(r("recalls"), F.when(F.coalesce(r("reps"), F.lit(0)) > 0, r("reps")))  # older rows counted in reps alone
    out = scheduled(grade, r("stability"), r("difficulty"), r("reps"), recalls, elapsed, interval)
    review = F.struct(
        out["stability"].alias("stability"), out["difficulty"].alias("difficulty"), out["reps"].cast("int").alias("reps"), out["recalls"].cast("int").alias("recalls"),
        out["interval_s"].alias("interval_s"), F.coalesce(r("ease"), F.lit(EASE)).alias("ease"), now.alias("last"), r("neglected").alias("neglected"), r("used").alias("used"),
    )
    return atoms.withColumn("review", review).withColumn("due_at", clock.shift(now, F.col("review.interval_s")))


def promoted(entities: Column, origin: Column, content: Column) -> Column:
    """Entities with the horizon tag that a recall writes in place of any other."""
    from ..functions.predicates import horizon

    own = F.filter(F.coalesce(entities, F.array().cast("array<string>")), lambda e: ~F.startswith(e, F.lit("horizon:")))
    return F.array_append(own, F.concat(F.lit("horizon:"), horizon(origin, content)))


def sweep(atoms: DataFrame, now: Column) -> DataFrame:
    """atoms(kind, due_at, tombstone, pinned, stability, difficulty, interval_s, neglected, recalls, used) with action, and the new values.

    A due claim of a reviewed kind that is overdue by more than two intervals is missed once more; at the third miss one that was
    never recalled or used, is of a forgettable kind and not pinned goes (forgotten: neglect); others lapse.
    """
    late = clock.days_between(F.col("due_at"), now)
    span = F.greatest(F.coalesce("interval_s", F.lit(DAY)) / F.lit(float(DAY)), F.lit(1.0))
    missed = ~F.coalesce("tombstone", F.lit(False)) & ~F.col("kind").isin(*UNREVIEWED) & F.coalesce(F.col("due_at") <= now, F.lit(False)) & (late > span * 2)
    times = F.coalesce("neglected", F.lit(0)) + 1
    gone = (times >= 3) & (F.coalesce("recalls", F.lit(0)) == 0) & (F.coalesce("used", F.lit(0)) == 0) & F.col("kind").isin(*FORGETTABLE) & ~F.coalesce("pinned", F.lit(False))
    out = scheduled("lapsed", F.col("stability"), F.col("difficulty"), F.lit(0), F.col("recalls"), F.lit(0.0))
    action = F.when(missed & gone, "forgotten").when(missed, "lapsed").otherwise("kept")
    own = atoms.withColumn("action", action)
    lapsed = F.col("action") == "lapsed"
    return own.withColumns({
        "neglected": F.when(F.col("action") == "kept", F.coalesce("neglected", F.lit(0))).otherwise(times),
        "new_stability": F.when(lapsed, out["stability"]).otherwise(F.col("stability")),
        "new_difficulty": F.when(lapsed, out["difficulty"]).otherwise(F.col("difficulty")),
        "forgotten": F.when(F.col("action") == "forgotten", "neglect"),
    })


def over_cap(atoms: DataFrame, now: Column, cap: int = CAP) -> DataFrame:
    """(workspace, id) of the least retrievable forgettable, unpinned claims by which a workspace's shown claims exceed cap.

    atoms: shown claims (workspace, id, kind, pinned, stability, last). Only the workspaces over the cap are ranked.
    """
    size = atoms.groupBy("workspace").agg((F.count(F.lit(1)) - cap).alias("over")).where("over > 0")
    able = atoms.where(F.col("kind").isin(*FORGETTABLE) & ~F.coalesce("pinned", F.lit(False))).join(F.broadcast(size), "workspace")  # one row a workspace
    r = retrievability(clock.days_between(F.col("last"), now), F.col("stability"))
    order = W.partitionBy("workspace").orderBy(F.round(r, 9), "last", "id")
    return able.withColumn("n", F.row_number().over(order)).where("n <= over").select("workspace", "id")


def provenance(atoms: DataFrame, old: DataFrame) -> DataFrame:
    """A rewrite's provenance against the stored one, by (workspace, id): the floor sinks silently, a rise is kept and labelled.

    Both have origin and basis; the result adds floor_origin, floor_basis and warning.
    """
    from ..functions.predicates import basis_rank, launders, origin_rank

    o = old.select("workspace", "id", F.col("origin").alias("__o"), F.col("basis").alias("__b"))
    own = atoms.join(o, ["workspace", "id"], "left")
    rose = F.col("__o").isNotNull() & (launders(F.col("origin"), F.col("__o")) | (basis_rank(F.col("basis")) > basis_rank(F.col("__b"))))
    low = lambda rank, new, was: F.when(F.col(was).isNull() | (rank(F.col(new)) <= rank(F.col(was))), F.col(new)).otherwise(F.col(was))
    return own.withColumns({"floor_origin": low(origin_rank, "origin", "__o"), "floor_basis": low(basis_rank, "basis", "__b"), "warning": F.when(rose, F.lit("provenance rises above what was stored"))}).drop("__o", "__b")


def replay(events: DataFrame) -> DataFrame:
    """Review states after a sequence of grades: events(id, at, grade) in order of at; (id, stability, difficulty, reps, recalls, last).

    Each step reads the one before it, so a claim's history is one group.
    """
    import math

    import pandas as pd

    kind = events.schema["id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        s, d, reps, recalls, last = STABILITY, DIFFICULTY, 0, 0, None
        for at, grade in sorted(zip(pdf["at"], pdf["grade"], strict=True)):
            if grade == "lapsed":
                d, s, reps = min(max(d + 0.2, 1), 10), max(s / 2, 0.1), 0
            elif grade == "recalled":
                t = max((at - last).total_seconds() / DAY, 0.0) if last is not None else 0.0
                r = min(max(0.9 ** (t / s), 0.01), 0.99)
                d = min(max(d - 0.15, 1), 10)
                s *= 1 + math.exp(1 - d / 10) * (1 - r)
                reps, recalls = reps + 1, recalls + 1
            last = at
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "stability": [s], "difficulty": [d], "reps": [reps], "recalls": [recalls], "last": [last]})

    return events.groupBy("id").applyInPandas(one, f"id {kind}, stability double, difficulty double, reps int, recalls int, last timestamp")
