"""Which claims are live, due, shown, served; what their trust and origin count for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds a claim may have; those that are mail; those without a review clock; those a sweep may forget.
KINDS = ("voice", "habit", "cache-pointer", "preference", "lesson", "goal", "conclusion", "card_line", "summary", "note", "correction", "belief", "trust", "persona", "prediction", "rule", "outcome", "message", "receipt", "group")
MAIL = ("message", "receipt", "group")
UNREVIEWED = ("trust", "persona", "outcome", "message", "receipt", "group")
FORGETTABLE = ("lesson", "conclusion", "summary", "note", "card_line", "belief", "voice", "cache-pointer", "correction")
LEVELS = ("explicit", "derived")
ORIGINS = ("user-declared", "agent-derived", "tool-echo", "external", "peer")
IDENTITY = ("from", "to", "about", "agent", "issue", "name")


def _none(c: Column) -> Column:
    """A blank string column as null; other types unchanged."""
    return F.nullif(c, F.lit(""))


def is_live(tombstone: Column, valid_to: Column, now: Column) -> Column:
    """Not closed by now; no bound on the start."""
    return ~F.coalesce(tombstone, F.lit(False)) & (valid_to.isNull() | (valid_to > now))


def is_live_at(tombstone: Column, valid_from: Column, ts: Column, valid_to: Column, at: Column) -> Column:
    """The instant lies in [valid_from, else ts; valid_to)."""
    start = F.coalesce(valid_from, ts)
    return is_live(tombstone, valid_to, at) & (start.isNull() | (start <= at))


def is_due(due_at: Column, now: Column) -> Column:
    return F.coalesce(due_at <= now, F.lit(False))


def shown_at(tombstone: Column, valid_to: Column, due_at: Column, now: Column) -> Column:
    """Not a tombstone, and live or due."""
    return ~F.coalesce(tombstone, F.lit(False)) & (is_live(tombstone, valid_to, now) | is_due(due_at, now))


def is_mail(kind: Column) -> Column:
    return kind.isin(*MAIL)


def in_memory(kind: Column, asked: str | None = None) -> Column:
    """The asked kind alone; without one, everything but mail."""
    return kind == asked if asked is not None else ~is_mail(kind)


def in_set(own: Column, name: str | None) -> Column:
    return F.lit(True) if name is None else F.coalesce(own == name, F.lit(False))


def serves(live: Column, own_set: Column, kind: Column, name: str | None = None, asked: str | None = None) -> Column:
    return live & in_set(own_set, name) & in_memory(kind, asked)


def origin_of(origin: Column) -> Column:
    """The origin as shown: blank or missing reads unknown."""
    return F.coalesce(_none(F.trim(origin)), F.lit("unknown"))


def capped_trust(declared: Column, content: Column, origin: Column) -> Column:
    """Authoritative content is capped by where it came from: 0.2 echoed by a tool, 0.4 external."""
    cap = F.when(origin == "tool-echo", 0.2).when(origin == "external", 0.4).otherwise(float("inf"))
    return F.when(F.coalesce(content == "authoritative", F.lit(False)), F.least(declared, cap)).otherwise(declared)


def rank_trust(trust: Column, content: Column, origin: Column, default: float = 1.0) -> Column:
    """Search takes 1 for a missing trust, recall 0."""
    return capped_trust(F.coalesce(trust, F.lit(default)), content, origin)


def needs_accept(origin: Column, hook: Column, hold: bool) -> Column:
    """Whether a write is held for acceptance: holding is on, and it comes by a hook or an agent derived it."""
    return F.lit(hold) & (F.coalesce(hook, F.lit(False)) | F.coalesce(origin == "agent-derived", F.lit(False)))


def origin_rank(origin: Column) -> Column:
    """2 declared by the user, 1 another known origin, 0 else."""
    return F.when(origin == "user-declared", 2).when(origin.isin(*ORIGINS), 1).otherwise(0)


def basis_rank(basis: Column) -> Column:
    """1 for a person, 0 else."""
    return F.coalesce(F.lower(F.trim(basis)) == "person", F.lit(False)).cast("int")


def horizon(origin: Column, content: Column) -> Column:
    """The horizon a recalled review may write: capped origins keep their own name for authoritative content."""
    capped = (content == "authoritative") & origin.isin("tool-echo", "external")
    return F.when(F.coalesce(capped, F.lit(False)), origin).otherwise("standing")


def launders(new_origin: Column, old_origin: Column) -> Column:
    """A rise in origin."""
    return origin_rank(new_origin) > origin_rank(old_origin)


#: The background jobs and the phases in which each may run.
SCHEDULE = {"extract": ("compaction",), "link-rewrite": ("compaction",), "fidelity": ("on-demand",), "due-suggest": ("on-demand",)}


def job_allowed(job: Column, phase: Column) -> Column:
    out = F.lit(False)
    for name, phases in SCHEDULE.items():
        out = out | ((job == name) & phase.isin(*phases))
    return out
