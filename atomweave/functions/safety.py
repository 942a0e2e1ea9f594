"""Labels for text that should not have been written: credentials, injections, hidden characters, dumps; and claims to keep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, lines

#: Invisible code points, phrases of injections, kinds of credentials with their patterns in order.
INVISIBLE = "[\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{206f}\\x{feff}]"
INJECTIONS = ("ignore previous instructions", "ignore all previous instructions", "ignore the above instructions", "disregard all previous instructions", "disregard previous instructions")
SECRETS = (
    ("a GitHub token", "(?<![A-Za-z0-9_])(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{30,}"),
    ("a Slack token", "(?<![A-Za-z0-9_])xox[bpars]-[A-Za-z0-9_-]{10,}"),
    ("an AWS access key id", "(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])"),
    ("a JSON Web Token", "eyJ[A-Za-z0-9_-]{7,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
)
GENERIC = ("(?<![a-z0-9_-])(?:api_key|api-key|apikey|secret|password|token)\\s*[=:]", "bearer \\s*[a-z0-9._-]{8,}", "sk-[a-z0-9]{8,}")
REJECTED = "credential-shaped text is rejected"


def has_invisible(text: Column) -> Column:
    return text.rlike(INVISIBLE)


def secret_kind(text: Column) -> Column:
    """What credential the text holds, null for none."""
    low = ascii_lower(text)
    out = F.when(F.contains(low, F.lit("-----begin")) & F.contains(low, F.lit("private key-----")), "a private key block")
    out = out.when(F.contains(text, F.lit("AGE-SECRET-KEY-1")), "an age secret key")
    for kind, pattern in SECRETS:
        out = out.when(text.rlike(pattern), kind)
    return out.when(low.rlike("|".join(GENERIC)), "a credential")


def looks_like_injection(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for p in INJECTIONS:
        out = out | F.contains(low, F.lit(p))
    return out


def content_warnings(text: Column) -> Column:
    kind = secret_kind(text)
    secret = F.when(kind == "a credential", F.lit(REJECTED)).when(kind.isNotNull(), F.concat(F.lit(f"{REJECTED} ("), kind, F.lit(")")))
    hidden = F.when(has_invisible(text), F.lit("invisible unicode is rejected"))
    steer = F.when(looks_like_injection(text), F.lit("text that instructs the model reading it is rejected; write the claim it stands for"))
    return F.array_compact(F.array(hidden, secret, steer))


def push_warning(warnings: Column, warning: Column) -> Column:
    """The list with the warning once."""
    own = F.coalesce(warnings, F.array().cast("array<string>"))
    return F.when(F.array_contains(own, warning), own).otherwise(F.array_append(own, warning))


def is_tool_dump(text: Column) -> Column:
    """Blank, a fence with stdout or stderr, a page, or a listing of eight lines with six that look listed."""
    t = F.regexp_replace(text, "^\\s+|\\s+$", "")
    low, own = ascii_lower(t), lines(t)
    listed = F.size(F.filter(own, lambda x: x.rlike("^(?:-|drwx|total )")))
    fenced = F.contains(low, F.lit("```")) & (F.contains(low, F.lit("stdout")) | F.contains(low, F.lit("stderr")))
    return (t == "") | fenced | low.rlike("^<(?:!doctype|html)") | ((F.size(own) >= 8) & (listed >= 6))


def _last(text: Column) -> Column:
    own = lines(F.regexp_replace(text, "^\\s+|\\s+$", ""))
    return F.regexp_replace(F.coalesce(F.try_element_at(own, F.lit(-1)), F.lit("")), "^\\s+|\\s+$", "")


def claim_from_user(text: Column) -> Column:
    """struct(kind, claim) of a keep directive on the last line, null without one."""
    last = _last(text)
    low = ascii_lower(last)
    kind = F.when(F.startswith(low, F.lit("remember:")), "lesson").when(F.startswith(low, F.lit("from now on:")), "habit").when(F.startswith(low, F.lit("prefer:")), "preference")
    rest = F.regexp_replace(last, "^[^:]*:", "")
    claim = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "^[: ,]+", ""), "^\\s+|\\s+$", ""), "[.,;:]+$", "")
    held = kind.isNotNull() & ~F.endswith(last, F.lit("?")) & (F.octet_length(claim) >= 8)
    return F.when(held, F.struct(kind.alias("kind"), claim.alias("claim")))


def admit(text: Column) -> Column:
    """struct(kind, claim) of what a seat takes in: lessons, preferences, and accepts with an id of four bytes."""
    last = _last(text)
    accept = F.startswith(ascii_lower(last), F.lit("accept:"))
    own = F.regexp_replace(F.substring(last, 8, 1_000_000), "^[:\\s]+|[:\\s]+$", "")
    claim = claim_from_user(text)
    taken = F.when(claim["kind"].isin("lesson", "preference"), claim)
    return F.when(accept, F.when(F.octet_length(own) >= 4, F.struct(F.lit("accept").alias("kind"), own.alias("claim")))).otherwise(taken)
