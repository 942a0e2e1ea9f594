"""Cases of the text, name, safety, clock and prose functions."""

import pytest
from pyspark.sql import functions as F

from atomweave.functions import clock, prose, safety, stem
from atomweave.functions import text as T
from atomweave.functions.fnv import fnv1a


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("r")).first()["r"]


PROSE = [
    ("", (0, 0, None, None, 0, 0.0, 0, 0, 0)),
    ("Parcels arrive with a signed receipt.", (6, 1, None, None, 0, 0.0, 0, 0, 0)),
    ("One thing. Another thing. A third thing.", (7, 3, None, None, 0, 0.0, 0, 0, 0)),
    ("The bridge was painted by the crew.", (7, 1, None, None, 0, 0.0, 1, 0, 0)),
    ("only family apply early daily", (5, 1, None, None, 0, 0.0, 0, 0, 0)),
    ("quickly and very carefully the reviewer really basically just moved on", (11, 1, 9.76, 18.78, 6, 0.545, 0, 0, 0)),
    ("word " * 20 + ".", (20, 1, 7.41, 101.94, 0, 0.0, 0, 1, 0)),
    ("word " * 30 + ".", (30, 1, 12.41, 91.79, 0, 0.0, 0, 0, 1)),
]


@pytest.mark.parametrize(("text", "want"), PROSE)
def test_prose(text, want):
    assert tuple(prose.assess(text).values()) == want


def test_prose_refusals():
    assert prose.refuse("One. Two. Three.") == "atom has 3 sentences; one claim is at most 2"
    assert prose.refuse("One. Two. Three.", atom=False) is None
    assert "very hard to read: 30 words" in prose.refuse("word " * 30 + ".")
    assert prose.sentences("See v0.9.3 at 127.0.0.1. Restart it. J. Smith agrees.") == ["See v0.9.3 at 127.0.0.1.", "Restart it.", "J. Smith agrees."]


def test_stem():
    got = [stem.stem(w) for w in "caresses ponies flies agreed plastered motoring hopping hoping happy relational running national skies dying".split()]
    assert got == ["caress", "poni", "fli", "agre", "plaster", "motor", "hop", "hope", "happi", "relat", "run", "nation", "sky", "die"]
    assert stem.fold("pre-tested") == "pre-tested" and stem.fold("v2s") == "v2s"


@pytest.mark.parametrize(
    ("remote", "want"),
    [
        ("https://github.com/example/kit.git", "git:github.com/example/kit"),
        ("git@github.com:example/kit.git", "git:github.com/example/kit"),
        ("ssh://git@github.com/a/b.git", "git:github.com/a/b"),
        ("https://example.com:8443/team/repo.git", "git:example.com/team/repo"),
        ("http://gitlab.com/group/sub/project.git", "git:gitlab.com/group/sub/project"),
        ("git@bitbucket.org:team/repo", "git:bitbucket.org/team/repo"),
        ("", None),
    ],
)
def test_remote(spark, remote, want):
    assert one(spark, T.normalize_remote(F.col("x")), x=remote) == want


@pytest.mark.parametrize(("name", "want"), [("git:github.com/A/b", "git_github.com_A_b"), ("global", "global"), ("dir:/home/x/y", "dir_home_x_y"), ("///", "workspace"), ("", "workspace"), ("a.b_c-d", "a.b_c-d")])
def test_slug(spark, name, want):
    assert one(spark, T.workspace_slug(F.col("x")), x=name) == want


@pytest.mark.parametrize(("name", "want"), [("Review", "review"), ("  joss-reviews  ", "joss-reviews"), ("1review", None), ("-review", None), ("", None), ("../etc", None), ("a b", None), ("a_b", None), ("a" * 32, "a" * 32), ("a" * 33, None)])
def test_set_name(spark, name, want):
    assert one(spark, T.set_name(F.col("x")), x=name) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("The Ferry leaves the Harbour early.", ["Ferry", "Harbour", "The"]), ("Take `oats` not `rice` today.", ["Take", "oats", "rice"]), ("no capitals", []), ("A single A and an AB pair", ["AB"]), ("Mixed `back tick` and Capitalized runs", ["Capitalized", "Mixed", "back tick"]), ("", [])],
)
def test_entities(spark, text, want):
    assert one(spark, T.entities_of(F.col("x")), x=text) == want


LISTING = "\n".join(["total 48", *[f"-rw-r--r-- 1 x x 0 file{i}" for i in range(8)]])


@pytest.mark.parametrize(
    ("text", "want"),
    [("", True), ("   ", True), ("Parcels arrive with a receipt.", False), ("Run:\n```\nstdout: fine\n```", True), ("```\nnothing named\n```", False), ("<!DOCTYPE html><html></html>", True), (LISTING, True), ("\n".join(LISTING.split("\n")[:5]), False)],
)
def test_tool_dump(spark, text, want):
    assert one(spark, safety.is_tool_dump(F.col("x")), x=text) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [("Remember: always lock the boat shed", ("lesson", "always lock the boat shed")), ("Prefer: oats over rice", ("preference", "oats over rice")), ("Remember that: pin it", None), ("Prefer conventional commits", None), ("remember: lowercase still counts", ("lesson", "lowercase still counts")), ("", None), ("Prefer: is it so, really?", None)],
)
def test_claims(spark, line, want):
    got = one(spark, safety.claim_from_user(F.col("x")), x=line)
    assert (tuple(got) if got else None) == want


def test_admit(spark):
    assert tuple(one(spark, safety.admit(F.col("x")), x="a\nAccept: abcd1")) == ("accept", "abcd1")
    assert one(spark, safety.admit(F.col("x")), x="accept: ab") is None
    assert one(spark, safety.admit(F.col("x")), x="From now on: never do that") is None


@pytest.mark.parametrize(
    ("text", "want"),
    [("api_key=sk-not-a-real-key-here", "a credential"), ("x ghp_" + "a" * 30, "a GitHub token"), ("xghp_" + "a" * 30, None), ("AKIA" + "A" * 16, "an AWS access key id"), ("AKIA" + "A" * 17, None), ("my token is here", None), ("-----BEGIN PRIVATE KEY-----", "a private key block")],
)
def test_secrets(spark, text, want):
    assert one(spark, safety.secret_kind(F.col("x")), x=text) == want


def test_same_head(spark):
    rows = [("The evening ferry leaves at six", "The evening ferry leaves at nine", True), ("a b c d e f g h", "a b c x y z w v", False), ("a b c", "a b c d", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", T.same_head(T.head_tokens(F.col("a")), T.head_tokens(F.col("b"))).alias("got")).collect())


def test_clock(spark):
    for raw in ("2026-01-01 00:00:00", "2026-01-01T00:00:00Z", "2026-01-01T00:00:00.0+00:00"):
        assert one(spark, clock.canonicalize(F.col("x")), x=raw) == "2026-01-01T00:00:00.000Z"
    assert one(spark, clock.shift(F.col("x"), 86400.5), x="2026-01-01T00:00:00.250Z") == "2026-01-02T00:00:00.750Z"
    assert one(spark, clock.elapsed_days(F.col("x"), F.col("y")), x="2026-01-01T00:00:00.000Z", y="2026-01-02T12:00:00.000Z") == 1.5
    assert one(spark, clock.elapsed_days(F.col("x"), F.col("y")), x="nonsense", y="2026-01-02T12:00:00.000Z") == 0.0


def test_glob_and_quotes(spark):
    assert one(spark, T.is_ignored(F.col("x"), ["*.pyc", "node_modules"]), x="a/node_modules/b.js")
    assert not one(spark, T.is_ignored(F.col("x"), ["*.pyc"]), x="a/b.py")
    assert one(spark, T.quoted(F.col("x")), x="it's") == '"it\'s"'
    assert one(spark, T.entity_error(F.col("x")), x="deed-") == "'deed-' is a bare 'deed-' and names no deed"
    assert one(spark, T.entity_error(F.col("x")), x="deed-a,b") == "'deed-a,b' carries ',', which would split the entity into two"
    assert one(spark, T.entity_error(F.col("x")), x="JOSS") is None


def test_fnv():
    assert fnv1a(["a"]) == 0xAF63DC4C8601EC8C and fnv1a(["a", "b"]) != fnv1a(["ab"])
