"""Words, sets of words, names and paragraphs of claims, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that searches leave out.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by", "can", "could", "do", "does", "for", "from", "if", "in", "is", "it", "its", "me", "my", "no", "not", "of", "on", "or", "our", "please", "should", "than", "that", "the", "then", "these", "this", "those", "to", "was", "we", "were", "what", "when", "where", "which", "who", "will", "with", "would", "yes", "you", "your")
WORD = "[a-z0-9][a-z0-9_-]*"
WHITE = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Prefixes of entities that name no topic; prefixes of accessions.
NON_TOPIC = ("seat:", "horizon:")
ACCESSION = ("deed-", "sha256:")


def ascii_lower(c: Column) -> Column:
    """A-Z alone; Unicode lowering would merge more."""
    return F.translate(c, UPPER, LOWER)


def all_of(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def raw_tokens(text: Column) -> Column:
    """Distinct words, stopwords kept."""
    return F.array_distinct(all_of(ascii_lower(text), WORD))


def tokens(text: Column, stem: bool = False) -> Column:
    """Words in order less stopwords; stem folds those of letters alone."""
    out = F.filter(all_of(ascii_lower(text), WORD), lambda w: ~w.isin(*STOPWORDS))
    if stem:
        from .stem import stem_words

        return stem_words(out)
    return out


def recall_tokens(text: Column) -> Column:
    """Words of two characters or more."""
    return F.array_distinct(all_of(ascii_lower(text), "[a-z0-9][a-z0-9_-]+"))


def set_tokens(text: Column) -> Column:
    """The set that tells a rewrite from a neighbour: ASCII letter and digit runs."""
    return F.array_distinct(all_of(ascii_lower(text), "[a-z0-9]+"))


def head_tokens(text: Column) -> Column:
    """Words in order, letters and numbers of any script, lower case."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{M}\\p{N}]+"), lambda w: w != "")


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of two arrays of distinct values; two empty texts agree, two empty entity lists do not."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def same_head(a: Column, b: Column) -> Column:
    """Two head_tokens arrays open with the same words, three at least and 0.6 of the shorter, and both go on differently."""
    n = F.least(F.size(a), F.size(b))
    first = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), F.lit(False))
    shared = F.when(first == 0, n).otherwise(first.cast("int") - 1)
    return (n > 0) & (shared >= 3) & (shared < F.size(a)) & (shared < F.size(b)) & (shared >= n * F.lit(0.6))


def atom_tokens(text: Column, entities: Column, stem: bool = False) -> Column:
    """Words of the text, then of each entity."""
    joined = F.concat_ws(" ", F.coalesce(text, F.lit("")), F.array_join(F.coalesce(entities, F.array().cast("array<string>")), " "))
    return tokens(joined, stem)


#: Characters of a gram at most; of a chunk that grams are cut from.
GRAM, CHUNK = 8, 256


def grams(word: Column, least: int = 1) -> Column:
    """Distinct substrings of least to GRAM characters. Cut from chunks that overlap, so a word of a megabyte takes time in proportion. A null or empty word has none."""
    step = CHUNK - GRAM + 1
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)), F.lit(step)), lambda i: F.substring(word, i, F.lit(CHUNK)))
    sizes = F.array(*map(F.lit, range(least, GRAM + 1)))

    def cut(c):
        at = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
        return F.flatten(F.transform(sizes, lambda n: F.filter(F.transform(at, lambda i: F.substring(c, i, n)), lambda x: F.length(x) == n)))

    return F.array_distinct(F.flatten(F.transform(chunks, cut)))


def gram_of(word: Column) -> Column:
    """The gram that every word holding this one has: its first GRAM characters, or all of it."""
    return F.substring(word, 1, GRAM)


def one_edit(a: Column, b: Column) -> Column:
    """Whether one edit at most parts two words. Long ones are compared behind what they share at the start, found by halving: levenshtein takes the product of their lengths."""
    n, m = F.length(a), F.length(b)
    bits = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    shared = F.aggregate(bits, F.lit(0), lambda at, x: F.when((at + x <= F.least(n, m)) & (F.left(a, at + x) == F.left(b, at + x)), at + x).otherwise(at))
    rest = lambda w, skip: F.substring(w, shared + F.lit(1 + skip), F.length(w))
    far = F.when(n == m, rest(a, 1) == rest(b, 1)).when(n == m + 1, rest(a, 1) == rest(b, 0)).otherwise(rest(a, 0) == rest(b, 1))
    return F.when(F.abs(n - m) > 1, False).when(F.least(n, m) > CHUNK, far).otherwise(F.levenshtein(a, b, 1).between(0, 1))


def token_score(q: Column, h: Column) -> Column:
    """4 equal, 3 prefix, 2 inside, 1.5 one edit; queries under four characters only equal."""
    near = one_edit(q, h)
    long = F.length(q) >= 4
    return F.when(q == h, 4.0).when(long & F.startswith(h, q), 3.0).when(long & F.contains(h, q), 2.0).when(long & near, 1.5).otherwise(0.0)


def scan_score(query: Column, hay: Column) -> Column:
    """Best score of each query word over the words of a document, summed."""
    best = F.transform(query, lambda q: F.coalesce(F.array_max(F.transform(hay, lambda h: token_score(q, h))), F.lit(0.0)))
    return F.aggregate(best, F.lit(0.0), lambda a, x: a + x)


def lines(text: Column) -> Column:
    """Lines, without their ends; a last line feed opens none."""
    cut = F.split(F.regexp_replace(text, "\\r?\\n$", ""), "\\r?\\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(cut)


def entries(text: Column) -> Column:
    """Paragraphs: runs of lines that are not blank."""
    body = F.regexp_replace(text, "\\r\\n", "\n")
    cut = F.split(body, "\\n(?:[^\\S\\n]*\\n)+")
    return F.filter(F.transform(cut, lambda p: F.regexp_replace(p, "^\\s+|\\s+$", "")), lambda p: p != "")


def paragraphs(text: Column) -> Column:
    """entries, or the lines where that is one block."""
    parts = entries(text)
    single = F.filter(F.transform(lines(text), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != "")
    return F.when(F.size(parts) <= 1, single).otherwise(parts)


def capitalized_runs(text: Column) -> Column:
    return F.array_distinct(all_of(text, "(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9]+(?![A-Za-z0-9_])"))


def backtick_names(text: Column) -> Column:
    inner = F.transform(all_of(text, "`([^`]*)`", 1), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
    return F.array_distinct(F.filter(inner, lambda x: x != ""))


def entities_of(text: Column, declared: Column | None = None) -> Column:
    """Sorted names a claim is about: the declared ones less those of no topic, else those read off the text."""
    read = F.array_union(capitalized_runs(text), backtick_names(text))
    if declared is None:
        return F.array_sort(read)
    kept = F.filter(F.transform(declared, lambda e: F.trim(e)), lambda e: (e != "") & ~F.startswith(e, F.lit(NON_TOPIC[0])) & ~F.startswith(e, F.lit(NON_TOPIC[1])))
    return F.array_sort(F.array_distinct(F.when(declared.isNotNull(), kept).otherwise(read)))


def gate(text: Column, declared: Column) -> Column:
    """entities_of less an undeclared capitalised first word."""
    first = F.regexp_extract(text, "[A-Za-z0-9]+", 0)
    opens = declared.isNull() & first.rlike("^.[a-z]*$")
    names = entities_of(text, declared)
    return F.when(opens, F.array_remove(names, first)).otherwise(names)


def is_accession(value: Column) -> Column:
    v = F.trim(value)
    return v.rlike("^(?:deed-|sha256:)[^,]+$") & ~v.rlike("\\s")


def entity_error(value: Column) -> Column:
    """Why an entity is refused, else null."""
    v = F.trim(value)
    prefix, rest = F.regexp_extract(v, "^(deed-|sha256:)(.*)$", 1), F.regexp_extract(v, "(?s)^(deed-|sha256:)(.*)$", 2)
    bad = F.regexp_extract(rest, "[\\s,]", 0)
    return (
        F.when(v == "", F.lit("an entity is empty"))
        .when(prefix == "", F.lit(None).cast("string"))
        .when(rest == "", F.concat(F.lit("'"), value, F.lit("' is a bare '"), prefix, F.lit("' and names no deed")))
        .when(bad != "", F.concat(F.lit("'"), value, F.lit("' carries '"), bad, F.lit("', which would split the entity into two")))
    )


def norm_claim(text: Column) -> Column:
    """ASCII lower case, white space squeezed, closing marks off."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(ascii_lower(text), "\\s+", " "), "^ | $", ""), "[.,;:]+$", "")


def normal(text: Column) -> Column:
    """Letters and numbers alone, lower case, single blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "), "^ | $", "")


def fidelity(claim: Column, transcript: Column) -> Column:
    """SUPPORTED where one of the normalised texts holds the other, else NEI."""
    a, b = norm_claim(claim), norm_claim(transcript)
    return F.when((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), "SUPPORTED").otherwise("NEI")


def chunks(text: Column, words: int = 384) -> Column:
    """Runs of that many words joined by blanks."""
    own = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(own) - 1) / words).cast("int"), F.lit(0)))
    return F.when(F.size(own) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(own, i * words + 1, F.lit(words)), " ")))


def facts(text: Column) -> Column:
    """Numbered fact lines."""
    own = F.transform(lines(text), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
    return F.filter(own, lambda x: x.rlike("^[0-9]") & F.contains(x, F.lit(". ")))


def units(source: Column, text: Column) -> Column:
    return F.when(F.startswith(source, F.lit("factconsolidation")), facts(text)).otherwise(chunks(text))


# -- names -----------------------------------------------------------------------------------------------------------------
def set_name(name: Column) -> Column:
    """The normalised name, null where it is none."""
    low = ascii_lower(F.trim(name))
    return F.when(low.rlike("^[a-z][a-z0-9-]{0,31}$"), low)


def workspace_slug(workspace: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(workspace, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "workspace").otherwise(out)


def normalize_remote(url: Column) -> Column:
    """git:host/path of a remote, null where it is none."""
    u = F.trim(url)
    web = "^(?:https?|ssh)://(?:[^@]*@)?([^/:]*)(?::[^/]*)?/+(.*?)(?:\\.git)*$"
    scp = "^(?:[^@]*@)?([^:/]+)[:/](.+?)(?:\\.git)*$"
    form = lambda p: F.concat(F.lit("git:"), F.regexp_extract(u, p, 1), F.lit("/"), F.regexp_extract(u, p, 2))
    return F.when(u.rlike("^(?:https?|ssh)://"), F.when(u.rlike(web), form(web))).when(u.rlike(scp), form(scp))


def agent_peer(harness: Column, profile: Column) -> Column:
    h, p = F.trim(harness), F.trim(profile)
    return F.when(h == "", F.lit(None).cast("string")).when(p.isNotNull() & ~p.isin("", "default"), F.concat(h, F.lit("."), p)).otherwise(h)


def export_file_name(workspace: Column) -> Column:
    return F.concat(F.translate(workspace, "/\\:", "___"), F.lit(".jsonl"))


def short_digest(text: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def quoted(value: Column) -> Column:
    """Single quotes; double where the value has a single and no double one; escapes where it has both."""
    one, two = F.contains(value, F.lit("'")), F.contains(value, F.lit('"'))
    escaped = F.regexp_replace(value, "([\\\\'])", "\\\\$1")
    return F.when(one & ~two, F.concat(F.lit('"'), value, F.lit('"'))).when(one, F.concat(F.lit("'"), escaped, F.lit("'"))).otherwise(F.concat(F.lit("'"), value, F.lit("'")))


def url_decode(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def query_parameters(url: Column) -> Column:
    """Map of the decoded parameters of a query string; the first of a repeated name."""
    part = F.filter(F.split(F.regexp_extract(url, "\\?([^#]*)", 1), "&"), lambda p: p != "")
    pairs = F.transform(part, lambda p: F.struct(url_decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("key"), url_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value")))
    keys = F.transform(pairs, lambda x: x["key"])
    return F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(keys, x["key"]) == i + 1))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regex: * crosses separators, an unclosed [ is itself."""
    import re

    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (j := pattern.find("]", i + 2)) > 0:
            own = pattern[i + 1 : j]
            neg = own[0] in "!^"
            own = own[neg:].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out += f"[{'^' if neg else ''}{own}]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern meets the path, its name, its folder or one of its parts."""
    folder = F.regexp_replace(path, "/?[^/]*$", "")

    def meets(pattern: str) -> Column:
        r = glob_regex(pattern.rstrip("/"))
        return path.rlike(r) | F.exists(F.split(path, "/"), lambda x: x.rlike(r)) | ((folder != "") & folder.rlike(r))

    out = F.lit(False)
    for p in patterns:
        out = out | meets(p)
    return out


def frontmatter(text: Column) -> Column:
    """Map of the key: value lines between two opening --- lines; empty where there is no such block."""
    body = F.regexp_extract(text, "(?s)^---\\r?\\n(.*?)\\r?\\n---", 1)
    pairs = F.filter(F.split(body, "\\r?\\n"), lambda x: x.rlike("^[^:#\\s][^:]*:"))
    trim = lambda c: F.regexp_replace(F.trim(c), "^[\"']|[\"']$", "")
    made = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    keys = F.transform(made, lambda x: x["key"])
    return F.map_from_entries(F.filter(made, lambda x, i: F.array_position(keys, x["key"]) == i + 1))
