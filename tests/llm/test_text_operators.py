"""The text operators against brute force, exact round trips and stated edge cases."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.llm import bpe, exact_dedup, jaccard_join, license_scan, line_dedup, mixing, pii, quality, token_files
from atomweave.llm.common import Shingler, shared_path

DOC = "doc_id long, text string, lang string, source string, n_chars long, __extra string, id string, n int"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"src{i % 3}", None, "e", "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


ODD = [None, "", " ", "\n", "word", "a b c d", "é " * 3000, "x" * 50_000, "a b c d e f\n" * 400, None, "", "a b c d e f g", "A B C D E F G"]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.no_truncation()
    t.no_padding()
    return t


HARD = ["It's WE'LL don't 's x's \x1c a\x85b  c d", "aaaaaaa aaa aaaa", "ΑΣ ΣΑΣ. Σ", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "naïve é İstanbul K ﬁ 日本語 😀😀 ½ ²³ १२३", "a\n\n b\t\tc\r\nd", "don''t ''''s 'S'T'RE", "\x00\x01\x7f", "H̱ ȩ́x ́a", "ẞß ŉ ǰ"]


def test_bpe_equals_the_library(tokenizer, library):
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("abcdeé .,'\n!?12<|>") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    b = bpe.PairIndexBPE(tokenizer, cache=50)
    for _ in range(2):  # again with a cache that was cleared
        for t, ids in zip(texts, b.encode_batch(texts), strict=True):
            want = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert b.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_bpe_report(spark, tokenizer, library):
    texts = ODD + HARD
    got = {r.doc_id: r for r in bpe.token_report(docs(spark, texts), tokenizer).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.token_report(docs(spark, []), tokenizer).count() == 0


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, [200, 70_000, 2**32 - 1][k % 3], k % 7 * 300).astype("<u4").tobytes() for k in range(20)]
    blob = token_files.pack([None, *range(19)], ids)
    f = token_files.TokenFile(lambda at, n: blob[at : at + n])
    flat = np.frombuffer(b"".join(ids), "<u4")
    assert (f.tokens(0, f.n_tokens) == flat).all() and f.nulls[0] and not f.nulls[1:].any()
    for i in range(0, len(flat), 37):
        assert f.token(i) == flat[i] and (f.tokens(i, min(i + 91, len(flat))) == flat[i : i + 91]).all()
    assert len(f.tokens(5, 5)) == 0


def test_token_files(spark, tokenizer, library):
    texts = ODD + HARD
    folder = shared_path(spark, "test-files")
    manifest = token_files.write_token_files(docs(spark, texts), tokenizer, folder, tokens_per_file=700)
    assert manifest.count() > 3
    got = token_files.read_token_files(manifest, folder).orderBy("start").collect()
    start = 0
    for i, r in enumerate(got):
        want = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(want)) and np.frombuffer(r.ids, "<u4").tolist() == want
        start += len(want)
    rep = token_files.files_report(docs(spark, ["a", "a", None], [None, 5, 5]), tokenizer).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in rep) == [(False, 1), (False, 2), (True, 2)]
    assert token_files.files_report(docs(spark, []), tokenizer).count() == 0
    assert zlib.crc32(np.array([1], "<u4").tobytes()) in {r.ids_crc32 for r in rep}


def brute_lines(texts, ids):
    white = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(white).encode().lower()
    held = {}
    for i, t in zip(ids, texts, strict=True):
        for x in (t or "").split("\n"):
            if len(x.strip(white)) >= 10:
                held.setdefault(key(x), set()).add((i is None, i or 0))
    out = []
    for i, t in zip(ids, texts, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(x.strip(white)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == (i is None, i or 0)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [f"line number {i} ÄÖ" for i in range(30)] + ["short", "", "  LINE number 3 äö ", "\tline NUMBER 3 ÄÖ\r"]
    texts = [*ODD, *("\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(150))]
    ids = [*range(100, 100 + len(texts) - 3), None, None, 100]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_report(docs(spark, texts, ids).repartition(5)).collect()), key=str)
    assert got == brute_lines(texts, ids)
    assert line_dedup.line_report(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("bits", "files"), [(256, 1000), (4, 1)])
def test_exact_dedup(spark, bits, files):
    """4 bits of digest: most hits are of other texts, so the byte check decides; one file a batch: state outlives batches."""
    texts = [*ODD, *[f"text {i % 7}" for i in range(60)]]
    ids = [*range(len(texts) - 3), None, None, 20]
    _, d = exact_dedup.exact_dedup(docs(spark, texts, ids).repartition(3), digest_bits=bits, files_per_batch=files)
    rows = d.collect()
    groups = {}
    for i, t in zip(ids, texts, strict=True):
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in own if i is not None), default=None) for t, own in groups.items()}
    got = sorted(((r.id, r.keep_id, r.n) for r in rows), key=str)
    assert got == sorted(((i, keep[t or ""], len(groups[t or ""])) for i, t in zip(ids, texts, strict=True)), key=str)
    assert sum(r.kept for r in rows) == len(groups) and not any(r.seen for r in rows)


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_dedup_continues_a_state(spark, bits):
    """Three runs of one folder: rows equal to those of earlier runs are seen, sizes and ids are those of all runs."""
    at = shared_path(spark, "test-state")
    runs = [([1, 2, 3, 9], ["a", "b", "a", None]), ([4, 0, 5], ["b", "c", ""]), ([], []), ([7, 8], ["c", "d"])]
    all_ = {}
    for ids, texts in runs:
        before = set(all_)
        for i, t in zip(ids, texts, strict=True):
            all_.setdefault(t or "", []).append(i)
        _, d = exact_dedup.exact_dedup(docs(spark, texts, ids).repartition(2), digest_bits=bits, files_per_batch=1, state_path=at)
        want = {(i, max(all_[t or ""]), len(all_[t or ""]), i == max(all_[t or ""]), (t or "") in before) for i, t in zip(ids, texts, strict=True)}
        assert {(r.id, r.keep_id, r.n, r.kept, r.seen) for r in d.collect()} == want
    at = shared_path(spark, "test-state")
    first = exact_dedup.drop_copies(docs(spark, ["a", "b", "a"], [1, 2, 3]), state_path=at)
    again = exact_dedup.drop_copies(docs(spark, ["c", "b", "c", "a"], [4, 5, 6, 0]), state_path=at)
    assert sorted(r.doc_id for r in first.collect()) == [2, 3] and [r.doc_id for r in again.collect()] == [6]


def test_drop_copies(spark):
    df = docs(spark, ["a", "b", "a", None, ""])
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 4]
    assert exact_dedup.drop_copies(docs(spark, [])).count() == 0


def brute_jaccard(texts, ids):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    p = list(range(len(texts)))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                p[max(x, y)] = min(x, y)
    low = {}
    for k in range(len(texts)):
        if ids[k] is not None:
            low[root(k)] = min(low.get(root(k), ids[k]), ids[k])
    return sorted(((ids[k], len(sets[k]), low.get(root(k))) for k in range(len(texts))), key=str)


@pytest.mark.parametrize(("rare", "region"), [(32, 128), (2, 3)])
def test_jaccard_join(spark, rare, region):
    """rare 2 gives nearly all landmarks to the salted join, region 3 splits nearly all regions by Voronoi pivots, several times."""
    rng = random.Random(4)
    texts = list(ODD)
    for _ in range(6):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 12, 60, 150]))]
        for _ in range(rng.randint(2, 14)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"v{rng.randint(0, 9)}"
            texts.append(" ".join(own[: len(own) - rng.randint(0, 3)]))
    shared = " ".join(f"s{i}" for i in range(30))
    texts += [f"{shared} {' '.join(f'q{rng.randint(0, 999)}' for _ in range(k % 9))}" for k in range(25)]
    ids = [*range(1000, 1000 - len(texts) + 3, -1), None, None, 990]
    got = jaccard_join.jaccard_components(docs(spark, texts, ids).repartition(4), rare=rare, region=region)
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_jaccard(texts, ids)
    if rare == 2:
        assert jaccard_join.jaccard_report(docs(spark, [])).count() == 0
        df = docs(spark, ["a b c d e f", "a b c d e f", "z y", None, ""], [9, 4, None, 4, 4])
        out = jaccard_join.one_of_each(df)
        assert out.columns == df.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(4, "a b c d e f"), (None, "z y"), (4, None), (4, "")], key=str)


def test_voronoi_windows_keep_all_links(spark):
    """Chains of documents that share one passage: one region, many components, several rounds of splitting; against brute force."""
    rng = random.Random(7)
    shared = " ".join(f"s{i}" for i in range(40))
    texts = []
    for g in range(12):
        own = [f"g{g}w{i}" for i in range(30)]
        for _ in range(8):
            own = list(own)
            for _ in range(2):
                own[rng.randrange(len(own))] = f"v{rng.randint(0, 10**6)}"
            texts.append(f"{shared} {' '.join(own)}")
    ids = list(range(len(texts)))
    got = jaccard_join.jaccard_components(docs(spark, texts, ids).repartition(3), rare=2, region=4)
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_jaccard(texts, ids)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)
        b = np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 90)).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        assert jaccard_join.apart(jaccard_join.sketch(a), jaccard_join.sketch(b)) <= len(np.setxor1d(a, b)) if len(b) else True


def test_shingles():
    s = Shingler()
    assert len(s("a b c d")) == 1 and len(s("a b c d e f")) == 2 and len(s(" \n")) == 0 and (s("A B C D E") == s("a\tb c  d e")).all() and len(s(None)) == 0


def invented(n, seed):
    """(words, labels) of n invented lines, drawn by rules that the labelled table knows nothing of: personal data in loose forms, and as many lookalikes that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[rng.integers(len(a))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda: "".join(pick(*"aeioulnrstdhmk") for _ in range(rng.integers(2, 9)))
    out = []
    for _ in range(n):
        filler = lambda k: [(w.capitalize() if rng.random() < 0.15 else w) + pick("", "", "", ".", ",") for w in (letters() for _ in range(k))]
        form = rng.integers(13)
        kind, middle = "O", ""
        if form == 0:
            kind, middle = "email", f"{letters()} at {letters()} dot {pick('com', 'org', 'net')}"
        elif form == 1:
            kind, middle = "email", f"{letters()}.{letters()} at {letters()}{digits(1)} dot {pick('com', 'org', 'net')}"
        elif form == 2:
            kind, middle = "phone", f"({digits(3)}) {digits(3)}-{digits(4)}"
        elif form == 3:
            kind, middle = "phone", f"{digits(3)}-{digits(3)}-{digits(4)}"
        elif form == 4:
            kind, middle = "national_id", f"{digits(3)}-{digits(2)}-{digits(4)}"
        elif form == 5:
            middle = f"{digits(4)}-{digits(2)}-{digits(2)}"
        elif form == 6:
            middle = pick(f"{digits(1)}.{digits(1)}", f"version {digits(1)}.{digits(1)}.{digits(2)}", f"{digits(2)}%", f"({digits(4)})", f"{digits(3)}-{digits(3)}")
        elif form == 7:
            middle = pick(digits(rng.integers(1, 20)), f"{digits(2)} {digits(3)} {digits(2)}", f"{digits(3)}.{digits(2)}.{digits(3)}.{digits(2)}")
        elif form == 8:
            middle = pick(f"{letters()} at {digits(1)} dot", f"at {letters()} {digits(2)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"{letters()}.{digits(2)}@{letters()}.com", f"@{letters()}")
        elif form == 9:
            middle = f"{letters()} = \"{''.join(pick(*'0123456789abcdef') for _ in range(40))}\""
        elif form == 10:
            middle = pick(f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", f"{digits(2)}-{digits(2)}-{digits(4)}")
        elif form == 11:
            middle = pick(f"{digits(1)}-{digits(1)}", f"{digits(3)}-{digits(2)}", f"{digits(4)}-{digits(3)}-{digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}-{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}")
        before, after = " ".join(filler(rng.integers(0, 6))), " ".join(filler(rng.integers(0, 6)))
        words, labels = pii.WORD.findall(before), []
        labels = ["O"] * len(words)
        own = pii.WORD.findall(middle)
        words += own
        labels += ["O"] * len(own) if kind == "O" else [f"B-{kind}", *[f"I-{kind}"] * (len(own) - 1)]
        rest = pii.WORD.findall(after)
        out.append((words + rest, labels + ["O"] * len(rest)))
    return [x for x in out if x[0]]


def test_pii_base_and_field(spark):
    text = "mail a.b@c.com, +1 (771) 555-1655 and 224.145.138.68 or 999.1.1.1; card 4111 1111 1111 1111 not 4111111111111112"
    base, more = pii.find([text])[0]
    assert [(text[a:b], k) for a, b, k in base] == [("a.b@c.com", "email"), ("+1 (771) 555-1655", "phone"), ("224.145.138.68", "ip"), ("4111 1111 1111 1111", "card")]
    held_out = invented(400, 77)
    got = pii.model().decode([[pii.shape(w) for w in words] for words, _ in held_out])
    assert sum([pii.LABELS[i] for i in g] == y for g, (_, y) in zip(got, held_out, strict=True)) >= 0.95 * len(held_out)
    loose = pii.find(["my number is 123-45-6789 ok", "nothing here at all", "version 1.2.3 of 2024-01-02"])
    assert [k for _, _, k in loose[0][1]] == ["national_id"] and loose[1] == ([], []) and loose[2] == ([], [])
    rows = {r.doc_id: r for r in pii.pii_report(docs(spark, [*ODD, text])).collect()}
    assert rows[len(ODD)].n_card == 1 and rows[0].spans == "" and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.pii_report(docs(spark, [])).count() == 0


def test_pii_base_spans_equal_the_patterns():
    """The linear searches against the fixed patterns, on random texts."""

    def naive(t):
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        out = [(m.start(), m.end(), "email") for m in re.finditer(pii.EMAIL, t)]
        out += [(m.start(), m.end(), "ip") for m in re.finditer(pii.IP, t) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [(m.start(), m.end(), "card") for m in re.finditer(pii.CARD, t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        out += [(m.start(), m.end(), "phone") for m in re.finditer(pii.PHONE, t) if 10 <= len(digits(m)) <= 15]
        return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))

    rng = random.Random(12)
    parts = ["@", "a", "b-c", ".", "..", "%", "é", " ", "  ", "-", "+", "(", ")", "1", "22", "256", "0001", "4111111111111111", "4111 1111-1111 1111", "+1 (202) 555-0147", "x@y.z", "a.b@c-d.ef", "10.0.0.1", "\n", "@@", ".com"]
    found = 0
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == naive(t), t
        found += len(naive(t))
    assert found > 3000


@pytest.mark.parametrize("run", ["1", "a", "1.", "a.", "@", "a@", "+1", "1 ", "-", "+1 ", "a@b", "1-"])
def test_pii_long_runs(run):
    """A megabyte of one run: seconds."""
    began = time.time()
    pii.find([run * (1_000_000 // len(run)) + " .", run * 200_000 + " @"])
    assert time.time() - began < 20


def test_pii_gradients_are_those_of_the_likelihood():
    from atomweave.llm.pii_table import lines

    rows = pii.Training(lines(pii.WORD, times=1)[:40])
    rng = np.random.default_rng(2)
    p = [rng.standard_normal((len(rows.index), len(pii.LABELS))) * 0.1, rng.standard_normal((len(pii.LABELS),) * 2) * 0.3, rng.standard_normal(len(pii.LABELS)) * 0.3]
    grads = rows.likelihood(*p, l2=0.01)[1]
    for v, g in zip(p, grads, strict=True):
        for at in rng.integers(0, v.size, 12):
            held = v.flat[at]
            v.flat[at] = held + 1e-5
            up = rows.likelihood(*p, l2=0.01)[0]
            v.flat[at] = held - 1e-5
            down = rows.likelihood(*p, l2=0.01)[0]
            v.flat[at] = held
            assert abs((up - down) / 2e-5 - g.flat[at]) < 1e-5


def test_pii_field_reads_whole_lines(spark):
    far = "la mi no " * 40
    texts = ["write to alice at example dot com", f"{far}alice at example dot com {far}", f"{far}\n\nalice at example dot com\n{far}7", "", "\n", "HEA ONONAT TO THE ANOR ERONNTEN ONNT " * 9]
    found = [[t[a:b] for a, b, _ in more] for t, (_, more) in zip(texts, pii.find(texts), strict=True)]
    assert found == [["alice at example dot com"]] * 3 + [[]] * 3
    assert [r.spans for r in pii.pii_report(docs(spark, texts[:1])).collect()] == ["email:9:33"]


def test_pii_labels_are_those_of_whole_sequences():
    crf, rng = pii.model(), random.Random(3)
    words = [w for ws, _ in invented(300, 5) for w in ws]
    lines = [[pii.shape(rng.choice(words)) for _ in range(rng.choice([0, 1, 2, 5, 30, 900]))] for _ in range(60)] + [[pii.shape(w) for w in words]]
    weight = lambda fs: sum(crf.emit[crf.index.get(f, -1)] for f in fs)
    for shapes, got in zip(lines, crf.decode(lines), strict=True):
        best, back = None, []
        for fs in pii.features(shapes):
            step = None if best is None else best[:, None] + crf.move
            back.append(None if step is None else step.argmax(0))
            best = (crf.start if step is None else step.max(0)) + weight(fs)
        want = [int(best.argmax())] if shapes else []
        for b in back[:0:-1]:
            want.append(int(b[want[-1]]))
        assert got == want[::-1]


def _says(tree, last, most):
    """A text that a parsed regex matches: its first or last branches, its optional parts left out or taken."""
    out = ""
    for op, v in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(v)
        elif op == "IN":
            out += chr(v[0][1] if str(v[0][0]) == "LITERAL" else v[0][1][0])
        elif op == "BRANCH":
            out += _says(v[1][-1 if last else 0], last, most)
        elif op == "SUBPATTERN":
            out += _says(v[3], last, most)
        elif op == "MAX_REPEAT":
            out += _says(v[2], last, most) * (min(v[1], 3) if most else v[0])
        else:
            assert op == "ASSERT_NOT"
    return out


def test_license_rules_each_alone(spark):
    """Every rule finds its own signatures through scan, and no keyword gate loses one."""
    rules = license_scan.rules()
    assert len(rules) > 200 and len({r[4] for r in rules}) == len(rules)
    own = []
    for label, keys, _, _, regex in rules:
        for last in (False, True):
            for most in (False, True):
                text = _says(re._parser.parse(regex), last, most)
                assert re.fullmatch(regex, text) and set(keys.split()) & set(text.split()), (regex, text)
                own.append((label, text))
    own += [("apache-2", "Released under Apache 2.0"), ("mit", "Released under the MIT."), ("bsd-3", "Distributed under BSD 3 clause"), ("zlib", "published under the zlib"), ("apache-2", "terms of Apache 2.0"), ("public-domain", "released into the public\ndomain"), ("gpl-3", "GNU General Public License v3"), ("gpl-3", "GPLv3"), ("eupl-1.2", "Published under EUPL 1.2"), ("0bsd", "zero-clause BSD licensed"), ("mpl-2", "published under MPL 2.0")]
    rows = {r.doc_id: r for r in license_scan.scan(docs(spark, [f"x, {t}\ny" for _, t in own])).collect()}
    lost = [(label, t, rows[i].labels) for i, (label, t) in enumerate(own) if label not in rows[i].labels.split(",") or rows[i].score == 0]
    assert lost == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def naive_licenses(text):
    """(n_words, base places, spans that stand) of a text, by comparing every detection with every other."""
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    norm, found = f" {' '.join(w)} ", []
    for at, (label, _, prio, score, regex) in enumerate(license_scan.rules()):
        for m in re.finditer(f"(?<= )(?:{regex})(?= )", norm):
            s = norm[: m.start()].count(" ") - 1
            found.append((s, s + m[0].count(" ") + 1, prio, at, label, score))
    inside = lambda d, o: o[0] <= d[0] and d[1] <= o[1] and (o[2] > d[2] or (o[2] == d[2] and ((o[1] - o[0]) > (d[1] - d[0]) or o[3] < d[3])))
    return len(w), places, sorted((d[4], d[0], d[1], d[5]) for d in found if not any(inside(d, o) for o in found if o is not d))


def test_license_scan(spark):
    rng = random.Random(8)
    pool = [_says(re._parser.parse(r[4]), rng.random() < 0.5, rng.random() < 0.5) for r in license_scan.rules()]
    parts = [*pool, *"under the mit license;licensed;Apache License, Version 2;CC-BY-NC;GNU;general public;v3;2.0;only;é;x;\n;the terms of;MIT/X11;gpl".split(";")]
    texts = [*ODD, "Released under the MIT license. under the mit-license; Under The MIT License", "Licensed under the Apache License, Version 2.0. See CC BY-NC 4.0, cc by nc sa", "This work is licensed under the GNU General Public License, version 3", "permit mitre account", "All rights reserved.", "under the mit license " * 300]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(250)]
    n = len(ODD)
    rows = {r.doc_id: r for r in license_scan.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n_words, places, spans = naive_licenses(t)
        at, r = [k for k, _ in places], rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n_words, len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert sorted((s.label, s.start, s.end) for s in r.spans) == [x[:3] for x in spans], t
        assert r.labels == ",".join(sorted({x for _, x in places} | {x[0] for x in spans}))
        assert r.score == max([x[3] for x in spans] + [0.9] * bool(places) + [0.0])
    assert rows[n + 2].labels == "gpl-3" and rows[n + 3].labels == "" and rows[n + 3].score == 0 and rows[n + 4].labels == "all-rights-reserved"
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_license_scan_is_linear(spark):
    """1 MB of one phrase, and of one word: seconds a text, not minutes."""
    small, big = "under the mit license " * 100, "under the mit license " * 48_000
    license_scan.scan(docs(spark, [small])).collect()
    began = time.time()
    r = license_scan.scan(docs(spark, [big, "a" * 1_000_000, "gpl " * 250_000])).orderBy("doc_id").collect()
    assert time.time() - began < 30 and r[0].n_base == 48_000 and len(r[0].spans) == 48_000


def test_license_base_columns_in_sql(spark):
    import duckdb
    from conftest import SF

    sql = r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p(phrase, label) AS (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')),
        x AS (SELECT doc_id, label, unnest([i FOR i IN range(0, len(w)) IF w[i + 1 : i + len(phrase)] = phrase]) AS i FROM w, p)
        SELECT w.doc_id, len(any_value(w.w)) AS n_words, count(x.i) AS n_base, min(x.i) AS first_word, max(x.i) AS last_word,
               coalesce(array_to_string(list_sort(list_distinct(list(x.label) FILTER (WHERE x.label IS NOT NULL))), ','), '') AS base_labels
        FROM w LEFT JOIN x USING (doc_id) GROUP BY w.doc_id ORDER BY 1"""
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = license_scan.scan(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").orderBy("doc_id")
    assert [tuple(r) for r in got.collect()] == con.sql(sql).fetchall()


def split(budget, children):
    """Budget among (weight, capacity) by weight, round after round: what a full child cannot take is dealt again."""
    got, open_ = [0.0] * len(children), [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    left = budget
    while open_ and left > 1e-9:
        total = sum(children[i][0] for i in open_)
        full = [i for i in open_ if got[i] + left * children[i][0] / total >= children[i][1]]
        if not full:
            for i in open_:
                got[i] += left * children[i][0] / total
            return got
        left -= sum(children[i][1] - got[i] for i in full)
        for i in full:
            got[i] = children[i][1]
        open_ = [i for i in open_ if i not in full]
    return got


def naive_budgets(leaves, weights, total):
    usable = lambda path: sum(c for p, c in leaves.items() if p[: len(path)] == path and all(weights.get(p[:k], 1.0) > 0 for k in range(len(path) + 1, 4)))
    out = {}

    def down(path, budget):
        if len(path) == 3:
            out[path] = budget
            return
        names = sorted({p[: len(path) + 1] for p in leaves if p[: len(path)] == path})
        for child, own in zip(names, split(budget, [(weights.get(c, 1.0), usable(c)) for c in names]), strict=True):
            down(child, own)

    down((), min(total, usable(())))
    return out


def test_budgets_redistribute_among_siblings_first(spark):
    def got(leaves, weights, total):
        df = spark.createDataFrame([(*k, v, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens double, holds double")
        return {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, weights, total).collect()}

    leaves = {("a", "x", "1"): 1.0, ("a", "x", "2"): 100.0, ("a", "y", "1"): 100.0, ("b", "x", "1"): 100.0}
    assert got(leaves, {}, 80) == {("a", "x", "1"): 1, ("a", "x", "2"): 19, ("a", "y", "1"): 20, ("b", "x", "1"): 40}
    assert got({}, {}, 5) == {}
    rng = random.Random(3)
    for _ in range(2):
        leaves = {(f"d{rng.randint(0, 3)}", f"l{rng.randint(0, 4)}", f"s{i}"): float(rng.choice([0, 1, 5, 60, 500, 7000])) for i in range(60)}
        weights = {p[: rng.randint(1, 3)]: rng.choice([0.0, 0.1, 2.0, 30.0]) for p in leaves if rng.random() < 0.4}
        total = rng.random() * sum(leaves.values())
        want, own = naive_budgets(leaves, weights, total), got(leaves, weights, total)
        assert own.keys() == want.keys() and all(abs(own[k] - want[k]) < 1e-6 * (1 + want[k]) for k in want)


def test_mixing(spark):
    """Budgets against the naive ones, and every leaf's token-prefix replayed by brute force."""
    rng = random.Random(6)
    texts = [" ".join("w" for _ in range(rng.randint(0, 30))) for _ in range(200)] + ODD
    df, weights = docs(spark, texts), {("even",): 3.0, ("odd", "en", "src1"): 0.2}
    rows = mixing.mix(df, weights, fraction=0.9, epochs=3, seed=5).collect()
    assert len(rows) == len(texts) and {r.id: r.n_tokens for r in rows} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    leaves = {}
    for r in rows:
        leaves.setdefault((r.domain, r.lang, r.source), []).append(r)
    sizes = {k: sum(r.n_tokens for r in v) for k, v in leaves.items()}
    want = naive_budgets({k: 3.0 * v for k, v in sizes.items()}, weights, 0.9 * sum(sizes.values()))
    parts = 0
    for k, v in leaves.items():
        budget = v[0].budget
        assert abs(budget - want[k]) < 1e-6 * (1 + want[k])
        whole = int(budget / sizes[k])
        order = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(5), F.lit(whole), F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))).alias("h")).collect()}
        left, copies = budget - whole * sizes[k], {}
        for r in sorted(v, key=lambda r: order[r.id]):
            copies[r.id] = whole + (left > 0)
            parts += left > 0
            left -= r.n_tokens
        assert {r.id: r.copies for r in v} == copies
    assert parts > 0
    out = mixing.mixed(df, weights=weights, fraction=0.9, epochs=3, seed=5)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(r.id for r in rows for _ in range(r.copies))
    assert mixing.mixed(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0
    again = mixing.mix(df.repartition(7), weights, fraction=0.9, epochs=3, seed=5).collect()
    assert {r.id: r.copies for r in again} == {r.id: r.copies for r in rows}


def test_quality(spark):
    from conftest import SF

    d = SF.replace("0.001", "0.01")
    r = quality.quality_report(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    own = r.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(own) > 80 and sum(x.predicted == x.quality for x in own) >= 0.95 * len(own)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    rows = quality.quality_report(docs(spark, ODD), labels).collect()
    assert len(rows) == len(ODD) and all(x.score == 0.5 for x in rows)
    assert all((zlib.crc32(str(x.doc_id).encode()) % 3 == 1) == x.held_out for x in rows)
    many = spark.createDataFrame([(i, i % 2) for i in range(len(ODD))], "doc_id long, quality int")
    df = docs(spark, ODD)
    assert quality.keep_good(df, many).columns == df.columns and quality.quality_report(docs(spark, []), many).count() == 0


def test_attention_gradients():
    """Against finite differences, bags of one to five passages."""
    rng = np.random.default_rng(4)
    sizes = np.array([1, 5, 3, 2])
    x, y, w = rng.standard_normal((11, 7)), np.array([1.0, 0, 1, 0]), rng.uniform(0.5, 1.5, 4)
    m = quality.Attention(7, d=5, a=4)
    _, grads = m.gradients(x, sizes, y, w, 0.01)
    for k, g in grads.items():
        for at in range(np.size(g)):
            held = np.array(m.p[k], float)
            diff = []
            for e in (1e-6, -1e-6):
                v = held.copy()
                v.flat[at] += e
                m.p[k] = v
                diff.append(m.gradients(x, sizes, y, w, 0.01)[0])
            m.p[k] = held
            assert abs((diff[0] - diff[1]) / 2e-6 - np.ravel(g)[at]) < 1e-6


def test_word_identity_reaches_the_score():
    """Bags that differ by one word's identity alone, of equal form."""
    texts = ["lorem dolor amet elits " * 30 + ("magna" if i % 2 else "felis") * 1 + " tempo nulla" for i in range(40)] * 3
    texts = [t if k % 3 else "sedes " * (k % 50) + t for k, t in enumerate(texts)]
    y = np.array([float("magna" in t) for t in texts])
    x, sizes = quality.PassageFeatures()(texts)
    m = quality.Attention(quality.WIDTH).fit(x, sizes, y)
    assert ((m.score(x, sizes) >= 0.5) == y).mean() >= 0.95


def test_features_do_not_depend_on_the_cache():
    texts = ["a B!! c| 12 " * 40, "", "é é é", "x"]
    x, n = quality.PassageFeatures()(texts)
    make = quality.PassageFeatures(cache=1)
    for _ in range(2):
        y, m = make(texts)
        assert (x == y).all() and (n == m).all()
    assert n.tolist() == [4, 1, 1, 1]


def test_token_files_search_plain_pieces_together(monkeypatch):
    """Plain pieces are searched a thousand at a time; those with others among them get the ids that each gets by itself."""
    from atomweave.llm import token_files
    from atomweave.llm.queries import tokenizer_path

    calls, own = [], token_files.beyond
    monkeypatch.setattr(token_files, "beyond", lambda text: calls.append(text) or own(text))
    encoder = token_files.LibraryEncoder(tokenizer_path(), 10)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    got = encoder.encode(plain)
    assert len(calls) == 3
    mixed = ["plain", "\u4f60\u597d", "<|", "a<|b", "\u0142\u00f3d\u017a", "last"]
    one = lambda p: np.array(encoder.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode(mixed) == [one(p) for p in mixed] and encoder.encode(mixed[1:3]) == [one(p) for p in mixed[1:3]]
    assert got[::100] == [one(p) for p in plain[::100]] and encoder.encode([]) == []
