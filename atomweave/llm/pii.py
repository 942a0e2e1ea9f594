"""Personal data: base patterns, and a linear-chain conditional random field over word-shape features.

The field is trained on a small labelled table (pii_table.py, written by hand) by gradient ascent of the conditional
log-likelihood, and decoded by Viterbi in numpy batches. It reads every line of the whole text, each as one
sequence. Its labels are those of the base kinds where their form is loose (a phone number without its plus sign, an address
written out with "at" and "dot") and national id numbers.

Base spans always stay; a span of the field is added where it overlaps none of them.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, text_slices
from .pii_table import lines

#: The base kinds in order, with their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The same matches in linear time: a search starts only where a run starts (an email at its @, from which its start is read
#: backwards), and runs are not given back.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IPS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARDS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONES = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[^0-9]")
NUMBER = re.compile(r"[0-9]")

#: Labels of the field: O, then begin and inside of each kind.
EXTRA = ("email", "phone", "national_id")
LABELS = ["O", *(f"{p}-{k}" for k in EXTRA for p in "BI")]
#: Fixed value: places of stretches decoded at once, but for a longer stretch.
CELLS = 200_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    """(start, end) of the email pattern's matches: at each @, the longest run of address characters before it since the last match."""
    at, done = text.find("@"), 0
    while at >= 0:
        head = text[done:at]
        start = at - (len(head) - len(head.rstrip(LOCAL)))
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns in code points: leftmost non-overlapping matches of each kind, those that fail its test dropped."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if NUMBER.search(text) is None:
        return out
    if "." in text:
        out += [(m.start(), m.end(), "ip") for m in IPS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARDS.finditer(text):
        if 14 <= m.end() - m.start() <= 37:  # 19 digits and 18 marks between them
            d = DIGIT.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONES.finditer(text) if 10 <= len(DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# -- features ----------------------------------------------------------------------------------------------------------------
WORD = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
#: Words that the field may know by themselves, as they link or announce personal data.
CUES = ("at", "dot", "phone", "tel", "call", "ssn", "social", "security", "email", "mail", "mobile", "fax", "com", "org", "net", "insurance")


#: Every value of shape(), and what features() puts beside the ends of a line.
SHAPES = {"^2", "^1", "$1", "$2", "o", *"()+-./@_#:,", *(f"d{n}" for n in range(1, 13)), *(f"w={c}" for c in CUES), *(a + b for a in ("X", "Xx", "x") for b in "13n")}


@lru_cache(maxsize=200_000)
def shape(word: str) -> str:
    """What the field sees of a word: a cue itself, digits by their count, letters by case and size class, others themselves."""
    if word.isdigit():
        return f"d{min(len(word), 12)}"
    low = word.lower()
    if low in CUES:
        return f"w={low}"
    if word.isalpha():
        return ("X" if word.isupper() else "Xx" if word[0].isupper() else "x") + ("1" if len(word) < 2 else "3" if len(word) < 4 else "n")
    return word if word in "()+-./@_#:," else "o"


def features(shapes: list[str]) -> list[list[str]]:
    """Of each place: the shapes from two before to two after it, and the pairs beside it."""
    s = ["^2", "^1", *shapes, "$1", "$2"]
    return [[f"0{s[i]}", f"-1{s[i - 1]}", f"+1{s[i + 1]}", f"-2{s[i - 2]}", f"+2{s[i + 2]}", f"-1{s[i - 1]}|0{s[i]}", f"0{s[i]}|+1{s[i + 1]}", f"-1{s[i - 1]}|+1{s[i + 1]}"] for i in range(2, len(s) - 2)]


# -- the field ---------------------------------------------------------------------------------------------------------------
class CRF:
    """Weights of (feature, label) and (label, label); index -1 (a feature unseen in training) weighs nothing."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.index, self.move, self.start = index, move, start
        self.emit = np.vstack([emit, np.zeros((1, emit.shape[1]))])
        self.held = self.words = None

    def tables(self) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the shapes, and the weights of a shape two before, of one two after, and of the three around a place by their ids."""
        if self.held is None:
            names = sorted(SHAPES)
            ids = {x: i for i, x in enumerate(names)}
            of = lambda form: self.emit[[self.index.get(form(x), -1) for x in names]]
            pair = lambda form: self.emit[[self.index.get(form(x, y), -1) for x in names for y in names]].reshape(len(names), len(names), -1)
            around = of(lambda x: f"-1{x}")[:, None, None] + of(lambda x: f"0{x}")[None, :, None] + of(lambda x: f"+1{x}")[None, None]
            around = around + pair(lambda x, y: f"-1{x}|0{y}")[:, :, None] + pair(lambda x, y: f"0{x}|+1{y}")[None] + pair(lambda x, y: f"-1{x}|+1{y}")[:, None]
            self.held = ids, of(lambda x: f"-2{x}"), of(lambda x: f"+2{x}"), around.reshape(len(names) ** 3, -1)
        return self.held

    def codes(self) -> Codes:
        """Ids of the shapes of words, kept."""
        if self.words is None:
            self.words = Codes(self.tables()[0])
        return self.words

    def scores(self, flat: np.ndarray) -> np.ndarray:
        """Of each place and label, of ids of shapes; nothing for the two places at either end."""
        ids, before, after, around = self.tables()
        out = np.zeros((len(flat), len(LABELS)))
        if len(flat) > 4:
            out[2:-2] = around[(flat[1:-3] * len(ids) + flat[2:-2]) * len(ids) + flat[3:-1]]
            out[2:-2] += before[flat[:-4]]
            out[2:-2] += after[flat[4:]]
        return out

    def labels(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best labels of sequences that follow each other, each with its two shapes of padding at either end, which get O.

        Viterbi runs where a label beside O may pay. A stretch of other labels in place of O gains at most the sum of bounds of
        its places; a place is O for sure where no stretch through it reaches zero. The labels are those of whole sequences.
        """
        e, out = self.scores(flat), np.zeros(len(flat), np.int8)
        first = np.cumsum(sizes + 4) - sizes - 2
        first, last = first[sizes > 0], (first + sizes - 1)[sizes > 0]
        into = self.move.max(0) - self.move[0, 0]
        gain = e[:, 1:] - e[:, :1]
        bound = (gain + into[1:]).max(1)
        bound[first] = np.maximum(bound[first], (gain[first] + (self.start - self.start[0])[1:]).max(1))
        leave = max(0.0, (self.move[1:, 0] - self.move[0, 0]).max())
        inside = np.ones(len(flat), bool)
        pad = np.cumsum(sizes + 4)
        for k in (pad - sizes - 4, pad - sizes - 3, pad - 2, pad - 1):
            inside[k] = False
        bound[~inside] = -1e3  # no stretch goes on into another sequence
        total = np.cumsum(bound)
        most = np.maximum.accumulate(total[::-1])[::-1] - np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
        open_ = inside & (most + leave > -1e-3)
        edge = np.diff(np.concatenate([[0], open_.view(np.int8), [0]]))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        starts, ends = np.isin(lo, first), np.isin(hi - 1, last)
        order = np.argsort(hi - lo, kind="stable")
        at = 0
        while at < len(order):
            long = (hi - lo)[order[at:]]
            to = at + max(1, int(np.searchsorted(long * np.arange(1, len(long) + 1), CELLS, "right")))
            some, at = order[at:to], to
            size = (hi - lo)[some]
            step = np.arange(size[-1])
            best = self.forward(e[lo[some, None] + np.minimum(step, size[:, None] - 1)], size, np.where(starts[some, None], self.start, self.move[0]))
            paths = self.backward(best, size, (best[:, -1] + np.where(ends[some, None], 0, self.move[:, 0])).argmax(1))
            own = step < size[:, None]
            out[(lo[some, None] + step)[own]] = paths[own]
        return out

    def forward(self, e: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Scores of the best path to each label of each place of padded sequences, shortest first; past its end a sequence keeps its last."""
        best = np.empty_like(e)
        best[:, 0] = now = e[:, 0] + start
        for t in range(1, e.shape[1]):
            step = (now.T[:, :, None] + self.move[:, None, :]).max(0) + e[:, t]
            now = step if t < sizes[0] else np.where((t < sizes)[:, None], step, now)
            best[:, t] = now
        return best

    def backward(self, best: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The labels of the best paths that end in last."""
        paths = np.empty(best.shape[:2], np.int8)
        for t in range(best.shape[1] - 1, -1, -1):
            paths[:, t] = last
            if t:
                last = np.where(t < sizes, (best[:, t - 1] + self.move.T[last]).argmax(1), last)
        return paths

    def decode(self, sequences: list[list[str]]) -> list[list[int]]:
        """Best labels of each sequence of shapes."""
        ids, sizes = self.tables()[0], np.array([len(s) for s in sequences], np.int64)
        flat = np.fromiter((ids[x] for s in sequences for x in ("^2", "^1", *s, "$1", "$2")), np.int64)
        out = self.labels(flat, sizes)
        return [out[b - n - 2 : b - 2].tolist() for n, b in zip(sizes, np.cumsum(sizes + 4), strict=True)]


class Codes(dict):
    """Ids of the shapes of words, by word; ends of lines are words of their own."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids
        self.ends = {x: ids[x] for x in ("^2", "^1", "$1", "$2")}
        self.update(self.ends)

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
            self.update(self.ends)
        v = self[word] = self.ids[shape(word)]
        return v


class Training:
    """The labelled rows as arrays: distinct feature rows of all places, padded places of each row, and what the true labels count."""

    def __init__(self, table: list[tuple[list[str], list[str]]]):
        rows = [(features([shape(w) for w in words]), [LABELS.index(x) for x in labels]) for words, labels in table if words]
        self.index: dict[str, int] = {}
        kinds: dict[tuple[int, ...], int] = {}
        places = [[kinds.setdefault(tuple(self.index.setdefault(x, len(self.index)) for x in f), len(kinds)) for f in fs] for fs, _ in rows]
        self.kinds, k = np.array(list(kinds)), len(LABELS)
        self.sizes = np.array([len(y) for _, y in rows])
        self.at, y = np.zeros((2, len(rows), self.sizes.max()), int)
        for i, (own, (_, ys)) in enumerate(zip(places, rows, strict=True)):
            self.at[i, : len(own)], y[i, : len(ys)] = own, ys
        self.mask = np.arange(y.shape[1]) < self.sizes[:, None]
        gold = np.bincount(self.at[self.mask] * k + y[self.mask], minlength=len(kinds) * k).reshape(-1, k).astype(float)
        inner = self.mask[:, 1:]
        move = np.bincount(y[:, :-1][inner] * k + y[:, 1:][inner], minlength=k * k).reshape(k, k).astype(float)
        self.gold = self.spread(gold), move, np.bincount(y[:, 0], minlength=k).astype(float)

    def spread(self, of_kinds: np.ndarray) -> np.ndarray:
        """Sums over feature rows, by feature."""
        width = self.kinds.shape[1]
        return np.stack([np.bincount(self.kinds.ravel(), np.repeat(c, width), len(self.index)) for c in of_kinds.T], 1)

    def likelihood(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray, l2: float = 0.0) -> tuple[float, list[np.ndarray]]:
        """Mean conditional log-likelihood less the penalty, and its gradients; forward and backward in scaled probabilities."""
        n, size, k = *self.at.shape, len(LABELS)
        e = emit[self.kinds].sum(1)[self.at]
        top = e.max(2, keepdims=True)
        e = np.exp(e - top)
        a, scale = np.exp(move), np.ones((size, n, 1))
        alpha, beta = np.empty((size, n, k)), np.ones((size, n, k))
        for t in range(size):
            now = e[:, t] * (np.exp(start) if t == 0 else alpha[t - 1] @ a)
            scale[t] = now.sum(1, keepdims=True)
            alpha[t] = now / scale[t]
        for t in range(size - 2, -1, -1):
            back = (e[:, t + 1] * beta[t + 1] / scale[t + 1]) @ a.T
            beta[t] = np.where((t + 1 < self.sizes)[:, None], back, 1)
        p = (alpha * beta).transpose(1, 0, 2) * self.mask[..., None]
        pairs = np.zeros((k, k))
        for t in range(1, size):
            on = t < self.sizes
            pairs += alpha[t - 1][on].T @ (e[on, t] * beta[t][on] / scale[t][on])
        expected = np.stack([np.bincount(self.at[self.mask], c, len(self.kinds)) for c in p[self.mask].T], 1)
        gold_e, gold_m, gold_s = self.gold
        grads = [(gold_e - self.spread(expected)) / n - l2 * emit, (gold_m - pairs * a) / n - l2 * move, (gold_s - p[:, 0].sum(0)) / n - l2 * start]
        total = (gold_e * emit).sum() + (gold_m * move).sum() + (gold_s * start).sum()
        total -= ((np.log(scale[..., 0].T) + top[..., 0]) * self.mask).sum()
        return total / n - l2 / 2 * sum((v * v).sum() for v in (emit, move, start)), grads


def train(table: list[tuple[list[str], list[str]]], rounds: int = 100, rate: float = 0.1, l2: float = 1e-3) -> CRF:
    """Maximum conditional likelihood by Adam over the whole table."""
    rows = Training(table)
    k = len(LABELS)
    p = [np.zeros((len(rows.index), k)), np.zeros((k, k)), np.zeros(k)]
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in p]
    for step in range(1, rounds + 1):
        for v, g, (m1, m2) in zip(p, rows.likelihood(*p, l2)[1], state, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            v += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return CRF(rows.index, *p)


@lru_cache(maxsize=1)
def model() -> CRF:
    return train(lines(WORD))


#: What a stretch must hold to be of its kind: digits, or an address with its at and dot.
FORM = {"email": re.compile(r"(?is)(?:@|\bat\b).+(?:\.|\bdot\b)"), "phone": NUMBER, "national_id": NUMBER}


def _stretches(line: str, path: list[int]):
    """(start, end, kind) of the runs of words of one kind in a line's labels that hold what the kind must."""
    places = [m.span() for m in WORD.finditer(line)]
    k = 0
    while k < len(path):
        j = k + 1
        if path[k] % 2:  # a begin
            while j < len(path) and path[j] == path[k] + 1:
                j += 1
            a, b, kind = places[k][0], places[j - 1][1], LABELS[path[k]][2:]
            if FORM[kind].search(line, a, b):
                yield a, b, kind
        k = j


def find(texts: list[str], crf: CRF | None = None) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(base spans, spans the field adds) of each text."""
    crf = crf or model()
    base = [base_spans(t) for t in texts]
    lines = [t.splitlines(keepends=True) for t in texts]
    words = [WORD.findall(line) for own in lines for line in own]
    sizes = np.array([len(w) for w in words], np.int64)
    codes = chain.from_iterable(("^2", "^1", *w, "$1", "$2") for w in words)
    path = crf.labels(np.fromiter(map(crf.codes().__getitem__, codes), np.int64, sizes.sum() + 4 * len(sizes)), sizes)
    upto = np.cumsum(sizes + 4)
    hit = np.zeros(len(sizes), bool)
    hit[np.searchsorted(upto, np.flatnonzero(path), "right")] = True
    more: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    n = 0
    for i, own in enumerate(lines):
        if not hit[n : n + len(own)].any():
            n += len(own)
            continue
        at = 0
        for line in own:
            if hit[n]:
                some = path[upto[n] - sizes[n] - 2 : upto[n] - 2].tolist()
                more[i] += [(at + a, at + b, k) for a, b, k in _stretches(line, some) if all(at + b <= s or e <= at + a for s, e, _ in base[i])]
            at += len(line)
            n += 1
    return list(zip(base, more, strict=True))


def spans_text(spans: list[tuple[int, int, str]]) -> str:
    order = (*KINDS, "national_id")
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order.index(s[2]))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base, spans) of each row of docs: counts of base spans, and both lists as text.

    A list is kind:start:end by start, then kind, joined by commas, in code points with the end exclusive. Null and empty
    texts have no spans, an empty table gives no rows. Rows repeat as they do in docs; null ids stay null. Spans that start at
    one place come in the order of the kinds. Long texts are read whole, in linear time. Other columns of docs are not read,
    whatever their names. One pass without a shuffle.
    """
    import pyarrow as pa

    crf = model()  # trained on the driver, a few thousand weights
    crf.held = crf.words = None  # made again by each worker

    def run(batches):
        for b in batches:
            for i, j, texts in text_slices(b.column(1)):
                found = find(texts, crf)
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *counts, pa.array([spans_text(base) for base, _ in found], pa.string()), pa.array([spans_text(base + more) for base, more in found], pa.string())], ["id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string").withColumnRenamed("id", id_col)


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row of docs."""
    return scan(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
