"""BPE encoding and decoding with a pair occurrence index.

Texts are cut at blanks and line feeds into chunks; no normalisation, pre-token or merge crosses them. The distinct
pre-tokens of a batch that are not encoded yet lie end to end in one array of symbols, linked to their neighbours. An index
maps each mergeable pair (by its rank) to all its positions in that array; active ranks are taken in ascending order from a
heap, all positions of the rank merge at once, and the pairs that arise left and right of each merge join the lists of
their own ranks.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, text_slices

#: The code points with the White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-token pattern for lower-cased texts of code points up to U+00FF, where letters and numbers are these.
LATIN = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'s|'t|'re|'ve|'m|'ll|'d|[^\t-\r \x85\xa0a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")


def beyond(text: str) -> bool:
    """Whether a text has code points above U+00FF or may hold special tokens. A text that has none is stored as Latin-1, so this is a copy, not a search."""
    if "<|" in text:
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return False


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class PieceEncoder:
    """Texts to ids by way of their distinct pieces; each piece that is not in the cache is encoded once a batch.

    Texts of code points up to U+00FF are lower-cased and cut into pre-tokens whole (normal form C changes nothing there);
    others, and those that may hold special tokens, chunk by chunk. The cache outlives a task where the Python worker does;
    it is bounded, and clearing it changes nothing but speed.
    """

    def __init__(self, cache: int):
        self.limit, self.known = cache, {}

    def pieces(self, chunk: str) -> list[str]:
        """The pieces of a chunk that the fast way does not cover."""
        raise NotImplementedError

    def encode(self, pieces: list[str]) -> list[bytes]:
        raise NotImplementedError

    def cut(self, text: str) -> list[str]:
        if not beyond(text):
            return LATIN.findall(text.lower())
        out: list[str] = []
        for chunk in text.replace("\n", " ").split(" "):
            out += LATIN.findall(chunk.lower()) if not beyond(chunk) else self.pieces(chunk)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.limit:
            self.known.clear()
        known, cut = self.known, [self.cut(t) for t in texts]
        todo = list(set().union(*cut).difference(known))
        for i in range(0, len(todo), 200_000):
            some = todo[i : i + 200_000]
            known.update(zip(some, self.encode(some), strict=True))
        return [b"".join(map(known.__getitem__, c)) for c in cut]


class PairIndexBPE(PieceEncoder):
    """A word-end BPE tokenizer file of the tokenizers library, encoded by the pair occurrence index."""

    def __init__(self, path: str, cache: int = 100_000):
        import regex
        from tokenizers import Tokenizer

        super().__init__(cache)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+")
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_alphabet()
        self.first = np.array([self.vocab[c] for c in self.letters], np.int32)
        self.last = np.array([self.vocab[c + self.suffix] for c in self.letters], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.uint64)
        right = np.array([self.vocab[b] for _, b in merges], np.uint64)
        self.made = np.array([self.vocab[a + b] for a, b in merges], np.int32)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        keys = (left << np.uint64(32)) | right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        by_id = {i: t for t, i in (self.vocab | self.special).items()}
        self.tokens = [by_id.get(i, "").encode() for i in range(max(by_id) + 1)]

    # -- the index ---------------------------------------------------------------------------------------------------
    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1 where they do not merge."""
        k = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.rank_of[at], -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers, all words merged together."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.first[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prv[ends - sizes] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(pos: np.ndarray) -> None:
            pos = pos[nxt[pos] >= 0]
            rank = self._ranks(sym[pos], sym[nxt[pos]])
            pos, rank = pos[rank >= 0], rank[rank >= 0]
            if not len(pos):
                return
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, p in zip(rank[np.r_[0, cuts]].tolist(), np.split(pos, cuts), strict=True):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)

        add(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            a, b = self.left[r], self.right[r]
            p = lists[0] if len(lists) == 1 else np.concatenate(lists)
            if len(p) > 1:
                p = np.unique(p)
            p = p[alive[p] & (sym[p] == a)]
            q = nxt[p]
            ok = q >= 0
            ok[ok] = sym[q[ok]] == b
            p, q = p[ok], q[ok]
            if a == b and len(p) > 1:  # aaa: from the left, each position once
                keep, taken = np.ones(len(p), bool), -1
                for i, (x, y) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
                    keep[i] = x != taken
                    taken = y if keep[i] else -1
                p, q = p[keep], q[keep]
            if not len(p):
                continue
            sym[p] = self.made[r]
            alive[q] = False
            after = nxt[q]
            nxt[p] = after
            has = after >= 0
            prv[after[has]] = p[has]
            before = prv[p]
            add(np.concatenate([p, before[before >= 0]]))
        ids = sym[alive].astype("<u4").tobytes()
        cut = np.r_[0, np.cumsum(np.add.reduceat(alive, ends - sizes, dtype=np.int64)) * 4].tolist()
        return [ids[x:y] for x, y in zip(cut, cut[1:], strict=False)]

    # -- texts -------------------------------------------------------------------------------------------------------
    def pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk; special tokens as they are."""
        out: list[str] = []
        for part in self.at_special.split(chunk):
            if part in self.special:
                out.append(part)
            else:
                out += self.split.findall(self.normalizer.normalize_str(part))
        return out

    def encode(self, pieces: list[str]) -> list[bytes]:
        ids = {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        plain = [p for p in pieces if p not in ids]
        ids.update(zip(plain, self.merge([p.encode() for p in plain]), strict=True))
        return [ids[p] for p in pieces]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens joined by blanks, as the library decodes where the file names no decoder; unknown ids are left out."""
        known, n = self.tokens, len(self.tokens)
        a = np.frombuffer(ids, "<u4")
        return b" ".join(map(known.__getitem__, (a if not len(a) or a.max() < n else a[a < n]).tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids binary, decoded string) of each row: ids are little-endian unsigned 32-bit integers.

    One pass without a shuffle; rows repeat as they do in docs. Null texts count as empty and give no ids; null ids stay null.
    """
    import pyarrow as pa

    def run(batches):
        bpe = load(tokenizer_path)
        for b in batches:
            for i, j, texts in text_slices(b.column(1)):
                ids = bpe.encode_batch(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(ids, pa.binary()), pa.array([bpe.decode(x).decode() for x in ids], pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)


def token_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encode_decode returns."""
    r = encode_decode(docs, tokenizer_path)
    return r.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
