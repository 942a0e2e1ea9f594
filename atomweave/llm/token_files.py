"""Token-id files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level k holds the k-th chunk of every id that has one, in order, and a
continuation bitmap says which ids go on to level k + 1; the rank directory counts the set bits before every block of 512.
Token i is then read without decoding a block: its chunk at level 0, and while its bit is set, the rank of the bit gives its
place in the next level.

A file (all integers little-endian): magic, header length, header (JSON: documents, tokens, levels with the offset and length
of codes, bits and ranks), document ids (int64), null marks (uint8), token offsets (uint64, one more than documents), then
the levels. Files are written in ascending document id; their names carry that order.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import PieceEncoder, beyond
from .common import lean, partitions, shared_path, text_slices

MAGIC = b"ADAC0001"
BLOCK = 512
POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_levels(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """(codes, bits, ranks) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        codes, more = (rest & np.uint32(255)).astype(np.uint8), rest > 255
        bits = np.packbits(more, bitorder="little")
        counts = POP[np.pad(bits, (0, -len(bits) % (BLOCK // 8)))].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])
        levels.append((codes.tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(8)


def pack(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One file's bytes; ids: per document little-endian unsigned 32-bit integers."""
    counts = np.array([len(x) // 4 for x in ids], np.uint64)
    starts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])
    body = [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), starts.astype("<u8").tobytes()]
    levels, at = [], 0
    for level in encode_levels(np.frombuffer(b"".join(ids), "<u4")):
        spans = []
        for part in level:
            spans.append([at, len(part)])
            at += len(part)
            body.append(part)
        levels.append(spans)
    head = json.dumps({"docs": len(doc_ids), "tokens": int(starts[-1]), "levels": levels}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *body])


class TokenFile:
    """Random access to a file through read_at(offset, length)."""

    def __init__(self, read_at):
        self.read_at = read_at
        top = read_at(0, 16)
        if top[:8] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(top[8:], "little")
        head = json.loads(read_at(16, size))
        self.n_docs, self.n_tokens, self.levels = head["docs"], head["tokens"], head["levels"]
        at = 16 + size
        self.doc_ids = np.frombuffer(read_at(at, 8 * self.n_docs), "<i8")
        self.nulls = np.frombuffer(read_at(at := at + 8 * self.n_docs, self.n_docs), np.uint8).astype(bool)
        self.starts = np.frombuffer(read_at(at := at + self.n_docs, 8 * self.n_docs + 8), "<u8")
        self.base = at + 8 * self.n_docs + 8

    def _at(self, span, offset: int, length: int) -> bytes:
        return self.read_at(self.base + span[0] + offset, length)

    def token(self, i: int) -> int:
        """The id at place i: one byte of each level, one bit and one rank."""
        out = 0
        for k, (codes, bits, ranks) in enumerate(self.levels):
            out |= self._at(codes, i, 1)[0] << (8 * k)
            if not self._at(bits, i // 8, 1)[0] >> (i % 8) & 1:
                return out
            i = self._rank(bits, ranks, i)
        return out

    def _rank(self, bits, ranks, i: int) -> int:
        """Set bits before place i."""
        block = i // BLOCK
        before = int.from_bytes(self._at(ranks, 8 * block, 8), "little")
        own = np.frombuffer(self._at(bits, block * BLOCK // 8, -(-(i % BLOCK) // 8)), np.uint8)
        return before + int(np.unpackbits(own, bitorder="little")[: i % BLOCK].sum())

    def tokens(self, i: int, j: int) -> np.ndarray:
        """The ids at places i to j - 1."""
        out = None
        live = np.arange(j - i)
        for k, (codes, bits, ranks) in enumerate(self.levels):
            c = np.frombuffer(self._at(codes, i, j - i), np.uint8).astype(np.uint32)
            out = c if out is None else out
            if k:
                out[live] |= c << np.uint32(8 * k)
            if j == i:
                break
            more = np.unpackbits(np.frombuffer(self._at(bits, i // 8, -(-j // 8) - i // 8), np.uint8), bitorder="little")[i % 8 : i % 8 + j - i].astype(bool)
            if not more.any():
                break
            i = self._rank(bits, ranks, i)
            j, live = i + int(more.sum()), live[more]
        return out if out is not None else np.zeros(0, np.uint32)


def _store(folder: str):
    """The file system of a folder's URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


@lru_cache(maxsize=1)
def _library(path: str, cache: int):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryEncoder(path, cache)


class LibraryEncoder(PieceEncoder):
    """The tokenizers library over pre-tokens, or over chunks between blanks and line feeds.

    For word-end vocabularies that drop white space no token crosses either, so this equals encoding the whole text.
    """

    def __init__(self, path: str, cache: int):
        from tokenizers import Tokenizer

        super().__init__(cache)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def pieces(self, chunk: str) -> list[str]:
        return [chunk]

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Plain pieces go to the library a thousand at a time, joined by blanks, and are told apart by the word-end tokens. A thousand are searched for others at once, by themselves only where one is found."""
        ids = {}
        for i in range(0, len(pieces), 1000):
            some = pieces[i : i + 1000]
            if beyond(text := " ".join(some)):
                some = [p for p in some if not beyond(p)]
                text = " ".join(some)
            got = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = got.tobytes(), [0, *((np.flatnonzero(self.ends[got]) + 1) * 4).tolist()]
            ids.update(zip(some, (raw[x:y] for x, y in zip(ends, ends[1:], strict=False)), strict=True))
        for p in pieces:
            if p not in ids:
                ids[p] = array("I", self.tokenizer.encode_batch_fast([p], add_special_tokens=False)[0].ids).tobytes()
        return [ids[p] for p in pieces]


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, tokens_per_file: int = 4_000_000, n: int | None = None, cache: int = 400_000) -> DataFrame:
    """Writes the files into folder and returns their manifest (file_no, part_no, path, n_docs, n_tokens), read back from it.

    Null texts count as empty: the end id alone. Rows with the same id lie beside each other, rows with a null id first.
    Each partition of the range order writes its own files under a name made of its number alone, so that a task that runs
    again overwrites them; a file appears under its name only when complete. An empty table gives no files.
    """
    import pyarrow as pa

    spark = docs.sparkSession

    def run(batches):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        encode, end = _library(tokenizer_path, cache).encode_batch, end_id.to_bytes(4, "little")
        doc_ids, ids, total, number = [], [], 0, 0

        def flush():
            path = f"{base}/tokens-{part:06d}-{number:04d}.adac"
            with store.open_output_stream(f"{path}.{attempt}.tmp") as f:
                f.write(pack(doc_ids, ids))
            store.move(f"{path}.{attempt}.tmp", path)
            return pa.RecordBatch.from_pydict({"part_no": [part], "file_no": [number], "path": [path.rpartition("/")[2]], "n_docs": [len(doc_ids)], "n_tokens": [total]}, schema=pa.schema([("part_no", pa.int64()), ("file_no", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for b in batches:
            own = b.column(0).to_pylist()
            for i, j, texts in text_slices(b.column(1), 8_000_000):
                for d, x in zip(own[i:j], encode(texts), strict=True):
                    doc_ids.append(d)
                    ids.append(x + end)
                    total += len(x) // 4 + 1
                    if total >= tokens_per_file:
                        yield flush()
                        doc_ids, ids, total, number = [], [], 0, number + 1
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").alias("t"))
    rows = rows.repartitionByRange(n or partitions(spark), F.col("d").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("d").asc_nulls_first(), F.xxhash64("t"))
    manifest = rows.mapInArrow(lean(run), "part_no long, file_no long, path string, n_docs long, n_tokens long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document, read from the files; start counts the ids of all documents before it.

    The window runs over one row a file, not over documents.
    """
    import pyarrow as pa

    before = W.orderBy("part_no", "file_no").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches):
        store, base = _store(folder)
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{path}") as f:
                    file = TokenFile(lambda at, n, f=f: f.read_at(n, at))
                    for i in range(0, file.n_docs, 2000):
                        j = min(i + 2000, file.n_docs)
                        lo = file.starts[i:j].astype(np.int64)
                        hi = file.starts[i + 1 : j + 1].astype(np.int64)
                        own = file.tokens(int(lo[0]), int(hi[-1])).astype("<u4")
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(file.doc_ids[i:j], pa.int64(), mask=file.nulls[i:j]), pa.array(lo + start), pa.array(hi - lo), pa.array([own[x - lo[0] : y - lo[0]].tobytes() for x, y in zip(lo, hi, strict=True)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"]
                        )

    n = partitions(manifest.sparkSession)
    return files.select("path", "start").repartition(n).mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids binary")


def files_report(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files just written."""
    folder = shared_path(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, tokenizer_path, folder, end_id)
    return read_token_files(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
