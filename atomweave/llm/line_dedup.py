"""Line deduplication: range-partitioned hashes, a stream of first occurrences, keep bitmaps.

Each line's key (stripped, A-Z lower-cased) of at least min_chars code points becomes a 128-bit hash. Within a batch of
documents only the smallest document of a hash goes on as a candidate: the batch's other lines of that hash are dropped
already, so a hot line reaches its partition once a batch and not once a document. Candidates are dealt by equal ranges of
the hash and sorted by (hash, document, position); one pass over each range keeps the first document of each hash and
reports the lines of the others. The drops of a document meet in one row, as a compressed bitmap of the lines that stay;
texts are not shuffled for that. apply_bitmaps rebuilds texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, partitions, small_batches, text_slices

WHITE = " \t\n\x0b\x0c\r"
KEYS = ["d", "dn", "dh"]
MOVED = "pid int, hi long, lo long, dn int, d long, dh long, pos binary, n_lines int"


def _spans(values: np.ndarray, starts: np.ndarray):
    """A binary column: the int32 values cut at starts."""
    import pyarrow as pa

    offsets = (np.r_[starts, len(values)] * 4).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype("<i4").tobytes())])


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, int)
    new = np.zeros(n - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.r_[0, np.flatnonzero(new) + 1]


def _candidates(n: int, min_chars: int):
    import pyarrow as pa
    import xxhash

    schema = pa.schema([("pid", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("dn", pa.int32()), ("d", pa.int64()), ("dh", pa.int64()), ("pos", pa.binary()), ("n_lines", pa.int32())])
    spread = lambda h: ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)

    def part(d, dn, dh, texts):
        digest, row, pos, count = [], [], [], []
        get = xxhash.xxh3_128_digest
        for i, t in enumerate(texts):
            lines = t.split("\n")
            count.append(len(lines))
            for k, line in enumerate(lines):
                key = line.strip(WHITE)
                if len(key) >= min_chars:
                    digest.append(get(key.encode().lower()))
                    row.append(i)
                    pos.append(k)
        h = np.frombuffer(b"".join(digest), ">u8").reshape(-1, 2).astype(np.uint64).view(np.int64)
        row, pos = np.array(row, np.int64), np.array(pos, np.int32)
        order = np.lexsort((pos, row, d[row], dn[row], h[:, 1], h[:, 0]))
        h, row, pos = h[order], row[order], pos[order]
        begin = _cuts(h[:, 0], h[:, 1])
        lead = np.repeat(row[begin], np.diff(np.r_[begin, len(row)])) if len(row) else row
        first = (d[row] == d[lead]) & (dn[row] == dn[lead])
        ch, crow, cpos = h[first], row[first], pos[first]
        at = _cuts(ch[:, 0], ch[:, 1], crow)
        own = crow[at]
        yield pa.RecordBatch.from_arrays([pa.array(spread(ch[at, 0].copy())), pa.array(ch[at, 0]), pa.array(ch[at, 1]), pa.array(dn[own]), pa.array(d[own]), pa.array(dh[own]), _spans(cpos, at), pa.nulls(len(at), pa.int32())], schema=schema)
        lost = np.lexsort((pos[~first], row[~first]))
        lrow, lpos = row[~first][lost], pos[~first][lost]
        k = np.searchsorted(lrow, np.arange(len(texts)))
        none = pa.nulls(len(texts), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(spread(dh.copy())), none, none, pa.array(dn), pa.array(d), pa.array(dh), _spans(lpos, k), pa.array(np.array(count, np.int32))], schema=schema)

    def run(batches):
        for b in batches:
            d, dn, dh = (np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
            for i, j, texts in text_slices(b.column(3), 16_000_000):
                yield from part(d[i:j], dn[i:j], dh[i:j], texts)

    return run


def _stream(batches):
    """Of rows sorted by (hi, lo, dn, d): rows of documents pass, candidates of the first document of a hash go, others come out as drops."""
    import pyarrow as pa

    schema = pa.schema([("d", pa.int64()), ("dn", pa.int32()), ("dh", pa.int64()), ("n_lines", pa.int32()), ("pos", pa.binary())])
    last = None
    for b in batches:
        b = b.select(["hi", "lo", "dn", "d", "dh", "n_lines", "pos"])
        own = np.asarray(b.column(5).is_valid())
        if own.any():
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(own)) for i in (3, 2, 4, 5, 6)], schema=schema)
        c = b.filter(pa.array(~own))
        if not c.num_rows:
            continue
        hi, lo, dn, d = (c.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        begin = _cuts(hi, lo)
        lead = np.repeat(begin, np.diff(np.r_[begin, len(hi)]))
        keep_d, keep_n = d[lead].copy(), dn[lead].copy()
        if last and (hi[0], lo[0]) == last[:2]:
            run = slice(0, begin[1] if len(begin) > 1 else len(hi))
            keep_d[run], keep_n[run] = last[2:]
        last = (hi[-1], lo[-1], keep_d[-1], keep_n[-1])
        drop = (d != keep_d) | (dn != keep_n)
        if drop.any():
            yield pa.RecordBatch.from_arrays([c.column(i).filter(pa.array(drop)) for i in (3, 2, 4, 5, 6)], schema=schema)


def _bitmap(n_lines: pd.Series, drops: pd.Series) -> pd.DataFrame:
    out = []
    for n, parts in zip(n_lines, drops, strict=True):
        gone = np.unique(np.frombuffer(b"".join(parts), "<i4"))
        keep = np.ones(n, bool)
        keep[gone] = False
        out.append((len(gone), zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)))
    return pd.DataFrame(out, columns=["n_dropped", "keep"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns d, dn, dh and t beside those of docs: the id (0 for null), whether it is null, a hash of the text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"d": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "dn": F.col(id_col).isNull().cast("int"), "dh": F.xxhash64(t), "t": t})


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(d, dn, dh, n_lines, n_dropped, keep) of each distinct (id, text): keep is zlib over bits of the lines, lowest bit first.

    A null or empty text is one empty line. Rows with one id count as one document. Null ids count as one document that is
    larger than all others (d is 0 and dn is 1 there). An empty table gives no rows.
    """
    n = partitions(small_batches(docs).sparkSession)
    rows = _keyed(docs.select(id_col, text_col), id_col, text_col).select("d", "dn", "dh", "t")
    moved = rows.mapInArrow(lean(_candidates(n, min_chars)), MOVED)
    dealt = moved.repartitionById(n, F.col("pid")).sortWithinPartitions("hi", "lo", "dn", "d", "dh")
    found = dealt.mapInArrow(lean(_stream), "d long, dn int, dh long, n_lines int, pos binary")
    one = found.groupBy(*KEYS).agg(F.max("n_lines").alias("n_lines"), F.collect_list("pos").alias("drops"))
    return one.withColumn("b", F.pandas_udf(_bitmap, "struct<n_dropped:long,keep:binary>")("n_lines", "drops")).select(*KEYS, "n_lines", "b.n_dropped", "b.keep")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_lines, n_dropped, kept string) of each row of docs."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            kept = []
            for text, n, dropped, bits in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if dropped:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), bitorder="little")[:n]
                    text = "\n".join([line for line, k in zip(text.split("\n"), keep.tolist(), strict=True) if k])
                kept.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int64()), b.column(3), pa.array(kept, pa.string())], ["id", "n_lines", "n_dropped", "kept"])

    rows = _keyed(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col).select(F.col(id_col).alias("id"), "t", *KEYS).join(bitmaps, KEYS)
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select("id", "t", "n_lines", "n_dropped", "keep").mapInArrow(lean(run), f"id {kind}, n_lines long, n_dropped long, kept string").withColumnRenamed("id", id_col)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row of docs."""
    r = apply_bitmaps(docs, keep_bitmaps(docs))
    return r.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
