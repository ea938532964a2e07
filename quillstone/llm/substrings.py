"""Exact removal of long repeated byte strings.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else as well, in any document. Sorting all
suffixes of a corpus is not needed for that: every window of ``LENGTH`` bytes has an anchor, the leftmost of its
``GRAM``-byte strings with the smallest hash, and equal windows have equal anchors at equal places. Consecutive
windows with one anchor form a span, so a span stands for about 180 windows and is one row.

1. Spans are counted by the hash of their anchor; an anchor that occurs once has no repeated window.
2. Spans that occur twice as a whole have only repeated windows. What is left are edge spans: their anchor is
   repeated, they are not.
3. Edge spans meet the distinct spans of their anchor with their bytes. The suffixes at the anchors are ordered by
   deep-shallow sorting, and so are the bytes before them, read backwards. Two windows at one distance from their anchor are
   equal if they lie in one interval of both orders, which the common prefixes of neighbours tell exactly. Up to
   ``PAIRWISE`` spans, neighbours outwards in the first order are compared directly, which is the same and faster.

Copies of whole spans (2.) are told by 128-bit fingerprints. An anchor with more than ``HOT`` different spans is not brought
together: its windows' 128-bit fingerprints are counted by a shuffle with partial sums.

Defined results. Null text is the empty text. Texts shorter than ``LENGTH`` bytes keep everything. Repeated rows are
separate documents, hence remove one another if they are long enough. Null ids are kept. An empty table gives no
rows. Extra columns are ignored. Long texts are worked through in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.deep_shallow import common, deep_shallow
from quillstone.llm.store import Scratch
from quillstone.llm.text_bytes import SLICE, bytes_of, mix, powers, row_slices

LENGTH, GRAM = 400, 32
PAIRWISE, HOT = 64, 20_000
CHUNK_BYTES = 8 << 20
_U = np.uint64
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


class Prints:
    """128-bit fingerprints of substrings of ``data``: two polynomial hashes, of the bytes and of scrambled bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = []
        for values in (data.astype(np.uint64) + _U(1), _TABLE[data]):
            s = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values * up[:-1], out=s[1:])
            self.sums.append(s)

    def of(self, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        s = self.sums[which]
        return mix((s[end] - s[begin]) * self.down[begin])


def spans_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first and last window start, anchor (all relative to the row), anchor hash and two span hashes."""
    found = []
    for row, stop in row_slices(offsets, SLICE):
        first, last = int(offsets[row]), int(offsets[stop])
        for at in range(first, last, SLICE):  # more than one piece only for a single long row
            found.append(_spans(data[at : min(last, at + SLICE + LENGTH - 1)], offsets[row : stop + 1] - at, row))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.empty(0, np.int64) for _ in range(7))


def _spans(data: np.ndarray, offsets: np.ndarray, row: int) -> tuple[np.ndarray, ...]:
    n, width = len(data) - LENGTH + 1, LENGTH - GRAM + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 3)
    prints = Prints(data)
    places = np.arange(len(data) - GRAM + 1)
    least = (prints.of(places, places + GRAM, 0) & _U(0xFFFFFFFFFF000000)) | places.astype(np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: n], least[width - size : width - size + n])
    anchor = (least & _U(0xFFFFFF)).astype(np.int64)
    starts = np.arange(n)
    bounds = np.clip(offsets, 0, len(data))
    rows = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + LENGTH <= bounds[np.minimum(rows + 1, len(bounds) - 1)]
    starts, rows, anchor = starts[inside], rows[inside], anchor[inside]
    if not len(starts):
        return tuple(np.empty(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 3)
    head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1]))))
    tail = np.append(head[1:], len(starts)) - 1
    lo, hi, m = starts[head], starts[tail], anchor[head]
    key = prints.of(m, m + GRAM, 1)
    place = mix(((m - lo) * 4096 + (hi - m + LENGTH)).astype(np.uint64))
    one, two = prints.of(lo, hi + LENGTH, 0) ^ place, prints.of(lo, hi + LENGTH, 1) ^ place
    base = offsets[rows[head]]
    return rows[head] + row, lo - base, hi - base, m - base, key, one, two


SPANS = pa.schema([("rk", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("m", pa.int64()), ("key", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])
SPANS_DDL = "rk long, lo long, hi long, m long, key long, one long, two long"


def _list_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            rows, *columns = spans_of(*bytes_of(part.column(1)))
            if len(rows):
                yield pa.record_batch([part.column(0).take(pa.array(rows)), *(pa.array(c.view(np.int64)) for c in columns)], schema=SPANS)


BODIES = pa.schema([("key", pa.int64()), ("hot", pa.bool_()), ("rk", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("m", pa.int64()), ("edge", pa.bool_()), ("body", pa.binary())])
BODIES_DDL = "key long, hot boolean, rk long, lo long, hi long, m long, edge boolean, body binary"


def _bodies(docs: pa.Table, wanted: pa.Table) -> pa.Table:
    """Wanted spans of a chunk with their bytes; those of hot anchors as fingerprints of their windows."""
    if not wanted.num_rows:
        return BODIES.empty_table()
    texts = dict(zip(docs.column("rk").to_pylist(), docs.column("text").to_pylist()))
    coded: dict[int, bytes] = {}
    out: list[tuple] = []
    for rk, lo, hi, m, key, edge, hot in zip(*(wanted.column(c).to_pylist() for c in ("rk", "lo", "hi", "m", "key", "edge", "hot"))):
        if rk not in coded:
            coded[rk] = texts[rk].encode()
        body = coded[rk][lo : hi + LENGTH]
        if not hot:
            out.append((key, False, rk, lo, hi, m, edge, body))
            continue
        prints, begin = Prints(np.frombuffer(body, np.uint8)), np.arange(hi - lo + 1)
        raw = np.stack([prints.of(begin, begin + LENGTH, k) for k in (0, 1)], 1).tobytes()
        out += [(key, True, rk, lo + k, lo + k, m, edge, (m - lo - k).to_bytes(4, "big") + raw[16 * k : 16 * k + 16]) for k in range(hi - lo + 1)]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), BODIES)], schema=BODIES)


def repeated_windows(group: list[tuple[int, int, int, bool, bytes]]) -> list[tuple[int, int, int]]:
    """(index, first, last) runs of repeated window starts of the edge spans of one anchor's distinct spans.

    Each span is (lo, hi, m, edge, bytes). An offset is the anchor's distance from the window's start.
    """
    if len(group) > PAIRWISE:
        return _by_orders(group)
    forward = [body[m - lo :] for lo, _, m, _, body in group]
    backward = [body[: m - lo][::-1] for lo, _, m, _, body in group]
    order, lcps = deep_shallow(forward)
    out = []
    for rank, i in enumerate(order):
        lo, hi, m, edge, _ = group[i]
        if not edge:
            continue
        covered = np.zeros(hi - lo + 1, bool)
        for step in (-1, 1):
            shared, r = len(forward[i]), rank
            while 0 <= r + step < len(order):
                shared = min(shared, lcps[r] if step < 0 else lcps[r + 1])
                r += step
                if shared < LENGTH - (m - lo):
                    break
                back = common(backward[i], backward[order[r]])
                least, most = max(LENGTH - shared, m - hi), min(back, m - lo)
                if least <= most:
                    covered[m - most - lo : m - least - lo + 1] = True
        out += [(i, lo + a, lo + b) for a, b in _runs_of(covered)]
    return out


def _runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def _by_orders(group: list[tuple[int, int, int, bool, bytes]]) -> list[tuple[int, int, int]]:
    """The same from the orders of all spans' bytes from the anchor on and before it, one distance at a time."""
    def places(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        order, lcps = deep_shallow(strings)
        return np.array(order), np.array(lcps)

    def intervals(order: np.ndarray, lcps: np.ndarray, length: int) -> np.ndarray:
        """Number of each string's interval of the order whose common prefix reaches ``length``."""
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(lcps < length)
        return out

    forward, backward = places([body[m - lo :] for lo, _, m, _, body in group]), places([body[: m - lo][::-1] for lo, _, m, _, body in group])
    near, far = np.array([m - hi for _, hi, m, _, _ in group]), np.array([m - lo for lo, _, m, _, _ in group])
    twice = [np.zeros(hi - lo + 1, bool) if edge else None for lo, hi, _, edge, _ in group]
    for distance in range(int(near.min()), int(far.max()) + 1):
        have = np.flatnonzero((near <= distance) & (distance <= far))
        names = intervals(*forward, LENGTH - distance)[have] * (len(group) + 1) + intervals(*backward, distance)[have]
        _, which, n = np.unique(names, return_inverse=True, return_counts=True)
        for i in have[n[which] > 1].tolist():
            if twice[i] is not None:
                twice[i][far[i] - distance] = True
    return [(i, lo + a, lo + b) for i, (lo, _, _, edge, _) in enumerate(group) if edge for a, b in _runs_of(twice[i])]


CUTS = pa.schema([("rk", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of key to removed byte ranges of the edge spans."""
    def close(rows: list[tuple]) -> list[tuple[int, int, int]]:
        found = repeated_windows([(lo, hi, m, edge, body) for _, lo, hi, m, edge, body in rows])
        return [(rows[i][0], a, b + LENGTH) for i, a, b in found]

    key, held = None, []
    for batch in batches:
        out = []
        for k, *row in zip(*(batch.column(n).to_pylist() for n in ("key", "rk", "lo", "hi", "m", "edge", "body"))):
            if k != key:
                out += close(held) if len(held) > 1 else []
                key, held = k, []
            held.append(tuple(row))
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=CUTS)
    if len(held) > 1 and (out := close(held)):
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=CUTS)


def _kept(raw: bytes, cuts: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What remains of a text, and the number of maximal removed runs."""
    pieces, at, runs = [], 0, 0
    for a, b in sorted(cuts):
        if a > at or not runs:
            runs += 1
            pieces.append(raw[at:a])
        at = max(at, b)
    return b"".join([*pieces, raw[at:]]), runs


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(with_bytes: bool):
    def remove(docs: pa.Table, cuts: pa.Table) -> pa.Table:
        by: dict[int, list[tuple[int, int]]] = {}
        for rk, a, b in zip(*(cuts.column(c).to_pylist() for c in ("rk", "begin", "end"))):
            by.setdefault(rk, []).append((a, b))
        out = []
        for rk, text in zip(docs.column("rk").to_pylist(), docs.column("text").to_pylist()):
            raw = text.encode()
            kept, runs = _kept(raw, by[rk]) if rk in by else (raw, 0)
            out.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
        columns = zip(*out) if out else [[]] * 5
        return pa.table([docs.column("doc_id").combine_chunks(), *(pa.array(c, f.type) for c, f in zip(columns, list(RESULT)[1:]))], schema=RESULT)

    return remove


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (null unless ``with_bytes``)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("rk", F.xxhash64("doc_id", "text"))
    listed = texts.where(F.octet_length("text") >= LENGTH).select("rk", "text").mapInArrow(_list_spans, SPANS_DDL)
    spans = scratch.table("spans", listed)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = int(max(spark.sparkContext.defaultParallelism, -(-size // CHUNK_BYTES)))
    chunk = F.pmod(F.col("rk"), F.lit(chunks)).alias("chunk")

    # Written, so that the join has a plain side and adaptive execution can split a very frequent anchor.
    again = scratch.table("again", spans.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    twice = scratch.table("twice", spans.join(again, "key", "left_semi"))
    scratch.drop("spans")
    distinct = scratch.table("distinct", twice.groupBy("key", "one", "two").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rk", "lo", "hi", "m")).alias("at")))
    edged = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("spans"), F.min("n").alias("least")).where("least = 1 AND spans > 1").select("key", (F.col("spans") > HOT).alias("hot"))
    wanted = distinct.join(edged, "key").select(F.col("at.rk").alias("rk"), "at.lo", "at.hi", "at.m", "key", (F.col("n") == 1).alias("edge"), "hot").withColumn("chunk", chunk)

    dealt = texts.select("doc_id", "text", "rk", chunk)
    bodies = scratch.table("bodies", dealt.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(_bodies, BODIES_DDL))
    compared = bodies.where(~F.col("hot")).repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "rk long, begin long, end long")
    hot = bodies.where("hot")
    shared = hot.groupBy("key", "body").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "body")
    of_hot = hot.where("edge").join(shared, ["key", "body"], "left_semi").select("rk", F.col("lo").alias("begin"), (F.col("lo") + LENGTH).alias("end"))
    whole = twice.join(distinct.where("n > 1").select("key", "one", "two"), ["key", "one", "two"], "left_semi").select("rk", F.col("lo").alias("begin"), (F.col("hi") + LENGTH).alias("end"))
    cuts = scratch.table("cuts", compared.unionByName(of_hot).unionByName(whole))
    scratch.drop("bodies", "twice", "distinct")
    return dealt.groupBy("chunk").cogroup(cuts.withColumn("chunk", chunk).groupBy("chunk")).applyInArrow(_remove(with_bytes), RESULT_DDL)
