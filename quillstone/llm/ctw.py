"""Language-model scoring by context-tree weighting over bytes, with a word-unigram base score.

The coded message of a text is its words, ASCII letters lower-cased, each followed by one space, and an end
symbol: the same events that the base score counts. A byte is eight binary decisions. Every decision has a tree
over the ``DEPTH`` preceding bytes; each node holds the counts of both outcomes under its context, its
Krichevsky-Trofimov block probability ``Pe``, and ``Pw = Pe`` at full depth, else ``(Pe + product of the children's
Pw) / 2``. The prediction mixes all depths: a node's own estimate has weight ``Pe / (2 Pw)``, the deeper prediction
the rest. Counts come from all training texts; the tree is then fixed and scores every text.

How it is spread. Documents are dealt to chunks of about ``CHUNK_BYTES``. A chunk lists its distinct (context,
byte) pairs and words once, with training counts, packed by owner. The two nearest bytes of a context name a group,
the third one of its ``SPLITS`` owners; a word's owner is its hash. The number of owners follows the cores and not
the input, so the rows grow with the input alone. Owners add up counts and evaluate the tree below depth 3, groups
depth 2 from their owners' sums; depths 0 and 1 have at most 65,792 nodes, whatever the corpus, and are the only thing
broadcast. Owners answer each chunk's list, and the chunk scores its texts. No task holds the model; what is shuffled
grows with the corpus.

Defined results. Null text is the empty text: one token, the end. A null id hashes like the empty text, hence is
held out by the default split. Repeated rows are separate documents and equally scored. Without training texts
every byte has probability 1/256 per the untrained tree and the base score is that of an empty vocabulary. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.store import Scratch
from quillstone.llm.text_bytes import mix

DEPTH = 5
CHUNK_BYTES = 8 << 20
SEGMENT_BYTES, SEGMENT_DOCS = 2 << 20, 60_000
SMOOTHING = 0.1
#: Owners of a group, and the least number of groups; a cluster of more cores has a group for every two.
SPLITS, GROUPS = 8, 64
#: Least depth of an owner's trees.
TOP = 3
GRAMS, WORDS = 0, 1
_PAD = b"\n" * DEPTH
_U = np.uint64
_HALF = math.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for positive x: Stirling's series after eight shifts."""
    x = np.asarray(x, float)
    product = np.ones_like(x)
    for k in range(8):
        product *= x + k
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def log_pe(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov block probability of any sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def words_of(text: bytes) -> list[bytes]:
    """``bytes.split`` cuts at exactly 0x20 and 0x09 to 0x0D, ``bytes.lower`` touches A to Z only."""
    return text.lower().split()


def segments(messages: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents' indices, sorted keys). A key is the context's bytes, nearest first, the byte, and 16 bits naming
    a document by its place in the indices. Long messages are cut; a cut carries its context over."""
    def close(held: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(m) for _, m in held])
        data = np.frombuffer(b"".join(m for _, m in held), np.uint8)
        n = len(data) - DEPTH
        key = np.zeros(n, np.uint64)
        for k in range(1, DEPTH + 1):
            key <<= _U(8)
            key |= data[DEPTH - k : DEPTH - k + n]
        key <<= _U(8)
        key |= data[DEPTH : DEPTH + n]
        key <<= _U(16)
        ends = np.cumsum(sizes)
        key |= np.repeat(np.arange(len(held), dtype=np.uint64), sizes)[DEPTH:]
        valid = np.ones(n, bool)
        for k in range(DEPTH):  # the padding of each further message is not coded
            valid[ends[:-1] + k - DEPTH] = False
        return np.array([d for d, _ in held]), np.sort(key[valid])

    held, size = [], 0
    for doc, message in enumerate(messages):
        for at in range(0, len(message), SEGMENT_BYTES):
            piece = (message[at - DEPTH : at] if at >= DEPTH else _PAD) + message[at : at + SEGMENT_BYTES]
            if held and (size + len(piece) > SEGMENT_BYTES or len(held) >= SEGMENT_DOCS):
                yield close(held)
                held, size = [], 0
            held.append((doc, piece))
            size += len(piece)
    if held:
        yield close(held)


def _runs(values: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal values."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts' sums."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = _runs(k)
    return k[first], np.add.reduceat(c[order], first) if len(first) else c


def message_of(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" \n" if words else b"\n"


def owner_of_grams(keys: np.ndarray, owners: int) -> np.ndarray:
    group, split = mix(keys >> _U(32)) % _U(owners // SPLITS), mix((keys >> _U(24)) & _U(0xFF)) % _U(SPLITS)
    return (group * _U(SPLITS) + split).astype(np.int64)


def _texts(table: pa.Table) -> list[list[bytes]]:
    return [words_of(t.encode()) for t in table.column("text").to_pylist()]


REQUEST = pa.schema([("owner", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
REQUEST_DDL = "owner long, kind int, chunk long, keys binary, counts binary"


def _ask(owners: int):
    """Of a chunk's documents, the distinct pairs and words with training counts, a row for each owner and kind."""
    def ask(table: pa.Table) -> pa.Table:
        chunk, held = table.column("chunk")[0].as_py(), np.array(table.column("held_out").to_pylist(), bool)
        texts = _texts(table)
        keys, counts = [], []
        for docs, combined in segments([message_of(w) for w in texts]):
            pairs = combined >> _U(16)
            first = _runs(pairs)
            learned = (~held[docs])[(combined & _U(0xFFFF)).astype(np.int64)].astype(np.int64)
            keys.append(pairs[first])
            counts.append(np.add.reduceat(learned, first))
        rows = []
        if keys:
            k, c = add_up(keys, counts)
            own = owner_of_grams(k, owners)
            order = np.argsort(own, kind="stable")
            k, c, own = k[order], c[order].astype(np.uint32), own[order]
            first = _runs(own)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)]):
                rows.append((int(own[a]), GRAMS, chunk, k[a:b].tobytes(), c[a:b].tobytes()))
        learned, seen = Counter(), set()
        for w, out in zip(texts, held.tolist()):
            seen.update(w) if out else learned.update(w)
        by_owner: dict[int, list[bytes]] = {}
        for w in sorted(seen.union(learned)):
            by_owner.setdefault(zlib.crc32(w) % owners, []).append(w)
        for o, own_words in by_owner.items():
            rows.append((o, WORDS, chunk, b"\n".join(own_words), np.array([learned[w] for w in own_words], np.uint32).tobytes()))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 5, REQUEST)], schema=REQUEST)

    return ask


MODEL = pa.schema([("owner", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests in order of owner and kind to one row for each, with all chunks' counts added up (chunk -1)."""
    at, keys, counts, pending, total = None, [], [], 0, Counter()

    def close() -> pa.RecordBatch:
        if at[1] == GRAMS:
            k, c = add_up(keys, counts)
            raw = k.tobytes(), c.astype(np.int64).tobytes()
        else:
            order = sorted(total)
            raw = b"\n".join(order), np.array([total[w] for w in order], np.int64).tobytes()
        return pa.record_batch([pa.array([x], f.type) for x, f in zip((at[0], at[1], -1, *raw), MODEL)], schema=MODEL)

    for batch in batches:
        for r in range(batch.num_rows):
            key = (batch.column(0)[r].as_py(), batch.column(1)[r].as_py())
            if key != at:
                if at is not None:
                    yield close()
                at, keys, counts, pending, total = key, [], [], 0, Counter()
            raw, number = batch.column(3)[r].as_py(), np.frombuffer(batch.column(4)[r].as_py(), np.uint32).astype(np.int64)
            if key[1] == WORDS:
                for w, n in zip(raw.split(b"\n"), number.tolist()):
                    total[w] += n
                continue
            keys.append(np.frombuffer(raw, np.uint64))
            counts.append(number)
            pending += len(number)
            if pending > 4_000_000:
                k, c = add_up(keys, counts)
                keys, counts, pending = [k], [c], 0
    if at is not None:
        yield close()


def _added(names: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct names in order, and the sums of each."""
    used, which = np.unique(names, return_inverse=True)
    return used, *(np.bincount(which, x, len(used)) for x in sums)


def _mixed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight of the nodes' own estimates, the estimates of a one, and log Pw, from the sum of the children's log Pw."""
    pe = log_pe(zeros, ones)
    pw = np.logaddexp(_HALF + pe, _HALF + below)
    return np.exp(_HALF + pe - pw), (ones + 0.5) / (zeros + ones + 1.0), pw


class Tree:
    """All levels from ``DEPTH`` up to ``TOP`` of the trees over an owner's pairs; distinct keys in order, and counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        levels, k, c = {}, keys, counts
        for depth in range(DEPTH, TOP - 1, -1):
            nodes = []
            for j in range(8):
                prefix = k >> _U(8 - j)
                first = _runs(prefix)
                bit = ((k >> _U(7 - j)) & _U(1)).astype(np.int64)
                ones, both = np.add.reduceat(c * bit, first), np.add.reduceat(c, first)
                index = np.zeros(len(k), np.int64)
                index[first[1:]] = 1
                nodes.append({"first": first, "index": np.cumsum(index), "ones": ones, "zeros": both - ones, "pe": log_pe(both - ones, ones)})
            parent = ((k >> _U(16)) << _U(8)) | (k & _U(0xFF))
            order = np.argsort(parent, kind="stable")
            sorted_parent = parent[order]
            first = _runs(sorted_parent)
            step = np.zeros(len(k), np.int64)
            step[first[1:]] = 1
            up = np.empty(len(k), np.int64)
            up[order] = np.cumsum(step)
            levels[depth] = {"keys": k, "nodes": nodes, "up": up}
            k, c = sorted_parent[first], np.add.reduceat(c[order], first)
        for depth in range(DEPTH, TOP - 1, -1):
            for j, node in enumerate(levels[depth]["nodes"]):
                if depth == DEPTH:
                    node["pw"] = node["pe"]
                    continue
                below = levels[depth + 1]
                child = below["nodes"][j]
                into = node["index"][below["up"][child["first"]]]
                children = np.bincount(into, child["pw"], len(node["pe"]))
                node["pw"] = np.logaddexp(_HALF + node["pe"], _HALF + children)
        self.levels = levels

    def upward(self) -> tuple[np.ndarray, ...]:
        """(name, zeros, ones, sum of log Pw) of the nodes above ``TOP``; a name is the two nearest bytes and the node."""
        k, parts = self.levels[TOP]["keys"], []
        for j, node in enumerate(self.levels[TOP]["nodes"]):
            key = k[node["first"]].astype(np.int64)
            parts.append(((key >> 16 << 8) | (1 << j) | ((key & 0xFF) >> (8 - j)), node["zeros"], node["ones"], node["pw"]))
        return _added(*(np.concatenate(x) for x in zip(*parts)))

    def log10(self, second: tuple[np.ndarray, np.ndarray, np.ndarray], upper: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 probability of each pair's byte after its context, mixed over all depths."""
        names, weight2, one2 = second
        weight1, one1, weight0, one0 = upper
        total = np.zeros(len(self.keys))
        near, byte = (self.keys >> _U(32)).astype(np.int64), (self.keys & _U(0xFF)).astype(np.int64)
        for j in range(8):
            bit, at = (byte >> (7 - j)) & 1, np.arange(len(self.keys))
            one = None
            for depth in range(DEPTH, TOP - 1, -1):
                node = self.levels[depth]["nodes"][j]
                own = (node["ones"] + 0.5) / (node["zeros"] + node["ones"] + 1.0)
                if one is None:
                    one = own[node["index"]]
                else:
                    weight = np.exp(_HALF + node["pe"] - node["pw"])
                    i = node["index"][at]
                    one = weight[i] * own[i] + (1 - weight[i]) * one
                at = self.levels[depth]["up"][at]
            name = (1 << j) | (byte >> (8 - j))
            i = np.searchsorted(names, (near << 8) | name)
            one = weight2[i] * one2[i] + (1 - weight2[i]) * one
            one = weight1[near >> 8, name] * one1[near >> 8, name] + (1 - weight1[near >> 8, name]) * one
            one = weight0[name] * one0[name] + (1 - weight0[name]) * one
            total += np.log10(np.where(bit == 1, one, 1 - one))
        return total


def second_level(parts: list[tuple[np.ndarray, ...]]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Names, weights and estimates of a group's depth-2 nodes, and the sums of the nodes above, named alike by their
    one byte, from what ``upward`` gave for each owner."""
    names, zeros, ones, below = _added(*(np.concatenate(x) for x in zip(*parts)))
    weight, one, pw = _mixed(zeros, ones, below)
    return (names, weight, one), _added((names >> 16 << 8) | (names & 0xFF), zeros, ones, pw)


def upper_levels(rows: list[tuple[int, float, float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights and estimates of depths 1 and 0 from (name, zeros, ones, sum of the children's log Pw)."""
    sums = np.zeros((3, 256, 256))
    for name, *values in rows:
        sums[:, name >> 8, name & 0xFF] = values
    zeros, ones, _ = sums
    weight1, one1, pw1 = _mixed(*sums)
    weight0, one0, _ = _mixed(zeros.sum(0), ones.sum(0), pw1.sum(0))
    return weight1, one1, weight0, one0


UP = pa.schema([("group", pa.int64()), *((n, pa.binary()) for n in ("names", "zeros", "ones", "below"))])
UP_DDL = "group long, names binary, zeros binary, ones binary, below binary"
SECOND = pa.schema([("group", pa.int64()), *((n, pa.binary()) for n in ("names", "weight", "one", "up_names", "up_zeros", "up_ones", "up_below"))])
SECOND_DDL = "group long, names binary, weight binary, one binary, up_names binary, up_zeros binary, up_ones binary, up_below binary"
FIRST = pa.schema([("name", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("below", pa.float64())])
FIRST_DDL = "name long, zeros double, ones double, below double"


def _raw(batch: pa.RecordBatch, column: int, row: int, kind) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_py(), kind)


def _named(batch: pa.RecordBatch, column: int, row: int) -> tuple[np.ndarray, ...]:
    """Names and three columns of values from ``column`` on."""
    return _raw(batch, column, row, np.int64), *(_raw(batch, column + k, row, np.float64) for k in (1, 2, 3))


def _upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            parts = Tree(_raw(batch, 3, r, np.uint64), _raw(batch, 4, r, np.int64)).upward()
            yield pa.record_batch([pa.array([batch.column(0)[r].as_py() // SPLITS]), *(pa.array([x.tobytes()]) for x in parts)], schema=UP)


def _second(table: pa.Table) -> pa.Table:
    """A group's sums, one row for each of its owners, to its depth-2 nodes and the sums above them."""
    here, up = second_level([_named(b, 1, r) for b in table.to_batches() for r in range(b.num_rows)])
    return pa.table([pa.array([table.column(0)[0].as_py()]), *(pa.array([x.tobytes()]) for x in (*here, *up))], schema=SECOND)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield pa.record_batch([pa.array(x) for x in _named(batch, 4, r)], schema=FIRST)


def _settle(upper):
    """An owner's counts, with its group's depth-2 nodes, to its answers: log10 probabilities of its pairs."""
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                tree, second = Tree(_raw(batch, 3, r, np.uint64), _raw(batch, 4, r, np.int64)), (_raw(batch, 5, r, np.int64), _raw(batch, 6, r, float), _raw(batch, 7, r, float))
                row = [*(batch.column(k)[r].as_py() for k in range(4)), tree.log10(second, upper.value).tobytes()]
                yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, MODEL)], schema=MODEL)

    return settle


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In order of owner, kind and chunk (the model's row first): each request with the values of its keys."""
    schema = pa.schema([("chunk", pa.int64()), ("owner", pa.int64()), ("kind", pa.int32()), ("answers", pa.binary())])
    keys = values = table = None
    for batch in batches:
        out = []
        for r in range(batch.num_rows):
            owner, kind, chunk = (batch.column(k)[r].as_py() for k in range(3))
            if chunk < 0 and kind == GRAMS:
                keys, values = _raw(batch, 3, r, np.uint64), _raw(batch, 4, r, np.float64)
            elif chunk < 0:
                table = dict(zip(batch.column(3)[r].as_py().split(b"\n"), _raw(batch, 4, r, np.int64).tolist()))
            elif kind == GRAMS:
                out.append((chunk, owner, kind, values[np.searchsorted(keys, _raw(batch, 3, r, np.uint64))].tobytes()))
            else:
                found = np.array([table[w] for w in batch.column(3)[r].as_py().split(b"\n")], np.int64)
                out.append((chunk, owner, kind, found.tobytes()))
        if out:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def _score(owners: int, total: int, distinct: int, ends: int):
    """A chunk's documents and its answers to scores."""
    below = math.log10(total + SMOOTHING * (distinct + 1))
    log_of = lambda c: math.log10(c + SMOOTHING) - below

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _texts(docs)
        kinds, owner_list, raw = (answers.column(c).to_pylist() for c in ("kind", "owner", "answers"))
        answer = {(k, o): x for k, o, x in zip(kinds, owner_list, raw)}
        messages = [message_of(w) for w in texts]
        scores = np.zeros(len(texts))
        parts = list(_lookup(messages, answer, owners))
        for docs_of, combined, values in parts:
            local = (combined & _U(0xFFFF)).astype(np.int64)
            scores += np.bincount(docs_of[local], values, len(texts)) if len(local) else 0
        seen = sorted(set().union(*texts)) if texts else []
        by_owner: dict[int, list[bytes]] = {}
        for w in seen:
            by_owner.setdefault(zlib.crc32(w) % owners, []).append(w)
        logs, unknown = {}, log_of(0)
        for o, own in by_owner.items():
            for w, c in zip(own, np.frombuffer(answer[WORDS, o], np.int64).tolist()):
                logs[w] = log_of(c) if c else unknown
        end, base, known = log_of(ends) if ends else unknown, [], []
        for w in texts:
            found = list(map(logs.__getitem__, w))
            base.append(math.fsum(found) + end)
            known.append(len(found) + 1 - found.count(unknown) - (not ends))
        n = len(texts)
        columns = [docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), pa.array([len(w) + 1 for w in texts]), pa.array(known, pa.int64()), pa.array(np.full(n, total)), pa.array(base, pa.float64()), pa.array(scores), pa.array([len(m) for m in messages], pa.int64())]
        return pa.table(columns, schema=SCORES)

    return score


def _lookup(messages: list[bytes], answer: dict[tuple[int, int], bytes], owners: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents' indices, keys, values) of each segment; the chunk's distinct pairs are rebuilt in request order."""
    made = [(docs, combined) for docs, combined in segments(messages)]
    if not made:
        return
    keys, _ = add_up([(c >> _U(16))[_runs(c >> _U(16))] for _, c in made], [np.zeros(len(_runs(c >> _U(16))), np.int64) for _, c in made])
    own = owner_of_grams(keys, owners)
    values = np.empty(len(keys), np.float64)
    order = np.argsort(own, kind="stable")
    first = _runs(own[order])
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)]):
        values[order[a:b]] = np.frombuffer(answer[GRAMS, int(own[order[a]])], np.float64)
    for docs, combined in made:
        pairs = combined >> _U(16)
        first = _runs(pairs)
        found = values[np.searchsorted(keys, pairs[first])]
        yield docs, combined, np.repeat(found, np.diff(np.append(first, len(pairs))))


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    ``held_out`` is a condition on ``doc_id``; the model learns from the other documents. By default a tenth is held
    out by a checksum of the id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ctw")
    if held_out is None:
        held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size, ends = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.coalesce(held_out, F.lit(False)))).first()
    chunks = int(max(spark.sparkContext.defaultParallelism, -(-size // CHUNK_BYTES)))
    dealt = texts.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"))

    owners = SPLITS * max(GROUPS, spark.sparkContext.defaultParallelism // 2)
    requests = scratch.table("requests", dealt.groupBy("chunk").applyInArrow(_ask(owners), REQUEST_DDL))
    gathered = scratch.table("counts", requests.repartition("owner").sortWithinPartitions("owner", "kind").mapInArrow(_gather, REQUEST_DDL))
    grams, words = gathered.where(F.col("kind") == GRAMS), gathered.where(F.col("kind") == WORDS)
    second = scratch.table("second", grams.mapInArrow(_upward, UP_DDL).groupBy("group").applyInArrow(_second, SECOND_DDL))
    ups = second.mapInArrow(_first, FIRST_DDL).groupBy("name").agg(F.sum("zeros"), F.sum("ones"), F.sum("below"))
    upper = spark.sparkContext.broadcast(upper_levels([tuple(r) for r in ups.collect()]))  # one row a node of depth 1
    total, distinct = words.mapInArrow(_totals, "total long, known long").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    of_group = second.select("group", "names", "weight", "one").hint("merge")
    settled = grams.join(of_group, F.floor(F.col("owner") / SPLITS) == F.col("group")).drop("group").mapInArrow(_settle(upper), REQUEST_DDL)
    model = scratch.table("model", settled.unionByName(words))
    asked = model.unionByName(requests.select("owner", "kind", "chunk", "keys", F.lit(None).cast("binary").alias("counts")))
    answers = asked.repartition("owner").sortWithinPartitions("owner", "kind", "chunk").mapInArrow(_answer, "chunk long, owner long, kind int, answers binary")
    answers = scratch.table("answers", answers)
    scratch.drop("requests", "counts", "second", "model")
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(owners, int(total + ends), int(distinct + (ends > 0)), int(ends)), SCORES_DDL)
    return scored.withColumn("bits_per_byte", -F.col("score") * math.log2(10) / F.col("n_bytes"))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("total", pa.int64()), ("known", pa.int64())])
    for batch in batches:
        for r in range(batch.num_rows):
            counts = _raw(batch, 4, r, np.int64)
            yield pa.record_batch([pa.array([int(counts.sum())]), pa.array([int((counts > 0).sum())])], schema=schema)
