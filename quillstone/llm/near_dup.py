"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

1. Every text becomes its set of word shingles and a MinHash signature. Texts with equal sets form a class, found
   by a digest; only one member of a class goes on, so copies are never compared with one another.
2. Each tree of the forest orders the classes by a run of ``MAX_DEPTH`` signature values of its own. Classes with a
   common prefix form a region; its depth is adapted to its size: a region of more than ``REGION_ROWS`` classes at
   depth ``MIN_DEPTH`` is cut into those of the next depth, and so on up to ``MAX_DEPTH``. Neighbours in an order whose
   longest common prefix reaches the depth of their region are candidates, so their number is linear: one a class and
   tree at most. The number of trees is set for the greatest depth: a pair at the threshold shares a region of
   ``MAX_DEPTH`` in no tree with probability 4e-7; lower depths only add candidates where there are few. A region that
   partitions of an order cut is linked at ``MIN_DEPTH`` across the cut.
3. Candidates are closed to families by contracting each class to its smallest neighbour, round by round, until no
   more than ``TAIL`` edges are left, which one task closes.
4. Families are confirmed exactly on full sets. A family that fits a block of ``BLOCK_ROWS`` classes is confirmed at
   once; a larger one is dealt to blocks, and rounds of ever more hubs, at most ``HUBS`` a family and round, go
   against all its blocks. All links that matter to the components are found, without all
   pairs: a class is compared with the whole family until every class that was not compared lies in one component;
   classes with many links go first, so a family around one original needs few rounds.

Links and components are exact within a family; see 2 for the probability that a family misses a class.

Defined results. Null text is the empty text: no shingles, linked with nothing, its own component. Fewer words than
the shingle size form one shingle. Null ids are larger than all others; a component of null ids only has a null
id and keeps its rows. Rows with equal ids are told apart by their text. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.store import Scratch, free_name
from quillstone.llm.text_bytes import bytes_of, mix, powers, shingles_of

_U = np.uint64
MIN_DEPTH, MAX_DEPTH, REGION_ROWS = 4, 6, 8
MISS = 4e-7
BLOCK_ROWS = 256
#: Hubs of a family in the first round, four times as many in each further one, and the most in a round.
FIRST_HUBS, HUBS = 128, 4096
#: Edges that one task closes by union-find, at 100 bytes each; more are contracted by shuffles first.
TAIL = 200_000
SIGNED = "doc_id long, rk long, n_shingles long, node binary, signature binary"


def trees_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** MAX_DEPTH))


def digests(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """16 bytes for each set, independent of order; empty sets get b""."""
    full = np.flatnonzero(np.diff(offsets))
    out = [b""] * (len(offsets) - 1)
    if len(full):
        one = np.add.reduceat(mix(values ^ _U(0x5851F42D4C957F2D)), offsets[full])
        two = np.add.reduceat(mix(values + _U(0x14057B7EF767814F)), offsets[full])
        raw = np.stack([one, two], 1).astype(">u8").tobytes()
        for k, row in enumerate(full.tolist()):
            out[row] = raw[16 * k : 16 * k + 16]
    return out


def signatures(values: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Smallest scrambled value of each non-empty set under ``n`` permutations, its lower 16 bits: the upper ones are small."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), n), ">u2")
    if len(starts):
        up = powers(2 * n + 2)[0]
        work = np.empty_like(values)
        for k in range(n):
            np.bitwise_xor(values, mix(up[2 * k + 1 : 2 * k + 2])[0], out=work)
            np.multiply(work, up[2 * k + 2] | _U(1), out=work)
            out[:, k] = np.minimum.reduceat(work, starts) & _U(0xFFFF)
    return out


def _sign(size: int, trees: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("signature", pa.binary())])
        for batch in batches:
            for row, values, offsets in shingles_of(batch.column(1), size):
                sizes = np.diff(offsets)
                signed = iter(signatures(values, offsets, trees * MAX_DEPTH))
                packed = [next(signed).tobytes() if n else b"" for n in sizes.tolist()]
                yield pa.record_batch([batch.column(0).slice(row, len(sizes)), batch.column(2).slice(row, len(sizes)), pa.array(sizes), pa.array(digests(values, offsets), pa.binary()), pa.array(packed, pa.binary())], schema=schema)

    return sign


def _binary(rows: np.ndarray) -> pa.Array:
    """A matrix of bytes as a column of its rows."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _orders(trees: int):
    """A row for each class and tree: the tree, the path of signature values in that order, the class."""
    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.int32()), ("path", pa.binary()), ("node", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n, width = part.num_rows, 2 * MAX_DEPTH
                signed = bytes_of(part.column(1))[0].reshape(n, trees, width)
                for tree in range(trees):
                    paths = _binary(np.ascontiguousarray(signed[:, tree]))
                    yield pa.record_batch([pa.array(np.full(n, tree, np.int32)), paths, part.column(0)], schema=schema)

    return orders


EDGES = pa.schema([("kind", pa.int32()), ("tree", pa.int32()), ("path", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])


def linked(common: np.ndarray) -> np.ndarray:
    """Which neighbours are candidates, from the length of each pair's common prefix, in order.

    A pair's region at a depth is the run of pairs around it whose common prefix reaches the depth.
    """
    out = common >= MAX_DEPTH
    for depth in range(MIN_DEPTH, MAX_DEPTH):
        inside = common >= depth
        run = np.cumsum(~inside)
        pairs = np.bincount(run, inside)
        out |= inside & (pairs[run] < REGION_ROWS)
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate edges of a sorted partition (kind 0), and its first and last row (kinds 1 and 2)."""
    def end(kind: int, tree: np.ndarray, path: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"kind": kind, "tree": int(tree), "path": path.tobytes(), "a": node.tobytes(), "b": None}], schema=EDGES)

    def edges(trees: np.ndarray, paths: np.ndarray, nodes: np.ndarray, done: int, last: bool) -> tuple[pa.RecordBatch, int]:
        """Edges of the pairs from ``done`` to those whose region may go on in the next batch, and where those begin."""
        same = (paths[1:].view(">u2") == paths[:-1].view(">u2")) & (trees[1:] == trees[:-1])[:, None]
        stop = len(same) if last else max(done, len(same) - REGION_ROWS)
        at = np.flatnonzero(linked(np.minimum.accumulate(same, 1).sum(1))[done:stop]) + done
        n = len(at)
        found = [pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), _binary(nodes[at]), _binary(nodes[at + 1])]
        return pa.record_batch(found, schema=EDGES), stop

    held, done = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        rows = [batch.column(0).to_numpy(), bytes_of(batch.column(1))[0].reshape(n, -1), bytes_of(batch.column(2))[0].reshape(n, -1)]
        if held is None:
            yield end(1, *(x[0] for x in rows))
            held = rows
        else:
            held = [np.concatenate(x) for x in zip(held, rows)]
        out, done = edges(*held, done, False)
        yield out
        cut = max(0, done - REGION_ROWS)  # rows that tell how far a pair's region reaches back
        held, done = [x[cut:].copy() for x in held], done - cut
    if held is not None:
        yield edges(*held, done, True)[0]
        yield end(2, *(x[-1] for x in held))


def candidates(classes: DataFrame, trees: int, scratch: Scratch) -> DataFrame:
    """Distinct candidate edges (a, b) between classes: neighbours in the forest's orders."""
    rows = classes.select("node", "signature").mapInArrow(_orders(trees), "tree int, path binary, node binary")
    ordered = rows.repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    found = scratch.table("neighbours", ordered.mapInArrow(_neighbours, "kind int, tree int, path binary, a binary, b binary"))
    # Neighbours across a partition's border: two rows a partition, stitched on the driver.
    ends = sorted((bytes(r.path), r.kind, bytes(r.a), r.tree) for r in found.where("kind > 0").collect())
    ends.sort(key=lambda e: (e[3], e[0], e[2]))
    depth = 2 * MIN_DEPTH  # a border tells nothing of its region's size
    stitched = [(x[2], y[2]) for x, y in zip(ends, ends[1:]) if x[3] == y[3] and x[0][:depth] == y[0][:depth] and x[2] != y[2]]
    borders = classes.sparkSession.createDataFrame(stitched, "a binary, b binary")
    edges = found.where("kind = 0").select("a", "b").unionByName(borders).where("a <> b")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to (x, p): every node and the smallest of its component."""
    above: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array([top(x) for x in nodes], pa.binary())], names=["x", "p"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): nodes are contracted to their smallest neighbour in rounds.

    What is left of the graph after a round is closed at once when it has at most ``TAIL`` edges.
    """
    edges, labels, k = scratch.table("edges-0", edges), None, 0
    while edges.count() > TAIL:
        if labels is None:
            labels = scratch.table("labels-0", edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")))
        k += 1
        both = edges.union(edges.select("b", "a"))
        parent = scratch.table(f"parent-{k}", both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("x"), F.least("a", "p").alias("p")))
        moved = edges.join(parent, F.col("a") == F.col("x")).select(F.col("p").alias("a"), "b").join(parent, F.col("b") == F.col("x")).select("a", F.col("p").alias("b"))
        moved = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        labels_next = labels.join(parent, F.col("label") == F.col("x"), "left").select("node", F.coalesce("p", "label").alias("label"))
        edges, labels = scratch.table(f"edges-{k}", moved), scratch.table(f"labels-{k}", labels_next)
        scratch.drop(f"edges-{k - 1}", f"labels-{k - 1}", f"parent-{k}")
    closed = edges.coalesce(1).mapInArrow(_close, "x binary, p binary")
    if labels is None:
        return scratch.table("closed", closed.select(F.col("x").alias("node"), F.col("p").alias("label")))
    # Two nodes an edge: the bound of the broadcast is TAIL's.
    return scratch.table("closed", labels.join(F.broadcast(closed), F.col("label") == F.col("x"), "left").select("node", F.coalesce("p", "label").alias("label")))


def link_family(values: np.ndarray, offsets: np.ndarray, percent: int) -> np.ndarray:
    """Component number of each set of a family, by links of at least ``percent`` % Jaccard similarity. Exact."""
    n = len(offsets) - 1
    sizes, starts = np.diff(offsets), offsets[:-1]
    labels = np.arange(n)
    if n < 2:
        return labels
    _, ids = np.unique(values, return_inverse=True)
    mark = np.zeros(int(ids.max()) + 1, np.int64)
    waiting, degree = np.ones(n, bool), np.zeros(n, np.int64)
    hub_next = False
    while True:
        open_labels = labels[waiting]
        if len(open_labels) == 0 or (open_labels == open_labels[0]).all():
            return labels
        numbers, counts = np.unique(open_labels, return_counts=True)
        giant = numbers[counts.argmax()]
        pool = np.flatnonzero(waiting & ((labels == giant) if hub_next else (labels != giant)))
        i = int(pool[degree[pool].argmax()])
        own = ids[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[ids], starts)
        mark[own] = 0
        linked = 100 * shared >= percent * (sizes + sizes[i] - shared)
        waiting[i] = False
        degree += linked
        joined = np.unique(labels[linked])
        labels[np.isin(labels, joined)] = joined[0]
        hub_next = len(joined) > 1 if not hub_next else len(joined) > 2


def _confirm(size: int, percent: int):
    """Rows (family, node, rep, text) in order of family to rows (node, component, group)."""
    schema = pa.schema([("node", pa.binary()), ("component", pa.int64()), ("group", pa.binary())])

    def close(held: dict) -> Iterator[pa.RecordBatch]:
        nodes = list(held)
        sizes = np.fromiter((len(held[x][1]) for x in nodes), np.int64, len(nodes))
        labels = link_family(np.concatenate([held[x][1] for x in nodes]), np.concatenate(([0], np.cumsum(sizes))), percent)
        least: dict[int, int | None] = {}
        name: dict[int, bytes] = {}
        for x, label in zip(nodes, labels.tolist()):
            rep, name[label] = held[x][0], min(x, name.get(label, x))
            least[label] = rep if least.get(label) is None else least[label] if rep is None else min(rep, least[label])
        yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array([least[x] for x in labels.tolist()], pa.int64()), pa.array([name[x] for x in labels.tolist()], pa.binary())], schema=schema)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held = None, {}
        for batch in batches:
            families, nodes, reps = (batch.column(k).to_pylist() for k in range(3))
            for row, values, offsets in shingles_of(batch.column(3), size):
                made = digests(values, offsets)
                for k, digest in enumerate(made):
                    at = row + k
                    if families[at] != family:
                        if held:
                            yield from close(held)
                        family, held = families[at], {}
                    if digest == nodes[at]:  # another text may carry the same id
                        held[digest] = (reps[at], values[offsets[k] : offsets[k + 1]].copy())
        if held:
            yield from close(held)

    return confirm


def _sets(size: int):
    """Rows (family, block, node, rep, text) to their shingle sets; rows whose text is another one's are left out."""
    schema = pa.schema([("family", pa.binary()), ("block", pa.int64()), ("node", pa.binary()), ("rep", pa.int64()), ("values", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(2).to_pylist()
            for row, values, offsets in shingles_of(batch.column(4), size):
                made = digests(values, offsets)
                keep = [k for k, digest in enumerate(made) if digest == nodes[row + k]]
                packed = pa.array([values[offsets[k] : offsets[k + 1]].tobytes() for k in keep], pa.binary())
                yield pa.record_batch([*(batch.column(c).take(pa.array([row + k for k in keep], pa.int64())) for c in range(4)), packed], schema=schema)

    return sets


def _meet(percent: int):
    """A block's classes against its family's hubs: edges (a, b), and as (a, null, n) the links that a class has."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])

    def meet(members: pa.Table, hubs: pa.Table) -> pa.Table:
        if not members.num_rows or not hubs.num_rows:
            return schema.empty_table()
        nodes, names = members.column("node").to_pylist(), hubs.column("node").to_pylist()
        sets = [np.frombuffer(v, np.uint64) for v in members.column("values").to_pylist()]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        starts = np.cumsum(sizes) - sizes
        known, ids = np.unique(np.concatenate(sets), return_inverse=True)
        linked = np.zeros((len(names), len(nodes)), bool)
        for h, raw in enumerate(hubs.column("values").to_pylist()):
            own = np.frombuffer(raw, np.uint64)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            mark = np.zeros(len(known), np.int64)
            mark[at[known[at] == own]] = 1
            shared = np.add.reduceat(mark[ids], starts)
            linked[h] = 100 * shared >= percent * (sizes + len(own) - shared)
        edges = set()
        for m in np.flatnonzero(linked.any(0)).tolist():
            of = np.flatnonzero(linked[:, m]).tolist()
            # One edge to the class, and hubs that share it are joined in a chain.
            edges.update((names[x], names[y]) for x, y in zip(of, of[1:]) if names[x] != names[y])
            if names[of[0]] != nodes[m]:
                edges.add((names[of[0]], nodes[m]))
        rows = [(min(e), max(e), None) for e in edges]
        rows += [(n, None, int(c)) for n, c in zip(names, linked.sum(1)) if c] + [(n, None, int(c)) for n, c in zip(nodes, linked.sum(0)) if c]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, schema)], schema=schema)

    return meet


def link_large(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component, group) of families of any size; ``sets`` has family, block, node, rep, values. Exact.

    A class that was a hub has met its whole family. Once all others of a family lie in one component, no link that
    changes the components is left. Hubs are classes with many links, half of them from the largest component.
    """
    nodes = scratch.table("large-nodes", sets.select("family", "node", "rep"))
    blocks = scratch.table("blocks", sets.select("family", "block").distinct())
    labels, seen, done, k = nodes.select("family", "node", F.col("node").alias("label")), None, None, 0
    while True:
        waiting = labels.join(done, "node", "left_anti") if done is not None else labels
        counts = waiting.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
        giants = scratch.table(f"giants-{k}", counts.groupBy("family").agg(F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("family", F.col("most.label").alias("giant")))
        if giants.isEmpty():
            break
        waiting = waiting.join(giants, "family").withColumn("inside", F.col("label") == F.col("giant"))
        if seen is not None:
            waiting = waiting.join(seen.groupBy("node").agg(F.sum("links").alias("degree")), "node", "left")
        else:
            waiting = waiting.withColumn("degree", F.lit(0))
        best = Window.partitionBy("family", "inside").orderBy(F.col("degree").desc_nulls_last(), "node")
        chosen = waiting.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= min(HUBS, FIRST_HUBS << (2 * k)) // 2)
        hubs = scratch.table(f"hubs-{k}", chosen.select("node").join(sets, "node").select("family", "node", "values"))
        dealt = hubs.join(blocks, "family")
        met = scratch.table(f"links-{k}", sets.groupBy("family", "block").cogroup(dealt.groupBy("family", "block")).applyInArrow(_meet(percent), "a binary, b binary, links long"))
        counted = met.where("b IS NULL").select(F.col("a").alias("node"), "links")
        seen = counted if seen is None else seen.unionByName(counted)
        done = hubs.select("node") if done is None else done.union(hubs.select("node"))
        # New links join the components so far, which stand for their classes.
        own, other = labels.select(F.col("node").alias("a"), F.col("label").alias("x")), labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
        between = met.where("b IS NOT NULL").select("a", "b").join(own, "a").join(other, "b").where("x <> y")
        found = components(between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), Scratch(scratch.spark, "near-large"))
        moved = found.select(F.col("node").alias("label"), F.col("label").alias("into"))
        labels = scratch.table(f"large-labels-{k}", labels.join(moved, "label", "left").select("family", "node", F.coalesce("into", "label").alias("label")))
        k += 1
    named = labels.join(nodes.select("node", "rep"), "node")
    least = named.groupBy("label").agg(F.min("rep").alias("component"), F.min("node").alias("group"))
    return named.join(least, "label").select("node", "component", "group")


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, rk (a hash of id and text), n_shingles, component_id, group (null without shingles)."""
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk"))
    trees = trees_for(percent)
    signed = scratch.table("signed", texts.mapInArrow(_sign(size, trees), SIGNED), "lz4")
    classes = scratch.table("classes", signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature")), "lz4")
    families = components(candidates(classes, trees, scratch), scratch)
    scratch.drop("neighbours")
    members = classes.select("node", "rep").join(families, "node").select("node", "rep", F.col("label").alias("family"))
    large = scratch.table("large", members.groupBy("family").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BLOCK_ROWS))
    # Texts are joined once: what is in families is stored, and both sizes of families read it.
    own = texts.join(members.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("family", "node", "rep", "text")
    own = own if large.isEmpty() else scratch.table("own", own)
    small = own if large.isEmpty() else own.join(large, "family", "left_anti")
    by_family = small.repartition("family").sortWithinPartitions("family")
    confirmed = scratch.table("confirmed", by_family.mapInArrow(_confirm(size, percent), "node binary, component long, group binary"))
    if not large.isEmpty():
        block = F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / BLOCK_ROWS)).alias("block")
        told = own.join(large, "family").select("family", block, "node", "rep", "text")
        sets = told.mapInArrow(_sets(size), "family binary, block long, node binary, rep long, values binary").dropDuplicates(["node"])
        stored = scratch.table("sets", sets, "lz4")
        scratch.drop("own")
        confirmed = confirmed.unionByName(link_large(stored, percent, scratch))
    named = classes.select("node", "rep").join(confirmed, "node", "left").select("node", F.coalesce("component", "rep").alias("component"), F.coalesce("group", "node").alias("group"))
    named = scratch.table("named", named)  # a plain side lets adaptive execution split a class with very many members
    joined = signed.select("doc_id", "rk", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "rk", "n_shingles", component.alias("component_id"), "group")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Options are those of ``grouped``."""
    found = grouped(docs, **options)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id; rows without shingles all stay. Columns are kept."""
    found = Scratch(docs.sparkSession, "groups").table("found", grouped(docs, id_col=id_col, text_col=text_col, **options))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rk"))
    rk, one, nth = (free_name(docs, n) for n in ("rk", "one_of_group", "nth_of_row"))
    chosen = found.where(F.col("group").isNotNull()).groupBy("group").agg(first.alias("first")).select(F.col("first.rk").alias(rk), F.lit(True).alias(one))
    blank = found.where(F.col("group").isNull()).select(F.col("rk").alias(rk), F.lit(False).alias(one)).distinct()
    marked = docs.withColumn(rk, F.xxhash64(F.col(id_col), F.col(text_col)))
    left = marked.join(chosen.unionByName(blank).hint("shuffle_hash"), rk)
    # Equal rows share a key: one of them stays, unless they have no shingles.
    number = F.row_number().over(Window.partitionBy(rk).orderBy(F.lit(1)))
    return left.withColumn(nth, number).where((F.col(nth) == 1) | ~F.col(one)).select(*docs.columns)
