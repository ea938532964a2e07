"""Token-ID output: Arrow stream files whose batches hold fixed-size lists.

Layout of an output folder: ``shard-*.arrow`` (columns ``ids`` and ``mask``, both fixed-size lists of
``seq_len`` items; every batch but the last holds ``BATCH_SEQUENCES`` sequences, so sequence *i* lies in batch
``i // BATCH_SEQUENCES`` and is a zero-copy slice of the memory-mapped file) and ``shard-*.index`` (one row per
document: id, offset of its first id in the shard, number of ids). Shards follow one another in ascending
document id. Only the last sequence of a shard is padded; its ``mask`` is false there.

Defined results. Null text is the empty text and yields the end id alone. Null document ids come first. Rows
with equal ids are ordered by a hash of their text and then the text; each gets its own span. An empty table
yields no shard. Extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.store import Scratch
from quillstone.llm.text_bytes import bytes_of, row_slices

SEQ_LEN = 2048
BATCH_SEQUENCES = 64
#: Words of a worker's memo; it is emptied when full, which changes speed only.
MEMO_ENTRIES = 700_000
#: Bytes of text that are cut into pieces at once.
CHUNK_BYTES = 8 << 20
#: White space other than single spaces and line ends between words, or a special token: the text is encoded in one call.
WHOLE = (
    r"[\x09\x0B\x0C\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
    r"|<\|endoftext\|>|  | \n|\n |\n\n|^[ \n]|[ \n]$"
)
TAILED = r"^(?P<word>(?s:.*)\p{L})(?P<tail>[.,!?;:#$%&*]+)$"


class PieceEncoder:
    """Encodes texts of a byte-level BPE by pieces: a word with the one space or line end before it.

    The pre-tokenizer never joins a non-space with the space that follows it, nor a letter or digit with the
    punctuation that follows it, so the encoding of a text is the concatenation of the encodings of its pieces,
    and that of a piece is its word's plus its tail's. Texts are cut, and equal pieces found, column-wise; only
    different words meet the tokenizer, once each. Texts with runs of white space or rare space characters, where
    this does not hold, are encoded in one call.
    """

    _of_worker: dict[tuple[str, int], PieceEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 65_536 else "<u4")
        self.bytes_of = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = len(token)
        self.memo: dict[str, bytes] = {}

    @classmethod
    def get(cls, path: str) -> PieceEncoder:
        key = (path, os.getpid())
        if key not in cls._of_worker:
            cls._of_worker[key] = cls(path)
        return cls._of_worker[key]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Words start with a line end, or stand for a space and themselves."""
        width = self.dtype.itemsize
        for k in range(0, len(words), 2048):
            part = words[k : k + 2048]
            texts = [w if w[:1] == "\n" else " " + w for w in part]
            ids = np.asarray(self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum([len(t.encode()) for t in texts])
            cuts = ((np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, "left") + 1) * width).tolist()
            packed, at = ids.astype(self.dtype).tobytes(), 0
            for w, cut in zip(part, cuts):
                self.memo[w] = packed[at:cut]
                at = cut

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of different pieces, each cut into its word and the punctuation at its end."""
        cut = pc.extract_regex(pieces, TAILED)
        words = pc.coalesce(pc.struct_field(cut, "word"), pieces).dictionary_encode()
        tails = pc.fill_null(pc.struct_field(cut, "tail"), "").dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.memo.get, different))
        if None in found:
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
                found = [None] * len(found)
            self._learn([w for w, x in zip(different, found) if x is None])
            found = list(map(self.memo.__getitem__, different))
        ends = [self._whole(t) for t in tails.dictionary.to_pylist()]
        parts = (pa.array(x, pa.binary()).take(c.indices) for x, c in ((found, words), (ends, tails)))
        return pc.binary_join_element_wise(*parts, b"")

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, ``end_id`` after each text, and the number of ids of each text."""
        n = len(texts)
        odd = pc.match_substring_regex(texts, WHOLE)
        lists = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        offsets, pieces = lists.offsets.to_numpy().astype(np.int64), lists.values
        coded = pieces.dictionary_encode()
        different, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        # The first piece has no space before it; of an odd text, it is the whole text.
        first = pc.if_else(odd, texts, pieces.take(pa.array(offsets[:-1]))).dictionary_encode()
        inner = np.ones(len(code), bool)
        inner[offsets[:-1]] = False
        used = np.zeros(len(different), bool)
        used[code[inner]] = True
        number = np.cumsum(used) - 1
        table = self._pieces(different.filter(pa.array(used)))
        code = number[code]
        code[offsets[:-1]] = len(table) + first.indices.to_numpy().astype(np.int64)
        others = [*(self._whole(t) for t in first.dictionary.to_pylist()), np.asarray([end_id], self.dtype).tobytes()]
        row = np.arange(n)
        places = np.empty(len(code) + n, np.int64)
        places[np.arange(len(code)) + np.repeat(row, np.diff(offsets))] = code
        places[offsets[1:] + row] = len(table) + len(others) - 1
        found = pa.concat_arrays([table, pa.array(others, pa.binary())]).take(pa.array(places))
        _, bounds, data = found.buffers()
        bounds = np.frombuffer(bounds, np.int32)[: len(places) + 1][np.concatenate(([0], offsets[1:] + row + 1))].astype(np.int64)
        return np.frombuffer(data, np.uint8)[: bounds[-1]].view(self.dtype), np.diff(bounds) // self.dtype.itemsize


def _schema(dtype: np.dtype, seq_len: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard int, path string, n_docs long, n_tokens long"


class _ShardWriter:
    """Streams ids into fixed-size-list batches; holds at most one batch beyond what it was given."""

    def __init__(self, fs, path: str, dtype: np.dtype, seq_len: int):
        self.schema, self.seq_len, self.dtype = _schema(dtype, seq_len), seq_len, dtype
        self.out, self.index_out = fs.open_output_stream(path + ".arrow"), fs.open_output_stream(path + ".index")
        self.stream, self.index = pa.ipc.new_stream(self.out, self.schema), pa.ipc.new_stream(self.index_out, INDEX)
        self.left, self.total, self.docs = np.empty(0, dtype), 0, 0

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask)]
        self.stream.write_batch(pa.record_batch(lists, schema=self.schema))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        starts = self.total + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(sizes)], schema=INDEX))
        flat = np.concatenate([self.left, ids])
        step = self.seq_len * BATCH_SEQUENCES
        whole = len(flat) // step * step
        for k in range(0, whole, step):
            self._batch(flat[k : k + step], step)
        self.left, self.total, self.docs = flat[whole:].copy(), self.total + int(sizes.sum()), self.docs + len(sizes)

    def close(self) -> None:
        if n := len(self.left):
            self._batch(np.pad(self.left, (0, -n % self.seq_len)), n)
        for x in (self.stream, self.index, self.out, self.index_out):
            x.close()


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, seq_len: int = SEQ_LEN) -> list[dict]:
    """Tokenise ``docs`` into ``out_dir`` (a URI that every executor can write) and return the manifest.

    One range exchange orders the documents; each task then encodes and writes its range as a shard. A retried
    task writes under another name, and only the names in the manifest count. The manifest has a row per shard.
    """
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer, fs, shard = PieceEncoder.get(tokenizer_path), None, None, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs, folder = pafs.FileSystem.from_uri(out_dir)
                fs.create_dir(folder, recursive=True)
                path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}"
                writer = _ShardWriter(fs, path, coder.dtype, seq_len)
            for row, stop in row_slices(bytes_of(batch.column(1))[1], CHUNK_BYTES):
                part = batch.slice(row, stop - row)
                writer.add(part.column(0), *coder.encode(part.column(1), end_id))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path.rsplit("/", 1)[1], "n_docs": writer.docs, "n_tokens": writer.total}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return sorted((r.asDict() for r in ordered.mapInArrow(write, MANIFEST).collect()), key=lambda m: m["shard"])


def open_shard(out_dir: str, path: str) -> tuple[pa.Table, pa.Table]:
    """Sequences and index of a shard; memory-mapped, without a copy, where the store is a local file system."""
    fs, folder = pafs.FileSystem.from_uri(out_dir)
    local = isinstance(fs, pafs.LocalFileSystem)
    tables = []
    for kind in (".arrow", ".index"):
        name = f"{folder}/{path}{kind}"
        tables.append(pa.ipc.open_stream(pa.memory_map(name) if local else fs.open_input_file(name)).read_all())
    return tables[0], tables[1]


def read_token_files(spark: SparkSession, out_dir: str, manifest: list[dict]) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    base, rows = 0, []
    for m in manifest:
        rows.append((m["path"], base))
        base += m["n_tokens"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sequences, index = open_shard(out_dir, path)
                parts = [c.flatten().to_numpy(zero_copy_only=True) for c in sequences.column("ids").chunks]
                begins = np.cumsum([0, *map(len, parts)])
                for part in index.to_batches(max_chunksize=20_000):
                    crcs = []
                    for at, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                        crc, k = 0, int(np.searchsorted(begins, at, "right")) - 1
                        while n:
                            piece = parts[k][at - begins[k] : at - begins[k] + n]
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                            at, n, k = at + len(piece), n - len(piece), k + 1
                        crcs.append(crc)
                    starts = part.column(1).to_numpy() + first
                    yield pa.record_batch([part.column(0), pa.array(starts), part.column(2), pa.array(crcs, pa.int64())], schema=schema)

    listed = spark.createDataFrame(rows, "path string, first long")
    return listed.repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return what the files hold per document."""
    spark = docs.sparkSession
    out_dir = Scratch(spark, "tokens").root
    return read_token_files(spark, out_dir, write_token_files(docs, out_dir, tokenizer_path, **options))
