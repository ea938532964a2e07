import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from quillstone.llm.store import Scratch
from quillstone.llm.token_files import BATCH_SEQUENCES, PieceEncoder, open_shard, read_token_files, token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "lang string, text string, doc_id long, start string"
TEXTS = ["", "plain words here", "tabs\tand\r\nlines \n\n end ", None, "nbsp    wide　 x", "<|endoftext|> inside", "a  b   c\n\n\nd", "ünï çödé 日本語 🙂 it's 'll", "x" * 9000, " lead", "same", "same"]


def expected(rows):
    tok = Tokenizer.from_file(PATH)
    at, out = 0, []
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_matches_direct_encoding_and_ignores_clashing_columns(spark):
    rows = [("en", t, 100 - i, "clash") for i, t in enumerate(TEXTS)]
    got = token_files(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, seq_len=16).collect()
    assert sorted(map(tuple, got)) == expected(sorted((r[2], r[1]) for r in rows))


def test_repeated_and_null_ids(spark):
    rows = [("en", "one", None, ""), ("en", "two", 7, ""), ("en", "two", 7, ""), ("en", "three", 7, "")]
    got = sorted(map(tuple, token_files(spark.createDataFrame(rows, SCHEMA), PATH).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 7, 7, 7]
    assert [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got])[:-1])


def test_empty_table(spark):
    assert token_files(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_fixed_size_sequences_round_trip(spark):
    rows = [("en", f"document number {i} " * 40, i, "") for i in range(60)]
    out = Scratch(spark, "test").root
    manifest = write_token_files(spark.createDataFrame(rows, SCHEMA), out, PATH, seq_len=32)
    tok, ids = Tokenizer.from_file(PATH), []
    for m in manifest:
        seqs, index = open_shard(out, m["path"])
        assert seqs.schema.field("ids").type == pa.list_(pa.uint16(), 32)
        assert all(c == BATCH_SEQUENCES for c in [len(c) for c in seqs.column("ids").chunks][:-1])
        flat = np.concatenate([c.flatten().to_numpy() for c in seqs.column("ids").chunks])
        mask = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in seqs.column("mask").chunks])
        assert mask.sum() == m["n_tokens"] and not mask[m["n_tokens"]:].any()
        ids += flat[mask].tolist()
        assert index.num_rows == m["n_docs"]
    assert ids == [x for _, t, _, _ in rows for x in [*tok.encode(t, add_special_tokens=False).ids, 0]]
    assert read_token_files(spark, out, manifest).count() == 60


def test_pieces_equal_whole_texts():
    rng, tok = random.Random(5), Tokenizer.from_file(PATH)
    marks = ["a", "B", "é", "ß", "日", "🙂", "1", "42", "'s", "'", ".", "?!", "#", "-", "_", " ", " ", " ", "\n", "word", "Wort", "١", "̈", "ª", "½", "\t"]
    texts = ["".join(rng.choice(marks[: rng.choice([5, 19, 26])]) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    coder = PieceEncoder(PATH)
    for part in (texts[:1000], texts[1000:], [], ["", ""]):
        ids, sizes = coder.encode(pa.array(part, pa.string()), 7)
        ends = np.cumsum(sizes)
        assert [ids[b - n : b].tolist() for b, n in zip(ends, sizes)] == [[*tok.encode(t, add_special_tokens=False).ids, 7] for t in part]


def test_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr("quillstone.llm.token_files.MEMO_ENTRIES", 3)
    coder, tok, texts = PieceEncoder(PATH), Tokenizer.from_file(PATH), ["one two three four five six", "five six seven, eight! nine", "one ten"]
    assert [coder.encode(pa.array([t]), 0)[0].tolist() for t in texts] == [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_very_long_text(spark):
    rng = random.Random(1)
    text = " ".join(f"{rng.choice(['Alpha', 'beta', 'gamma'])}{rng.randint(0, 9999)}{rng.choice(['', ',', '.'])}" for _ in range(400_000))
    rows = [("en", text, 2, ""), ("en", "short", 1, "")]
    assert sorted(map(tuple, token_files(spark.createDataFrame(rows, SCHEMA), PATH).collect())) == expected([(1, "short"), (2, text)])
