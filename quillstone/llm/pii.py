"""Personal data: fixed patterns, and spans added by a character-level bidirectional LSTM with CRF transitions.

Base spans come from the four patterns below, leftmost and non-overlapping for each kind, on the whole text. The
model is trained in numpy on labelled spans: base spans of a bounded sample of documents (``MAX_SAMPLE`` whole
texts of at most ``SAMPLE_BYTES``), variants of them that the patterns miss (numbers without a plus, other
separators, spaced at-signs), and drawn examples. A window of ``WINDOW`` characters starts every ``STRIDE``; a span of any kind holds a
digit or an at-sign, so windows without them hold none and are not decoded. Each window is decoded by Viterbi; a
span's score is the mean marginal of its characters. Spans that touch a window's inner edge are left to the next
window. All windows' spans of a text are then reconciled at once: what overlaps a base span goes, and of the rest
the non-overlapping set of highest total score is kept. Added spans must be sure (``SURE``) and plausible (digit
counts, checksum), base spans always stay.

Defined results. Null text is the empty text: no spans. Offsets are code points. Repeated rows and null ids are
rows like others. An empty table gives no rows. Extra columns are ignored. The patterns run in linear time on any
text.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.bilstm_crf import BiLstmCrf

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, MARGIN, SURE = 128, 64, 2, 0.8
MAX_SAMPLE, DRAWN = 400, 700
#: Longest text that is drawn for training.
SAMPLE_BYTES = 50_000
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A number that starts inside a run of digits would match from the run's start as well, so the look-behind changes
# nothing but the time on long runs.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TRIGGER = re.compile("[0-9@]")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[Span]:
    """Same matches as ``[A-Za-z0-9._%+-]+@`` plus the domain, found from the at-signs: linear on any text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end(), 0
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by start and kind."""
    found = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        # Long parts cannot be at most 255 once leading zeros are gone; int() is kept to short ones.
        found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        found += [(m.start(), m.end(), 2) for m in CARD.finditer(text) if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


_SYMBOL = np.full(0x80, 1, np.int64)
_SYMBOL[[*range(0x30, 0x3A)]] = 2
_SYMBOL[[*range(0x41, 0x5B)]] = 3
_SYMBOL[[*range(0x61, 0x7B)]] = 4
for _n, _c in enumerate("@.+-()_%:/,[]"):
    _SYMBOL[ord(_c)] = 5 + _n
_SYMBOL[[0x20, 0x09, 0x0A, 0x0D]] = 0
N_SYMBOLS, N_TAGS = 19, 1 + 2 * len(KINDS)


def symbols(text: str) -> np.ndarray:
    """Classes of characters: blank, digit, capital, letter, single marks, other; non-ASCII is one class."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 0x80, _SYMBOL[np.minimum(code, 0x7F)], N_SYMBOLS - 1)


def windows(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at-sign."""
    found = set()
    for m in TRIGGER.finditer(text):
        k = m.start() // STRIDE
        found.update((max(0, k - 1) * STRIDE, k * STRIDE))
    return sorted(found)


def tag_spans(tags: np.ndarray, sure: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """Spans of a tag sequence: 1 + 2 * kind begins, the next number continues."""
    k = 0
    while k < len(tags):
        if tags[k] % 2 == 1:
            end = k + 1
            while end < len(tags) and tags[end] == tags[k] + 1:
                end += 1
            yield k, end, (int(tags[k]) - 1) // 2, float(sure[k:end].mean())
            k = end
        else:
            k += 1


def plausible(kind: int, text: str) -> bool:
    digits = _digits(text)
    if kind == 0:
        return re.fullmatch(r"[^\s@]+\s?@\s?[^\s@]+\.[A-Za-z]{2,}", text) is not None
    if kind == 1:
        return re.fullmatch(r"[0-9]{1,3}(\s?\.\s?[0-9]{1,3}){3}", text) is not None and all(int(x) <= 255 for x in re.findall("[0-9]+", text))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9 .\-]+", text) is not None
    return 10 <= len(digits) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ().\-]*[0-9]", text) is not None and re.search(r"[ ().\-]", text) is not None


def reconcile(text: str, base: list[Span], found: list[tuple[int, int, int, float]]) -> list[Span]:
    """Base spans and the best non-overlapping set of added ones, over all windows of the text."""
    busy = sorted(base)
    best: dict[Span, float] = {}
    for a, b, k, p in found:
        if p >= SURE and plausible(k, text[a:b]) and not any(a < y and x < b for x, y, _ in busy):
            best[a, b, k] = max(p, best.get((a, b, k), 0))
    spans = sorted(best, key=lambda s: (s[1], s[0]))
    ends, value, took = [s[1] for s in spans], [0.0], []
    for n, s in enumerate(spans):
        fits = int(np.searchsorted(ends[:n], s[0], "right"))
        with_it = value[fits] + best[s] * (s[1] - s[0])
        took.append((with_it > value[-1], fits))
        value.append(max(with_it, value[-1]))
    added, n = [], len(spans)
    while n:
        n, keep = (took[n - 1][1], spans[n - 1]) if took[n - 1][0] else (n - 1, None)
        if keep:
            added.append(keep)
    return sorted([*base, *added], key=lambda s: (s[0], s[2]))


def added_spans(model: BiLstmCrf, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """All spans of each text: base ones and those the model adds."""
    at = [(n, w) for n, t in enumerate(texts) for w in windows(t)]
    coded = {n: symbols(texts[n]) for n in {n for n, _ in at}}
    found: dict[int, list[tuple[int, int, int, float]]] = {}
    for k in range(0, len(at), 256):
        part = at[k : k + 256]
        ids = np.zeros((len(part), WINDOW), np.int64)
        for row, (n, w) in enumerate(part):
            piece = coded[n][w : w + WINDOW]
            ids[row, : len(piece)] = piece
        for (n, w), tags, sure in zip(part, *model.decode(ids)):
            inner = len(texts[n]) - w
            for a, b, kind, p in tag_spans(tags[:inner], sure[:inner]):
                if (a >= MARGIN or w == 0) and (b <= WINDOW - MARGIN or w + WINDOW >= len(texts[n])):
                    found.setdefault(n, []).append((w + a, w + b, kind, p))
    return [reconcile(t, b, found.get(n, [])) if n in found else b for n, (t, b) in enumerate(zip(texts, base))]


def _variant(text: str, kind: int, rng: random.Random) -> str:
    """Another way to write a span that the patterns do not match."""
    if kind == 0:
        return text.replace("@", rng.choice([" @ ", "@ ", " @"]))
    if kind == 1:
        return text.replace(".", " . ")
    if kind == 2:
        d = _digits(text)
        return rng.choice([".", "  ", " - "]).join(d[k : k + 4] for k in range(0, len(d), 4))
    d = _digits(text)[-10:]
    return rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}) {} {}"]).format(d[:3], d[3:6], d[6:])


def _drawn(rng: random.Random) -> tuple[str, list[Span]]:
    """A text with one span among words, versions, keys and dates."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randint(2, 10)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.randrange(4)
    if kind == 0:
        span = f"{word()}{rng.choice(['.', '_', '', '-'])}{number(rng.randint(0, 3))}{word()}@{word()}{rng.choice(['', number(1)])}.{rng.choice(['com', 'org', 'example.com', 'co.uk'])}"
    elif kind == 1:
        span = ".".join(str(rng.randint(0, 255)) for _ in range(4))
    elif kind == 2:
        body = number(rng.randint(13, 18))
        span = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        span = rng.choice([span, " ".join(span[k : k + 4] for k in range(0, len(span), 4))])
    else:
        span = f"+{rng.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}"
    plain = [f"version {number(1)}.{number(1)}.", f"password={word()}{number(4)}{word()}", f"\"{''.join(rng.choice('0123456789abcdef') for _ in range(40))}\"", f"{number(4)}-{number(2)}-{number(2)}", number(rng.randint(1, 9)), "CC BY-NC 4.0."]
    noise = [rng.choice(plain) if rng.random() < 0.12 else word() for _ in range(rng.randint(6, 16))]
    at = rng.randint(0, len(noise))
    head = " ".join(noise[:at])
    text = " ".join([*noise[:at], span, *noise[at:]])
    start = len(head) + (1 if at else 0)
    return text, [(start, start + len(span), kind)]


def training_set(texts: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: base spans of ``texts``, variants of them, and drawn examples."""
    rng, labelled = random.Random(seed), []
    for text in texts:
        spans = base_spans(text)
        disjoint = [s for n, s in enumerate(spans) if not any(s[0] < o[1] and o[0] < s[1] for o in spans[:n])]
        labelled.append((text, disjoint))
    labelled += [_drawn(rng) for _ in range(DRAWN)]
    ids, tags = [], []
    for text, spans in labelled:
        for vary in (False, True):
            if vary and not spans:
                continue
            pieces, placed, at, length = [], [], 0, 0
            for a, b, k in spans:
                new = _variant(text[a:b], k, rng) if vary else text[a:b]
                pieces += [text[at:a], new]
                length += a - at
                placed.append((length, length + len(new), k))
                length, at = length + len(new), b
            whole = "".join([*pieces, text[at:]])
            coded, tag = symbols(whole), np.zeros(len(whole), np.int64)
            for a, b, k in placed:
                tag[a:b] = 2 + 2 * k
                tag[a] = 1 + 2 * k
            for w in rng.sample(found, min(4, len(found))) if (found := windows(whole)) else []:
                row, mark = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
                row[: len(coded[w : w + WINDOW])], mark[: len(coded[w : w + WINDOW])] = coded[w : w + WINDOW], tag[w : w + WINDOW]
                ids.append(row)
                tags.append(mark)
    return np.array(ids), np.array(tags)


def train(texts: list[str], *, epochs: int = 10, seed: int = 3) -> BiLstmCrf:
    model = BiLstmCrf(N_SYMBOLS, N_TAGS, kind=np.float32)
    model.fit(*training_set(texts, seed), epochs=epochs)
    return model


def fitted(sample: DataFrame) -> BiLstmCrf:
    """A model of the ``text`` column of a bounded sample, trained in one task; only its weights come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted(t for batch in batches for t in batch.column(0).to_pylist() if t is not None)
        made = sorted(train(texts).p.items())
        columns = [[n for n, _ in made], [list(v.shape) for _, v in made], [np.ascontiguousarray(v, np.float32).tobytes() for _, v in made]]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.list_(pa.int32()), pa.binary()))], ["name", "shape", "weights"])

    # The row without text lets the task run where no document has anything to learn from.
    rows = sample.select("text").union(sample.sparkSession.range(1).select(F.lit(None).cast("string"))).coalesce(1)
    model = BiLstmCrf(N_SYMBOLS, N_TAGS, kind=np.float32)
    for r in rows.mapInArrow(run, "name string, shape array<int>, weights binary").collect():
        model.p[r["name"]] = np.frombuffer(r["weights"], np.float32).reshape(r["shape"]).copy()
    return model


OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("n_spans", pa.int64())])
OUT_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_sample: int = MAX_SAMPLE) -> DataFrame:
    """One row per document: doc_id, counts of base spans by kind, base_sha256, spans (all), n_added, n_spans (their number)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Whole texts with a digit or at-sign, drawn by a hash; long ones are left to be scanned, not learned from.
    some = texts.where((F.octet_length("text") <= SAMPLE_BYTES) & F.col("text").rlike("[0-9@]")).withColumn("draw", F.xxhash64("doc_id"))
    total = some.count()
    if total > max_sample:  # about a fifth more than needed, so that little is sorted and sent
        some = some.where(F.pmod("draw", F.lit(1_000_003)) < 1_000_003 * 1.2 * max_sample / total)
    model = docs.sparkSession.sparkContext.broadcast(fitted(some.orderBy("draw", "doc_id", "text").limit(max_sample)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = part.column(1).to_pylist()
                base = [base_spans(t) for t in rows]
                every = added_spans(model.value, rows, base)
                counts = [[sum(s[2] == k for s in b) for b in base] for k in range(len(KINDS))]
                digests = [hashlib.sha256(written(b).encode()).hexdigest() for b in base]
                extra = [len(e) - len(b) for e, b in zip(every, base)]
                columns = [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array([written(e) for e in every]), pa.array(extra, pa.int64()), pa.array(list(map(len, every)), pa.int64())]
                yield pa.record_batch(columns, schema=OUT)

    return texts.mapInArrow(find, OUT_DDL)
