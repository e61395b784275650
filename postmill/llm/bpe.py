"""Byte-pair encoding by forced boundaries, and its decoding (operator 7).

Inside a pre-token, two neighbouring byte symbols that stand side by side in no
vocabulary token can never end up in one token: every merge result is a vocabulary
token, so no merge crosses them. The pre-token is cut there and each fragment is
merged by itself; the ids are then concatenated. Pre-tokens repeat, so the ids of those
met lately are kept, as bytes, up to a number of bytes; a text's ids stay bytes until a
slice of texts becomes one Arrow column, from which the decoded texts are taken.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postmill.llm.common import give_back, slices

CACHE = 400_000  # entries a worker keeps before it starts its cache anew
CACHE_BYTES = 16_000_000  # of each of the two generations of pre-tokens that a worker keeps
ENTRY_BYTES = 150         # of a kept pre-token besides its letters and ids
SLICE = 1_000_000
LONG = 48        # symbols from which a heap replaces the scan for the best pair
NEVER = float("inf")

# Pre-token pattern of the model file (a format that must match).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


def merge(parts: list[str], ranks: dict[tuple[str, str], float]) -> list[str]:
    """Merge the pair of lowest rank, leftmost first, until no neighbours have a rank."""
    if len(parts) > LONG:
        return _merge_heap(parts, ranks)
    get = ranks.get
    order = [get(p, NEVER) for p in zip(parts, parts[1:])]
    while order:
        best = min(order)
        if best == NEVER:
            break
        i = order.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del order[i]
        if i < len(order):
            order[i] = get((parts[i], parts[i + 1]), NEVER)
        if i:
            order[i - 1] = get((parts[i - 1], parts[i]), NEVER)
    return parts


def _merge_heap(parts: list[str], ranks: dict[tuple[str, str], float]) -> list[str]:
    """The same in n log n for long pre-tokens: a heap of pairs over a linked list."""
    sym, n = list(parts), len(parts)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < n and (r := ranks.get((sym[i], sym[j]))) is not None:
            heapq.heappush(heap, (r, i, sym[i], sym[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = a + b, None
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        offer(i, nxt[i])
        offer(prv[i], i)
    return [s for s in sym if s is not None]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others for U+0100 upwards."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBPE:
    """Encoder and decoder over a byte-level BPE model file with word ends."""

    def __init__(self, blob: bytes):
        j = json.loads(blob)
        model = j["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids = dict(model["vocab"])
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.names = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        self.bytes = byte_alphabet()
        self.pre = regex.compile(PRE_TOKEN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.inside = {pair for t in self.ids for pair in self._neighbours(t)}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def symbols(self, word: str) -> list[str]:
        """Byte symbols of a pre-token; the last one carries the word end."""
        out = [self.bytes[b] for b in word.encode("utf-8")]
        out[-1] += self.end
        return out

    def _neighbours(self, token: str) -> Iterator[tuple[str, str]]:
        ends = bool(self.end) and token.endswith(self.end)
        chars = list(token[:-len(self.end)] if ends else token)
        if ends and chars:
            chars[-1] += self.end
        return zip(chars, chars[1:])

    def fragments_of(self, symbols: list[str]) -> Iterator[tuple[str, ...]]:
        """Cut wherever two neighbours occur side by side in no vocabulary token."""
        start = 0
        for i in range(1, len(symbols)):
            if (symbols[i - 1], symbols[i]) not in self.inside:
                yield tuple(symbols[start:i])
                start = i
        yield tuple(symbols[start:])

    def encode_word(self, word: str) -> bytes:
        """Ids (32-bit) of a pre-token, merged fragment by fragment."""
        out = array("i")
        for f in self.fragments_of(self.symbols(word)):
            out.extend([self.ids[t] for t in merge(list(f), self.ranks)])
        return out.tobytes()

    def met(self, word: str) -> bytes:
        """Ids of a pre-token that the younger generation does not hold; it does afterwards."""
        got = self.older.get(word)
        if got is None:
            got = self.encode_word(word)
        if len(word) <= LONG:
            if self.held >= CACHE_BYTES:
                self.older, self.words, self.held = self.words, {}, 0
            self.words[word] = got
            self.held += ENTRY_BYTES + len(word) + len(got)
        return got

    def pre_tokens(self, text: str) -> list[str]:
        if not text.isascii():
            # one character at a time lower-cases a final capital sigma like any other
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pre.findall(text.lower())

    def encoded(self, text: str | None) -> bytes:
        """Ids (32-bit) of a whole text; special strings in it become their own ids."""
        if not text:
            return b""
        out: list[bytes] = []
        for k, part in enumerate(self.cut.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(array("i", [self.special[part]]).tobytes())
                continue
            get = self.words.get
            for w in self.pre_tokens(part):
                got = get(w)
                if got is None:
                    got = self.met(w)
                    get = self.words.get
                out.append(got)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encoded(text)).tolist()

    def decode(self, ids) -> str:
        """The model file names no decoder, so tokens are joined by one space."""
        return " ".join([self.names[i] for i in ids])


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_MODELS: dict[str, WordBPE] = {}


def _model(key: str, blob) -> WordBPE:
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = WordBPE(blob.value)
    return _MODELS[key]


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  decoded: bool = True) -> DataFrame:
    """Columns ``keep``, then ``ids array<int>`` and (with ``decoded``) the decoded text.

    The model file (bounded, a few MB) is read by the driver and broadcast. Texts are
    whole. Null and empty texts give no ids and an empty decoded text; repeated rows
    repeat; other columns of ``docs`` are ignored.
    """
    sc = docs.sparkSession.sparkContext
    blob = sc.broadcast(read_file(model_path))
    key = uuid.uuid4().hex  # a worker builds the model once for each call
    src = docs.select(*keep, docs[text_col].cast("string").alias("_text"))
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType(), False))
    schema = T.StructType([*src.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n = _model(key, blob), len(keep)
        names = pa.array([model.names.get(i, "") for i in range(max(model.names) + 1)], pa.string())
        for batch in batches:
            for start, size in slices(batch.column(n), SLICE):
                part = batch.slice(start, size)
                texts = [model.encoded(t.as_py()) for t in part.column(n)]
                ends = pa.array(np.cumsum([0, *(len(x) // 4 for x in texts)]), pa.int32())
                ids = pa.array(np.frombuffer(b"".join(texts), np.int32))
                cols = [*part.columns[:n], pa.ListArray.from_arrays(ends, ids)]
                if decoded:
                    cols.append(pc.binary_join(pa.ListArray.from_arrays(ends, names.take(ids)), " "))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        give_back()

    return src.mapInArrow(run, schema)
