"""Token counts by the whole-token shortcut (operator 5).

A sentence-piece BPE model marks spaces inside the text. No vocabulary piece holds a
space mark after another character, so merges never cross the gap before a run of
spaces: a text is the sequence of its pre-tokens (a run of spaces and the characters
up to the next one). Offline, every vocabulary string is merged by itself; those that
come out as one token form the proven set. A pre-token in that set counts 1 directly;
only the others are merged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postmill.llm.bpe import CACHE, LONG, merge, read_file
from postmill.llm.common import slices

MARK = "▁"


class PieceCounter:
    """Counts the tokens of texts; picklable, so the driver builds it once.

    ``pieces`` maps each ordinary vocabulary string to its score.
    """

    def __init__(self, pieces: dict[str, float]):
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a space mark after another character")
        self.pieces = set(pieces)
        inside = {c for p in pieces for c in p}
        symbols = self.pieces | inside
        self.ranks = {(p[:i], p[i:]): -s for p, s in pieces.items() for i in range(1, len(p))
                      if p[:i] in symbols and p[i:] in symbols}
        # characters that are in no piece stand alone, so the text is also cut around them
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        self.cut = re.compile(f" *[^ {alone}]+| +" + (f"|[{alone}]" if alone else ""))
        self.whole = {p.replace(MARK, " ") for p in pieces if len(merge(list(p), self.ranks)) == 1}
        self.known: dict[str, int] = {}

    def tokens_of(self, pre_token: str) -> int:
        """Merge one pre-token; a character without a piece falls back to its bytes."""
        pieces = self.pieces
        return sum(1 if t in pieces else len(t.encode("utf-8"))
                   for t in merge(list(pre_token.replace(" ", MARK)), self.ranks))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        whole, known, total = self.whole, self.known, 0
        for p, n in Counter(self.cut.findall(" " + text.replace(MARK, " "))).items():
            if p in whole:
                total += n
                continue
            got = known.get(p)
            if got is None:
                got = self.tokens_of(p)
                if len(p) <= LONG:
                    if len(known) >= CACHE:
                        known.clear()
                    known[p] = got
            total += n * got
        return total


def piece_counter(model_path: str) -> PieceCounter:
    """Read a sentence-piece BPE model and prove its whole tokens.

    The model must copy text unchanged apart from the leading space (identity
    normalizer, dummy prefix, byte fallback); anything else is refused.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    proto.ParseFromString(read_file(model_path))
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
        raise ValueError("needs an identity normalizer, a dummy prefix and byte fallback")
    normal = pb.ModelProto.SentencePiece.NORMAL
    if any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in proto.pieces):
        raise ValueError("user-defined pieces are not supported")
    return PieceCounter({p.piece: p.score for p in proto.pieces if p.type == normal})


def token_counts(docs: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 limit: int = 4096) -> DataFrame:
    """Columns ``keep``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    No begin, end or special tokens are added; special strings are ordinary text. Null
    and empty texts have 0 tokens; repeated rows repeat; other columns are ignored.
    """
    counter = docs.sparkSession.sparkContext.broadcast(piece_counter(model_path))
    src = docs.select(*keep, docs[text_col].cast("string").alias("_text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("n_bytes", T.LongType(), False),
                           T.StructField("n_tokens", T.LongType(), False),
                           T.StructField("over_limit", T.BooleanType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter.value.count
        for batch in batches:
            n = len(keep)
            for start, size in slices(batch.column(n)):
                part = batch.slice(start, size)
                texts = part.column(n).to_pylist()
                tokens = [count(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n], pa.array([len(t.encode("utf-8")) if t else 0 for t in texts], pa.int64()),
                     pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                    names=schema.names)

    return src.mapInArrow(run, schema)
