"""Token-array operators on pre-tokenized columns (F1-F6). Pure array and
higher-order functions: no explode/regroup, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pad_truncate(ids, max_length: int, pad_id: int = 0, side: str = "right"):
    """(ids, attention_mask) of exactly ``max_length`` (F1). Right padding for
    supervised/preference rows, left padding for generation prompts."""
    i = F.slice(_c(ids), 1, max_length)
    n_pad = F.greatest(F.lit(0), F.lit(max_length) - F.size(i))
    pads, zeros, ones = F.array_repeat(F.lit(pad_id), n_pad), F.array_repeat(F.lit(0), n_pad), \
        F.array_repeat(F.lit(1), F.size(i))
    if side == "right":
        return F.concat(i, pads), F.concat(ones, zeros)
    return F.concat(pads, i), F.concat(zeros, ones)


def span_labels(ids, n_real, spans, max_length: int, keep: str = "last"):
    """Loss labels and attention mask from assistant token spans (F2).

    ``ids``: padded ids (length ``max_length``); ``n_real``: unpadded length;
    ``spans``: array<struct<start, end>> in order. Inside a span the ids are
    kept (plus the token right after it, normally eos), elsewhere -100; the
    mask position right after each span is set to 1 (the last position when
    the span is clamped). With ``keep='last'`` only the last span keeps labels,
    as in the reference, where each span resets everything before it."""
    L = max_length
    sp = _c(spans)
    if keep == "last":
        sp_lab = F.filter(F.array(F.try_element_at(sp, F.lit(-1))), lambda s: s.isNotNull())
    else:
        sp_lab = sp

    def covered(i, s):
        ts, te = F.least(s["start"], F.lit(L)), F.least(s["end"], F.lit(L))
        return (i >= ts) & ((i < te) | ((i == te) & (te < L)))

    labels = F.transform(_c(ids), lambda x, i: F.when(F.exists(sp_lab, lambda s: covered(i, s)), x)
                         .otherwise(F.lit(K.IGNORE_INDEX)))
    mask = F.transform(_c(ids), lambda x, i: F.when(
        (i < _c(n_real)) | F.exists(sp, lambda s: F.least(s["end"], F.lit(L - 1)) == i), 1).otherwise(0))
    return labels, mask


def prompt_length(mask, minus: int = 0) -> Column:
    """Count of ones in the 0/1 prompt mask, minus an optional offset."""
    return F.size(F.array_remove(_c(mask), 0)) - F.lit(minus)


def first_real(mask) -> Column:
    """0-based position of the first real token: the padding before a left-padded row, 0 for
    a right-padded one, -1 if the mask has no one."""
    return (F.array_position(_c(mask), 1) - 1).cast("int")


def response_mask(mask, prompt_len, prompt_offset=None) -> Column:
    """Shifted response mask (F4): position i (0..n-2) is kept when
    ``i >= prompt_offset + prompt_len`` and ``mask[i+1] = 1``.

    ``prompt_len`` counts real prompt tokens, so the prompt starts where the mask does:
    by default ``prompt_offset`` is the first real position, which aligns rows padded on
    either side. ``prompt_offset=0`` gives the reference's formula, which also keeps
    prompt tokens of left-padded rows."""
    m = _c(mask)
    off = first_real(m) if prompt_offset is None else prompt_offset if isinstance(prompt_offset, Column) else F.lit(prompt_offset)
    start = F.array(off + _c(prompt_len))
    # the start is bound outside the lambda over positions, so the mask is searched once
    return F.transform(start, lambda s: F.transform(F.sequence(F.lit(0), F.size(m) - 2),
                                                    lambda i: (i >= s) & (F.element_at(m, i + 2) == 1)))[0]


def left_padded(values, n_pad, pad) -> Column:
    """An array moved right by ``n_pad``: ``pad`` in front, as many of its last elements gone.
    What a right-padded row records per position is so read as that of its left-padded form."""
    v = _c(values)
    n = F.size(v)
    return F.concat(F.array_repeat(F.lit(pad), _c(n_pad).cast("int")), F.slice(v, F.lit(1), n - _c(n_pad).cast("int")))


def nonpad_mask(ids, pad_id: int = 0) -> Column:
    """``ids != pad`` (F6). Pad equals eos, so a real eos is dropped too."""
    return F.transform(_c(ids), lambda x: x != pad_id)


def collate(df: DataFrame, batch: str, ids: str, pad_id: int = 0) -> DataFrame:
    """Pad every row to the longest sequence of its batch (F5). A batch is a few rows by
    definition, so its longest is a window over them: rows are read and shuffled once."""
    out = df.withColumn("padded_len", F.max(F.size(ids)).over(Window.partitionBy(batch)))
    return out.withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad_id),
                                                                     F.col("padded_len") - F.size(ids))))
