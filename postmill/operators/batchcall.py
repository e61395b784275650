"""A user's function over bounded batches of rows (H1, H2).

Where a recorded table does not exist yet, the model call itself is a function from a
batch of inputs to a batch of outputs. It runs inside the partitions: each task cuts its
rows into batches bounded in rows and bytes, calls the function, checks what it returns
against a declared schema and appends the output columns. A batch that raises does not
fail the job; its rows come out with a ``reject_reason``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from postmill.functions.answer import parse_reward
from postmill.session import let_workers_import

BATCH_ROWS, BATCH_BYTES = 64, 1 << 20
REASON = "reject_reason"
REASON_CHARS = 200


class OutputMismatch(ValueError):
    """The function broke its contract: missing columns, another number of rows, other types."""


def row_bytes(batch: pa.RecordBatch) -> list[int]:
    """Bytes of the text columns of each row; what else a row holds is small."""
    total = [0] * batch.num_rows
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            total = [a + b for a, b in zip(total, pc.fill_null(pc.binary_length(col), 0).to_pylist())]
    return total


def bounded(batch: pa.RecordBatch, rows: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``rows`` rows and ``limit`` bytes of text, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(row_bytes(batch)):
        if i > start and (i - start >= rows or held + n > limit):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def checked(result, names: Sequence[str], types: Sequence[pa.DataType], rows: int) -> list[pa.Array]:
    """The declared output columns as arrays; OutputMismatch where the result is another."""
    frame = result if isinstance(result, pd.DataFrame) else pd.DataFrame(result)
    missing = [n for n in names if n not in frame.columns]
    if missing:
        raise OutputMismatch(f"the function returned no column {', '.join(missing)}")
    if len(frame) != rows:
        raise OutputMismatch(f"the function returned {len(frame)} rows for {rows}")
    try:
        return [pa.Array.from_pandas(frame[n], type=t, safe=True) for n, t in zip(names, types)]
    except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError) as e:
        raise OutputMismatch(f"the function returned values of another type: {e}") from e


def call_in_batches(df: DataFrame, fn: Callable[[pd.DataFrame], object] | None, output: str | T.StructType, inputs: Sequence[str] | None = None, *,
                    setup: Callable[[], Callable[[pd.DataFrame], object]] | None = None, batch_rows: int = BATCH_ROWS,
                    batch_bytes: int = BATCH_BYTES, isolate: bool = True, retries: int = 0, tasks: int | None = None) -> DataFrame:
    """``df`` with the columns of ``output`` that ``fn`` returns for them, and ``reject_reason``.

    ``fn`` gets a pandas frame of the columns ``inputs`` (all by default) with at most
    ``batch_rows`` rows and ``batch_bytes`` bytes of text (a longer row is a batch of its
    own) and returns a frame, or a mapping of lists, with a row for each row in order. It
    may run again after a lost executor, so it should not depend on being called once.
    ``setup`` is called once a task instead and returns the function, for one that must
    load something first. With ``tasks`` the rows are dealt to as many tasks before, as a
    call costs far more than moving its rows.

    If a call raises, it is tried ``retries`` times more; then the batch is halved until
    only the rows at fault are left (``isolate``), or rejected as a whole. A rejected row
    keeps its columns, has null outputs and the error's type and text as
    ``reject_reason``; it is null for all others, so ``curate.split_kept`` splits them. A
    result that breaks the declared schema is a fault of the function and not of a row:
    the job fails with ``OutputMismatch``. Clashing column names are refused at once. A
    partition without rows calls nothing.
    """
    let_workers_import(df.sparkSession)
    if (fn is None) == (setup is None):
        raise ValueError("give fn or setup")
    if batch_rows < 1 or batch_bytes < 1:
        raise ValueError("batches need a row and a byte at least")
    schema = output if isinstance(output, T.StructType) else T._parse_datatype_string(output)
    names = schema.names
    clash = sorted({*names, REASON} & set(df.columns)) + sorted({n for n in names if names.count(n) > 1 or n == REASON})
    if clash:
        raise ValueError(f"columns {', '.join(clash)} exist already")
    inputs = list(df.columns if inputs is None else inputs)
    places = [df.columns.index(c) for c in inputs]
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    full = T.StructType([*df.schema.fields, *[T.StructField(f.name, f.dataType) for f in schema.fields], T.StructField(REASON, T.StringType())])

    def outcome(call, rows: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array], str | None]]:
        given = pa.Table.from_batches([rows.select(places)]).to_pandas()
        for left in range(retries, -1, -1):
            try:
                result = call(given)
            except Exception as e:  # noqa: BLE001  whatever the user's function raises is the row's outcome
                if left:
                    continue
                if isolate and rows.num_rows > 1:
                    half = rows.num_rows // 2
                    yield from outcome(call, rows.slice(0, half))
                    yield from outcome(call, rows.slice(half))
                else:
                    yield rows, [pa.nulls(rows.num_rows, t) for t in types], f"{type(e).__name__}: {e}"[:REASON_CHARS]
                return
            yield rows, checked(result, names, types, rows.num_rows), None
            return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = fn
        for batch in batches:
            if batch.num_rows and call is None:
                call = setup()
            for part in bounded(batch, batch_rows, batch_bytes):
                for rows, made, reason in outcome(call, part):
                    why = pa.array([reason] * rows.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays([*rows.columns, *made, why], names=full.names)

    return (df if tasks is None else df.repartition(tasks)).mapInArrow(run, full)


def respond(requests: DataFrame, fn: Callable[[pd.DataFrame], object] | None, inputs: Sequence[str] = ("messages",), **options) -> DataFrame:
    """H1 by a function: ``response`` for each request (or a ``reject_reason``)."""
    return call_in_batches(requests, fn, "response string", inputs, **options)


def reward(requests: DataFrame, fn: Callable[[pd.DataFrame], object] | None, inputs: Sequence[str] = ("reward_request",), form: str = "last",
           **options) -> DataFrame:
    """H2 by a function: the ``reply`` to each reward request and the ``score`` parsed from it
    (D5). A reply that does not parse is a reject like a call that raised."""
    out = call_in_batches(requests, fn, "reply string", inputs, **options)
    out = out.withColumn("score", parse_reward(F.col("reply"), form))
    return out.withColumn(REASON, F.coalesce(REASON, F.when(F.col("score").isNull(), "unparsable")))
