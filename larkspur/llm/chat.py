"""Operator 5: chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context, and only
its reply is trainable. The context of a later example repeats that of an earlier one, so examples
of one conversation are prefixes of one rendering. ``render_turns`` therefore stores each rendered
turn once with its place in the rendering, and an example is a row there (``is_target``): its text
is everything up to and including its own segment, and its loss mask is the span ``loss_start`` to
``loss_end``. That keeps the output in proportion to the input; ``expand_examples`` writes the whole
examples out where a consumer wants them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut, quoted

HEAD, END = "### ", "\n</turn>\n"
_CONTROL = r"(\\|###|</turn>)"
#: A role ends at the first unescaped ``:\n``.
_CONTROL_ROLE = r"(\\|###|</turn>|:\n)"
_ESCAPED = r"\\(\\|###|</turn>|:\n)"


def escaped(column, control: str = _CONTROL):
    """Puts a backslash before each backslash and control string; ``unescaped`` takes it away."""
    return F.regexp_replace(column, control, r"\\$1")


def unescaped(column):
    return F.regexp_replace(column, _ESCAPED, "$1")


def render_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """One row for each turn: conv_id, position (from 0), segment, seg_start, is_target, loss_start, loss_end.

    A segment is ``### <role>:\\n<text>\\n</turn>\\n`` with role and text escaped, so a text that
    contains markers stays a text. Positions count code points of the conversation's rendering.
    The example of a target turn has the text of segments 0 to its own, and the loss mask
    [loss_start, loss_end) (null for other turns).

    Turns are ordered by turn, then role, then text (nulls first), so ties and repeated rows have
    one order up to equal rows, which all stay. Null role and null text count as empty. Rows with a
    null conv_id form one conversation. Other columns are left out; an empty table gives no rows.

    One shuffle by conversation. A conversation is a sequence, so one task reads its turns in order;
    the running sums stream over the sorted rows, which spill, so a conversation that holds a third
    of all rows takes time, but no memory for its turns.
    """
    rows = turns.select(F.col(quoted(conv_col)).alias("conv_id"), F.col(quoted(turn_col)).alias("turn"), F.coalesce(F.col(quoted(role_col)).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("conv_id", "turn", "role", "text", F.concat(F.lit(HEAD), escaped(F.col("role"), _CONTROL_ROLE), F.lit(":\n")).alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit(END)))
    rows = rows.withColumn("position", F.row_number().over(order) - 1).withColumn("seg_start", F.coalesce(F.sum(F.char_length("segment").cast("long")).over(before), F.lit(0).cast("long")))
    target = F.col("role") == target_role
    start = F.col("seg_start") + F.char_length("head")
    return rows.select("conv_id", "position", "segment", "seg_start", target.alias("is_target"), F.when(target, start).alias("loss_start"), F.when(target, start + F.char_length("body")).alias("loss_end"))


def expand_examples(rendered: DataFrame) -> DataFrame:
    """The whole examples: conv_id, position, formatted, loss_start, loss_end, one row for each target turn.

    The output repeats contexts, as the method wants it, and so grows with the square of a
    conversation's length. A worker holds one conversation's rendering at a time: its last example
    is that rendering, one string of one row.
    """
    kind = rendered.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prefix = (), []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for conv, position, segment, target, start, end in zip(*columns, strict=True):
                if now != (conv,):
                    now, prefix = (conv,), []
                prefix.append(segment)
                if target:
                    prefix = ["".join(prefix)]
                    yield pa.RecordBatch.from_arrays([pa.array([conv], type=batch.column(0).type), pa.array([position], pa.int32()), pa.array([prefix[0]], pa.string()), pa.array([start], pa.int64()), pa.array([end], pa.int64())], names=["conv_id", "position", "formatted", "loss_start", "loss_end"])

    rows = rendered.select("conv_id", "position", "segment", "is_target", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return rows.mapInArrow(run, f"conv_id {kind}, position int, formatted string, loss_start bigint, loss_end bigint")


def read_back(rendered: DataFrame) -> DataFrame:
    """What the rendering says of each conversation, read from its segments and loss spans alone.

    Returns conv_id, n_turns, turns_sha256 (of role, newline, text, newline of every turn),
    loss_chars and loss_sha256 (of all text under the loss masks, unescaped), formatted_chars (code
    points of all examples of the conversation). Turns are read in sorted order with running
    digests; no conversation is held in memory.
    """
    kind = rendered.schema["conv_id"].dataType.simpleString()
    shape = r"(?s)\A### ((?:[^\\]|\\(?:\\|###|</turn>|:\n))*?):\n(.*)\n</turn>\n\z"
    inner = F.col("segment").substr(F.col("loss_start") - F.col("seg_start") + 1, F.col("loss_end") - F.col("loss_start"))
    rows = rendered.select(
        "conv_id", "position", unescaped(F.regexp_extract("segment", shape, 1)).alias("role"), unescaped(F.regexp_extract("segment", shape, 2)).alias("text"),
        F.when(F.col("is_target"), unescaped(inner)).alias("loss"), F.when(F.col("is_target"), F.col("seg_start") + F.char_length("segment")).alias("chars"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, state = (), []

        def close() -> None:
            if now:
                n, all_text, loss_chars, loss, chars = state
                done.append((now[0], n, all_text.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def flush(type_: pa.DataType) -> pa.RecordBatch:
            types = [type_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*done, strict=True)) if done else [()] * 6
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=_READ)

        type_ = None
        for batch in batches:
            type_ = batch.column(0).type
            for conv, role, text, loss, chars in zip(*[batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5)], strict=True):
                if now != (conv,):
                    close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                    state[4] += chars
            if len(done) > 10_000:
                yield flush(type_)
        close()
        if done:
            yield flush(type_)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def read_examples(examples: DataFrame) -> DataFrame:
    """What the whole examples say of each conversation that has any: conv_id, loss_chars, loss_sha256 and formatted_chars, as ``read_back`` has them.

    Loss is cut out of each example's own text, and the text is counted; only the loss is shuffled.
    """
    kind = examples.schema["conv_id"].dataType.simpleString()
    inner = F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    rows = examples.select("conv_id", "position", unescaped(inner).alias("loss"), F.char_length("formatted").cast("long").alias("chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, loss_chars, digest, chars = (), 0, hashlib.sha256(), 0
        done: list[tuple] = []

        def flush(type_: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [type_, pa.int64(), pa.string(), pa.int64()], strict=True)], names=["conv_id", *_READ[3:]])

        type_ = None
        for batch in batches:
            type_ = batch.column(0).type
            for conv, loss, n in zip(*[batch.column(k).to_pylist() for k in (0, 2, 3)], strict=True):
                if now != (conv,):
                    if now:
                        done.append((now[0], loss_chars, digest.hexdigest(), chars))
                    now, loss_chars, digest, chars = (conv,), 0, hashlib.sha256(), 0
                loss_chars += len(loss)
                digest.update(loss.encode())
                chars += n
            if len(done) > 10_000:
                yield flush(type_)
        if now:
            done.append((now[0], loss_chars, digest.hexdigest(), chars))
            yield flush(type_)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.mapInArrow(run, f"conv_id {kind}, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def read_whole(rendered: DataFrame) -> DataFrame:
    """``read_back``, with loss and formatted_chars read from the examples that ``expand_examples`` writes out."""
    rendered = cut(rendered)
    turns, examples = read_back(rendered).select(*_READ[:3]), read_examples(expand_examples(rendered)).withColumnRenamed("conv_id", "_conv")
    joined = turns.join(examples, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select(*_READ[:3], F.coalesce("loss_chars", F.lit(0).cast("long")).alias("loss_chars"), F.coalesce("loss_sha256", F.lit(hashlib.sha256().hexdigest())).alias("loss_sha256"), F.coalesce("formatted_chars", F.lit(0).cast("long")).alias("formatted_chars"))


_READ = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
