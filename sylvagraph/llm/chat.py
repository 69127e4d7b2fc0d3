"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and only that reply trainable. A
conversation that doesn't end with an assistant turn also gives one example without a target, so that no turn is lost.

Template: `<|im_start|>ROLE\\nTEXT<|im_end|>\\n` for each turn. Inside roles and texts, the escape character and the
`<` of both control strings are escaped (`\\` as `\\\\`, `<|` as `\\<|`), and line ends inside roles as `\\n`, so every
control string left in an example is one of the template, and unescaping gives back each turn exactly.

Defined cases: null text or role counts as empty; rows are taken by turn, then role, then text, nulls first; repeated
rows are turns of their own; rows without a conversation id form one conversation with a null id; a conversation
without an assistant turn has its targetless example only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by, rows_of, tune

START, END, TARGET_ROLE = "<|im_start|>", "<|im_end|>", "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "\\<|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, k = [], 0
    while (at := text.find("\\", k)) >= 0:
        out += [text[k:at], "\n" if text[at + 1] == "n" else text[at + 1]]
        k = at + 2
    return "".join([*out, text[k:]])


def expand(turns: list[tuple[str, str]]) -> Iterator[tuple[str, int, int]]:
    """(formatted text, start and end of its trainable characters); start = end for the example without a target."""
    done, at = [], 0
    for k, (role, text) in enumerate(turns):
        head = f"{START}{escape_role(role)}\n"
        body = escape(text)
        done.append(f"{head}{body}{END}\n")
        start = at + len(head)
        at += len(done[-1])
        if role == TARGET_ROLE:
            yield "".join(done), start, start + len(body)
        elif k == len(turns) - 1:
            yield "".join(done), at, at


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of an example."""
    turns = []
    for part in _split(formatted, START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape(role), unescape(_split(rest, END)[0])))
    return turns


def _split(text: str, mark: str) -> list[str]:
    """Splits at control strings of the template. A `<` after an odd number of escapes is not one of them."""
    parts, begin, k = [], 0, 0
    while (at := text.find(mark, k)) >= 0:
        back = at
        while back > begin and text[back - 1] == "\\":
            back -= 1
        k = at + 1
        if (at - back) % 2 == 0:
            parts.append(text[begin:at])
            begin = k = at + len(mark)
    return [*parts, text[begin:]]


def format_chat(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start, loss_end (in code points)."""
    tune(conversations.sparkSession)
    blank = F.lit("")
    turns = conversations.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text")).alias("t"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), ("example", pa.int32()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
            found = ((conv, n, *x) for conv, roles, texts in rows_of([batch]) for n, x in enumerate(expand(list(zip(roles, texts, strict=True)))))
            yield from batches_by(found, schema)

    return rows.mapInArrow(run, f"conv_id {id_type}, example int, formatted string, loss_start bigint, loss_end bigint")


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the examples alone.

    Each example gives its target and length; only the longest one of a conversation, which holds all turns, is parsed.
    """
    id_type = examples.schema["conv_id"].dataType.simpleString()
    one = examples.withColumn("target", F.expr("substring(formatted, int(loss_start) + 1, int(loss_end - loss_start))"))
    grouped = one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("example", "target"))).alias("targets"), F.max_by("formatted", "example").alias("formatted"), F.sum(F.length("formatted")).alias("formatted_chars"))
    grouped = grouped.select("conv_id", F.col("targets.target").alias("targets"), "formatted", "formatted_chars")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

            def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                for conv, targets, formatted, chars in rows_of([batch]):
                    turns = parse(formatted)
                    loss = "".join(map(unescape, targets))
                    yield conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars

            yield from batches_by(rows(), schema)

    return grouped.mapInArrow(run, f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
