"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a text.  Successive prefixes of a conversation are
rendered, and what a turn adds to the output is its span; a template that does not repeat its earlier
output at the front of the next one rewrites history and is reported for that turn.  Inside a span the
place of the turn's text is found the same way: the turn is rendered once more with an empty text, and
what the two outputs have in common at both ends is the frame.

`reach` tells how many turns before it a turn's rendering may look at (None: all of them).  With a finite
reach a conversation is cut into blocks, each rendered behind the turns it may look at, so that one very
long conversation is spread over many tasks and no prefix grows beyond a block.  The promise is held against the
template: the last turn of every block that has more turns is rendered a second time behind no more than `reach`
turns, and a span that differs stops the job.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Turn = tuple[str, str]
BLOCK = 32

# The marks of a turn, and how a mark, an escape sign or a line end inside it is written.
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], text)


def _role(role: str) -> str:
    return escaped(role).replace("\n", "\\n")


def marked(turns: Sequence[Turn]) -> str:
    """The default template: start mark, role, line end, text, end mark, line end."""
    return "".join(f"{START}{_role(role)}\n{escaped(text)}{END}\n" for role, text in turns)


def parsed(span: str) -> Turn:
    """Role and text of one rendered turn of the default template."""
    role, _, rest = span[len(START) :].partition("\n")
    return unescaped(role), unescaped(rest[: -len(END) - 1])


@dataclass(frozen=True)
class Template:
    render: Callable[[Sequence[Turn]], str] = marked
    reach: int | None = 0
    trained_roles: tuple[str, ...] = ("assistant",)


def common_front(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def spans(turns: Sequence[Turn], behind: Sequence[Turn], template: Template) -> Iterator[tuple[str, int, int, bool]]:
    """For each turn its span, where its text starts and ends in it, and whether history was rewritten."""
    so_far = list(behind)
    before = template.render(so_far)
    for role, text in turns:
        one, two = (template.render([*so_far, (role, probe)]) for probe in "01")
        so_far.append((role, text))
        now = template.render(so_far)
        kept = now.startswith(before)
        start = len(before) if kept else common_front(before, now)
        # What two probes have in common before and after them frames the text.
        head = max(common_front(one, two) - start, 0)
        tail = common_front(one[::-1], two[::-1])
        span = now[start:]
        yield span, head, len(span) - tail, not kept
        before = now


class ReachError(ValueError):
    """A template looks at more turns than it is said to."""


def check_reach(turns: Sequence[Turn], behind: Sequence[Turn], template: Template, span: str) -> None:
    """Hold the span of the last turn against a rendering behind `reach` turns only."""
    earlier = [*behind, *turns[:-1]]
    if template.reach is None or len(earlier) <= template.reach:
        return
    near = earlier[len(earlier) - template.reach :]
    alone = next(spans(turns[-1:], near, template))[0]
    if alone != span:
        raise ReachError(f"the rendering of a turn depends on more than the {template.reach} turns before it")


SCHEMA = "conv_id long, block long, place long, span string, text_start long, text_end long, trained boolean, rewrites boolean"


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """A row for each turn, in the order (conv_id, block, place): its span, the place of its text, the loss mask.

    The text under the mask is span[text_start:text_end] where `trained` is true; `rewrites` tells that
    the template changed earlier output when this turn came.  Defined results for odd rows: a null role
    or text is empty; turns are ordered by turn, role and text, a null turn first; repeated rows are turns
    of their own; rows without conv_id form one conversation; further columns are left out.  A template that
    looks at more turns than its reach ends the job with a ReachError, as far as a block has more turns.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.lit(False).alias("behind"),
    )
    if template.reach is None:
        rows = rows.withColumn("block", F.lit(0).cast("long"))
    elif template.reach == 0:
        rows = rows.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK).cast("long"))
    else:
        order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
        rows = rows.withColumn("number", F.row_number().over(order) - 1)
        rows = rows.withColumn("block", F.floor(F.col("number") / BLOCK).cast("long"))
        ahead = F.floor((F.col("number") + template.reach) / BLOCK).cast("long")
        led = rows.withColumn("_to", F.explode(F.sequence(F.col("block"), ahead)))
        rows = led.select("conv_id", "turn", "role", "text", (F.col("_to") > F.col("block")).alias("behind"),
                          F.col("_to").alias("block"))
    dealt = rows.select("conv_id", "block", "turn", "role", "text", "behind").repartition("conv_id", "block")
    dealt = dealt.sortWithinPartitions("conv_id", "block", "turn", "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for (conv, block), turns in _runs(batches):
            place = 0
            for behind, chain in _chains(turns, template.reach):
                for turn, (span, start, end, rewrites) in zip(chain, spans(chain, behind, template), strict=True):
                    made.append((conv, block, place, span, start, end, turn[0] in template.trained_roles, rewrites))
                    place += 1
                    if len(made) >= 2_000:
                        yield _batch(made)
                        made = []
                check_reach(chain, behind, template, span)
        if made:
            yield _batch(made)

    return dealt.mapInArrow(render, SCHEMA)


_KINDS = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]


def _batch(made: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    columns = zip(*made, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Neighbouring rows with one (conv_id, block), as streams of (role, text, behind)."""
    for key, rows in groupby(_rows(batches), key=lambda row: row[:2]):
        yield key, (row[3:] for row in rows)


def _chains(turns: Iterator[tuple], reach: int | None) -> Iterator[tuple[list[Turn], list[Turn]]]:
    """The turns that a chain of prefixes starts behind, and the turns of the chain."""
    behind: list[Turn] = []
    chain: list[Turn] = []
    for role, text, is_behind in turns:
        if is_behind:
            behind.append((role, text))
            continue
        chain.append((role, text))
        if reach is not None and len(chain) == BLOCK:
            yield behind, chain
            behind, chain = (behind + chain)[len(behind) + len(chain) - reach :], []
    if chain:
        yield behind[max(len(behind) - reach, 0) :] if reach is not None else behind, chain


def conversation_digests(formatted: DataFrame, parse: Callable[[str], Turn] = parsed) -> DataFrame:
    """Digests of every conversation, read back from the formatted spans in a stream.

    A conversation passes through one task, for a digest is sequential, but no more of it than a turn is
    held at a time.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block", "place")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for conv, rows in groupby(_rows(batches), key=lambda row: row[0]):
            turns, lost = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            for _, _, _, span, start, end, trained, _ in rows:
                role, text = parse(span)
                turns.update(f"{role}\n{text}\n".encode())
                n_turns += 1
                chars += len(span)
                if trained:
                    masked = unescaped(span[start:end])
                    lost.update(masked.encode())
                    loss_chars += len(masked)
            made.append((conv, n_turns, turns.hexdigest(), loss_chars, lost.hexdigest(), chars))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*made, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return ordered.mapInArrow(
        digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
