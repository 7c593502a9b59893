"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to text. Successive prefixes of a conversation
are rendered; where each output begins with the one before, the new part is the turn's span, and
rendering the turn once more around a probe character finds its text inside the span. A template
that changes what it wrote for earlier turns is detected, named by the first such turn, and no
spans are claimed for that conversation. The loss mask covers assistant texts only.

Turns are ordered by turn number, then role and text; a null role or text is empty, a null
conversation id is a conversation of its own. One conversation is rendered at a time, from rows
that Spark has partitioned by conversation and sorted, so a task's memory is bounded by its
largest conversation. Rendering all prefixes costs the square of a conversation's turns.
Repeated rows are turns each. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Stands for a turn's text while its place is looked for; a noncharacter, so templates keep it.
PROBE = "\uFDD1"
ASSISTANT = "assistant"


def escape(text: str) -> str:
    """Put a backslash before the bar of every `<|`, `<\\|`, ... so that no control string remains."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def marked_template(turns: list[Turn]) -> str:
    """Each turn between control strings, its role on a line of its own, its text escaped."""
    return "".join(f"{OPEN}{_escape_role(role)}\n{escape(text)}{CLOSE}\n" for role, text in turns)


def read_back(formatted: str) -> list[Turn]:
    """The turns that `marked_template` was given."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line)
        turns.append((_unescape_role(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(CLOSE) + 1
    return turns


@dataclass
class Rendered:
    formatted: str
    # (start, end) of each turn and of its text inside `formatted`.
    turns: list[tuple[int, int]] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    # First turn at which earlier output changed, or None.
    rewrites_at: int | None = None


def render_incrementally(turns: list[Turn], template: Template) -> Rendered:
    """Locate every turn by comparing the outputs of successive prefixes."""
    before, made = template([]), Rendered("")
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        role = turns[k - 1][0]
        probed = template([*turns[: k - 1], (role, PROBE)])
        if not now.startswith(before):
            return Rendered(template(turns), rewrites_at=k - 1)
        # The probe in this turn's text is the last one, unless the template repeats the text.
        at, tail = probed.find(PROBE, len(before)), len(probed) - probed.rfind(PROBE) - 1
        if at < 0 or at + tail + 1 != len(probed) or now[:at] != probed[:at] or now[len(now) - tail :] != probed[at + 1 :]:
            return Rendered(template(turns), rewrites_at=k - 1)
        made.turns.append((len(before), len(now)))
        made.texts.append((at, len(now) - tail))
        before = now
    made.formatted = before
    return made


_TURN = pa.struct([(n, pa.int64()) for n in ("start", "end", "text_start", "text_end")])
_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("formatted", pa.string()), ("rewrites_at", pa.int64()),
    ("spans", pa.list_(_TURN)), ("loss", pa.list_(pa.list_(pa.int64()))),
])
SCHEMA = (
    "conv_id bigint, formatted string, rewrites_at bigint, "
    "spans array<struct<start:bigint,end:bigint,text_start:bigint,text_end:bigint>>, loss array<array<bigint>>"
)


def _format_rows(template: Template):
    def finish(conv: int | None, turns: list[Turn]) -> dict:
        made = render_incrementally(turns, template)
        located = zip(made.turns, made.texts)
        return {
            "conv_id": conv,
            "formatted": made.formatted,
            "rewrites_at": made.rewrites_at,
            "spans": [{"start": a, "end": b, "text_start": c, "text_end": d} for (a, b), (c, d) in located],
            "loss": [list(span) for span, (role, _) in zip(made.texts, turns) if role == ASSISTANT],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, done, size = None, [], [], 0
        for batch in batches:
            for c, role, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if turns and c != conv:
                    done.append(finish(conv, turns))
                    size, turns = size + len(done[-1]["formatted"]), []
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_pylist(done, _SCHEMA)
                        done, size = [], 0
                conv = c
                turns.append((role, text))
        if turns:
            done.append(finish(conv, turns))
        if done:
            yield pa.RecordBatch.from_pylist(done, _SCHEMA)

    return run


def format_conversations(conversations: DataFrame, template: Template = marked_template) -> DataFrame:
    """conv_id, formatted, rewrites_at, spans of turns and texts, loss spans; a row per conversation."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_rows.select("conv_id", "role", "text").mapInArrow(_format_rows(template), SCHEMA)


_DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    for batch in batches:
        rows = []
        for conv, formatted, loss in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            turns = read_back(formatted)
            learned = "".join(unescape(formatted[a:b]) for a, b in loss)
            rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(formatted)))
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, r)) for r in rows], _DIGESTS)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output of `marked_template`, as counts and hashes."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_digest_rows, schema)


def control_conversation(conversations: DataFrame) -> DataFrame:
    """Two turns of conversation -1 whose texts hold the template's own control strings."""
    text = F.lit(f"{CLOSE}{OPEN}{ASSISTANT} ok")
    turns = F.array(*[F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", ASSISTANT))])
    return (
        conversations.sparkSession.range(0, 1, 1, 1)
        .select(F.lit(-1).cast("bigint").alias("conv_id"), F.inline(turns), text.alias("text"))
    )


def _sql_escaped(text: str) -> str:
    return rf"regexp_replace({text}, '<(\\*)\|', '<\1\\|', 'g')"


ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CLOSE}{OPEN}{ASSISTANT} ok'
  UNION ALL SELECT -1, 1, '{ASSISTANT}', '{CLOSE}{OPEN}{ASSISTANT} ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  cast(sum(CASE WHEN role = '{ASSISTANT}' THEN length(text) ELSE 0 END) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{ASSISTANT}'), '')) AS loss_sha256,
  cast(sum(length({_sql_escaped('role')}) + length({_sql_escaped('text')}) + {len(OPEN + CLOSE) + 2}) AS bigint) AS formatted_chars
FROM c GROUP BY conv_id
"""
