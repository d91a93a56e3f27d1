"""Chat formatting in budgeted windows, and reading formatted windows back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorframe.llm.common import bare, written

#: Fixed values of the template. A turn is ``### Role: text</turn>\n``.
HEAD, TAIL = "### ", "</turn>"
_ESCAPE = re.compile(r"\\|### |</turn>")
_UNESCAPE = re.compile(r"\\(\\|### |</turn>)")
_TURN = re.compile(r"### ((?:[^\\\n:]++|\\.)*+): ((?:[^\\<]++|\\\\|\\### |\\</turn>|<(?!/turn>))*+)</turn>\n", re.S)
_ROLE = re.compile(r"[\\:\n]")
_ROLE_BACK = re.compile(r"\\(.)", re.S)

WINDOWS = (
    "conv_id long, window long, text string, first_turn long, n_turns long, n_system long, n_history long, n_tokens long,"
    " over_budget boolean, loss_starts array<int>, loss_ends array<int>"
)


def escape(text: str) -> str:
    """Control strings of the template, and the escape sign itself, get a backslash in front."""
    return _ESCAPE.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def head(role: str) -> str:
    """A role opens its turn with a capital; whatever else it holds is kept."""
    shown = role.capitalize() if role in ("system", "user", "assistant") else "=" + _ROLE.sub(lambda m: "\\" + m.group(), role)
    return f"{HEAD}{shown}: "


def role_of(shown: str) -> str:
    return _ROLE_BACK.sub(r"\1", shown[1:]) if shown.startswith("=") else shown.lower()


def _placed(turns: DataFrame) -> DataFrame:
    """``turns`` as a saved table: none (whether there is no conv_id), conv, at (place from 0), role, text, tokens, before
    (tokens of the turns before it). Rows are dealt by ranges of the whole order, so any conversation is spread over
    tasks; what a task's rows begin with comes from the sums of the tasks before it."""
    own = bare(turns, "conv_id", "turn", "role", "text")
    own = own.select(
        F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0).cast("long")).alias("conv"), "turn",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")], F.monotonically_increasing_id().alias("salt"),
    )
    key, order = ["none", "conv"], ["none", "conv", "turn", "role", "text", "salt"]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order)
    tokens = (F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)) + 2).cast("long")
    rows = written(dealt.select(*key, "role", "text", tokens.alias("tokens"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row")))
    sums = rows.groupBy(*key, "part").agg(F.min("row").alias("first"), F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    ahead = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, "part", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("shift"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("sum"))
    along = Window.partitionBy(*key, "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("tokens").over(along), F.lit(0))).join(sums, [*key, "part"])
    return written(rows.select(*key, (F.col("row") + F.col("shift")).alias("at"), "role", "text", "tokens", (F.col("before") + F.col("sum")).alias("before")))


def format_chats(turns: DataFrame, budget: int = 512, history: int = 1) -> DataFrame:
    """Windows of whole turns of each conversation, one row each (``WINDOWS``).

    ``turns`` has conv_id, turn, role and text. Tokens of a turn are its words plus two for its marks. With the
    prefix sums of a conversation's tokens, a turn opens a new span where the sum of tokens before it passes another
    multiple of half of what the budget leaves beside the system turn, so spans need no look at one another, and turns of up to
    that half always fit. A window is the conversation's leading system turn (if the span does not hold it), which is
    never left out, up to ``history`` turns before the span as far as they fit, and the span. Repeated turns bear no
    loss: ``loss_starts`` and ``loss_ends`` mark, in code points of ``text``, the texts of the span's own assistant turns
    only. A window over the budget, as one very long turn or system turn makes it, stays whole and is marked
    ``over_budget``. ``window`` rises along a conversation, with gaps.

    A null text or role counts as empty, a null turn comes first, and turns that tie are ordered by role and text,
    repeated rows included. Rows with a null conv_id make one conversation. Other columns are not read. An empty table
    gives an empty result. Every step deals rows by conversation and place or span, so a task holds windows, not a
    conversation.
    """
    key = ["none", "conv"]
    rows = _placed(turns)
    system = rows.filter((F.col("at") == 0) & (F.col("role") == "system"))
    system = written(system.select(*key, F.col("text").alias("system"), F.col("tokens").alias("system_tokens")))
    room = F.greatest(F.lit(1), F.floor((budget - F.coalesce("system_tokens", F.lit(0))) / 2))
    rows = rows.join(system.drop("system"), key, "left").withColumn("span", F.floor(F.col("before") / room))
    turn = F.struct("at", "role", "text", "tokens")
    rows = written(rows.select(*key, "span", (F.col("system_tokens").isNotNull() & (F.col("at") == 0)).alias("leads"), turn.alias("turn")))
    starts = written(rows.groupBy(*key, "span").agg(F.min("turn.at").alias("first")).filter("first > 0"))
    back = starts.withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(max(1, history))))).withColumn("at", F.col("first") - F.col("at"))
    back = back.filter(F.lit(history > 0) & (F.col("at") >= 0)).drop("first")
    back = back.join(rows.filter("not leads").drop("span").withColumn("at", F.col("turn.at")), [*key, "at"])
    lead = starts.join(system, key).select(*key, "span", F.lit(0).alias("kind"), F.struct(F.lit(0).cast("long").alias("at"), F.lit("system").alias("role"), F.col("system").alias("text"), F.col("system_tokens").alias("tokens")).alias("turn"))
    back = back.select(*key, "span", F.lit(1).alias("kind"), "turn")
    all_ = rows.select(*key, "span", F.lit(2).alias("kind"), "turn").unionByName(back).unionByName(lead)
    spans = all_.groupBy(*key, "span").agg(F.sort_array(F.collect_list(F.struct("kind", "turn"))).alias("turns"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, window, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                turns_ = [(t["kind"], t["turn"]) for t in found.as_py()]
                own = [t for kind, t in turns_ if kind == 2]
                lead = [t for kind, t in turns_ if kind == 0]
                tokens = sum(t["tokens"] for t in own + lead)
                back: list[dict] = []
                for t in reversed([t for kind, t in turns_ if kind == 1]):
                    if tokens + t["tokens"] > budget:
                        break
                    back.insert(0, t)
                    tokens += t["tokens"]
                text, starts_, ends, n = [], [], [], 0
                for k, t in enumerate([*lead, *back, *own]):
                    opening, shown = head(t["role"]), escape(t["text"])
                    if k >= len(lead) + len(back) and t["role"] == "assistant":
                        starts_.append(n + len(opening))
                        ends.append(n + len(opening) + len(shown))
                    text += [opening, shown, TAIL, "\n"]
                    n += len(opening) + len(shown) + len(TAIL) + 1
                out.append((conv_id, window, "".join(text), own[0]["at"], len(own), len(lead), len(back), tokens, tokens > budget, starts_, ends))
            yield _batch(out, WINDOWS)

    return spans.select(F.when(~F.col("none"), F.col("conv")), "span", "turns").mapInArrow(windows, WINDOWS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def read_back(windows: DataFrame) -> DataFrame:
    """What formatted windows hold, per conversation, read from their text and loss marks: conv_id, n_turns,
    turns_sha256 (of role, newline, text, newline per turn), loss_chars, loss_sha256 (of all text under the loss
    mask, unescaped), formatted_chars. Repeated turns are left out by each window's counts. Windows are parsed wherever
    they are; only the digests take a conversation's own text through one task, as a stream."""
    parsed = "conv_id long, window long, n_turns long, formatted long, turns string, loss string"
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, window, text, n_system, n_history, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                at, turns = 0, []
                while at < len(text):
                    m = _TURN.match(text, at)
                    if m is None:
                        raise ValueError(f"conversation {conv_id}: no turn at {at}")
                    turns.append(f"{role_of(m.group(1))}\n{unescape(m.group(2))}\n")
                    at = m.end()
                own = turns[n_system + n_history :]
                out.append((conv_id, window, len(own), len(text), "".join(own), "".join(unescape(text[a:b]) for a, b in zip(starts, ends))))
            yield _batch(out, parsed)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun = None, False

        def result() -> tuple:
            return conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted

        for batch in batches:
            out = []
            for conv_id, n, chars, own, target in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "formatted", "turns", "loss"))):
                if not begun or conv_id != conv:
                    if begun:
                        out.append(result())
                    conv, begun = conv_id, True
                    n_turns = loss_chars = formatted = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                n_turns, formatted, loss_chars = n_turns + n, formatted + chars, loss_chars + len(target)
                turns.update(own.encode())
                loss.update(target.encode())
            yield _batch(out, schema)
        if begun:
            yield _batch([result()], schema)

    rows = windows.select("conv_id", "window", "text", "n_system", "n_history", "loss_starts", "loss_ends").mapInArrow(parse, parsed)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(digest, schema)
