"""Chat formatting with a grammar round trip.

Grammar of the output::

    conversation := turn*
    turn         := "### " role ": " body "</turn>" "\\n"      plain body
                  | "###+ " role ": " body "</turn>" "\\n"     escaped body

A plain body is the text itself and holds neither ``### `` nor ``</turn>``; in
an escaped body a backslash takes the next character literally.  Each turn is
rendered plain, parsed again by the deterministic parser, and compared; while
what comes back differs, the next stronger escape is used: first before
control strings only, then before every character that can begin one.

Turns are rendered where they lie.  A conversation's turns then meet in one
task, sorted by Spark (which spills), and their joined text is parsed as it
comes and compared with hashes of the source turns, so memory depends on the
longest turn, not on a conversation's length; a digest over a conversation is
sequential by nature.

Defined results: a null text or role is an empty string; turns of equal number
are ordered by role, then text; repeated rows are turns of their own; a null
turn number comes first, a null conv_id is a conversation of its own.  Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtable.llm._shared import has, table

HEAD, HEAD_ESCAPED, END = "### ", "###+ ", "</turn>"
LEARN = "assistant"

#: Escapes from weak to strong: what gets a backslash.
ESCAPES = [re.compile(r"\\|###|</turn>"), re.compile(r"[\\#<]")]
_BODY = re.compile(r"(?:[^\\#<]+|\\.|#(?!## )|<(?!/turn>))*", re.S)
_ROLE = re.compile(r"(?:[^\\:\n]|\\.)*", re.S)
_TAKE = re.compile(r"\\(.)", re.S)


class GrammarError(ValueError):
    pass


class Reader:
    """The deterministic parser: takes a conversation's text in pieces of any length and gives its turns as (role, text); raises GrammarError on anything outside the grammar."""

    def __init__(self):
        self.rest = ""

    def feed(self, text: str) -> list[tuple[str, str]]:
        self.rest += text
        out, at = [], 0
        while True:
            turn = self._turn(at)
            if turn is None:
                self.rest = self.rest[at:]
                return out
            out.append(turn[0])
            at = turn[1]

    def _turn(self, at: int) -> tuple[tuple[str, str], int] | None:
        """The turn that begins here and where it ends; None if its end has not come yet."""
        text = self.rest
        if at == len(text):
            return None
        escaped = text.startswith(HEAD_ESCAPED, at)
        if not escaped and not text.startswith(HEAD, at):
            if HEAD.startswith(text[at : at + 4]) or HEAD_ESCAPED.startswith(text[at : at + 5]):
                return None
            raise GrammarError(f"no turn begins at {text[at : at + 20]!r}")
        at += len(HEAD_ESCAPED if escaped else HEAD)
        m = _ROLE.match(text, at)
        role, at = m[0], m.end()
        if at >= len(text) - 1:
            return None
        if not text.startswith(": ", at):
            raise GrammarError(f"no role ends at {text[at : at + 20]!r}")
        at += 2
        if escaped:
            end = _BODY.match(text, at).end()
        else:
            end = text.find(END, at)
            if end < 0:
                return None
            if text.find(HEAD, at, end) >= 0:
                raise GrammarError("a head inside a turn")
        if len(text) < end + len(END) + 1:
            return None
        if not text.startswith(END + "\n", end):
            raise GrammarError(f"no turn ends at {text[end : end + 20]!r}")
        body = text[at:end]
        return (_TAKE.sub(r"\1", role), _TAKE.sub(r"\1", body) if escaped else body), end + len(END) + 1

    def close(self) -> None:
        if self.rest:
            raise GrammarError(f"an open turn: {self.rest[:20]!r}")


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a whole text."""
    reader = Reader()
    out = reader.feed(text)
    reader.close()
    return out


def source_hash(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)} {role} {text}".encode(), digest_size=16).digest()


def render(role: str | None, text: str | None) -> str:
    """One turn, by the weakest escape that survives the round trip."""
    role, text = role or "", text or ""
    name = re.sub(r"([\\:\n])", r"\\\1", role)
    for level in range(len(ESCAPES) + 1):
        if level:
            out = f"{HEAD_ESCAPED}{name}: {ESCAPES[level - 1].sub(lambda m: chr(92) + m[0], text)}{END}\n"
        else:
            out = f"{HEAD}{name}: {text}{END}\n"
        try:
            if parse(out) == [(role, text)]:
                return out
        except GrammarError:
            continue
    raise GrammarError("no escape survives the round trip")


def turns(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, formatted, source, learn: one row per turn.  ``formatted`` strings of a conversation, joined in order, are its formatted text; ``source`` is a hash of the turn's role and text, ``learn`` says whether its text is under the loss mask."""
    has(conversations, conv, turn, role, text)
    c = lambda name: F.col(f"`{name}`")
    rows = conversations.select(c(conv).cast("bigint").alias("conv_id"), c(turn).cast("bigint").alias("turn"), F.coalesce(c(role).cast("string"), F.lit("")).alias("role"), F.coalesce(c(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            out = [render(r, t) for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(out, pa.string()), pa.array([source_hash(r, t) for r, t in zip(roles, texts, strict=True)], pa.binary()), pa.array([r == LEARN for r in roles], pa.bool_())],
                names=["conv_id", "turn", "role", "formatted", "source", "learn"],
            )

    return rows.mapInArrow(run, "conv_id bigint, turn bigint, role string, formatted string, source binary, learn boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its formatted text alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The text of a conversation is parsed as one, with no regard to where its
    rows begin, and every turn that comes out is compared with the hash of the
    source turn in its place; a turn more, less or other is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, state, done = None, None, []
        reader, sources = Reader(), deque()

        def close():
            reader.close()
            if sources:
                raise GrammarError(f"conversation {now[0]}: {len(sources)} turns are missing")
            done.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done.clear()
            return out

        for batch in batches:
            for conv, formatted, source in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("source").to_pylist(), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                sources.append(source)
                for role, text in reader.feed(formatted):
                    if not sources or source_hash(role, text) != sources.popleft():
                        raise GrammarError(f"conversation {conv}: turn {state[0]} is not its source")
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == LEARN:
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(formatted)
                if len(done) >= 5000:
                    yield flush()
        if now is not None:
            close()
        if done:
            yield flush()

    # The text decides among turns of equal number and role; the formatted text begins with nothing else that could differ.
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return ordered.select("conv_id", "formatted", "source").mapInArrow(run, schema)


def op6(spark, sf_dir):
    hard = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))])).alias("t"))
    own = own.select("conv_id", "t.turn", "t.role", F.lit(hard).alias("text"))
    return read_back(turns(rows.unionByName(own)))
