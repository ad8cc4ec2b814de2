"""Chat formatting with a grammar round trip.

    conversation = turn*
    turn         = "<|im_start|>" role "<|im_sep|>" text "<|im_end|>"

Roles and texts may hold any characters, control strings of this template and of others included.  A turn is
first rendered as it is and reparsed with a deterministic parser, which refuses control strings out of
place.  Where the recovered turn is not the source, the conflicting content is escaped and the turn
rendered and reparsed again, until both are identical: a mark goes in after the first character of a
control string, and one more where content already looks like that.  So no control string of a
text survives whole in the output, and unescaping takes one mark from each.

A conversation is written as pieces of whole turns of about PIECE_CHARS code points, with the places of
the loss mask (the assistant's texts), in Parquet files of the shared folder: sorted by conversation and
turn, and a conversation never spans files.  A reader needs one piece at a time.  A digest runs over a
conversation's pieces in order, so one with a third of all turns passes through one task as a stream,
never as a group in memory; its rendering and reparsing happen before, wherever its rows lie.

Rows go by turn, null turns first, ties in the order of their rendered form; repeated rows are turns of
their own.  Null role or text: empty.  Null conversation ids form one conversation.  An empty table
gives none.  A very long text is a piece of its own.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import filesystem, frozen, shared_folder

START, SEP, END, MARK = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "\\"
# Control strings of public chat templates and vocabularies.
OTHERS = (
    "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|startoftext|>", "<|endoftext|>",
    "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>",
    "<start_of_turn>", "<end_of_turn>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>",
)
CONTROL = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in (START, SEP, END, *OTHERS)))
LOSS_ROLE = "assistant"
PIECE_CHARS = 1 << 18


class Turn(NamedTuple):
    role: str
    text: str
    #: Place of the text, still escaped, in the formatted string.
    start: int
    end: int


def escape(text: str) -> str:
    """A mark more in everything that is, or looks like, a control string with marks."""
    return CONTROL.sub(lambda m: m[0][0] + MARK + m[0][1:], text)


def unescape(text: str) -> str:
    """A mark less in every control string with marks."""
    return CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == MARK else m[0], text)


def parse(formatted: str) -> list[Turn] | None:
    """The turns of a formatted string; None if it is not a sentence of the grammar."""
    turns, state, at, role, begin = [], START, 0, "", 0
    for token in CONTROL.finditer(formatted):
        word = token[0]
        if word[1] == MARK:
            continue
        if word != state:
            return None
        if state == START:
            if token.start() != at:
                return None
            state, begin = SEP, token.end()
        elif state == SEP:
            role, state, begin = unescape(formatted[begin : token.start()]), END, token.end()
        else:
            turns.append(Turn(role, unescape(formatted[begin : token.start()]), begin, token.start()))
            state, at = START, token.end()
    return turns if state == START and at == len(formatted) else None


def render(role: str, text: str) -> tuple[str, Turn]:
    """A turn in the template, escaped until the parser recovers it."""
    fields = [role, text]
    while True:
        formatted = START + fields[0] + SEP + fields[1] + END
        turns = parse(formatted)
        if turns and len(turns) == 1 and turns[0][:2] == (role, text):
            return formatted, turns[0]
        conflicts = [f for f, source in zip(fields, (role, text)) if f == source and CONTROL.search(f)]
        if not conflicts:
            raise ValueError("no escaped form of this turn is recovered")
        fields = [escape(f) if f in conflicts else f for f in fields]


def rendered(turns: DataFrame) -> DataFrame:
    """Every turn in the template, with the place of its text in code points: conv_id, turn, formatted, loss, start, end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [render(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([f for f, _ in out], pa.string()),
                    pa.array([t.role == LOSS_ROLE for _, t in out], pa.bool_()),
                    pa.array([t.start for _, t in out], pa.int64()), pa.array([t.end for _, t in out], pa.int64()),
                ],
                names=["conv_id", "turn", "formatted", "loss", "start", "end"],
            )

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    source = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))
    return source.mapInArrow(run, "conv_id long, turn long, formatted string, loss boolean, start long, end long")


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
PIECE = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("formatted", pa.large_string()), ("loss", pa.list_(SPAN))])


class _Pieces:
    """Sorted turns as pieces of one conversation each."""

    def __init__(self, size: int):
        self.size, self.conversation, self.piece = size, ..., 0
        self.parts, self.spans, self.chars = [], [], 0

    def add(self, conversation: int | None, formatted: str, loss: bool, start: int, end: int) -> Iterator[tuple]:
        if conversation != self.conversation or (self.chars and self.chars + len(formatted) > self.size):
            yield from self.close()
            self.piece = self.piece + 1 if conversation == self.conversation else 0
            self.conversation = conversation
        if loss:
            self.spans.append({"start": self.chars + start, "end": self.chars + end})
        self.parts.append(formatted)
        self.chars += len(formatted)

    def close(self) -> Iterator[tuple]:
        if self.parts:
            yield self.conversation, self.piece, "".join(self.parts), self.spans
        self.parts, self.spans, self.chars = [], [], 0


def write_conversations(turns: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Format and write all conversations; returns the manifest (path, pieces).

    A task writes one file under a name of its own, and the manifest names those of the tasks that
    ended well, so a repeated task leaves no conversation twice.
    """
    folder = shared_folder(turns.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held, size, count, writer, uri = _Pieces(piece_chars), [], 0, 0, None, ""

        def flush():
            nonlocal writer, uri, held, size, count
            if writer is None:
                uri = f"{folder}/chat-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.parquet"
                fs, path = filesystem(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                writer = pq.ParquetWriter(path, PIECE, filesystem=fs, compression="zstd")
            writer.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), PIECE)], schema=PIECE))
            count, held, size = count + len(held), [], 0

        def keep(found):
            nonlocal size
            for piece in found:
                held.append(piece)
                size += len(piece[2])
                if size > 8 * piece_chars:
                    flush()

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                keep(pieces.add(*row))
        keep(pieces.close())
        if held:
            flush()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [uri], "pieces": [count]})

    ordered = rendered(turns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").drop("turn")
    return frozen(ordered.mapInArrow(write, "path string, pieces long"))


def _read(manifest: DataFrame, run, schema: str) -> DataFrame:
    """One task per file; `run` gets the file's pieces in order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as source:
                    pieces = (row for b in pq.ParquetFile(source).iter_batches(batch_size=64) for row in b.to_pylist())
                    yield from run(pieces)

    return manifest.repartition(max(1, manifest.count()), "path").mapInArrow(task, schema)


class NotFormatted(ValueError):
    """A piece is not a sentence of the grammar, or its loss mask is not on texts."""


def _turns(piece: dict) -> Iterator[tuple[Turn, bool]]:
    """The piece's turns, and whether the loss mask covers their text."""
    found = parse(piece["formatted"])
    if found is None:
        raise NotFormatted(f"conversation {piece['conv_id']}, piece {piece['piece']}")
    masked = {(s["start"], s["end"]) for s in piece["loss"]}
    for turn in found:
        covered = (turn.start, turn.end) in masked
        masked.discard((turn.start, turn.end))
        yield turn, covered
    if masked:
        raise NotFormatted(f"conversation {piece['conv_id']}, piece {piece['piece']}: loss mask")


def read_turns(manifest: DataFrame) -> DataFrame:
    """The turns that the files hold: conv_id, position, role, text, loss."""

    def run(pieces: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        conversation, position = ..., 0
        for piece in pieces:
            if piece["conv_id"] != conversation:
                conversation, position = piece["conv_id"], 0
            turns = list(_turns(piece))
            n = len(turns)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conversation] * n, pa.int64()), pa.array(range(position, position + n), pa.int64()),
                    pa.array([t.role for t, _ in turns], pa.string()), pa.array([t.text for t, _ in turns], pa.string()),
                    pa.array([m for _, m in turns], pa.bool_()),
                ],
                names=["conv_id", "position", "role", "text", "loss"],
            )
            position += n

    return _read(manifest, run, "conv_id long, position long, role string, text string, loss boolean")


class _Digest:
    def __init__(self, conversation: int | None):
        self.conversation, self.turns, self.loss_chars, self.chars = conversation, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: dict) -> None:
        self.chars += len(piece["formatted"])
        for turn, covered in _turns(piece):
            self.turns += 1
            self.all.update(f"{turn.role}\n{turn.text}\n".encode())
            if covered:
                self.loss_chars += len(turn.text)
                self.loss.update(turn.text.encode())

    def row(self) -> tuple:
        return self.conversation, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(manifest: DataFrame) -> DataFrame:
    """Per conversation, read back from the files: turns, digest and size of the texts, of those under the loss mask, and of the whole."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(pieces: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for piece in pieces:
            if current is None or piece["conv_id"] != current.conversation:
                rows += [current.row()] if current else []
                current = _Digest(piece["conv_id"])
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
            current.add(piece)
        rows += [current.row()] if current else []
        if rows:
            yield batch(rows)

    return _read(manifest, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
