"""Token counts by a finite-state transducer compiled from a piece vocabulary.

A byte-pair encoding is fixed by its adjacent pairs: a sequence of pieces is the
encoding of a text if each piece and each two neighbours are the encodings of their
own strings. So the last piece of every prefix follows from the last pieces of
earlier prefixes, and a machine that reads one code point at a time needs to remember
only the places where a piece may still begin: those after which the text so far is
the beginning of a piece. A state is these places, each with the piece before it and
the tokens between it and here; a transition reads a code point and emits the change
of the token count, which the state that it leads to carries. The machine is compiled
by spelling every piece of the vocabulary from the start; transitions that the
vocabulary alone does not show (pieces after other pieces) are added when first met.
No piece spans the border between a word and a following space mark, so the mark after
a word leads back to the start: there the transducer forgets what it read.

Every text is cut into chunks. The map of a chunk sends a state to a state and a count;
it is kept as the part before its first border (still to be run from the state it
meets), the count after it and the end state, which no longer depends on the start.
Maps compose associatively and are folded pairwise, as in a parallel prefix scan. Each
code point is read by one transition.

Defined cases: a null text is empty and has no tokens; control strings of the
vocabulary are plain text; code points outside the vocabulary count a token a byte;
null and repeated ids are rows like others; a long text needs memory for its text and
a chunk; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import accumulate
from operator import attrgetter, getitem
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.storage import bounded

SPACE = "▁"
CHUNK = 1 << 12
#: A machine that has grown beyond so many states is compiled anew.
STATES = 250_000
_BORDER = re.compile(f"(?<=[^{SPACE}]){SPACE}")
_emitted = attrgetter("emits")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""
    i = 0

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if kind == 2 else ({5: 4, 1: 8}[kind], i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


def read_pieces(model: bytes) -> dict[str, float]:
    """Scores of the normal pieces of a vocabulary file; refuses options that the transducer does not model."""
    pieces: dict[str, float] = {}
    for field, value in _fields(model):
        if field == 1:
            piece = dict(_fields(value))
            kind = piece.get(3, 1)
            if kind in (4, 5):
                raise ValueError("user-defined or unused pieces are not supported")
            if kind == 1:
                pieces[piece[1].decode()] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
        elif field == 2:
            options = dict(_fields(value))
            if options.get(3, 1) != 2 or not options.get(35, 0) or options.get(24, 0):
                raise ValueError("a byte-pair vocabulary with byte fallback and leading space marks is needed")
        elif field == 3:
            options = dict(_fields(value))
            if options.get(2) or not options.get(3, 1) or options.get(4, 1) or not options.get(5, 1):
                raise ValueError("identity normalisation with a leading space mark is needed")
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
        raise ValueError("a piece spans the end of a word")
    return pieces


class State(dict):
    """Code points to the next states. key: the text since the first open place; (length, piece before, tokens since) of each open place, the nearest last; the tokens emitted on entry."""

    __slots__ = ("machine", "key", "emits")

    def __missing__(self, char: str) -> State:
        return self.machine.extend(self, char)


#: The map of a chunk: the part before its first border, the count after it, the end state (None without a border).
ChunkMap = tuple[str, int, State | None]


class CountTransducer:
    def __init__(self, model: bytes):
        self.scores = read_pieces(model)
        self._solid: dict[str, bool] = {}
        self.opened = {piece[:i] for piece in self.scores if self._whole(piece) for i in range(1, len(piece))}  # beginnings of pieces
        self.steps = 0
        self.compile()

    def compile(self) -> None:
        """The states and transitions that spell the vocabulary."""
        self.states: dict[tuple, State] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self.start = self._state("", ((0, "", 0),), 0)
        for piece in self.scores:
            self.run(self.start, piece if piece[0] == SPACE else SPACE + piece)
        self.steps = 0

    def encode(self, text: str) -> list[str]:
        """Merges in order of score, leftmost first; only for strings of about two pieces."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _whole(self, piece: str) -> bool:
        if (known := self._solid.get(piece)) is None:
            known = len(piece) == 1 or (piece in self.scores and self.encode(piece) == [piece])
            if piece in self.scores:
                self._solid[piece] = known
        return known

    def _joint(self, a: str, b: str) -> bool:
        if (known := self._pairs.get((a, b))) is None:
            known = self._pairs[a, b] = self.encode(a + b) == [a, b]
        return known

    def _cost(self, piece: str) -> int:
        return 1 if piece in self.scores else len(piece.encode("utf-8", "surrogatepass"))

    def _state(self, text: str, places: tuple, emits: int) -> State:
        key = (text, places, emits)
        if (state := self.states.get(key)) is None:
            state = self.states[key] = State()
            state.machine, state.key, state.emits = self, key, emits
        return state

    def extend(self, state: State, char: str) -> State:
        """The transition from the state by the code point, added to the machine."""
        text, places, _ = state.key
        if char == SPACE and state is not self.start and not text.endswith(SPACE):
            new = state[char] = self.start[char]
            return new
        text += char
        n = len(text)
        for length, before, since in places:  # the piece that ends here begins at one of the open places
            piece = text[n - length - 1 :]
            if (length == 0 or (piece in self.scores and self._whole(piece))) and (not before or self._joint(before, piece)):
                change = since + self._cost(piece)
                break
        else:
            raise AssertionError("no piece ends here")
        still = [(length + 1, before, since - change) for length, before, since in places if text[n - length - 1 :] in self.opened]
        new = state[char] = self._state(text[n - still[0][0] :] if still else "", (*still, (0, piece, 0)), change)
        return new

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after the text and the tokens emitted on the way."""
        total = 0
        for i in range(0, len(text), CHUNK):
            path = list(accumulate(text[i : i + CHUNK], getitem, initial=state))
            total += sum(map(_emitted, path)) - state.emits
            state = path[-1]
        self.steps += len(text)
        return state, total

    def chunk_map(self, text: str) -> ChunkMap:
        if len(self.states) > STATES:
            self.compile()
        if (first := _BORDER.search(text)) is None:
            return text, 0, None
        state, count = self.run(self.start, text[first.start() :])
        return text[: first.start()], count, state

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, count = self.run(a[2], b[0])
        return a[0], a[1] + count + b[1], state if b[2] is None else b[2]

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        maps = [self.chunk_map(marked[i : i + CHUNK]) for i in range(0, len(marked), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, count, _ = maps[0]
        return self.run(self.start, head)[1] + count


_machine: dict[int, CountTransducer] = {}


def _compiled(model: bytes) -> CountTransducer:
    """One machine a worker process, with what it has learnt; bounded by STATES."""
    key = hash(model)
    if key not in _machine:
        _machine.clear()
        _machine[key] = CountTransducer(model)
    return _machine[key]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, UTF-8 bytes and tokens of each row, and whether the tokens exceed the limit. No shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _compiled(model.value)
        for batch in batches:
            counts = [machine.count(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
