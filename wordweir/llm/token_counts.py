"""Token counts by a compiled finite-state transducer.

A BPE encoding has this property: its prefix encodings are encodings, and the last piece of a text is the only one that
ends it and stands well after the piece before (their joint encoding is the two). So reading left to right needs, for
every place where a piece may still be open, only the place in the piece trie, which of the open pieces stand well there, and the
count there relative to the count here. That is a finite state; a transition emits the change in the number of
tokens (negative where pieces join). States are built when first met, interned, and start over beyond a bound, which is looked at
before every chunk, so that a long text of ever new characters is bounded too.

Long texts are cut into chunks. A chunk's state map is the function from its first state to its last state and the tokens emitted;
it is constant after the first word start, where all states meet, so it is held as the head up to there and a
constant. Maps compose associatively and are combined pairwise, in the tree of a parallel prefix scan's up-sweep, though by the one task that
has the text.

Only models that this fits are taken: sentencepiece BPE, with byte fallback, identity normalisation and the
space mark inside no piece after other characters.

Defined cases: a null or empty text has no tokens; repeated rows are counted each; the limit is exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import held

SPACE = "▁"
CHUNK, MAX_STATES, MAX_PAIRS, FEW = 1 << 16, 250_000, 400_000, 8


class State(dict):
    """Character -> (next state, emitted tokens), filled when first asked for."""

    __slots__ = ("machine", "open")

    def __missing__(self, c: str) -> tuple[State, int]:
        out = self[c] = self[SPACE] if c == " " else self.machine.step(self, c)
        return out


@dataclass(frozen=True)
class StateMap:
    """head: the text up to the first word start; then constant: state and tokens after it (None: no word start)."""

    head: str
    state: State | None
    tokens: int

    def __call__(self, start: State) -> tuple[State, int]:
        state, n = run(start, self.head)
        return (state, n) if self.state is None else (self.state, n + self.tokens)

    def then(self, other: StateMap) -> StateMap:
        if self.state is None:
            return StateMap(self.head + other.head, other.state, other.tokens)
        state, n = other(self.state)
        return StateMap(self.head, state, self.tokens + n)


def run(state: State, text: str) -> tuple[State, int]:
    n = 0
    for c in text:
        state, d = state[c]
        n += d
    return state, n


class Machine:
    """The transducer of a sentencepiece BPE model file."""

    def __init__(self, path: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        normal = [p for p in model.pieces if p.type == 1]
        fits = (
            spec.model_type == 2 and spec.byte_fallback and norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
            and not spec.treat_whitespace_as_suffix and all(p.type in (1, 2, 3, 6) for p in model.pieces)
            and all(SPACE not in p.piece.lstrip(SPACE) for p in normal)
        )
        if not fits:
            raise ValueError(f"{path} is not a model that this transducer can stand for")
        self.rank = {p.piece: -p.score for p in normal}
        self.trie: dict = {}
        for p in self.rank:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.below: dict[int, list[str]] = {}
        self.clear()

    def clear(self) -> None:
        # states that maps still hold stay valid: they only forget where they lead to, and with that each other
        for state in getattr(self, "states", {}).values():
            state.clear()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.kinds: dict[tuple[int, str], object] = {}
        self.states: dict[tuple, State] = {}
        self.first = self.intern([(self.trie, None, 0)])
        #: after the mark that is put before every text, and so before every word
        self.start, self.start_tokens = self.first[SPACE]

    def intern(self, places: list[tuple[dict, object, int]]) -> State:
        key = tuple((id(node), kind, n) for node, kind, n in places)
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = State()
            state.machine, state.open = self, places
        return state

    def encode(self, text: str) -> list[str]:
        """BPE by its definition, for the few characters of two pieces."""
        parts = list(text)
        while True:
            ranks = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
            if not ranks:
                return parts
            _, i = min(ranks)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def well(self, before: object, piece: str) -> bool:
        """Whether the piece may follow: before is None (anything), the pieces that may, or the last piece."""
        if before is None:
            return True
        if not isinstance(before, str):
            return piece in before
        if SPACE == piece[0] and before[-1] != SPACE:
            return True
        found = self.pairs.get((before, piece))
        if found is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            found = self.pairs[before, piece] = self.encode(before + piece) == [before, piece]
        return found

    def narrowed(self, node: dict, before: object) -> object:
        """What has to be remembered of ``before`` below this trie node: equal states become one by it."""
        if before is None:
            return None
        key = (id(node), before)
        if key not in self.kinds:
            pieces = self.below.get(id(node))
            if pieces is None:
                pieces, nodes = [], [node]
                while nodes:
                    for c, child in nodes.pop().items():
                        if c:
                            nodes.append(child)
                            if "" in child:
                                pieces.append(child[""])
                self.below[id(node)] = pieces
            if isinstance(before, str) and len(pieces) > FEW and not (node is self.trie.get(SPACE) and before[-1] != SPACE):
                kind: object = before
            else:
                allowed = frozenset(p for p in pieces if self.well(before, p))
                kind = None if len(allowed) == len(pieces) else allowed
            if len(self.kinds) >= MAX_PAIRS:
                self.kinds.clear()
            self.kinds[key] = kind
        return self.kinds[key]

    def step(self, state: State, c: str) -> tuple[State, int]:
        if c not in self.trie or c not in self.rank:
            return self.intern([(self.trie, None, 0)]), len(c.encode("utf-8", "replace"))
        still, piece, tokens = [], None, 0
        for node, before, n in state.open:
            child = node.get(c)
            if child is None:
                continue
            here = child.get("")
            if here is not None and piece is None and self.well(before, here):
                piece, tokens = here, n + 1
            if len(child) > (here is not None):
                kind = self.narrowed(child, before)
                if kind is None or kind:
                    still.append((child, kind, n))
        places = [(node, kind, n - tokens) for node, kind, n in still]
        return self.intern([*places, (self.trie, piece, 0)]), tokens

    def bound(self) -> None:
        if len(self.states) > MAX_STATES:
            self.clear()

    def state_map(self, chunk: str) -> StateMap:
        self.bound()
        for i in range(1, len(chunk)):
            if chunk[i] in " ▁" and chunk[i - 1] not in " ▁":
                state, n = run(self.start, chunk[i + 1 :])
                return StateMap(chunk[:i], state, n + 1)
        return StateMap(chunk, None, 0)

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        if len(text) <= chunk:
            self.bound()
            return self.start_tokens + run(self.start, text)[1]
        maps = [self.state_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [maps[i].then(maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.start_tokens + maps[0](self.start)[1]


def count_tokens(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes (UTF-8), n_tokens. ``model`` is the path of a model file on every executor."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run_all(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held("machine", model, lambda: Machine(model))
        for part in parts:
            counts = [machine.count(text.as_py()) for text in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(id_col).alias("id"), size.alias("n_bytes"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run_all, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
