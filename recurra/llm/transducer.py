"""Token counts of a byte-pair tokenizer by a deterministic transducer, whole texts cut into chunks.

The tokenizer merges the neighbouring pieces with the best score, the leftmost first, until none is left. Whether two
neighbouring tokens of the result stay apart depends on these two alone, so a sequence of tokens is the tokenizer's own if
and only if each two neighbours stay apart, and every prefix of a text has just one last token. A state of the transducer
therefore holds, for every place from where a token may still grow, the last token before it; a transition reads a
character and is annotated with the number of tokens that it adds to (or takes from) the prefix. States are compiled when
they are first met and forgotten all together when there are too many.

A long text is cut into chunks. The map of a chunk takes a state at its begin to the state at its end and the tokens
between, for all states that come from a token's begin shortly before it. Maps are composed in a tree, many at once, as a
parallel prefix scan does. If a chunk is entered in a state that its map lacks, the map gets it and the scan is repeated.
"""

from __future__ import annotations

from ast import literal_eval
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from recurra.llm.common import Batches, fixed, kept_by, map_arrow
from recurra.settings import new_folder, use_local_folder

SPACE = "▁"
CHUNK = 1 << 16
STATES = 60_000
# What is kept beside states: followers of a token, cells of joinable left ends.
_FOLLOWERS, _CELLS = 200_000, 1 << 25
LOOK_BACK = 64
FAN = 256
_OPEN = -1
_NEVER = float("-inf")

State = tuple[tuple[int, int | bytes | None, int], ...]


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_pieces(path: str) -> tuple[dict[str, float], int]:
    """Score by piece of a sentencepiece model that merges pairs and falls back to bytes; and the length of the longest."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    trained, normal = model.trainer_spec, model.normalizer_spec
    kinds = {p.type for p in model.pieces}
    known = model.pieces[0].NORMAL, model.pieces[0].UNKNOWN, model.pieces[0].CONTROL, model.pieces[0].BYTE
    plain = not normal.precompiled_charsmap and normal.add_dummy_prefix and not normal.remove_extra_whitespaces
    plain = plain and normal.escape_whitespaces and not trained.treat_whitespace_as_suffix
    if trained.model_type != trained.BPE or not trained.byte_fallback or not plain or kinds - set(known):
        raise ValueError("needs pair merges, byte fallback, a space before every text and no other change of texts")
    scores = {p.piece: p.score for p in model.pieces if p.type == p.NORMAL}
    return scores, max(map(len, scores))


class _Step(NamedTuple):
    """Ends of a text between two merges: lowest score of merges up to it and up to the next one, score of the next one."""

    left: str
    right: str
    since: float
    until: float
    next: float


class _Row(dict):
    """Transitions of one state: character to (row of the next state, tokens added)."""

    __slots__ = ("state", "owner")

    def __init__(self, state: State, owner: Transducer):
        self.state, self.owner = state, owner

    def __missing__(self, character: str):
        return self.owner.compile(self, character)


class Transducer:
    """States are tuples of items (node of the trie, what may follow, tokens relative to the prefix), one per open place.

    At the root, "what may follow" is the last token; below it, one byte per longer piece that says whether the piece keeps
    apart from the token before, or None if all do. Two tokens with the same effect give the same state.
    """

    def __init__(self, scores: dict[str, float], longest: int, states: int = STATES):
        self.scores, self.longest, self.limit = scores, longest, states
        merges = {piece: self._merges(piece) for piece in scores}
        # A piece that its own text does not give is no token. Sorted, the pieces below a node are pieces[low:high], its own first.
        self.pieces = sorted(p for p, steps in merges.items() if steps[-1].left == p)
        self.children: list[dict[str, int]] = [{}]
        self.low, self.high, self.own = [0], [len(self.pieces)], [False]
        for number, piece in enumerate(self.pieces):
            node = 0
            for character in piece:
                if character not in self.children[node]:
                    self.children[node][character] = len(self.children)
                    self.children.append({})
                    self.low.append(number)
                    self.high.append(number)
                    self.own.append(False)
                node = self.children[node][character]
                self.high[node] = number + 1
            self.own[node] = True
        # By left end: the pieces that have it at some time, and when.
        begins: dict[str, list[tuple]] = {}
        for number, piece in enumerate(self.pieces):
            for step in merges[piece]:
                begins.setdefault(step.left, []).append((number, step.since, step.until, step.next))
        self._begins = {left: np.array(rows, np.float32).T for left, rows in begins.items()}
        self.first = ((0, _OPEN, 0),)
        self._forget()

    def _forget(self) -> None:
        self._cells = 0
        self._joins: dict[tuple[str, str], np.ndarray | None] = {}
        self._after: dict[tuple[int, str], bytes | None] = {}
        self._rows: dict[State, _Row] = {}

    # -- what the tokenizer does with one and with two tokens ---------------------------------------------------------

    def _merges(self, text: str) -> list[_Step]:
        """What stands at the ends of a text while it is merged, from its characters on."""
        parts = list(text)
        ends, scores = [(parts[0], parts[-1])], []
        while len(parts) > 1:
            best, at = _NEVER, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1], _NEVER)
                if score > best:
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            ends.append((parts[0], parts[-1]))
            scores.append(best)
        lowest = [-_NEVER, *np.minimum.accumulate(scores).tolist(), _NEVER]
        following = [*scores, _NEVER]
        return [_Step(*pair, *rest) for pair, rest in zip(ends, zip(lowest, lowest[1:], following))]

    def _joinable(self, end: str, character: str) -> np.ndarray | None:
        """All left ends that begin with the character and merge with a right end: score of the merge, piece, and when."""
        if (end, character) in self._joins:
            return self._joins[end, character]
        node = 0
        for c in end + character:
            node = self.children[node].get(c, -1)
            if node < 0:
                break
        found = []
        for joined in self.pieces[self.low[node] : self.high[node]] if node >= 0 else ():
            rows = self._begins.get(joined[len(end) :])
            if rows is not None:
                found.append(np.vstack([np.full(rows.shape[1], self.scores[joined], np.float32), rows]))
        if self._cells > _CELLS:
            self._joins, self._cells = {}, 0
        made = self._joins[end, character] = np.concatenate(found, axis=1) if found else None
        self._cells += 0 if made is None else made.size
        return made

    def _followers(self, token: int, character: str) -> bytes | None:
        """One byte per piece that begins with the character: 1 if it keeps apart from the token before; None if all do.

        The merges of two neighbouring tokens interleave by score, so a merge comes before one of the other side if the lowest
        score up to it is the higher one (or an equal one further left). A right end and a left end that meet in this
        order are merged if the score of that is better than that of the next merge on either side.
        """
        if token == _OPEN:
            return None
        if (token, character) not in self._after:
            node = self.children[0][character]
            apart = np.ones(self.high[node] - self.low[node], bool)
            for step in self._merges(self.pieces[token]):
                met = self._joinable(step.right, character)
                if met is not None:
                    score, piece, since, until, following = met
                    meet = (step.until < since) & (step.since >= until)
                    lost = meet & (score > step.next) & (score >= following)
                    apart[piece[lost].astype(np.int64) - self.low[node]] = False
            self._after[token, character] = None if apart.all() else apart.tobytes()
        return self._after[token, character]

    # -- states -------------------------------------------------------------------------------------------------------

    def row(self, state: State) -> _Row:
        found = self._rows.get(state)
        if found is None:
            found = self._rows[state] = _Row(state, self)
        return found

    def compile(self, row: _Row, character: str) -> tuple[_Row, int]:
        """The transition of a state by a character, kept from now on."""
        if len(self._rows) > self.limit or len(self._after) > _FOLLOWERS:
            for old in self._rows.values():
                old.clear()
            self._forget()
            self._rows[row.state] = row
        if character not in self.children[0]:
            # No piece holds it: one token per byte, and nothing merges across it.
            state, added = self.first, len(character.encode())
        else:
            grown, last, added = [], None, 0
            for node, follow, tokens in row.state:
                child = self.children[node].get(character)
                if child is None:
                    continue
                if node == 0:
                    follow = self._followers(follow, character)
                elif follow is not None:
                    begin = self.low[node] + self.own[node]
                    follow = follow[self.low[child] - begin : self.high[child] - begin]
                if self.own[child]:
                    if follow is None or follow[0]:
                        last, added = self.low[child], tokens + 1
                    follow = None if follow is None else follow[1:]
                if self.children[child] and (follow is None or any(follow)):
                    grown.append((child, None if follow is None or all(follow) else follow, tokens))
            if last is None:
                raise AssertionError("every prefix has a last token")
            state = (*[(node, follow, tokens - added) for node, follow, tokens in grown], (0, last, 0))
        made = row[character] = self.row(state), added
        return made

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after a text (spaces already replaced) and the tokens it adds."""
        row, total = self.row(state), 0
        for character in text:
            row, added = row[character]
            total += added
        return row.state, total

    def count(self, text: str) -> int:
        return self.run(self.first, SPACE + text.replace(" ", SPACE))[1] if text else 0

    def entries(self, before: str) -> list[State]:
        """States in which a chunk may be entered whose text follows ``before``: one per place where a token may begin."""
        return list({self.run(self.first, before[i:])[0] for i in range(min(len(before), self.longest))})

    def chunk_map(self, entries: list[State], text: str, block: int = 512) -> dict[State, tuple[State, int]]:
        """State and tokens after the text for each entry; entries that have come to one state go on as one."""
        now = {entry: (entry, 0) for entry in entries}
        for at in range(0, len(text), block):
            some = text[at : at + block]
            after = {state: self.run(state, some) for state in {s for s, _ in now.values()}}
            now = {entry: (after[s][0], n + after[s][1]) for entry, (s, n) in now.items()}
        return now


@kept_by("recurra.llm.transducer")
def transducer(path: str) -> Transducer:
    """One per process, which Spark's Python workers keep from task to task."""
    return Transducer(*read_pieces(path))


# -- texts and chunks -----------------------------------------------------------------------------------------------------

_CUT = "row long, id {0}, n_bytes long, n_tokens long, chunk long, before string, text string"
_MAPS = "row long, chunk long, entry string, exit string, tokens long"


def _count_or_cut(path: str, chunk: int, look_back: int, kind: pa.DataType):
    """Rows (row, id, text) to rows of ``_CUT``: a text of one chunk is counted, a longer one comes in chunks."""
    names = ["row", "id", "n_bytes", "n_tokens", "chunk", "before", "text"]
    types = [pa.int64(), kind, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Batches) -> Batches:
        machine = transducer(path)
        for batch in batches:
            made = []
            for row, key, text in zip(batch["row"].to_pylist(), batch["id"].to_pylist(), batch["text"]):
                text = text.as_py() or ""
                size = len(text.encode())
                if len(text) <= chunk:
                    made.append((row, key, size, machine.count(text), None, None, None))
                    continue
                text = SPACE + text.replace(" ", SPACE)
                for n, at in enumerate(range(0, len(text), chunk)):
                    before = text[max(0, at - max(1, look_back)) : at]
                    yield table([(row, key, size, None, n, before, text[at : at + chunk])])
            if made:
                yield table(made)
            pa.default_memory_pool().release_unused()

    return run


def _maps(path: str, asked: bool):
    """Chunks to rows of ``_MAPS``; ``asked`` takes the one entry of each row, else all that ``Transducer.entries`` gives."""
    names = ["row", "chunk", "entry", "exit", "tokens"]

    def rows(machine: Transducer, chunk: dict) -> Iterator[tuple]:
        if asked:
            entries = [literal_eval(chunk["entry"])]
        else:
            entries = machine.entries(chunk["before"]) if chunk["chunk"] else [machine.first]
        for entry, (last, tokens) in machine.chunk_map(entries, chunk["text"]).items():
            yield chunk["row"], chunk["chunk"], repr(entry), repr(last), tokens

    def run(batches: Batches) -> Batches:
        machine = transducer(path)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for chunk in batch.to_pylist():
                made = list(zip(*rows(machine, chunk)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, types)], names)

    return run


_COMPOSED = "row long, chunk long, place long, entry string, exit string, tokens long, missing long"


def _compose(fan: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Compose the maps of consecutive chunks (or blocks) into one map per entry of the first of them.

        Where a map lacks the state in which it is entered, ``missing`` is that chunk and ``exit`` the state.
        """
        maps: dict[int, dict] = {}
        for place, entry, *rest in zip(*[group[c] for c in ("place", "entry", "exit", "tokens", "missing")]):
            maps.setdefault(int(place), {})[entry] = rest
        first, begins = min(maps), group.groupby("place")["chunk"].min()
        made = []
        for entry in maps[first]:
            state, total, missing = entry, 0, -1
            for place in range(first, first + len(maps)):
                found = maps[place].get(state)
                if found is None:
                    missing = int(begins[place])
                    break
                state, total, missing = found[0], total + int(found[1]), int(found[2])
                if missing >= 0:
                    break
            made.append((int(group["row"].iloc[0]), int(begins.iloc[0]), first // fan, entry, state, total, missing))
        return pd.DataFrame(made, columns=[c.split()[0] for c in _COMPOSED.split(", ")])

    return run


def _scan(maps: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """(row, tokens) of all rows that go through, and (row, chunk, entry) of the states that maps lack."""
    now = maps.distinct().withColumns({"place": F.col("chunk"), "missing": F.lit(-1).cast("long")})
    lacking = None
    while True:
        block = F.floor(F.col("place") / fan)
        now = fixed(now.withColumn("block", block).groupBy("row", "block").applyInPandas(_compose(fan), _COMPOSED))
        asked = now.where("missing >= 0").select("row", F.col("missing").alias("chunk"), F.col("exit").alias("entry"))
        lacking = asked if lacking is None else lacking.unionByName(asked)
        if now.agg(F.max("place")).first()[0] in (None, 0):
            break
    return now.where("missing < 0").select("row", "tokens"), lacking.distinct()


def token_counts(
    docs: DataFrame,
    path: str | None = None,
    limit: int = 4096,
    id_column: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK,
    look_back: int = LOOK_BACK,
    fan: int = FAN,
) -> DataFrame:
    """One row (id, n_bytes, n_tokens, over_limit) per row: UTF-8 bytes, tokens without begin and end, more than ``limit``.

    A null text counts as empty, which has no token. Strings of special tokens in a text are ordinary text. Repeated rows
    and null ids come back as often as they are there; other columns are ignored; an empty table gives no rows. Texts longer
    than ``chunk`` characters are written in chunks, whose maps are made by all tasks; the states in which a chunk is entered
    are guessed from ``look_back`` characters before it, and ``fan`` maps are composed at once. None of these changes a result.
    """
    path = path or tokenizer_file()
    use_local_folder(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text).alias("text"))
    cut = map_arrow(rows, _count_or_cut(path, chunk, look_back, to_arrow_type(docs.schema[id_column].dataType)), _CUT.format(kind))
    folder = new_folder(docs.sparkSession, "table")
    # Small row groups, so that the chunks of a long text are read by many tasks.
    cut.write.option("parquet.block.size", 64 * CHUNK).parquet(folder)
    cut = docs.sparkSession.read.parquet(folder)
    counted = cut.where("chunk is null").select("id", "n_bytes", "n_tokens")
    chunks = cut.where("chunk is not null")
    maps = fixed(map_arrow(chunks.select("row", "chunk", "before", "text"), _maps(path, False), _MAPS))
    while True:
        totals, lacking = _scan(maps, fan)
        lacking = fixed(lacking)
        if lacking.isEmpty():
            break
        asked = chunks.select("row", "chunk", "text").join(lacking, ["row", "chunk"])
        maps = fixed(maps.unionByName(map_arrow(asked, _maps(path, True), _MAPS)))
    heads = chunks.where("chunk = 0").select("row", "id", "n_bytes")
    long = heads.join(totals, "row").select("id", "n_bytes", F.col("tokens").alias("n_tokens"))
    both = counted.unionByName(long)
    return both.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
