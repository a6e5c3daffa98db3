"""Token ids of whole texts, computed in bulk.

Most words repeat, and a tokenizer that drops white space gives a word the same ids wherever it stands. Each different
word of a few megabytes of text is therefore looked up once, in a compact table of the words met before, and encoded if it is
not there; words made of plain letters travel to the tokenizer many at a time.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from recurra.llm.common import kept_by

_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+([.,;:!?]?)").fullmatch
_WORDS_AT_ONCE = 500
_KEPT_WORDS = 2_000_000
_SLICE_BYTES = 4 << 20
_ID = np.dtype("<u4")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces(word: str) -> int:
    """Into how many pieces the tokenizer splits a word of plain letters and a mark; 0 for other words."""
    match = _PLAIN(word)
    return 0 if match is None else 2 if match[1] else 1


class WordTable:
    """Ids of words, known by 64-bit hash: sorted hashes and, for each, a stretch of one array of ids.

    ``forget``, called before words are looked up, holds it at about ``most`` words: those that were never asked for again
    are forgotten, or all if that does not help.
    """

    def __init__(self, most: int, kind: type):
        self.most, self.kind = most, kind
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.begin = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.length, self.again = np.zeros(0, np.int32), np.zeros(0, bool)
        self.ids = np.zeros(0, self.kind)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is unknown."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, place, -1)

    def add(self, hashes: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """Add unknown words with different hashes; ``ids`` are theirs one after another."""
        begin = len(self.ids) + np.cumsum(length) - length
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.begin = np.insert(self.begin, at, begin[order])
        self.length = np.insert(self.length, at, length[order])
        self.again = np.insert(self.again, at, False)
        self.ids = np.concatenate([self.ids, ids.astype(self.kind)])

    def forget(self) -> None:
        if len(self.hashes) <= self.most:
            return
        which = self.again if self.again.sum() < self.most // 2 else np.zeros(len(self.again), bool)
        self.ids = self.take(np.flatnonzero(which))[1].astype(self.kind)
        self.hashes, self.length = self.hashes[which], self.length[which]
        self.begin = np.cumsum(self.length, dtype=np.int64) - self.length
        self.again = np.zeros(len(self.hashes), bool)

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the ids of the words at these places, laid end to end, and the ids."""
        n = self.length[places]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return ends, self.ids[np.repeat(self.begin[places] - ends + n, n) + np.arange(total)]


class Encoder:
    """Ids of texts by a tokenizer file of the ``tokenizers`` library, without special tokens, plus an end id."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.end_id = end_id
        self._tokenizer = Tokenizer.from_file(path)
        suffix = json.loads(self._tokenizer.to_str())["model"].get("end_of_word_suffix")
        self._by_word = bool(suffix)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        if suffix:
            self._ends = np.zeros(self.size, bool)
            self._ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._words = WordTable(_KEPT_WORDS, np.uint16 if self.size <= 1 << 16 else np.uint32)

    def _encode(self, texts: list[str]) -> list[bytes]:
        encoded = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, _ID).tobytes() for e in encoded]

    def _encode_plain(self, texts: list[str], pieces: list[int]) -> list[bytes]:
        """Words of letters with at most one mark behind them: each run of letters and each mark ends one token."""
        made: list[bytes] = []
        for at in range(0, len(texts), 50 * _WORDS_AT_ONCE):
            some = texts[at : at + 50 * _WORDS_AT_ONCE]
            lines = [" ".join(some[i : i + _WORDS_AT_ONCE]) for i in range(0, len(some), _WORDS_AT_ONCE)]
            ids = b"".join(self._encode(lines))
            last = np.flatnonzero(self._ends[np.frombuffer(ids, _ID)])
            last = last[np.cumsum(pieces[at : at + len(some)]) - 1]
            edges = [0, *(4 * (last + 1)).tolist()]
            made += [ids[a:b] for a, b in zip(edges, edges[1:])]
        return made

    def _places_of_words(self, different: pa.Array) -> np.ndarray:
        """Places of different words in the table, to which unknown ones are added."""
        self._words.forget()
        words = different.to_pandas().to_numpy(object)
        hashes = pd.util.hash_array(words, categorize=False)
        places = self._words.find(hashes)
        self._words.again[places[places >= 0]] = True
        missing = np.flatnonzero(places < 0)
        if not len(missing):
            return places
        texts = words[missing].tolist()
        ends = [_pieces(w) for w in texts]
        made: list[bytes] = [b""] * len(texts)
        simple = [i for i, n in enumerate(ends) if n]
        other = [i for i, n in enumerate(ends) if not n and texts[i]]
        for where, ids in (
            (simple, self._encode_plain([texts[i] for i in simple], [ends[i] for i in simple])),
            (other, self._encode([texts[i] for i in other])),
        ):
            for i, own in zip(where, ids):
                made[i] = own
        lengths = np.fromiter(map(len, made), np.int32, len(made)) // 4
        self._words.add(hashes[missing], lengths, np.frombuffer(b"".join(made), _ID))
        return self._words.find(hashes)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yield (first row, edges, ids) for slices of the column; row ``first + i`` has ids[edges[i]:edges[i + 1]]."""
        texts = pc.fill_null(column, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + _SLICE_BYTES, "right")))
            some = texts.slice(at, to - at)
            edges, ids = self._by_words(some) if self._by_word else self._by_texts(some)
            yield at, edges, ids
            at = to
        pa.default_memory_pool().release_unused()

    def _by_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        end = np.array([self.end_id], _ID).tobytes()
        made = [ids + end for ids in self._encode(texts.to_pylist())]
        edges = np.concatenate([[0], np.cumsum([len(ids) // 4 for ids in made])])
        return edges, np.frombuffer(b"".join(made), _ID)

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        row_edges = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        word = coded.indices.to_numpy(zero_copy_only=False)
        ends, ids = self._words.take(self._places_of_words(coded.dictionary)[word])
        edges = np.concatenate([[0], ends])[row_edges]
        ids = np.insert(ids.astype(_ID), edges[1:], self.end_id)
        return edges + np.arange(len(edges)), ids


@kept_by("recurra.llm.frames", "recurra.llm.packing")
def encoder(path: str, end_id: int) -> Encoder:
    """One encoder per process, which Spark's Python workers keep from task to task."""
    return Encoder(path, end_id)
