"""Language model scores by a Brown class-based bigram model.

log P(text) is the sum over its tokens of log P(class | class before) + log P(token | class).

Clustering has two steps. The most frequent words, those with at least 1/2048 of the training tokens, are units of their own
beside units of all other words by a hash of their last three bytes; units are bounded in number, and so is the table of
their bigrams, which Spark counts over the whole training text, so exchange clustering can move one unit after the other
as long as the likelihood of the bigrams grows. Then every word with at least 2**-18 of the tokens, of which there are at
most 2**18, becomes a unit, in the class of its former unit. Batch exchange passes over the whole text count the classes
before and after each of them, in Spark, and move all of them at once to the class that fits these best; a pass that lowers
the likelihood is undone. Rarer and unknown words keep the class of their last bytes. Emissions are counts of all words.
A word's count reaches the documents in two ways: words with at least a millionth of the tokens, of which there are
at most 2**20, are broadcast, all others are joined. Words are known by their 64-bit XXH64.

Texts are cut into words twice: to count these, and to write every text as its unit numbers, which all passes read.
Only the counts and the coded texts are written to tables, each partition of which is a file; sums over them are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import Batches, fixed, map_arrow, whole_groups

CLASSES = 64
PASSES = 6
# A word with this share of the training tokens is a unit; other words share so many units.
UNIT_SHARE = 1 / 2048
GROUPS = 512
# After these the words with this share, 2**18 at most, are units too, and move in batch passes.
CLUSTER_SHARE = 1 / (1 << 18)
BATCH_PASSES = 2
_SMOOTH = 0.5
# A word with this share is broadcast with its count: 2**20 words at most.
BROADCAST_SHARE = 1 / (1 << 20)
FOLDS, HELD_OUT = 5, 1
_TRANSITION = 10.0
_SLICE_BYTES = 4 << 20
_SLICE_UNITS = 1 << 20
_MERGE = 1_000_000
END = 0

CODED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, counted double, "
    "rare array<long>, times array<int>, units array<int>"
)


@dataclass
class _Slice:
    first: int
    edges: np.ndarray  # places of the texts in ``word``
    word: np.ndarray  # numbers of the different words, in the order of the texts
    hashes: np.ndarray
    groups: np.ndarray


def _slices(column: pa.Array) -> Iterator[_Slice]:
    """The words of a column of texts, a few megabytes at a time."""
    texts = pc.ascii_lower(pc.fill_null(column, ""))
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + _SLICE_BYTES, "right")))
        split = pc.ascii_split_whitespace(texts.slice(at, to - at))
        coded = split.flatten().dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        different = coded.dictionary.cast(pa.binary())
        each = different.to_numpy(zero_copy_only=False)
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in each], np.uint64).view(np.int64)
        # White space at the ends of a text makes empty words, which don't count.
        empty = pc.binary_length(different).to_numpy() == 0
        if empty.any():
            real = ~empty[word]
            edges = np.concatenate([[0], np.cumsum(real)])[edges]
            word = word[real]
        yield _Slice(at, edges, word, hashes, _groups(different))
        at = to


def _groups(words: pa.Array) -> np.ndarray:
    """The groups of words by their last three bytes; each different ending is hashed once."""
    coded = pc.binary_slice(words, -3).dictionary_encode()
    of_ending = np.array([xxhash.xxh32_intdigest(w) % GROUPS for w in coded.dictionary.to_pylist()], np.int64)
    return of_ending[coded.indices.to_numpy()]


def _sum_by(keys: np.ndarray, values: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unique, first, at = np.unique(keys, return_index=True, return_inverse=True)
    return unique, np.bincount(at, values, len(unique)).astype(np.int64), extra[first]


def count_words(texts: DataFrame) -> DataFrame:
    """(hash, grp, n) for every different word; ``texts`` has one column."""

    def run(batches: Batches) -> Batches:
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        held, size = [none], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return _sum_by(*(np.concatenate(x) for x in zip(*held)))

        def out(sums) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in sums], names=["hash", "n", "grp"])

        for batch in batches:
            for s in _slices(batch.column(0)):
                n = np.bincount(s.word, minlength=len(s.hashes))
                some = n > 0
                held.append((s.hashes[some], n[some], s.groups[some]))
                size += int(some.sum())
                if size >= _MERGE:
                    held = [merged()]
                    if len(held[0][0]) >= _MERGE // 2:
                        yield out(held[0])
                        held = [none]
                    size = len(held[0][0])
        yield out(merged())

    counted = map_arrow(texts, run, "hash long, n long, grp long")
    return counted.groupBy("hash").agg(F.min("grp").alias("grp"), F.sum("n").alias("n"))


class _Units:
    """Unit numbers: END is 0, then words of their own, then groups."""

    def __init__(self, own: np.ndarray):
        self.own = own  # sorted hashes
        self.size = 1 + len(own) + GROUPS

    def of(self, hashes: np.ndarray, groups: np.ndarray) -> np.ndarray:
        units = 1 + len(self.own) + groups
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
            units = np.where(self.own[at] == hashes, 1 + at, units)
        return units

    def coded(self, s: _Slice) -> np.ndarray:
        """The unit of every token, END behind each text."""
        return np.insert(self.of(s.hashes, s.groups)[s.word], s.edges[1:], END)


def _paths(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, unit before, unit, places of the texts) of a column of coded texts, about a million tokens at a time.

    Every text ends with END, so END also stands before the first token of each.
    """
    edges = column.offsets.to_numpy().astype(np.int64)
    units = column.values.to_numpy()
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + _SLICE_UNITS, "right")) - 1)
        unit = units[edges[at] : edges[to]].astype(np.int64)
        before = np.empty_like(unit)
        before[1:] = unit[:-1]
        before[:1] = END
        yield at, before, unit, edges[at : to + 1] - edges[at]
        at = to


def _count_bigrams(coded: DataFrame, coarse: np.ndarray, size: int) -> np.ndarray:
    """Bigrams over all coded texts, as a matrix of bounded size; ``coarse`` names the row of every unit."""

    def run(batches: Batches) -> Batches:
        total = np.zeros(size**2, np.int64)
        for batch in batches:
            for _, before, unit, _ in _paths(batch.column(0)):
                total += np.bincount(coarse[before] * size + coarse[unit], minlength=size**2)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    sums = map_arrow(coded, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.zeros(size**2)
    matrix[sums["pair"].to_numpy(np.int64)] = sums["n"].to_numpy(np.float64)
    return matrix.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(bigrams: np.ndarray, classes: np.ndarray, n: int) -> float:
    """What the classes add to the log likelihood of the bigrams."""
    table = _by_class(bigrams, classes, n)
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def _by_class(bigrams: np.ndarray, classes: np.ndarray, n: int) -> np.ndarray:
    member = np.zeros((len(classes), n))
    member[np.arange(len(classes)), classes] = 1
    return member.T @ bigrams @ member


def exchange(bigrams: np.ndarray, n: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Classes of the units: each unit in turn, frequent ones first, moves to the class that is best for the likelihood.

    END keeps class 0 to itself. Ties keep a unit where it is, then go to the first class.
    """
    size = len(bigrams)
    frequency = bigrams.sum(0) + bigrams.sum(1)
    order = [u for u in np.argsort(-frequency, kind="stable").tolist() if u != END]
    classes = np.zeros(size, np.int64)
    classes[order] = 1 + np.arange(len(order)) % (n - 1)
    member = np.zeros((size, n))
    member[np.arange(size), classes] = 1
    follow, lead = bigrams @ member, bigrams.T @ member  # unit to the class behind it, before it
    table = member.T @ follow
    for _ in range(passes):
        moved = 0
        for unit in order:
            if not frequency[unit]:
                continue
            own = classes[unit]
            out, back, self_ = follow[unit].copy(), lead[unit].copy(), bigrams[unit, unit]
            out[own] -= self_
            back[own] -= self_
            table[own] -= out
            table[:, own] -= back
            table[own, own] -= self_
            rows, columns = table.sum(1), table.sum(0)
            known = _xlogx(table)
            gain = (_xlogx(table + out) - known).sum(1) + (_xlogx(table.T + back) - known.T).sum(1)
            cell = np.diag(table)
            gain += _xlogx(cell + out + back + self_) - _xlogx(cell + out) - _xlogx(cell + back) + _xlogx(cell)
            leaving, arriving = out.sum() + self_, back.sum() + self_
            gain -= _xlogx(rows + leaving) - _xlogx(rows) + _xlogx(columns + arriving) - _xlogx(columns)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            table[best] += out
            table[:, best] += back
            table[best, best] += self_
            if best != own:
                moved += 1
                classes[unit] = best
                follow[:, own] -= bigrams[:, unit]
                follow[:, best] += bigrams[:, unit]
                lead[:, own] -= bigrams[unit]
                lead[:, best] += bigrams[unit]
        if not moved:
            break
    return classes


def _neighbours(coded: DataFrame, units: _Units, classes: np.ndarray, n: int, of_words: bool) -> DataFrame:
    """(unit, slot, n): how often a class stands behind a word (slot) or before it (slot - n); unit -1 has class bigrams.

    Groups and the end are no words here; without ``of_words`` there are class bigrams only.
    """
    words, width = len(units.own), 2 * n

    def run(batches: Batches) -> Batches:
        cells = np.zeros(words * width if of_words else 0, np.int32)
        table = np.zeros(n * n, np.int64)
        for batch in batches:
            for _, before, unit, _ in _paths(batch.column(0)):
                left, right = classes[before], classes[unit]
                table += np.bincount(left * n + right, minlength=n * n)
                if of_words:
                    own = (before > END) & (before <= words)
                    held = [(before[own] - 1) * width + right[own]]
                    own = (unit > END) & (unit <= words)
                    held.append((unit[own] - 1) * width + n + left[own])
                    found, times = np.unique(np.concatenate(held), return_counts=True)
                    cells[found] += times.astype(np.int32)
        for first, counts in ((-n * n, table), (0, cells)):
            cell = np.flatnonzero(counts)
            arrays = [pa.array(cell + first), pa.array(counts[cell].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["cell", "n"])

    return map_arrow(coded, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _class_table(cells: DataFrame, n: int) -> np.ndarray:
    table = np.zeros(n * n)
    for r in cells.where("cell < 0").collect():
        table[r["cell"] + n * n] = r["n"]
    return table.reshape(n, n)


def _table_likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def best_classes(behind: np.ndarray, before: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class whose row and column of the table fit each word's counts of classes behind and before it best.

    To the first order this is the change of the likelihood as the word's counts join the class; class 0 is the end's alone,
    and ties go to the first class.
    """
    smooth = table + _SMOOTH
    follow = np.log(smooth) - np.log(smooth.sum(1, keepdims=True))
    lead = np.log(smooth) - np.log(smooth.sum(0, keepdims=True))
    fit = behind @ follow.T + before @ lead
    fit[:, 0] = -np.inf
    return np.argmax(fit, axis=1)


def _moves(cells: DataFrame, table: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (numbers from 0) with counts and their best classes; each word's cells meet in one task, 2n at most."""
    width = 2 * n

    def run(batches: Batches) -> Batches:
        for group in whole_groups(batches, "word"):
            word, at = np.unique(group.column("word").to_numpy(), return_inverse=True)
            counts = np.zeros((len(word), width))
            counts[at, group.column("slot").to_numpy()] = group.column("n").to_numpy()
            best = best_classes(counts[:, :n], counts[:, n:], table)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(best)], names=["word", "class"])

    own = cells.where("cell >= 0")
    own = own.select(F.floor(F.col("cell") / width).alias("word"), F.pmod("cell", F.lit(width)).cast("long").alias("slot"), "n")
    dealt = own.repartition("word").sortWithinPartitions("word")
    found = map_arrow(dealt, run, "word long, class long").toPandas()
    return found["word"].to_numpy(np.int64), found["class"].to_numpy(np.int64)


def exchange_words(
    coded: DataFrame, units: _Units, classes: np.ndarray, table: np.ndarray, passes: int = BATCH_PASSES
) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units, and the table of class bigrams, after batch passes that move every word at once.

    ``table`` belongs to ``classes``. A pass after which the likelihood is lower is undone and is the last.
    """
    n = len(table)
    if not len(units.own) or not passes:
        return classes, table
    # Whole numbers over a fixed table: what is lost with an executor and counted again is the same.
    cells = _neighbours(coded, units, classes, n, True).persist(StorageLevel.DISK_ONLY)
    try:
        for number in range(passes):
            word, best = _moves(cells, table, n)
            cells.unpersist()
            moved = classes.copy()
            moved[1 + word] = best
            cells = _neighbours(coded, units, moved, n, number + 1 < passes).persist(StorageLevel.DISK_ONLY)
            after = _class_table(cells, n)
            if _table_likelihood(after) <= _table_likelihood(table):
                break
            classes, table = moved, after
    finally:
        cells.unpersist()
    return classes, table


@dataclass
class _Words:
    """What is known of the training words before they have classes."""

    hashes: np.ndarray  # broadcast words, sorted, their counts and groups
    counts: np.ndarray
    groups: np.ndarray
    ends: int
    tokens: int
    words: int

    def with_share(self, share: float) -> np.ndarray:
        return self.counts >= self.tokens * share

    def units(self) -> _Units:
        return _Units(self.hashes[self.with_share(max(CLUSTER_SHARE, BROADCAST_SHARE))])


def _known_words(texts: DataFrame, vocabulary: DataFrame) -> _Words:
    ends = texts.count()
    tokens, words = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, words = tokens + ends, words + (ends > 0)
    common = vocabulary.where(F.col("n") >= tokens * BROADCAST_SHARE).select("hash", "grp", "n").toPandas()
    common = common.sort_values("hash", ignore_index=True)
    hashes, counts, groups = (common[name].to_numpy(np.int64) for name in ("hash", "n", "grp"))
    return _Words(hashes, counts, groups, ends, tokens, words)


def _code(rows: DataFrame, known: _Words) -> DataFrame:
    """One row (``CODED``) per text: its units, what broadcast counts give, and its other words."""
    units = known.units()
    log_ends = float(np.log10(known.ends + 0.5))
    logs = np.log10(known.counts + 0.5)

    def run(batches: Batches) -> Batches:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for s in _slices(batch.column("text")):
                n = len(s.edges) - 1
                found = np.zeros(len(s.hashes), bool)
                log = np.zeros(len(s.hashes))
                if len(known.hashes):
                    at = np.minimum(np.searchsorted(known.hashes, s.hashes), len(known.hashes) - 1)
                    found = known.hashes[at] == s.hashes
                    log = np.where(found, logs[at], 0.0)
                owner = np.repeat(np.arange(n), np.diff(s.edges))
                n_known = np.bincount(owner, found[s.word], n).astype(np.int64) + (known.ends > 0)
                counted = np.bincount(owner, log[s.word], n) + log_ends
                rare = ~found[s.word]
                pair, times = np.unique(owner[rare] * len(s.hashes) + s.word[rare], return_counts=True)
                if len(s.hashes):
                    owners, word = pair // len(s.hashes), pair % len(s.hashes)
                else:
                    owners = word = pair
                offsets = pa.array(np.searchsorted(owners, np.arange(n + 1)).astype(np.int32))
                coded = units.coded(s).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(s.hashes[word])),
                    pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array((s.edges + np.arange(n + 1)).astype(np.int32)), pa.array(coded)),
                ]
                some = slice(s.first, s.first + n)
                arrays = [
                    pa.array(number + np.arange(n)),
                    batch.column("doc_id")[some],
                    batch.column("held_out")[some],
                    pa.array(np.diff(s.edges) + 1),
                    pa.array(n_known),
                    pa.array(counted),
                    *lists,
                ]
                number += n
                names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "counted", "rare", "times", "units"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return map_arrow(rows.select("doc_id", "held_out", "text"), run, CODED)


@dataclass
class ClassModel:
    units: _Units
    classes: np.ndarray
    step: np.ndarray  # log10 of P(class | class before) / (class tokens + (class words + 1) / 2)


def fit(texts: DataFrame, vocabulary: DataFrame, classes: int = CLASSES) -> ClassModel:
    """Classes and transitions of all texts; ``vocabulary`` has their word counts (``count_words``)."""
    known = _known_words(texts, vocabulary)
    text = F.col(texts.columns[0]).alias("text")
    rows = texts.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), text)
    return _fit_coded(fixed(_code(rows, known)).select("units"), vocabulary, known, classes)


def _fit_coded(coded: DataFrame, vocabulary: DataFrame, known: _Words, classes: int) -> ClassModel:
    few = _Units(known.hashes[known.with_share(UNIT_SHARE)])
    units = known.units()
    own = np.isin(known.hashes, units.own)
    # The unit of the first step that every unit belongs to.
    start = np.concatenate([[END], few.of(units.own, known.groups[own]), 1 + len(few.own) + np.arange(GROUPS)])
    bigrams = _count_bigrams(coded, start, few.size)
    seeds = exchange(bigrams, classes)
    found, table = exchange_words(coded, units, seeds[start], _by_class(bigrams, seeds, classes))

    # Different words of each class: those of the groups, less the words that are units of their own.
    per_group = np.zeros(GROUPS)
    for r in vocabulary.groupBy("grp").count().collect():
        per_group[r["grp"]] = r["count"]
    np.subtract.at(per_group, known.groups[own], 1)
    types = np.concatenate([[known.ends > 0], np.ones(len(units.own)), per_group])
    of_class, types = table.sum(0), np.bincount(found, types, classes)
    share = (of_class + 1) / (of_class.sum() + classes)
    step = (table + _TRANSITION * share) / (table.sum(1, keepdims=True) + _TRANSITION)
    step = np.log10(step) - np.log10(of_class + 0.5 * (types + 1))
    return ClassModel(units, found, step)


def _follow_paths(coded: DataFrame, model: ClassModel) -> DataFrame:
    """``coded`` with the score of each text's path through the classes (path) in place of its units."""
    names = [name for name in coded.columns if name != "units"]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            paths = [np.empty(0)]
            for _, before, unit, edges in _paths(batch.column("units")):
                n = len(edges) - 1
                text = np.repeat(np.arange(n), np.diff(edges))
                paths.append(np.bincount(text, model.step[model.classes[before], model.classes[unit]], n))
            yield batch.select(names).append_column("path", pa.array(np.concatenate(paths)))

    return map_arrow(coded, run, coded.select(names).withColumn("path", F.lit(0.0)).schema)


def scores(docs: DataFrame, classes: int = CLASSES, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    The model learns from the rows whose crc32(id as text) modulo 5 is not 1; a null id is not held out. Tokens are the words
    of the text with A-Z in lower case and one end; null and empty texts have the end alone. base_score is the log10
    probability of the tokens by their counts plus one half, score that of the class model. Repeated rows count as often
    as they stand there and get equal scores; other columns are ignored; an empty table gives no rows.
    """
    if classes < 2:
        raise ValueError("there must be a class beside that of the end")
    held = F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == HELD_OUT
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(held, F.lit(False)).alias("held_out"),
        F.col(text).alias("text"),
    )
    training = rows.where("not held_out").select("text")
    vocabulary = fixed(count_words(training))
    known_words = _known_words(training, vocabulary)
    coded = fixed(_code(rows, known_words))
    model = _fit_coded(coded.where("not held_out").select("units"), vocabulary, known_words, classes)

    pairs = F.explode(F.arrays_zip("rare", "times"))
    rare = coded.select("row", pairs.alias("x")).select("row", F.col("x.rare").alias("hash"), F.col("x.times").alias("times"))
    uncommon = vocabulary.where(F.col("n") < known_words.tokens * BROADCAST_SHARE).select("hash", "n")
    met = rare.join(uncommon, "hash", "left")
    gained = F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("gained")
    known = F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known")
    per_row = met.groupBy("row").agg(gained, known)
    scored = _follow_paths(coded.drop("rare", "times"), model)
    total = scored.join(per_row, "row", "left")
    counted = F.col("counted") + F.coalesce("gained", F.lit(0.0))
    whole = float(np.log10(known_words.tokens + 0.5 * (known_words.words + 1)))
    return total.select(
        F.col("doc_id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(known_words.tokens).cast("long").alias("train_tokens"),
        (counted - F.col("n_tokens") * whole).alias("base_score"),
        (counted + F.col("path")).alias("score"),
    )
