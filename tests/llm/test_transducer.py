from __future__ import annotations

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from recurra.llm.queries import op12_transducer
from recurra.llm.transducer import SPACE, Transducer, read_pieces, token_counts, tokenizer_file
from tests.llm.conftest import DATA


@pytest.fixture(scope="module")
def library():
    processor = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())
    return lambda text: len(processor.encode(text))


@pytest.fixture(scope="module")
def machine():
    return Transducer(*read_pieces(tokenizer_file()))


ALPHABETS = ["aehinorst lg▁  \n\t.,0189éñ漢字日本語の🙂\x00<s>/", "a ", "ab", "  \n", "-=", "0123456789", "etaoinshr", "▁a ", "日本語中国"]


def odd_texts(n=400):
    rng = random.Random(11)
    texts = ["".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(1, 60))) for _ in range(n)]
    return [*texts, "", " ", "a" * 3000, " " * 777, "-" * 2001, "abc" * 700, "<s></s><unk><0x0A>", "𝔘" * 300, "the" * 500 + " "]


def test_counts_equal_the_library(machine, library):
    rng = random.Random(12)
    joined = ["".join(rng.choices(machine.pieces, k=rng.randint(2, 6))).replace(SPACE, " ") for _ in range(4000)]
    for text in [*odd_texts(), *joined]:
        assert machine.count(text) == library(text), text


def test_counts_do_not_depend_on_the_states_kept(library):
    small = Transducer(*read_pieces(tokenizer_file()), states=40)
    for text in odd_texts(60):
        assert small.count(text) == library(text)
        assert len(small._rows) <= 43


def test_maps_of_chunks_compose(machine, library):
    rng = random.Random(13)
    for text in odd_texts(60)[40:]:
        whole = SPACE + text.replace(" ", SPACE)
        state, total, at = machine.first, 0, 0
        while at < len(whole):
            size = rng.randint(1, 40)
            found = machine.chunk_map([state, *machine.entries(whole[max(0, at - 64) : at])], whole[at : at + size], block=7)
            state, tokens = found[state]
            total += tokens
            at += size
        assert total == (library(text) if text else 0) or not text


def expected(rows, library, limit):
    out = []
    for key, text in rows:
        n = library(text or "")
        out.append((key, len((text or "").encode()), n, n > limit))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("chunk", [1 << 16, 23])
def test_equals_the_library(spark, documents, some_texts, library, chunk):
    rows = list(enumerate(some_texts)) + [(7, some_texts[7]), (7, "another text"), (None, some_texts[3]), (None, None)]
    rows += [(1000 + i, t) for i, t in enumerate(odd_texts(80))]
    df = documents(rows)
    for clash in ("row", "chunk", "entry", "n_tokens", "id"):
        df = df.withColumn(clash, F.lit("x"))
    found = token_counts(df, limit=100, chunk=chunk).collect()
    assert sorted(map(tuple, found), key=key) == sorted(expected(rows, library, 100), key=key)


def test_chunks_entered_in_unforeseen_states(spark, documents, library):
    """From one character before a chunk its state cannot be guessed; it is asked for, and the scan repeated."""
    rows = [(1, "abcdefgh" * 9), (2, "a" * 70), (3, " ".join(["international"] * 9))]
    found = token_counts(documents(rows), chunk=16, look_back=1, fan=3).collect()
    assert sorted(map(tuple, found)) == expected(rows, library, 4096)


def test_a_very_long_text(spark, documents, library):
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghij  ", k=700_000)) + "x" * 200_000
    assert [tuple(r) for r in token_counts(documents([(1, text)])).collect()] == expected([(1, text)], library, 4096)


def test_query_equals_the_library(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    found = op12_transducer(spark, DATA)
    assert found.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert sorted(map(tuple, found.collect())) == sorted(expected(rows, library, 4096))


def test_empty_table(spark, documents):
    assert token_counts(documents([])).count() == 0
