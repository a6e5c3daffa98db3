from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from recurra.llm import chunks as module
from recurra.llm.chunks import chunks, cut_points, gear, repeated_passages, without_repeats
from recurra.llm.queries import op5_chunks
from tests.llm.conftest import DATA


def brute_chunks(text):
    """Byte by byte: the same rule without arrays."""
    raw = text.encode()
    table = [int(x) for x in module._GEAR]
    out, at, h = [], 0, 0
    for i, b in enumerate(raw):
        h = (2 * h + table[b]) % 65536
        end = i + 1
        if end - at > module.MOST:
            cut = at + module.MOST
            while raw[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append((at, cut))
            at = cut
        if end < len(raw) and raw[end] & 0xC0 != 0x80 and h < int(module._BOUND) and end - at >= module.LEAST:
            out.append((at, end))
            at = end
    if len(raw) > at:
        out.append((at, len(raw)))
    return out


def brute_passages(rows, min_words=30):
    """(id, start, end, words, first id) of the parts of all runs, for rows (id, text), each different row once."""
    rows = list(dict.fromkeys(rows))
    pieces = [[(a, b, t.encode()[a:b]) for a, b in brute_chunks(t)] for _, t in rows]
    holders = defaultdict(set)
    for (i, _), own in zip(rows, pieces):
        for *_, p in own:
            holders[p].add(i)

    def split(chunks, key):
        """Neighbours with equal keys."""
        parts = []
        for c in chunks:
            if parts and key(parts[-1][-1]) == key(c) and parts[-1][-1]["at"] + 1 == c["at"]:
                parts[-1].append(c)
            else:
                parts.append([c])
        return parts

    def words(part):
        return sum(c["words"] for c in part)

    found = []
    for (i, text), own in zip(rows, pieces):
        raw, spaces, chunks = b" " + text.encode(), b" \t\n\x0b\x0c\r", []
        for at, (a, b, p) in enumerate(own):
            n = sum(1 for k in range(a, b) if raw[k] in spaces and raw[k + 1] not in spaces)
            if len(holders[p]) > 1:
                chunks.append({"at": at, "a": a, "b": b, "words": n, "first": min(holders[p])})
        for run in split(chunks, lambda c: 0):
            if words(run) < min_words:
                continue
            for part in split(run, lambda c: c["first"]):
                for c in part:
                    c["name"] = c["first"] if words(part) >= min_words else None
            for part in split(run, lambda c: (c["name"] is None, c["first"] < i)):
                early = part[0]["first"] < i
                for c in part:
                    c["row"] = ("one", c["name"]) if c["name"] is not None else ("joined",) if early and words(part) >= min_words else None
            for reach in split(run, lambda c: c["first"] < i):
                rows_here = [c["row"] for c in reach]
                for n, c in enumerate(reach):
                    if c["row"] is None and c["first"] < i:
                        near = [r for r in rows_here[:n][::-1] + rows_here[n:] if r]
                        c["filled"] = near[0] if near else None
            for part in split(run, lambda c: c["row"] or c.get("filled")):
                row = part[0]["row"] or part[0].get("filled")
                if row or words(part) >= min_words:
                    first = i if not row else row[1] if row[0] == "one" else min(c["first"] for c in part)
                    found.append((i, part[0]["a"], part[-1]["b"], words(part), first))
    return sorted(found)


def test_gear_depends_on_sixteen_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 500).astype(np.uint8)
    h, table = 0, module._GEAR.astype(int)
    expected = []
    for b in data:
        h = (2 * h + table[b]) % 65536
        expected.append(h)
    assert gear(data).tolist() == expected
    assert gear(data[100:])[15:].tolist() == expected[115:]


def test_chunks_equal_brute_force(spark, documents, some_texts, monkeypatch):
    texts = [t for t in some_texts if t] + ["漢字" * 300, "é" * 500, "a" * 1000, "x" * 12, "🙂 " * 90]
    docs = documents(list(enumerate(texts))).withColumn("digest", F.lit("clash"))
    found = defaultdict(list)
    for r in chunks(docs).orderBy("doc_id", "ordinal").collect():
        found[r.doc_id].append((r.start, r.start + r.size))
    assert dict(found) == {i: brute_chunks(t) for i, t in enumerate(texts)}
    monkeypatch.setattr(module, "_BLOCK", 64)
    raw = "".join(texts[:5]).encode()
    cut = cut_points(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    assert cut == [b for _, b in brute_chunks("".join(texts[:5]))]


def test_passages_are_found_wherever_they_stand(spark, documents):
    rng = random.Random(5)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(2, 9))) for _ in range(n))

    passage = prose(51)
    common = prose(8)
    rows = [(i, f"{prose(rng.randint(5, 200))} {passage} {prose(rng.randint(5, 90))}") for i in range(20)]
    clean = [(100 + i, f"{prose(150)}\n{common}\n{prose(20)}") for i in range(40)] + [(200, None), (201, ""), (None, passage)]
    docs = documents(rows + clean)
    found = repeated_passages(docs)
    assert {r.doc_id for r in found.collect()} == set(range(20))
    assert {r.first_doc_id for r in found.collect()} == {0}
    kept = {r.doc_id: r.text for r in without_repeats(docs, found).collect()}
    assert kept[0] == rows[0][1] and kept[100] == clean[0][1] and kept[200] is None
    assert all(len(kept[i]) < len(t) - len(passage) / 2 for i, t in rows[1:])


def test_chunks_known_from_other_documents_do_not_split_a_passage(spark, documents):
    rng = random.Random(6)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(4, 9))) for _ in range(n))

    halves = [prose(26), prose(26)]
    passage = " ".join(halves)
    rows = [(i, f"{prose(60)} {half} {prose(60)}") for i, half in enumerate(halves)]
    rows += [(i, f"{prose(60)} {passage} {prose(60)}") for i in range(5, 9)]
    docs = documents(rows)
    found = repeated_passages(docs)
    spans = {r.doc_id: r for r in found.collect()}
    assert found.count() == 4 and {i: r.first_doc_id for i, r in spans.items()} == {5: 5, 6: 0, 7: 0, 8: 0}
    assert all(r.words > 40 for r in spans.values())
    kept = {r.doc_id: r.text for r in without_repeats(docs, found).collect()}
    for i, text in rows:
        cut = text[: spans[i].start] + text[spans[i].end :] if i > 5 else text
        assert kept[i] == cut


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = sorted(map(tuple, op5_chunks(spark, DATA).collect()))
    assert found == brute_passages([tuple(d) for d in docs if d.text])
    assert found


def test_copies_repeated_rows_and_empty_tables(spark, documents, some_texts):
    text = some_texts[0] + " " + some_texts[1]
    copies = repeated_passages(documents([(1, text), (2, text), (3, text)])).collect()
    assert {(r.doc_id, r.start, r.end, r.first_doc_id) for r in copies} == {(i, 0, len(text), 1) for i in (1, 2, 3)}
    assert repeated_passages(documents([(1, text), (1, text)])).count() == 0
    assert repeated_passages(documents([])).count() == 0


def test_texts_with_one_id_and_repeated_rows(spark, documents):
    """Each text under an id is cut for itself, and a row given many times counts as one."""
    rng = random.Random(9)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(4, 9))) for _ in range(n))

    short, long = prose(24), prose(60)
    rows = [(1, f"{prose(80)} {short} {prose(40)} {long} {prose(9)}"), (2, f"{prose(70)} {short} {prose(70)}")]
    rows += [(5, f"{prose(90)} {long} {prose(30)}"), (5, prose(90))]
    docs = documents(rows + [rows[0]] * 3 + [rows[2]])
    found = repeated_passages(docs)
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in found.collect()) == brute_passages(rows)
    assert {r.doc_id for r in found.collect()} == {1, 5} and found.count() == 2
    kept = Counter((r.doc_id, r.text) for r in without_repeats(docs, found).collect())
    span = next(r for r in found.collect() if r.doc_id == 5)
    cut = rows[2][1][: span.start] + rows[2][1][span.end :]
    assert kept == Counter([rows[0]] * 4 + [rows[1], (5, cut), (5, cut), rows[3]])


def test_no_chunk_that_earlier_documents_hold_is_left_out(spark, documents):
    rng = random.Random(10)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(4, 9))) for _ in range(n))

    parts = [prose(n) for n in (12, 40, 15, 33, 10)]
    rows = [(i, f"{prose(40)} {p} {prose(40)}") for i, p in enumerate(parts)]
    rows += [(i, f"{prose(20)} {' '.join(parts)} {prose(20)}") for i in (10, 11, 12)]
    found = sorted(tuple(r)[:1] + tuple(r)[2:] for r in repeated_passages(documents(rows)).collect())
    assert found == brute_passages(rows)
    for i in (11, 12):
        spans = [r[1:3] for r in found if r[0] == i]
        assert len(spans) > 1 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_one_row_many_times_is_combined_before_it_is_shuffled(spark, documents, some_texts):
    """A third of the rows is one row; its chunks meet once per task."""
    text = f"{some_texts[0]} {some_texts[1]}"
    rows = [(i, t) for i, t in enumerate(some_texts[:20]) if t] + [(100, text)] * 300
    found = repeated_passages(documents(rows).repartition(8))
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in found.collect()) == brute_passages(rows)
