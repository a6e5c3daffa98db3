from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recurra.llm.language import (
    CODES,
    PRIOR_ROWS,
    TextModel,
    documents_as_rows,
    fit_text_model,
    identify,
    pages_as_rows,
    trigram_codes,
    without_rejected,
)
from recurra.llm.queries import op2_language
from tests.llm.conftest import DATA

WORDS = {
    "en": "the of and with there house water morning evening weather thing should would",
    "de": "der die und mit dort häuser wasser morgen abend wetter sollte würde größe",
    "fr": "le la et avec maison eau matin soirée être où français déjà forêt",
}


def prose(rng, lang, n=60):
    return " ".join(rng.choices(WORDS[lang].split(), k=n))


@pytest.fixture(scope="module")
def labelled(documents):
    rng = random.Random(4)
    langs = ["en"] * 60 + ["de"] * 30 + ["fr"] * 30
    return documents([(i, prose(rng, lang), lang, f"{lang}.example.org") for i, lang in enumerate(langs)])


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, declared string, host string")


def test_held_out_accuracy(spark, documents, labelled):
    model = fit_text_model(labelled, "text", "lang", "doc_id", sample_rows=1_000_000)
    assert model.languages == ["de", "en", "fr"]
    rng = random.Random(5)
    truth = [rng.choice(["en", "de", "fr"]) for _ in range(200)]
    rows = [(i, prose(rng, lang, rng.randint(3, 40)), None, None) for i, lang in enumerate(truth)]
    found = {r.id: r for r in identify(rows_of(spark, rows), model).collect()}
    assert sum(found[i].lang == lang and found[i].kept for i, lang in enumerate(truth)) >= 196


def test_evidence_other_than_text_decides_where_text_does_not(spark, labelled):
    model = fit_text_model(labelled, "text", "lang", "doc_id", sample_rows=1_000_000)
    rng = random.Random(6)
    rows = [(i, prose(rng, "de"), "de", f"h{i % 3}.example.de") for i in range(60)]
    rows += [(100 + i, prose(rng, "fr"), "FR-fr", "www.example.fr") for i in range(60)]
    rows += [(500, "ok", None, "h1.example.de"), (501, "ok", None, "new.example.fr"), (502, "ok", "de", None)]
    rows += [(600, None, "de", "x.de"), (601, "", None, None), (602, " 123 — !!", "fr", "www.example.fr"), (600, None, "de", "x.de")]
    clashes = {name: F.lit("clash") for name in ("n", "own", "suffix", "p0", "t1", "c0", "_host", "kept")}
    found = identify(rows_of(spark, rows).withColumns(clashes), model).collect()
    assert {(r.n, r.own, r.p0) for r in found} == {("clash",) * 3}
    by = {r.id: r for r in found}
    assert len(found) == len(rows)
    assert [by[i].lang for i in (500, 501, 502)] == ["de", "fr", "de"]
    for i in (600, 601, 602):
        assert (by[i].lang, by[i].kept, by[i].probability) == ("und", False, 1.0) or i == 602
    assert all(by[i].lang == "de" and by[i].kept for i in range(60))


def test_equals_plain_python(spark, documents, labelled):
    """The same sums with dictionaries, one row at a time."""
    model = fit_text_model(labelled, "text", "lang", "doc_id", sample_rows=1_000_000)
    rng = random.Random(8)
    rows = []
    for i in range(80):
        lang = rng.choice(["en", "de", "fr"])
        host = rng.choice(["a.x.de", "b.x.de", "c.y.fr", "z", None, ""])
        rows.append((i, prose(rng, lang, rng.randint(1, 30)), rng.choice([lang, "xx", None]), host))
    names = [*model.languages, "und"]
    width = len(names)
    texts = []
    for _, text, _, _ in rows:
        import numpy as np

        codes = trigram_codes(np.frombuffer((text + "  ").encode(), np.uint8))
        # The two bytes before a text are blanks, as behind any other text.
        codes = trigram_codes(np.frombuffer(("  " + text + "  ").encode(), np.uint8))[2:]
        n = int((codes != 0).sum())
        weight = 0.3 * min(1, 1000 / n)
        texts.append([weight * float(model.table.astype("float32")[codes, k].astype(float).sum()) for k in range(width)])

    def softmax(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    shares = [softmax(t) for t in texts]
    keys = []
    for _, _, _, host in rows:
        host = host or None
        parts = (host or "").split(".")
        suffix = parts[-1] if len(parts) > 1 else None
        keys.append((suffix, ".".join(parts[-2:]) if len(parts) > 1 else host, host))
    counts = [Counter(), Counter(), Counter()]
    for key, p in zip(keys, shares):
        for level in range(3):
            for k in range(width):
                counts[level][key[: level + 1], k] += p[k]
    whole = [1 + sum(p[k] for p in shares) for k in range(width)]
    top = [w / sum(whole) for w in whole]
    seen = [d if d in model.languages else "(none)" if d is None else "(other)" for _, _, d, _ in rows]
    found = {r.id: r for r in identify(rows_of(spark, rows), model).collect()}
    for (i, *_), key, p, t, s in zip(rows, keys, shares, texts, seen):
        above = top
        for level in range(2):
            own = [counts[level][key[: level + 1], k] for k in range(width)]
            above = [(c + PRIOR_ROWS * a) / (sum(own) + PRIOR_ROWS) for c, a in zip(own, above)]
        own = [max(0.0, counts[2][key, k] - p[k]) for k in range(width)]
        prior = [(c + PRIOR_ROWS * a) / (sum(own) + PRIOR_ROWS) for c, a in zip(own, above)]
        if key[2] is None:
            prior = top
        logs = []
        for k in range(width):
            says = sum(q[k] for q, x in zip(shares, seen) if x == s)
            total = sum(q[k] for q in shares)
            logs.append(math.log(prior[k]) + math.log((says + 1) / (total + len(names) + 1)) + t[k])
        after = softmax(logs)
        assert found[i].lang == names[after.index(max(after))]
        assert found[i].probability == pytest.approx(max(after), abs=1e-6)


def test_rare_languages_are_fitted_and_unfitted_ones_are_not_rejected(spark):
    rng = random.Random(9)
    greek, georgian = "και το να με που σπίτι νερό πρωί βράδυ καιρός", "და რომ ეს არ სახლი წყალი დილა საღამო ამინდი"
    many = spark.range(30_000).selectExpr("id", f"'{WORDS['en']}' text", "'en' declared", "'a.example.org' host")
    few = [(40_000 + i, " ".join(rng.choices(greek.split(), k=40)), "el", "a.example.org") for i in range(250)]
    few += [(50_000 + i, " ".join(rng.choices(georgian.split(), k=40)), "ka", "a.example.org") for i in range(5)]
    few += [(60_000, " ".join(rng.choices(greek.split(), k=40)), None, None), (60_001, "123", "ka", None)]
    rows = many.unionByName(rows_of(spark, few))
    model = fit_text_model(rows, "text", "declared", "id")
    assert model.languages == ["el", "en"]
    found = {r.id: r for r in identify(rows, model).where("id >= 40000").collect()}
    assert all(r.lang == "el" and r.kept for i, r in found.items() if i < 50_000 or i == 60_000)
    assert all(found[50_000 + i].kept for i in range(5)) and not found[60_001].kept


def test_pages(spark):
    pages = spark.createDataFrame(
        [
            (1, "https://u@Sub.Example.de:80/x?y", '<html dir=a lang="de-AT"><script>the of and</script><p>die&amp;der</p><!-- x -->'),
            (2, None, None),
            (3, "nonsense", "<p>no tag"),
        ],
        "page_id long, url string, html string",
    )
    found = {r.page_id: r for r in pages_as_rows(pages).collect()}
    assert (found[1].declared, found[1].host, found[1].text.split()) == ("de-AT", "Sub.Example.de", ["die", "der"])
    assert found[2].text is None and found[3].text.split() == ["no", "tag"]


def test_query_keeps_prose_and_stage_drops_the_rest(spark, documents):
    found = op2_language(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    pages = spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert len(found) == len(docs) + pages
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert sum(by[d.doc_id].kept for d in docs) >= 0.97 * len(docs)
    assert sum(by[d.doc_id].lang == d.lang for d in docs) >= 0.95 * len(docs)


def test_empty_tables_and_no_labels(spark, documents, labelled):
    model = fit_text_model(documents([]), "text", "lang", "doc_id")
    assert model.languages == [] and model.table.shape == (CODES, 1)
    rows = documents_as_rows(documents([(1, "some text"), (2, None)]))
    assert [(r.lang, r.kept) for r in identify(rows, model).collect()] == [("und", False)] * 2
    model = fit_text_model(labelled, "text", "lang", "doc_id")
    assert isinstance(model, TextModel)
    assert identify(documents_as_rows(documents([])), model).count() == 0
    docs = documents([(1, "a"), (1, "b"), (None, None)])
    decided = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), (F.col("text") == "a").alias("kept"))
    assert [r.text for r in without_rejected(docs, decided.fillna({"kept": False})).collect()] == ["a"]
