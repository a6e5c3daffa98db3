"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

For every language l: log P(l | all) = log P(l | host) + log P(declared | l) + w * log P(text | l) + constant.

- The text likelihood is a naive Bayes model of byte trigrams; a uniform background stands for "no language" (``und``).
  Trigrams of a text depend on each other, so their evidence is weighted down and bounded.
- P(l | host) is smoothed along a hierarchy: all rows, the address suffix, the registered domain, the host. Each level is
  a grouped aggregation of what the texts alone say, and the level above is its prior. A row does not vote for itself.
- P(declared | l) is a table of counts over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from recurra.llm.common import Batches, fixed, map_arrow

UNKNOWN = "und"
CODES = 1 << 16
# Texts of each language that the model is fitted on, in expectation. A label is fitted if it has so many labelled texts, or
# in small tables this share of them.
SAMPLE_ROWS = 2_000
LEAST_ROWS, LEAST_SHARE = 200, 0.01
# A trigram counts for this share of an independent one, and at most so many count in one text.
TEXT_WEIGHT, MOST_TRIGRAMS = 0.3, 1_000
# Strength of the level above, in rows.
PRIOR_ROWS = 20.0
KEEP = 0.5
_BLOCK = 1 << 20

# Letters of ASCII in lower case and all other bytes of UTF-8 letters stay; the rest is space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigram_codes(data: np.ndarray) -> np.ndarray:
    """A code below 65,536 for the three bytes that end at each position; 0 for blanks alone."""
    folded = _FOLD[data].astype(np.uint32) - np.uint32(32)
    packed = folded.copy()
    packed[1:] |= folded[:-1] << np.uint32(8)
    packed[2:] |= folded[:-2] << np.uint32(16)
    return (packed * np.uint32(2654435761)) >> np.uint32(16)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each behind a space and a second one, and the edges between them."""
    parts = [(t or "").encode() + b"  " for t in column.to_pylist()]
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.frombuffer(b"".join(parts), np.uint8), edges


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # CODES x (languages + 1): log probabilities, the last column is the background


def language_code(column: Column | str) -> Column:
    """The primary part of a language tag in lower case; null if there is none."""
    tag = F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2,8})(?:[-_].*)?$", 1)
    return F.nullif(tag, F.lit(""))


def fit_text_model(
    labelled: DataFrame, text: str, label: str, id_column: str, sample_rows: int = SAMPLE_ROWS
) -> TextModel:
    """Trigram counts per label over about ``sample_rows`` texts of each, drawn by a hash of the id.

    Labels are those with LEAST_ROWS texts or a share of LEAST_SHARE. Counts reach the driver: 65,536 per label at most.
    """
    rows = labelled.select(F.col(id_column).alias("id"), F.col(text).alias("text"), language_code(label).alias("label"))
    rows = rows.where("text is not null and label is not null")
    counts = rows.groupBy("label").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    least = min(LEAST_ROWS, LEAST_SHARE * total)
    shares = {r["label"]: r["count"] for r in counts.where(F.col("count") >= least).collect()}
    languages = sorted(shares)
    if not languages:
        return TextModel([], np.zeros((CODES, 1)))
    chance = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, sample_rows / shares[name])))])
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / (1 << 30) < F.element_at(chance, F.col("label"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            data, edges = _texts(batch.column(0))
            codes = trigram_codes(data)
            row = np.repeat(np.array([languages.index(x) for x in batch.column(1).to_pylist()], np.int64), np.diff(edges))
            keys, n = np.unique(row * CODES + codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    sample = rows.where(F.col("label").isin(languages)).where(drawn).select("text", "label")
    sums = map_arrow(sample, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    counted = np.zeros(len(languages) * CODES)
    counted[sums["key"].to_numpy(np.int64)] = sums["n"].to_numpy(np.float64)
    counted = counted.reshape(len(languages), CODES).T.copy()
    counted[0] = 0
    table = np.log((counted + 0.5) / (counted.sum(0) + 0.5 * CODES))
    table = np.column_stack([table, np.full(CODES, -np.log(CODES))])
    table[0] = 0
    return TextModel(languages, table)


def _score(rows: DataFrame, model: TextModel) -> DataFrame:
    """Replace ``text`` by ``n`` (trigrams with a letter), ``t0, t1, ...`` (weighted log likelihoods) and ``p0, p1, ...``
    (what the text alone says).
    """
    kept = [f for f in rows.schema.fields if f.name != "text"]
    width = model.table.shape[1]
    table = model.table.astype(np.float32)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            data, edges = _texts(batch.column("text"))
            sums = np.zeros((batch.num_rows, width))
            counts = np.zeros(batch.num_rows, np.int64)
            row_of = edges[1:]
            for at in range(0, len(data), _BLOCK):
                before = max(0, at - 2)
                codes = trigram_codes(data[before : at + _BLOCK])[at - before :]
                first = int(np.searchsorted(row_of, at, "right"))
                last = int(np.searchsorted(row_of, at + len(codes) - 1, "right"))
                begin = np.maximum(edges[first : last + 1] - at, 0)
                sums[first : last + 1] += np.add.reduceat(table[codes], begin, axis=0, dtype=np.float64)
                counts[first : last + 1] += np.add.reduceat((codes != 0).astype(np.int64), begin)
            weight = TEXT_WEIGHT * np.minimum(1, MOST_TRIGRAMS / np.maximum(counts, 1))
            arrays = [batch.column(f.name) for f in kept] + [pa.array(counts)]
            logs = sums * weight[:, None]
            powers = np.exp(logs - logs.max(axis=1, keepdims=True))
            shares = powers / powers.sum(axis=1, keepdims=True)
            arrays += [pa.array(x) for x in [*logs.T, *shares.T]]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in [*kept, *added]])

    added = [StructField("n", LongType())]
    added += [StructField(f"{name}{i}", DoubleType()) for name in "tp" for i in range(width)]
    return map_arrow(rows, run, StructType([*kept, *added]))


def host_priors(rows: DataFrame, width: int) -> tuple[list[float], DataFrame]:
    """Shares of languages over all rows, and per host the smoothed prior ``b0, b1, ...`` of its domain and its own
    counts ``c0, c1, ...``; ``rows`` has host, domain, suffix and the share ``p0, p1, ...`` of each language.
    """
    sums = [F.sum(f"p{i}").alias(f"c{i}") for i in range(width)]
    per_host = fixed(rows.groupBy("suffix", "domain", "host").agg(*sums))
    again = [F.sum(f"c{i}").alias(f"c{i}") for i in range(width)]
    per_domain = per_host.groupBy("suffix", "domain").agg(*again)
    per_suffix = per_domain.groupBy("suffix").agg(*again)
    counts = per_suffix.agg(*[F.sum(f"c{i}") for i in range(width)]).first()
    counts = [(c or 0.0) + 1.0 for c in counts]
    shares = [c / sum(counts) for c in counts]

    def smoothed(df: DataFrame, above: list[Column], name: str) -> DataFrame:
        total = reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in range(width)])
        made = {f"{name}{i}": (F.col(f"c{i}") + PRIOR_ROWS * above[i]) / (F.col("_total") + PRIOR_ROWS) for i in range(width)}
        return df.withColumn("_total", total).withColumns(made)

    keep = lambda name: [F.col(f"{name}{i}") for i in range(width)]
    suffixes = smoothed(per_suffix, [F.lit(s) for s in shares], "s").select(F.col("suffix").alias("_s"), *keep("s"))
    domains = per_domain.join(suffixes, F.col("suffix").eqNullSafe(F.col("_s")))
    domains = smoothed(domains, keep("s"), "b").select(F.col("suffix").alias("_s"), F.col("domain").alias("_d"), *keep("b"))
    same = F.col("suffix").eqNullSafe(F.col("_s")) & F.col("domain").eqNullSafe(F.col("_d"))
    hosts = per_host.join(domains, same).where("host is not null")
    return shares, fixed(hosts.select(F.col("host").alias("_host"), *keep("b"), *keep("c")))


def with_places(rows: DataFrame) -> DataFrame:
    """Add domain (the last two labels of the host) and suffix (the last label, if there are several)."""
    host = F.nullif(F.lower(F.trim("host")), F.lit(""))
    rows = rows.withColumn("host", host)
    rows = rows.withColumn("suffix", F.nullif(F.regexp_extract("host", r"\.([^.]+)$", 1), F.lit("")))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    return rows.withColumn("domain", F.coalesce(F.nullif(domain, F.lit("")), "host"))


def identify(rows: DataFrame, model: TextModel, keep: float = KEEP) -> DataFrame:
    """Add lang, probability, text_lang and kept to ``rows``, without their text.

    ``rows`` has text, declared and host; all columns but the text come back unchanged, whatever their names, except that the
    four new ones replace old ones of the same name. A row is rejected
    (kept is false) if it has no letters, if no language is more likely than the background, or if the most likely one is
    below ``keep``; but if some language was fitted and the row declares one that was not, only for want of letters, as the model
    knows nothing of that language: its lang may then be ``und``. Null and empty texts are rejected with language ``und`` and probability 1. Null hosts have the prior of
    all rows, null or odd declarations say what such declarations say elsewhere. Ties go to the language first in order.
    Without any labelled text all rows are ``und``. Repeated rows get equal results; an empty table gives no rows.
    """
    width = len(model.languages) + 1
    names = [*model.languages, UNKNOWN]
    added = ["lang", "probability", "text_lang", "kept"]
    own = F.struct(*[c for c in rows.columns if c not in ("text", *added)])
    evidence = rows.select(own.alias("own"), "text", language_code("declared").alias("declared"), "host")
    scored = fixed(_score(with_places(evidence), model))
    voting = scored.where("n > 0")
    shares, hosts = host_priors(voting, width)

    seen = F.when(F.col("declared").isin(model.languages), F.col("declared")) if model.languages else F.lit(None)
    seen = F.coalesce(seen, F.when(F.col("declared").isNull(), F.lit("(none)")).otherwise(F.lit("(other)")))
    sums = voting.groupBy(seen.alias("seen")).agg(*[F.sum(f"p{i}") for i in range(width)]).collect()
    counted = {r[0]: r[1:] for r in sums}
    totals = [sum(c[i] for c in counted.values()) for i in range(width)]
    kinds = [*model.languages, "(none)", "(other)"]
    logs_of = [
        (k, [float(np.log((counted.get(k, [0.0] * width)[i] + 1) / (totals[i] + len(kinds)))) for i in range(width)])
        for k in kinds
    ]
    says = rows.sparkSession.createDataFrame(logs_of, "_seen string, says array<double>")
    met = scored.join(hosts, F.col("host") == F.col("_host"), "left")
    others = reduce(lambda a, b: a + b, [F.col(f"c{i}") - F.col(f"p{i}") for i in range(width)])
    met = met.join(F.broadcast(says), seen == F.col("_seen"), "left").withColumn("_others", others)
    prior = [
        F.when(F.col("_host").isNull() | (F.col("n") == 0), F.lit(shares[i])).otherwise(
            (F.greatest(F.col(f"c{i}") - F.col(f"p{i}"), F.lit(0.0)) + PRIOR_ROWS * F.col(f"b{i}")) / (F.col("_others") + PRIOR_ROWS)
        )
        for i in range(width)
    ]
    met = met.withColumns({f"q{i}": F.log(prior[i]) + F.col("says")[i] + F.col(f"t{i}") for i in range(width)})
    logs = F.array(*[F.col(f"q{i}") for i in range(width)])
    powers = F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)

    def best(prefix: str) -> Column:
        order = F.array(*[F.struct(-F.col(f"{prefix}{i}"), F.lit(i).alias("i")) for i in range(width)])
        return F.get(F.array(*[F.lit(n) for n in names]), F.array_min(order)["i"])

    empty = F.col("n") == 0
    result = met.withColumn("logs", logs).withColumns(
        {
            "lang": F.when(empty, UNKNOWN).otherwise(best("q")),
            "probability": F.when(empty, 1.0).otherwise(1 / total),
            "text_lang": F.when(empty, UNKNOWN).otherwise(best("p")),
        }
    )
    kept = (F.col("lang") != UNKNOWN) & (F.col("probability") >= keep)
    if model.languages:
        kept |= ~empty & (seen == "(other)")
    result = result.withColumn("kept", kept)
    return result.select("own.*", *added)


def documents_as_rows(docs: DataFrame) -> DataFrame:
    """Documents as evidence: ``lang`` is declared, ``source`` is the host."""
    names = [F.col("lang").alias("declared"), F.col("source").alias("host")]
    return docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", *names)


def pages_as_rows(pages: DataFrame) -> DataFrame:
    """Web pages as evidence: the text between tags, the language of the html tag, the host of the address."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", " ")
    tag = F.regexp_extract("html", r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    names = [bare.alias("text"), tag.alias("declared"), host.alias("host")]
    return pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", *names)


def without_rejected(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` without rejected rows; ``decided`` has doc_id, text_hash (XXH64 of the text) and kept."""
    bad = decided.where("not kept").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(bad, same, "left_anti")
