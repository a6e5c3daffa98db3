"""The definitions in plain Python, one loop at a time, for small fixtures."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, timedelta

HORIZONS = (1, 2, 3)
SCHEMA = "pers_id bigint, sentence_date date, release_date date, crime_type string, ed_level string"


def random_episodes(seed: int, n: int = 900, hot: int = 0) -> list[tuple]:
    """Episodes with ties, copies, leap days, nulls and bad intervals; ``hot`` extra rows go to one entity."""
    rng = random.Random(seed)
    days = [date(2008, 2, 29), date(2010, 1, 1), date(2010, 12, 31), date(2012, 2, 29), date(2009, 12, 31)]
    days += [date(2007, 1, 1) + timedelta(days=rng.randrange(2800)) for _ in range(60)]
    days += [d + timedelta(days=k) for d in days[:8] for k in (365, 366, 730, 731, 1095, 1096)]

    def episode(person):
        start, end = rng.choice(days), rng.choice(days)
        if rng.random() < 0.05:
            start = None
        if rng.random() < 0.05:
            end = None
        return person, start, end, rng.choice(["Drug", "Property", None]), rng.choice(["A", "B"])

    rows = [episode(rng.choice([None, *range(250)])) for _ in range(n)]
    rows += [episode(7) for _ in range(hot)]
    rows += [rng.choice(rows) for _ in range(n // 8 + hot // 3)]
    return rows


def random_risks(seed: int) -> list[tuple]:
    rng = random.Random(seed + 1)
    return [(rng.choice([None, *range(250)]), rng.choice(["High", "Med", None])) for _ in range(400)]


def plus(day: date, years: int) -> date | None:
    try:
        return day.replace(year=day.year + years)
    except ValueError:
        return None


def clean_risks(records):
    seen = defaultdict(set)
    for person, risk in records:
        seen[person].add(risk)
    return {p: next(iter(v)) for p, v in seen.items() if len(v) == 1}


def valid(rows):
    return [r for r in rows if r[1] is not None and r[2] is not None and r[2] > r[1]]


def case_ids(rows):
    def order(key):
        return tuple((part is None, part if part is not None else 0) for part in key)

    keys = sorted({r[:3] for r in rows}, key=order)
    return {k: i for i, k in enumerate(keys, 1)}


def cohort(rows, year):
    """One row per tied index episode: (person, index start, index end)."""
    ends = defaultdict(list)
    for r in valid(rows):
        ends[r[0]].append(r[2])
    first = {p: min(v) for p, v in ends.items()}
    return [(r[0], r[1], r[2]) for r in valid(rows) if r[2] == first[r[0]] and r[2].year == year]


def classify(start, index_end):
    bounds = [index_end] + [plus(index_end, n) for n in HORIZONS]
    if start <= index_end:
        return None
    for n, (low, high) in enumerate(zip(bounds, bounds[1:]), 1):
        if low is not None and high is not None and low < start <= high:
            return n
    return HORIZONS[-1] + 1


def prepared(rows, year, risks):
    """Every episode of the cohort once per index row, as dicts."""
    index = defaultdict(list)
    for person, start, end in cohort(rows, year):
        index[person].append((start, end))
    out = []
    for person, start, end, crime, ed in valid(rows):
        for index_start, index_end in index[person]:
            out.append(
                {
                    "pers_id": person,
                    "sentence_date": start,
                    "release_date": end,
                    "crime_type": crime,
                    "ed_level": ed,
                    "index_start": index_start,
                    "index_end": index_end,
                    "risk": risks.get(person),
                    "class": classify(start, index_end),
                }
            )
    return out


def rates(prepared_rows, keys, level):
    """Mean flags per level; ``keys`` collapse episodes, ``level`` maps a collapsed key to its group."""
    classes = defaultdict(set)
    for r in prepared_rows:
        classes[tuple(r[k] for k in keys)].add(r["class"])
    groups = defaultdict(list)
    for key, found in classes.items():
        low = min((c for c in found if c is not None), default=99)
        groups[level(dict(zip(keys, key)))].append([int(low <= n) for n in HORIZONS])
    return {g: tuple(sum(col) / len(col) for col in zip(*flags)) for g, flags in groups.items()}


def duration_band(key):
    months = (key["index_end"] - key["index_start"]).days / 30.4375
    for upper, label in ((12, "Less than a year"), (24, "1-2 years"), (36, "2-3 years")):
        if months <= upper:
            return label
    return None


def mix(prepared_rows, within, of):
    counts, totals = defaultdict(int), defaultdict(int)
    for r in prepared_rows:
        if r[within] is not None and r["release_date"] == r["index_end"]:
            counts[r[within], r[of]] += 1
            totals[r[within]] += 1
    return {k: (n, n / totals[k[0]]) for k, n in counts.items()}
