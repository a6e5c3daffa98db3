"""The reports: return rates overall and by attribute or duration, and the category mix."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.functions.dates import average_months
from recurra.functions.labels import band, band_order
from recurra.operators import cohort as c
from recurra.operators.attributes import add_entity_attribute
from recurra.operators.mix import category_counts, category_shares
from recurra.operators.returns import (
    FIRST_CLASS,
    classify_return,
    first_class,
    flags_from_first_class,
    return_rates,
    stack_attributes,
)
from recurra.operators.skew import join_per_key
from recurra.settings import scratch_table
from recurra.spec import (
    BAND,
    BAND_ORDER,
    COHORT,
    DURATION_BANDS,
    HORIZONS,
    INDEX_ROWS,
    MONTHS,
    RETURN_CLASS,
    Bands,
    CohortWindow,
    EpisodeSpec,
    check_horizons,
)


@dataclass(frozen=True)
class ReturnStudy:
    """One cohort and everything that is asked about it.

    ``episodes`` are valid episodes. ``entity_attributes`` maps attribute names to tables with one row per entity
    (see ``consistent_attribute``). They are joined to entities of the cohort, never to episodes.

    Every report scans the episodes once and works on day histories (see ``operators.cohort``). None needs the repeated
    rows that tied index episodes cause in ``cohort_episodes``: flags collapse them and the mix counts them.
    """

    episodes: DataFrame
    spec: EpisodeSpec
    window: CohortWindow
    horizons: tuple[int, ...] = HORIZONS
    entity_attributes: Mapping[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        check_horizons(self.horizons)

    # -- shared parts --------------------------------------------------------------------------------------------

    def _with_attributes(self, per_entity: DataFrame, *names: str) -> DataFrame:
        for name in names:
            per_entity = add_entity_attribute(per_entity, self.entity_attributes[name], self.spec)
        return per_entity

    def _split(self, *dims: str) -> tuple[list[str], list[str]]:
        """Attributes of episodes and attributes of entities among ``dims``."""
        of_entity = [d for d in dims if d in self.entity_attributes]
        return [d for d in dims if d not in of_entity], of_entity

    def _decisive(self) -> DataFrame:
        return c.decisive_episodes(self.episodes, self.spec, self.window, self.horizons)

    def _classified(self, episodes: DataFrame, *dims: str) -> DataFrame:
        """Day history of the cohort with return classes."""
        history = c.start_history(episodes, self.spec, self.window, dims)
        return classify_return(c.add_horizons(history, self.spec, self.horizons), self.spec, self.horizons)

    def _rates(self, first: DataFrame, *dims: str) -> DataFrame:
        return return_rates(flags_from_first_class(first, self.horizons), dims, self.horizons)

    def classified_episodes(self, *attributes: str, ties: str = "weighted") -> DataFrame:
        """Row-level result: every episode of the cohort with the named entity attributes and its return class."""
        tables = [self.entity_attributes[a] for a in attributes]
        rows = c.cohort_episodes(self.episodes, self.spec, self.window, self.horizons, ties, tables)
        return classify_return(rows, self.spec, self.horizons)

    # -- rates ---------------------------------------------------------------------------------------------------

    def flags(self, *attributes: str) -> DataFrame:
        """One row per cohort entity: cumulative return flags and the named entity attributes."""
        first = first_class(self._classified(self._decisive()), [self.spec.entity])
        return flags_from_first_class(self._with_attributes(first, *attributes), self.horizons)

    def rates(self, by: str | None = None, attribute_from: str = "episode") -> DataFrame:
        """Return rates over the cohort or per level of ``by``.

        For an attribute of the episodes, an entity counts once under each level found in any of its episodes, and as
        returned only if a returning episode has that level. ``attribute_from="index"`` instead puts an entity
        under the levels of its index episodes and counts every return.
        """
        if attribute_from not in ("episode", "index"):
            raise ValueError(attribute_from)
        if by is None:
            return return_rates(self.flags(), (), self.horizons)
        if by in self.entity_attributes:
            return return_rates(self.flags(by), (by,), self.horizons)
        entity = self.spec.entity
        if attribute_from == "index":
            index_days = self._index_days(by).select(entity, by, FIRST_CLASS).distinct()
            return self._rates(index_days, by)
        return self._rates(first_class(self._classified(self.episodes, by), [entity, by]), by)

    def _index_days(self, *dims: str) -> DataFrame:
        """Index days of the cohort beside the lowest return class of the whole entity."""
        entity = self.spec.entity
        classified = self._classified(self._decisive(), *dims)
        index_day = c.is_index_day(self.spec)
        if not dims:
            lowest = F.min(RETURN_CLASS).over(Window.partitionBy(entity))
            return classified.withColumn(FIRST_CLASS, lowest).where(index_day)
        days = classified.where(index_day)
        return join_per_key(days, first_class(classified, [entity]), [entity], "inner", self.spec.entity_nullable)

    def rates_by_duration(self, bands: Bands = DURATION_BANDS) -> DataFrame:
        """Return rates by the length of the index episode in average months."""
        months = average_months(F.col(self.spec.start), F.col(self.spec.index_end))
        days = self._index_days().withColumn(MONTHS, months)
        days = days.withColumns({BAND: band(F.col(MONTHS), bands), BAND_ORDER: band_order(F.col(MONTHS), bands)})
        return self._rates(days, BAND, BAND_ORDER)

    def rates_by_each(self, *dims: str) -> DataFrame:
        """Overall rates and the rates by each of ``dims`` as one table (dim, level), from one pass over the data.

        Equal to ``rates()`` and ``rates(by)``. Dimensions are told apart before an entity's rows meet; attributes of
        entities are added to the row that stands for the whole entity.
        """
        entity = self.spec.entity
        of_episode, of_entity = self._split(*dims)
        history = c.stacked_start_history(self.episodes, self.spec, self.window, of_episode)
        classified = classify_return(c.add_horizons(history, self.spec, self.horizons), self.spec, self.horizons)
        first = first_class(classified, [entity, "dim", "level"])
        for name in of_entity:
            table = self.entity_attributes[name]
            first = join_per_key(first, table, [entity], "left", self.spec.entity_nullable)
        return self._rates(stack_attributes(first, of_entity, c.ALL), "dim", "level")

    def rates_by_cohort(self, by: str | None = None, cohort: Column | None = None) -> DataFrame:
        """Return rates of many cohorts in one pass: one row per cohort (and level of an entity attribute ``by``).

        The study's window spans all of them. ``cohort`` is an expression of the first end date, its year unless given, and
        becomes the column ``cohort``; each entity belongs to one and is followed from its own first end. The window's dates
        bound the scan as a whole, and days beyond the last horizon of the entity's own cohort are left out before its rows
        are classified.
        """
        if by is not None and by not in self.entity_attributes:
            raise ValueError(f"{by!r} is no entity attribute")
        spec = self.spec
        history = c.start_history(self._decisive(), spec, self.window)
        reach = F.date_add(F.col(spec.index_end), 366 * max(self.horizons))
        history = history.where(F.col(spec.start) <= reach)
        classified = classify_return(c.add_horizons(history, spec, self.horizons), spec, self.horizons)
        key = F.year(spec.index_end) if cohort is None else cohort
        first = first_class(classified.withColumn(COHORT, key), [spec.entity, COHORT])
        dims = [] if by is None else [by]
        return self._rates(self._with_attributes(first, *dims), COHORT, *dims)

    # -- everything at once ----------------------------------------------------------------------------------------

    def all_reports(self, *dims: str, within: str, of: str, bands: Bands = DURATION_BANDS) -> DataFrame:
        """All reports as one table, from one scan of the episodes.

        ``report`` says which: "rates" has the overall rates and those by each of ``dims`` as (dim, level), equal to
        ``rates_by_each``; "duration" the rates by band, equal to ``rates_by_duration``; "mix" the number ``n`` and share
        ``prop`` of ``other_level`` of the episode attribute ``of`` at each level of the entity attribute ``within``, equal to
        ``mix``. The day history that all of them group is computed once and written (``remove_tables`` removes it).
        """
        spec, entity = self.spec, self.spec.entity
        of_episode, of_entity = self._split(*dims)
        if within not in self.entity_attributes or of in self.entity_attributes:
            raise ValueError("the mix is one of an episode attribute within an entity attribute")
        needed = [*of_episode, *([of] if of not in of_episode else [])]
        history = c.stacked_start_history(self.episodes, spec, self.window, needed, rows=True)
        history = classify_return(c.add_horizons(history, spec, self.horizons), spec, self.horizons)
        index_day = c.is_index_day(spec)
        history = scratch_table(history.withColumn("_index_day", index_day))
        key = [entity, "dim", "level"]
        first = history.groupBy(*key).agg(
            F.min(RETURN_CLASS).alias(FIRST_CLASS), F.sum(F.when(F.col("_index_day"), F.col(INDEX_ROWS))).alias(INDEX_ROWS)
        )
        for name in dict.fromkeys([*of_entity, within]):
            first = join_per_key(first, self.entity_attributes[name], [entity], "left", spec.entity_nullable)
        first = scratch_table(first)

        shown = first.drop(INDEX_ROWS, *([within] if within not in of_entity else []))
        shown = shown.where(F.col("dim").isin(c.ALL, *of_episode))
        rates = self._rates(stack_attributes(shown, of_entity, c.ALL), "dim", "level")

        whole = first.where(F.col("dim") == c.ALL).select(entity, FIRST_CLASS, F.col(INDEX_ROWS).alias(c.TIED_ROWS))
        days = history.where((F.col("dim") == c.ALL) & F.col("_index_day")).select(entity, spec.start, spec.index_end)
        days = join_per_key(days, whole, [entity], "inner", spec.entity_nullable)
        months = average_months(F.col(spec.start), F.col(spec.index_end))
        banded = days.withColumn(MONTHS, months).withColumn("level", band(F.col(MONTHS), bands))
        duration = self._rates(banded, "level").withColumn("dim", F.lit(BAND))

        levels = first.where((F.col("dim") == of) & F.col(INDEX_ROWS).isNotNull() & F.col(within).isNotNull())
        levels = join_per_key(levels, whole.drop(FIRST_CLASS), [entity], "inner", spec.entity_nullable)
        levels = levels.withColumn(INDEX_ROWS, F.col(INDEX_ROWS) * F.col(c.TIED_ROWS))
        counts = category_counts(levels.withColumnRenamed("level", "other_level"), within, "other_level", INDEX_ROWS)
        mix = category_shares(counts, within).withColumnRenamed(within, "level").withColumn("dim", F.lit(within))

        parts = [t.withColumn("report", F.lit(n)) for n, t in (("rates", rates), ("duration", duration), ("mix", mix))]
        stacked = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
        rest = [x for x in stacked.columns if x not in ("report", "dim", "level", "other_level", "n", "prop")]
        return stacked.select("report", "dim", "level", "other_level", "n", "prop", *rest)

    # -- mix -----------------------------------------------------------------------------------------------------

    def mix(self, within: str, of: str) -> DataFrame:
        """Shares of ``of`` among the index rows at each known level of ``within``.

        Counts are rows of the cohort, so an entity with *k* tied index rows counts each of them *k* times.
        """
        of_episode, of_entity = self._split(within, of)
        counts = c.index_counts(self.episodes, self.spec, self.window, of_episode)
        weight = F.col(INDEX_ROWS) * F.col(c.TIED_ROWS)
        weighted = self._with_attributes(counts.withColumn(INDEX_ROWS, weight), *of_entity)
        known = weighted.where(F.col(within).isNotNull())
        return category_shares(category_counts(known, within, of, INDEX_ROWS), within)
