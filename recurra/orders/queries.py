"""One query per operator and report, each over the whole tables."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from recurra import operators as ops
from recurra.functions import add_years, average_months, band, band_order, with_automatic_labels
from recurra.orders.episodes import (
    DURATION_YEAR,
    SEGMENTS,
    SPEC,
    UNSEGMENTED,
    YEAR,
    clean_status,
    order_episodes,
    segmented_episodes,
    segments,
    status_records,
    study,
    table,
)
from recurra.plans import classify_prepared, prepare_cohort, prepared_mix, prepared_rates
from recurra.settings import new_folder, scratch_table
from recurra.sources import (
    attribute_schema,
    read_attribute_file,
    read_bucketed,
    read_episode_files,
    read_rejects,
    read_table,
    read_years,
    reject_counts,
    replace_years,
    write_bucketed,
    write_table,
    write_years,
)
from recurra.spec import BAND_ORDER, COHORT, DURATION_BANDS, HORIZONS, CohortWindow

WINDOW = CohortWindow.of_year(YEAR)


def _text_day(column: str, pattern: str = "ddMMMyyyy"):
    return F.date_format(column, pattern)


def _valid(spark, folder):
    return ops.valid_episodes(order_episodes(spark, folder), SPEC)


def _valid_segmented(spark, folder):
    return ops.valid_episodes(segmented_episodes(spark, folder), SPEC)


def _text_episodes(spark, folder):
    """Episodes with dates as text, as they stand in raw files."""
    days = {c: F.lower(_text_day(c)) for c in ("order_date", "ship_date")}
    return segmented_episodes(spark, folder).withColumns(days)


# -- sources and sinks --------------------------------------------------------------------------------------------


def csv_episode_files(spark, folder):
    """Two CSV exports of the episodes, by ship year, found by name pattern and read as one table.

    A missing priority is written as the token NA.
    """
    base = new_folder(spark, "tables")
    text = _text_episodes(spark, folder).withColumn("priority", F.coalesce("priority", F.lit("NA")))
    late = F.substring("ship_date", 6, 4) >= str(YEAR)
    text.where(~late).write.csv(f"{base}/releases_early.csv", header=True)
    text.where(late).write.csv(f"{base}/releases_late.csv", header=True)
    write_table(status_records(spark, folder), f"{base}/other.csv", "csv")
    return ops.parse_date_columns(read_episode_files(spark, f"{base}/releases*.csv", SPEC, files="*.csv"))


def csv_attribute_file(spark, folder):
    path = new_folder(spark, "tables")
    write_table(status_records(spark, folder), path, "csv")
    return read_attribute_file(spark, path, SPEC, "status")


def csv_table(spark, folder):
    path = new_folder(spark, "tables")
    episodes = segmented_episodes(spark, folder)
    write_table(episodes, path, "csv", multi_line=False)
    return read_table(spark, path, episodes.schema, "csv", multi_line=False)


def csv_text_table(spark, folder):
    """Number of records and of records without a status in a CSV table that holds text only."""
    path = new_folder(spark, "tables")
    keys = status_records(spark, folder).select(F.col("custkey").cast("string").alias("custkey"), "status")
    write_table(keys, path, "csv")
    read = read_table(spark, path, keys.schema, "csv")
    # The first count needs no column at all.
    n = F.lit(read.count()).cast("long").alias("n")
    return read.agg(F.count_if(F.col("status").isNull()).alias("missing")).select(n, "missing")


def csv_quoted_text(spark, folder):
    """Whole document texts with padding, quotes, commas and line breaks, written and read again."""
    path = new_folder(spark, "tables")
    text = F.concat(F.lit('  "'), F.col("text"), F.lit('",\n\t'))
    documents = table(spark, folder, "documents").select("doc_id", text.alias("text"), "source")
    write_table(documents, path, "csv")
    return read_table(spark, path, documents.schema, "csv")


def _broken_records(spark, folder):
    """Order records as raw lines of text, some of them broken."""
    path = new_folder(spark, "tables")
    orders = table(spark, folder, "orders")
    key, kind = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 50
    line = (
        F.when(kind == 1, F.concat(key, F.lit(",P,extra")))
        .when(kind == 2, key)
        .when(kind == 3, F.concat(F.lit("c"), key, F.lit(",P")))
        .when(kind == 4, F.concat(key, F.lit(',"a ""quoted"", word"')))
        .otherwise(F.concat(key, F.lit(","), F.col("o_orderstatus")))
    )
    # Every part needs the header, which the CSV writer puts there; its text goes out unquoted as it is.
    lines = orders.select(line.alias("custkey,status"))
    lines.write.csv(path, header=True, quote="", sep="\x01")
    return path


def csv_rejects(spark, folder):
    """What cannot be read comes back with the reason."""
    return read_rejects(spark, _broken_records(spark, folder), attribute_schema(SPEC, "status"))


def counted_rejects(spark, folder):
    """The same counted by reason while the good records are read and written."""
    counts = Observation("records")
    good = read_attribute_file(spark, _broken_records(spark, folder), SPEC, "status", multi_line=False, counts=counts)
    write_table(good, new_folder(spark, "tables"))
    return reject_counts(spark, counts)


def counted_invalid(spark, folder):
    """Episodes dropped for their dates, counted by reason while the valid ones are written."""
    counts = Observation("episodes")
    write_table(ops.valid_episodes(order_episodes(spark, folder), SPEC, counts), new_folder(spark, "tables"))
    return reject_counts(spark, counts)


def _ordered_records(spark, folder):
    """Records of orders as CSV parts, the latest order first; of a customer, order, day, priority and status differ."""
    path = new_folder(spark, "tables")
    status = status_records(spark, folder, "o_orderkey", "o_orderdate", "o_orderpriority")
    records = status.select(
        "custkey",
        "status",
        F.col("o_orderkey").alias("orderkey"),
        F.to_date("o_orderdate").alias("order_date"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("priority"),
    )
    write_table(records.orderBy(F.desc("order_date"), "orderkey"), path, "csv", multi_line=False)
    return read_table(spark, path, records.schema, "csv", multi_line=False, order=True)


def first_order_records(spark, folder):
    """The first record of every customer in the order of files and lines, with all columns, though records disagree."""
    return ops.first_records(_ordered_records(spark, folder), ["custkey"], "record_order")


def first_consistent_records(spark, folder):
    """The first record of the customers whose records agree in the status."""
    return ops.consistent_records(_ordered_records(spark, folder), "custkey", "status", "record_order")


def records_with_distinct_status(spark, folder):
    return ops.add_distinct_values(status_records(spark, folder), "custkey", "status")


def sorted_rows(spark, folder):
    """Episodes written in row order; rows read and places where the order descends, in and between the files."""
    path = new_folder(spark, "tables")
    write_table(ops.in_row_order(order_episodes(spark, folder), *SPEC.key), path)
    key = F.struct(*SPEC.key)
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")]
    rows = spark.read.parquet(path).select(key.alias("key"), *place)
    before = F.lag("key").over(Window.partitionBy("file").orderBy("at"))
    inside = rows.withColumn("down", (F.col("key") < before).cast("long")).groupBy("file")
    files = inside.agg(
        F.count(F.lit(1)).alias("n"), F.sum("down").alias("down"), F.min("key").alias("low"), F.max("key").alias("high")
    )
    # One row per file meets in this window.
    last = F.max("high").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.withColumn("between", (F.col("low") < last).cast("long"))
    descents = F.coalesce(F.sum("down"), F.lit(0)) + F.coalesce(F.sum("between"), F.lit(0))
    return files.agg(F.sum("n").alias("n"), descents.cast("long").alias("descents"))


def parquet_table(spark, folder):
    path = new_folder(spark, "tables")
    write_table(_valid(spark, folder), path)
    return read_table(spark, path)


# -- cleaning and ids ---------------------------------------------------------------------------------------------


def parsed_text_dates(spark, folder):
    """Order dates in several spellings, one of them no real day, next to upper-case ship dates."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    spelled = (
        F.when(F.col("l_linenumber") == 1, _text_day("o_orderdate", "d-MMM-yyyy"))
        .when(F.col("l_linenumber") == 2, _text_day("o_orderdate", "d MMMM yyyy"))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("31feb"), F.year("o_orderdate")))
        .otherwise(F.lower(_text_day("o_orderdate")))
    )
    text = orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        "l_orderkey",
        "l_linenumber",
        spelled.alias("order_date"),
        F.upper(_text_day("l_shipdate")).alias("ship_date"),
    )
    return ops.parse_date_columns(text)


def rejected_episodes(spark, folder):
    return ops.rejected_episodes(order_episodes(spark, folder), SPEC)


def case_ids(spark, folder):
    return ops.add_case_ids(order_episodes(spark, folder), SPEC)


def numbered_clean_episodes(spark, folder):
    return ops.clean_episodes(_text_episodes(spark, folder), SPEC, case_ids=True)


def calendar_years(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("orderkey"), F.to_date("o_orderdate").alias("order_date")
    )
    later = {f"plus_{n}": add_years(F.col("order_date"), n) for n in HORIZONS}
    return orders.withColumns({"year": F.year("order_date"), **later})


def duration_bands(spark, folder):
    months = average_months(F.col("order_date"), F.col("ship_date"))
    rows = _valid(spark, folder).withColumn("months", months)
    return rows.withColumns(
        {
            "band": band(F.col("months"), DURATION_BANDS),
            "band_order": band_order(F.col("months"), DURATION_BANDS),
        }
    )


def ordered_segments(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return ops.order_levels(customers, "segment", SEGMENTS)


# -- attributes ---------------------------------------------------------------------------------------------------


def consistent_return_flag(spark, folder):
    lines = table(spark, folder, "lineitem")
    return ops.consistent_attribute(lines, "l_orderkey", "l_returnflag")


def distinct_priorities(spark, folder):
    return ops.distinct_values(order_episodes(spark, folder), "custkey", "priority")


# -- cohort -------------------------------------------------------------------------------------------------------


def cohort(ties):
    return lambda spark, folder: ops.build_cohort(_valid(spark, folder), SPEC, WINDOW, ties=ties)


def _rows_of_cohort(spark, folder, episodes):
    """Rows of the cohort; the segment is one of the customer and joined to the cohort's customers only."""
    return ops.cohort_episodes(episodes, SPEC, WINDOW, ties="weighted", entity_attributes=[segments(spark, folder)])


def cohort_episodes(spark, folder):
    return _rows_of_cohort(spark, folder, _valid(spark, folder))


def _monthly(spark, folder):
    """Valid episodes that end with the month of their ship date, so that many of a customer tie."""
    ends = order_episodes(spark, folder).withColumn("ship_date", F.last_day("ship_date"))
    return ops.valid_episodes(ends, SPEC)


def monthly_cohort(spark, folder):
    return ops.build_cohort(_monthly(spark, folder), SPEC, WINDOW, ties="weighted")


def monthly_cohort_episodes(spark, folder):
    return _rows_of_cohort(spark, folder, _monthly(spark, folder))


def prepared_cohort(spark, folder):
    prepared = prepare_cohort(order_episodes(spark, folder), UNSEGMENTED, WINDOW, ties="weighted")
    return ops.add_episode_attribute(prepared, segments(spark, folder), SPEC)


def replaced_year_cohort(spark, folder):
    """The cohort from a table by end year in which the episodes of one year were replaced by those with a priority."""
    path = new_folder(spark, "tables")
    write_years(_valid(spark, folder), path, SPEC)
    corrected = _valid(spark, folder).where((F.year("ship_date") == YEAR) & F.col("priority").isNotNull())
    replace_years(corrected, path, SPEC)
    return ops.build_cohort(read_years(spark, path, last=YEAR), SPEC, WINDOW, ties="weighted")


def _merged_state(spark, folder):
    """State of the episodes file by file, a file being those that end in a year, the last year's first."""
    valid = _valid(spark, folder)
    ends = [None, *range(1995, 1999), None]
    parts = [valid.where(_between(low, high)) for low, high in zip(ends, ends[1:])]
    state = scratch_table(ops.entity_state(parts[-1], SPEC))
    for part in parts[:-1]:
        state = scratch_table(ops.merge_states(state, ops.entity_state(part, SPEC), spec=SPEC))
    return state


def _between(low, high):
    """End years from ``low`` on and before ``high``; None is no bound."""
    year = F.year("ship_date")
    return (F.lit(True) if low is None else year >= low) & (F.lit(True) if high is None else year < high)


def merged_state_flags(spark, folder):
    return ops.flags_of_state(_merged_state(spark, folder), SPEC, WINDOW)


def merged_state_cohort(spark, folder):
    return ops.cohort_of_state(_merged_state(spark, folder), SPEC, WINDOW, ties="weighted")


# -- rates and mix ------------------------------------------------------------------------------------------------


def rates_by_segment(spark, folder):
    return ops.in_report_order(study(spark, folder, segment=True).rates("segment"), "segment")


def rates_by_duration(spark, folder):
    rates = study(spark, folder, DURATION_YEAR).rates_by_duration()
    return ops.in_report_order(rates, BAND_ORDER)


def rates_by_each(spark, folder):
    rates = study(spark, folder, segment=True, status=True).rates_by_each("segment", "priority", "status")
    return ops.in_report_order(rates, "dim", "level")


def rates_by_cohort(spark, folder):
    """Cohorts of four years and their segments in one pass."""
    window = CohortWindow(date(YEAR - 1, 1, 1), date(YEAR + 2, 12, 31))
    both = replace(study(spark, folder, segment=True), window=window)
    return ops.in_report_order(both.rates_by_cohort("segment"), COHORT, "segment")


def all_reports(spark, folder):
    reports = study(spark, folder, DURATION_YEAR, segment=True, status=True)
    return reports.all_reports("segment", "priority", "status", within="status", of="priority")


def status_priority_mix(spark, folder):
    mix = study(spark, folder, status=True).mix("status", "priority")
    return ops.in_report_order(with_automatic_labels(mix, "prop"), "status", "priority")


BUCKETS = 8


def saved_cohort_rates(spark, folder):
    """The two-step way: save the cohort and the attribute in buckets by customer, read them again, report."""
    base = new_folder(spark, "tables")
    write_bucketed(ops.cohort_episodes(_valid(spark, folder), SPEC, WINDOW), f"{base}/cohort", ["custkey"], BUCKETS)
    write_bucketed(clean_status(spark, folder), f"{base}/status", ["custkey"], BUCKETS)
    saved, status = read_bucketed(spark, f"{base}/cohort"), read_bucketed(spark, f"{base}/status")
    return prepared_rates(classify_prepared(saved, status, SPEC, bucketed=True), SPEC, "status")


def saved_cohort_mix(spark, folder):
    base = new_folder(spark, "tables")
    write_table(ops.cohort_episodes(_valid(spark, folder), SPEC, WINDOW, ties="weighted"), f"{base}/cohort")
    saved = classify_prepared(read_table(spark, f"{base}/cohort"), clean_status(spark, folder), SPEC)
    return prepared_mix(saved, SPEC, "status", "priority")


QUERIES = {
    "csv_episode_files": csv_episode_files,
    "csv_attribute_file": csv_attribute_file,
    "csv_table": csv_table,
    "csv_text_table": csv_text_table,
    "csv_quoted_text": csv_quoted_text,
    "csv_rejects": csv_rejects,
    "counted_rejects": counted_rejects,
    "counted_invalid": counted_invalid,
    "sorted_rows": sorted_rows,
    "parquet_table": parquet_table,
    "parsed_text_dates": parsed_text_dates,
    "valid_episodes": _valid_segmented,
    "rejected_episodes": rejected_episodes,
    "case_ids": case_ids,
    "numbered_clean_episodes": numbered_clean_episodes,
    "calendar_years": calendar_years,
    "duration_bands": duration_bands,
    "ordered_segments": ordered_segments,
    "consistent_status": clean_status,
    "consistent_return_flag": consistent_return_flag,
    "distinct_priorities": distinct_priorities,
    "records_with_distinct_status": records_with_distinct_status,
    "first_order_records": first_order_records,
    "first_consistent_records": first_consistent_records,
    "cohort_all_ties": cohort("all"),
    "cohort_weighted": cohort("weighted"),
    "cohort_one_start": cohort("one"),
    "cohort_episodes": cohort_episodes,
    "monthly_cohort": monthly_cohort,
    "monthly_cohort_episodes": monthly_cohort_episodes,
    "prepared_cohort": prepared_cohort,
    "replaced_year_cohort": replaced_year_cohort,
    "merged_state_flags": merged_state_flags,
    "merged_state_cohort": merged_state_cohort,
    "classified_episodes": lambda spark, folder: study(spark, folder, status=True).classified_episodes("status"),
    "return_flags": lambda spark, folder: study(spark, folder, status=True).flags("status"),
    "rates_overall": lambda spark, folder: study(spark, folder).rates(),
    "rates_by_segment": rates_by_segment,
    "rates_by_priority": lambda spark, folder: study(spark, folder).rates("priority"),
    "rates_by_index_priority": lambda spark, folder: study(spark, folder).rates("priority", "index"),
    "rates_by_status": lambda spark, folder: study(spark, folder, status=True).rates("status"),
    "rates_by_duration": rates_by_duration,
    "rates_by_each": rates_by_each,
    "rates_by_cohort": rates_by_cohort,
    "all_reports": all_reports,
    "rates_by_priority_long": lambda spark, folder: ops.rates_long(study(spark, folder).rates("priority")),
    "chart_overall": lambda spark, folder: ops.chart_table(study(spark, folder).rates()),
    "chart_by_segment": lambda spark, folder: ops.chart_table(
        study(spark, folder, segment=True).rates("segment"), "segment", SEGMENTS
    ),
    "chart_by_status": lambda spark, folder: ops.chart_table(
        study(spark, folder, status=True).rates("status"), "status", drop_null_level=True
    ),
    "status_priority_mix": status_priority_mix,
    "saved_cohort_rates": saved_cohort_rates,
    "saved_cohort_mix": saved_cohort_mix,
}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return rates_by_each(spark, folder)
