"""Reading and writing of episode and attribute tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurra.spec import EpisodeSpec

# File name pattern of episode files, the second missing-value token (the first is the empty field) and
# the text form of dates in written CSV files.
EPISODE_FILES = "*releases*.csv"
MISSING = "NA"
CSV_DAY = "yyyy-MM-dd'T'00:00:00'Z'"

RECORD, REASON = "record", "reason"
ORDER = "record_order"
_PLACE, _VALUE = "_place", "_value_"
_DAY_TEXT = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}Z)?$"
_LINE_BREAK = "[\r\n]"
KEPT = "kept"
_WRONG_NUMBER = "wrong number of fields"


def _read_text(
    spark: SparkSession, path: str, names: list[str], multi_line: bool, trim: bool, files: str | None
) -> DataFrame:
    """Every field as text, and the whole record where its number of fields is wrong.

    All columns are parsed, or a wrong number of fields would pass unseen where only some are wanted. ``trim`` is for raw
    files, in which an empty field in quotes is missing as well.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, RECORD]])
    reader = spark.read.schema(schema).option("columnPruning", False)
    return reader.csv(
        path,
        header=True,
        enforceSchema=False,
        columnNameOfCorruptRecord=RECORD,
        quote='"',
        escape='"',
        multiLine=multi_line,
        ignoreLeadingWhiteSpace=trim,
        ignoreTrailingWhiteSpace=trim,
        nullValue=MISSING,
        pathGlobFilter=files,
    )


def _is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


def _typed(field: T.StructField) -> Column:
    """The value of a text field, null where it is none."""
    text = F.col(field.name)
    if isinstance(field.dataType, T.DateType):
        return F.when(text.rlike(_DAY_TEXT), F.try_to_date(F.substring(text, 1, 10)))
    return text.try_cast(field.dataType)


def _wrong_kind(field: T.StructField) -> str:
    return f"{field.name} is no {field.dataType.simpleString()}"


def reject_reasons(schema: T.StructType) -> list[str]:
    """All reasons for which records of a schema may be left out."""
    return [_WRONG_NUMBER, *[_wrong_kind(f) for f in schema.fields if not _is_text(f)]]


def _parsed(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool, trim: bool, files: str | None
) -> DataFrame:
    """Text fields, the values of the others as ``_value_*``, the reason for which a record is rejected, and its order.

    Values are computed once, below the place of the record, which no filter above may be pushed through; the filter that
    keeps the good records and the columns that come out both take them from there. Files are read in blocks from their
    first record to their last, so the file, the block and the place within the task put records in file order.
    """
    raw = _read_text(spark, path, schema.names, multi_line, trim, files)
    if trim:
        raw = raw.withColumns({n: F.nullif(F.col(n), F.lit("")) for n in schema.names})
    values = {_VALUE + f.name: _typed(f) for f in schema.fields if not _is_text(f)}
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    parsed = raw.select(*schema.names, RECORD, *block, *[v.alias(n) for n, v in values.items()], F.monotonically_increasing_id().alias(_PLACE))
    # The record alone is not to be asked for: Spark parses it only beside a field. No text has a negative length.
    some_field = F.coalesce(F.length(schema.names[0]), F.lit(0)) >= 0
    reason = F.when(F.col(RECORD).isNotNull() & some_field, _WRONG_NUMBER)
    for field in schema.fields:
        if not _is_text(field):
            wrong = F.col(field.name).isNotNull() & F.col(_VALUE + field.name).isNull()
            reason = reason.when(wrong, _wrong_kind(field))
    order = F.struct("file", "block", F.col(_PLACE).alias("place"))
    return parsed.withColumns({REASON: reason, ORDER: order})


def _good(parsed: DataFrame, schema: T.StructType, order: bool) -> DataFrame:
    values = [F.col(f.name if _is_text(f) else _VALUE + f.name).alias(f.name) for f in schema.fields]
    # The place is never negative, but it keeps the filter above it.
    kept = parsed.where(F.col(REASON).isNull() & (F.col(_PLACE) >= 0))
    return kept.select(*values, ORDER) if order else kept.select(*values)


def _read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    multi_line: bool = True,
    trim: bool = True,
    files: str | None = None,
    order: bool = False,
    counts: Observation | None = None,
) -> DataFrame:
    parsed = _parsed(spark, path, schema, multi_line, trim, files)
    if counts is not None:
        each = {r: F.count_if(F.col(REASON) == r).alias(r) for r in reject_reasons(schema)}
        kept = F.count_if(F.col(REASON).isNull()).alias(KEPT)
        parsed = parsed.observe(counts, kept, *each.values())
    return _good(parsed, schema, order)


def read_rejects(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    multi_line: bool = True,
    trim: bool = True,
    files: str | None = None,
) -> DataFrame:
    """(record, reason) for every record of CSV files that the readers below leave out.

    A record is left out if its number of fields differs from the schema's or a field that is no text cannot be read; it
    never turns into a row with nulls in place of what stood there.
    """
    parsed = _parsed(spark, path, schema, multi_line, trim, files)
    record = F.coalesce(F.rtrim(F.col(RECORD), F.lit("\r\n")), F.to_csv(F.struct(*schema.names)))
    return parsed.where(F.col(REASON).isNotNull() & (F.col(_PLACE) >= 0)).select(record.alias(RECORD), REASON)


def reject_counts(spark: SparkSession, counts: Observation) -> DataFrame:
    """(reason, n) of the records that a reader left out, for the ``counts`` it was given.

    They are counted while the records pass, so an action on the whole table, such as its write, has to come first; the
    files are not read again. A read that an action cuts short, or that is repeated, counts what that action has seen.
    """
    found = [(reason, n) for reason, n in counts.get.items() if n and reason != KEPT]
    return spark.createDataFrame(found, T.StructType().add(REASON, T.StringType()).add("n", T.LongType()))


def attribute_schema(spec: EpisodeSpec, value: str) -> T.StructType:
    return T.StructType([T.StructField(spec.entity, spec.entity_type), T.StructField(value, T.StringType())])


def read_episode_files(
    spark: SparkSession,
    folder: str,
    spec: EpisodeSpec,
    files: str = EPISODE_FILES,
    multi_line: bool = True,
    order: bool = False,
    counts: Observation | None = None,
) -> DataFrame:
    """All CSV files of a folder whose name matches ``files``, as one table; dates are still text.

    The schema is declared, so nothing is scanned to guess types, and headers are checked against it. Fields may hold
    doubled quotes and line breaks in quotes (CRLF there is read as a line feed if lines end with CRLF). A file with such
    breaks cannot be split, so each file is one task; pass ``multi_line=False`` for large files known to hold none.
    Records that cannot be read are in ``read_rejects``; an Observation given as ``counts`` counts them on the way (see
    ``reject_counts``). ``order`` adds the struct ``record_order``, which puts records in the order of file names and, within
    a file, of lines, however the files are split (see ``first_records``).
    """
    return _read_csv(spark, folder, spec.text_schema(), multi_line, files=files, order=order, counts=counts)


def read_attribute_file(
    spark: SparkSession,
    path: str,
    spec: EpisodeSpec,
    value: str,
    multi_line: bool = True,
    order: bool = False,
    counts: Observation | None = None,
) -> DataFrame:
    """A CSV file (or folder) of (entity, value) records; options as above."""
    return _read_csv(spark, path, attribute_schema(spec, value), multi_line, order=order, counts=counts)


def write_table(
    df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists", multi_line: bool = True
) -> None:
    """Write a dataset as a folder of Parquet or CSV parts.

    CSV parts have a header; dates are written as UTC date-times and nulls as ``NA``, which is also what the text "NA" is
    read as. Other text comes back from ``read_table`` as it was, with quotes, line breaks and padding. CSV that is written
    with ``multi_line=False`` holds no line breaks in fields (one there is an error), so it may be read in splits.
    """
    if form == "parquet":
        df.write.mode(mode).parquet(path)
    elif form == "csv":
        days = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
        text = df.withColumns({c: F.date_format(c, CSV_DAY) for c in days})
        if not multi_line:
            text = text.withColumns({f.name: _one_line(f.name) for f in df.schema.fields if _is_text(f)})
        text.write.mode(mode).csv(
            path,
            header=True,
            nullValue=MISSING,
            quote='"',
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
    else:
        raise ValueError(f"unknown form {form!r}")


def _one_line(name: str) -> Column:
    error = F.raise_error(F.lit(f"column {name} holds a line break, write it with multi_line=True"))
    return F.when(F.col(name).rlike(_LINE_BREAK), error.cast("string")).otherwise(F.col(name))


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    form: str = "parquet",
    multi_line: bool = True,
    order: bool = False,
) -> DataFrame:
    """Read what ``write_table`` wrote. CSV needs the schema of the written table.

    CSV that was written with ``multi_line=False`` can be read so too; its files then are split over tasks. ``order`` adds
    ``record_order`` (CSV only).
    """
    if form == "parquet":
        return spark.read.parquet(path)
    if form != "csv" or schema is None:
        raise ValueError("CSV tables need a schema" if form == "csv" else f"unknown form {form!r}")
    return _read_csv(spark, path, schema, multi_line, trim=False, order=order)
