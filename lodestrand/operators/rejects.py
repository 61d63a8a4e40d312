"""Loading of raw text records with their failing lines set apart by reason.

Records are read by Spark's permissive CSV reader under an explicit schema that keeps the raw text
of corrupt rows. Corrupt rows, and those where the reader is more lenient than the file rules
(quotes, line ends), are reclassified from their raw text by quoting and field count; all others
keep the reader's fields. Identifier and cast checks follow on the fields. Every record is read and
judged in one pass; repeats are removed afterwards, by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import skew_join

# Fixed values of the record formats.
MISSING_TOKENS = ("", "na", "nan", "null", "none", "n/a")
FAM_FIELDS = 6
NUMBER = r"[+-]?+(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?+[0-9]++)?+"
#: White space as text processing libraries strip it, for use inside a character class.
BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and every control, format, surrogate, private or unassigned character.
BAD_IN_ID = r"[\p{Z}\p{C}]"
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_PLAIN_ID = r'[^\p{Z}\p{C}",]++'
#: Characters by which the permissive reader's fields can differ from those of the file rules.
_LENIENT = r'["\\\r\n\x00]'


#: The same characters one by one.
_BLANK_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK_CHARACTERS))


def is_missing(trimmed_text: Column) -> Column:
    return F.lower(trimmed_text).isin(*MISSING_TOKENS)


def number(trimmed_text: Column) -> Column:
    """The finite double that a decimal number stands for, else null."""
    # Of these characters the cast accepts decimal numbers only.
    plain = (F.length(trimmed_text) > 0) & (F.length(F.translate(trimmed_text, "0123456789+-.eE", "")) == 0)
    value = F.when(plain, trimmed_text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def bad_identifier(text: Column) -> Column:
    return text.isNull() | (text == "") | text.rlike(BAD_IN_ID)


def _quotes_removed(line: Column) -> Column:
    """The record with each well-formed quoted field emptied; a quote that is left breaks the rules."""
    return F.regexp_replace(line, rf"(\A|,){_QUOTED}(?=,|\z)", "$1")


def _fields(line: Column) -> Column:
    """Unquoted fields of a record whose quoting is well formed."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf',({_QUOTED}|[^",]*+)'), 1)
    quoted = lambda f: F.regexp_replace(F.substring(f, 2, F.length(f) - 2), '""', '"')
    return F.transform(raw, lambda f: F.when(f.startswith('"'), quoted(f)).otherwise(f))


def _read(lines: DataFrame, most: int) -> DataFrame:
    """``lines`` (line, width) with n, the fields that the permissive reader finds, or null where the row is corrupt.

    The explicit schema has as many text columns as the widest header. Records are filled up to it
    with empty fields, so that exactly those of their own file's width are not corrupt.
    """
    schema = ", ".join([*(f"f{i} string" for i in range(most)), "corrupt string"])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "escape": '"', "maxColumns": str(max(20_480, 2 * most))}
    commas = F.length("line") - F.length(F.translate("line", ",", ""))
    # The reader gives up on records wider than any schema; they are corrupt by their count alone.
    readable = F.when(commas < max(20_480, 2 * most) - most, F.concat("line", F.repeat(F.lit(","), F.lit(most) - F.col("width"))))
    fields = F.slice(F.array(*(F.coalesce(F.col(f"read.f{i}"), F.lit("")) for i in range(most))), 1, F.greatest("width", F.lit(1)))
    read = lines.withColumn("read", F.from_csv(readable, schema, options))
    return read.withColumn("read_fields", F.when(F.col("read").isNotNull() & F.col("read.corrupt").isNull(), fields)).drop("read")


def classify_csv(lines: DataFrame) -> DataFrame:
    """file_name, line_no, line, fid, iid, values, reason of each record that is no header and not blank.

    reason is null for valid records, whose identifiers and values (null for missing tokens) are
    set. A null record counts as a blank one. The width comes from the file's first line; in a file
    without one the count is not judged. Repeats of a record are kept.
    """
    csv = lines.filter("kind = 'csv'").select("file_name", "line_no", "line")
    header = F.regexp_replace("line", "\\A\ufeff", "")
    widths = csv.filter("line_no = 1").groupBy("file_name").agg(F.max(F.size(F.split(_quotes_removed(header), ",", -1))).alias("width"))
    most = max(2, widths.agg(F.max("width")).first()[0] or 0)  # one row
    records = _read(skew_join(csv.filter("line_no > 1 and line is not null"), widths, ["file_name"], "left"), most)

    certain = F.col("read_fields").isNotNull() & ~F.col("line").rlike(_LENIENT)
    quoting = ~F.coalesce(certain, F.lit(False)) & _quotes_removed(F.col("line")).contains('"')
    records = records.withColumn("quoting", quoting).withColumn("fields", F.when(certain, F.col("read_fields")).when(~F.col("quoting"), _fields(F.col("line")))).drop("read_fields")
    blank = F.col("line").rlike(rf"\A[{BLANKS},\"]*+\z") & ~F.col("quoting") & ~F.exists("fields", lambda f: trimmed(f) != "")
    fid, iid = F.get("fields", F.lit(0)), F.get("fields", F.lit(1))
    judged = records.withColumn("texts", F.transform(F.slice("fields", 3, F.greatest(F.size("fields"), F.lit(2))), trimmed))
    judged = judged.withColumn("values", F.transform("texts", number))
    bad_value = F.exists(F.arrays_zip(F.col("texts").alias("t"), F.col("values").alias("v")), lambda x: x["v"].isNull() & ~is_missing(x["t"]))
    reason = F.when(blank, "blank").when(F.col("quoting"), "quoting").when(F.size("fields") != F.col("width"), "column_count").when(bad_identifier(fid) | bad_identifier(iid), "identifier").when(bad_value, "value")
    judged = judged.withColumn("reason", reason)
    valid = lambda c: F.when(F.col("reason").isNull(), c)
    # As a generated row, the verdict is not taken apart and repeated by filters that follow.
    verdict = F.struct(valid(fid).alias("fid"), valid(iid).alias("iid"), valid(F.col("values")).alias("values"), F.col("reason"))
    return judged.select("file_name", "line_no", "line", F.inline(F.array(verdict))).filter("reason is null or reason <> 'blank'")


def classify_fam(lines: DataFrame) -> DataFrame:
    """file_name, line_no, line, fid, iid, values (empty), reason of each fam record, repeats kept; a null record has no fields."""
    fam = lines.filter("kind = 'fam'").select("file_name", "line_no", "line")
    stripped = F.regexp_replace(F.coalesce("line", F.lit("")), r"\A[ \t]++|[ \t]++\z", "")
    fields = F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, "[ \t]++", -1))
    first, second = F.get("fields", F.lit(0)), F.get("fields", F.lit(1))
    reason = F.when(F.size("fields") != FAM_FIELDS, "column_count").when(bad_identifier(first) | bad_identifier(second), "identifier")
    return (
        fam.withColumn("fields", fields)
        .withColumn("reason", reason)
        .select("file_name", "line_no", "line", F.when(F.col("reason").isNull(), first).alias("fid"), F.when(F.col("reason").isNull(), second).alias("iid"), F.array().cast("array<double>").alias("values"), "reason")
    )


def classify_lines(lines: DataFrame) -> DataFrame:
    """All judged records of both kinds, repeats kept; records of other kinds are left out."""
    return classify_csv(lines).unionByName(classify_fam(lines))


def _once(judged: DataFrame, columns: list[str]) -> DataFrame:
    """Each different record once, told apart by place and a hash of its text."""
    key = [F.col("file_name"), F.col("line_no"), F.xxhash64("line").alias("_text")]
    rest = [c for c in columns if c not in ("file_name", "line_no")]
    return judged.groupBy(*key).agg(*(F.first(c).alias(c) for c in rest)).select(*columns)


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loaded, rejected): the valid records with their values, the others with reason and raw text. Exact repeats count once."""
    judged = classify_lines(lines)
    loaded = _once(judged.filter("reason is null"), ["file_name", "line_no", "fid", "iid", "values"])
    return loaded, _once(judged.filter("reason is not null"), ["file_name", "line_no", "reason", "line"])
