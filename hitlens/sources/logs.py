"""Access-log reader: every line is recognised by its own shape, in one narrow pass."""

import csv
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hitlens.functions.fields import DEFAULT_FORMATS, parse_datetime
from hitlens.schema import CANONICAL, EXTENSIONS, LAYOUTS, RENAMES

# Common and combined log lines; the request may be "-" or lack a protocol.
CLF = (r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "(?:(\S+) (\S+) ?([^"]*)|-)" (\d{3}|-) (\d+|-)'
       r'(?: "([^"]*)" "([^"]*)")?.*$')
TOKENS = r'"([^"]*)"|(\S+)'
_MARK = "\u0001"
_CLF_FIELDS = _MARK.join(f"${i + 1}" for i in range(len(LAYOUTS["clf"])))


# One pair of enclosing quotes is dropped from every field; few lines have any.
_UNQUOTED = r"""transform({parts}, p -> if(p rlike '^".*"$' and length(p) > 1,
                                           substring(p, 2, length(p) - 2), p))"""


def _tab_layout() -> Column:
    width = F.size("_parts")
    day_and_time = (F.get("_parts", F.lit(0)).rlike(r"^\d{4}-\d{2}-\d{2}$")
                    & F.get("_parts", F.lit(1)).rlike(r"^\d{1,2}:\d{2}(:\d{2}([.]\d+)?)?$"))
    return (F.when((width <= len(LAYOUTS["tsv11"])) & day_and_time, "tsv11")
            .when(width <= len(LAYOUTS["tsv9"]), "tsv9"))


def _field(name: str, layouts: Sequence[str]) -> Column:
    """Text of a canonical field: its position depends on the layout of the line; fields
    missing from a short line are null."""
    places = {}
    for layout in layouts:
        names = [RENAMES.get(raw, raw) for raw in LAYOUTS[layout]]
        if name in names:
            places[layout] = names.index(name)
    if not places:
        return F.expr("cast(null as string)")
    cases = " ".join(f"when '{layout}' then {i}" for layout, i in places.items())
    return F.expr(f"nullif(get(_parts, case _kind {cases} end), '')")


def parse_lines(lines: DataFrame, layout: str = "auto",
                formats: Sequence[str] = DEFAULT_FORMATS) -> DataFrame:
    """Lines (column ``value``, optionally ``source_file``) -> canonical columns plus
    ``layout``, ``source_file`` and ``raw_line``.

    A line of unknown shape has a null ``layout``; one whose time cannot be read has a
    null ``datetime``. Both belong to the quarantine. All work is one narrow pass: a line is
    split once (a common-log line by a single regex), and the fields leave through a
    one-element ``inline``, above which later filters stay, so that they do not repeat the
    parsing.
    """
    if layout != "auto" and layout not in LAYOUTS:
        raise ValueError(f"layout must be 'auto' or one of {sorted(LAYOUTS)}, not {layout!r}")
    line = F.col("value")
    source = F.col("source_file") if "source_file" in lines.columns else F.lit(None).cast("string")
    tabs = F.split(line, "\t")
    clf = F.split(F.regexp_replace(line, CLF, _CLF_FIELDS), _MARK)
    words = F.regexp_extract_all(line, F.lit(TOKENS), F.lit(0))
    width, is_clf = F.size("_parts"), F.size("_clf") == len(LAYOUTS["clf"])
    rows = lines.select(line, source.alias("source_file"))
    if layout == "auto":
        kinds = tuple(LAYOUTS)
        rows = (rows.withColumn("_clf", F.when(~line.contains("\t"), clf))
                .withColumn("_parts", F.when(F.col("_clf").isNull(), tabs)
                            .when(is_clf, F.col("_clf")).otherwise(words))
                .withColumn("_kind", F.when(F.col("_clf").isNull(), _tab_layout())
                            .when(is_clf, "clf")
                            .when((width >= 4) & (width <= len(LAYOUTS["space11"])), "space11")))
    else:
        kinds = (layout,)
        parts = {"clf": clf, "space11": words}.get(layout, tabs)
        limit = len(LAYOUTS[layout])
        # too long a line is set aside, never shifted
        fits = width == limit if layout == "clf" else width <= limit
        rows = rows.withColumn("_parts", parts).withColumn("_kind", F.when(fits, F.lit(layout)))
    quoted = F.col("value").contains('"') & (F.col("_kind") != "clf")
    rows = rows.withColumn("_parts", F.when(quoted, F.expr(_UNQUOTED.format(parts="_parts")))
                           .otherwise(F.col("_parts")))
    when = F.coalesce(F.concat(_field("date", kinds), F.lit(" "), _field("time", kinds)),
                      _field("timestamp", kinds))
    rows = rows.withColumn("_when", when)
    fields = [_field(name, kinds).alias(name) for name in CANONICAL.fieldNames()[1:]]
    row = F.struct(parse_datetime(F.col("_when"), formats).alias("datetime"), *fields)
    guess = F.col("_kind").isin("tsv9", "space11")  # shapes that many other lines share
    return (rows.select("value", "source_file", "_kind", F.inline(F.array(row)))
            .select(*CANONICAL.fieldNames(),
                    F.when(~guess | F.col("datetime").isNotNull(), F.col("_kind")).alias("layout"),
                    "source_file", F.col("value").alias("raw_line")))


def _has_extension(extensions: Sequence[str]) -> Column:
    suffix = F.lower(F.regexp_extract(F.col("_metadata.file_name"), r"[.]([^.]*)$", 1))
    return suffix.isin(*[e.lower().lstrip(".") for e in extensions])


def _any_case_glob(extension: str) -> str:
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in extension)


def _csv_headers(spark: SparkSession, path) -> dict[str, list[str]]:
    """Header line -> the comma files that begin with it (the driver lists files anyway)."""
    lines = (spark.read.option("pathGlobFilter", _any_case_glob("csv")).text(path)
             .where((F.trim("value") != "") & (F.col("_metadata.file_block_start") == 0))
             .select(F.col("_metadata.file_path").alias("file"), "value",
                     F.monotonically_increasing_id().alias("at")))
    found: dict[str, list[str]] = {}
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    for row in first.orderBy("header", "file").collect():
        # metadata holds URLs, readers take globs
        plain = re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(row["file"]))
        found.setdefault(row["header"], []).append(plain)
    return found


def _read_csv_files(spark: SparkSession, header: str, files: list[str], formats) -> DataFrame:
    """Comma files of one header. Every field is text; a short row is padded with nulls, a long
    one keeps only its raw line. Under a header that names fewer than two known fields no row
    can be used."""
    names = [n.strip() for n in next(csv.reader([header.lstrip("\ufeff")]))]
    missing = F.lit(None).cast("string")
    known = {*CANONICAL.fieldNames(), "date", "time", "timestamp"}
    fields = {RENAMES.get(n, n).lower(): i for i, n in reversed(list(enumerate(names)))}
    if len(known & fields.keys()) < 2:
        lines = spark.read.text(files).where(F.trim("value") != "")
        return lines.select(
            F.lit(None).cast("timestamp_ntz").alias("datetime"),
            *[missing.alias(n) for n in CANONICAL.fieldNames()[1:]], missing.alias("layout"),
            F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("raw_line"))
    unread, columns = "_unread", [f"_c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, unread]])
    rows = (spark.read.option("header", True).schema(schema)
            .option("columnNameOfCorruptRecord", unread)
            # a row's length is judged by all its fields, whichever a query reads
            .option("columnPruning", False)
            .option("nullValue", "\u0000").csv(files))
    # Only the raw line of an irregular row is kept; its last named field tells long from short.
    too_long = F.col(unread).isNotNull() & F.col(columns[-1]).isNotNull()
    rows = rows.withColumn("layout", F.when(~too_long, F.lit("csv")))
    named = {name: F.nullif(F.col(columns[i]), F.lit("")) for name, i in fields.items()}
    if {"date", "time"} <= named.keys():
        when = F.concat(named["date"], F.lit(" "), named["time"])
    else:
        when = named.get("timestamp", named.get("datetime", F.col(columns[0])))
    kept = F.col("layout").isNotNull()
    labels = [F.col(c).alias(n if names.count(n) == 1 else f"{n}_{i}")
              for i, (c, n) in enumerate(zip(columns, names))]
    return rows.select(
        F.when(kept, parse_datetime(when, formats)).alias("datetime"),
        *[F.when(kept, named.get(name, missing)).alias(name)
          for name in CANONICAL.fieldNames()[1:]],
        "layout", F.col("_metadata.file_path").alias("source_file"),
        F.coalesce(F.col(unread), F.to_json(F.struct(*labels))).alias("raw_line"))


def _read_csv(spark: SparkSession, path, formats) -> DataFrame | None:
    """Comma files with headers of canonical (or raw) names, each group of files with its own;
    None when there are none."""
    out = None
    for header, files in _csv_headers(spark, path).items():
        rows = _read_csv_files(spark, header, files, formats)
        out = rows if out is None else out.unionByName(rows)
    return out


def read_logs(spark: SparkSession, path, layout: str = "auto", *,
              quarantine: bool = False, extensions: Sequence[str] | None = EXTENSIONS,
              formats: Sequence[str] = DEFAULT_FORMATS):
    """Read access logs of mixed layouts into the canonical table.

    ``layout='auto'`` decides per line (and reads ``.csv`` files by header);
    ``'csv'`` or a name from ``LAYOUTS`` forces one. With ``quarantine`` the result is
    ``(good, bad)``: ``bad`` holds file, layout and raw line of everything set aside.
    """
    parsed = None
    wanted = None if extensions is None else {e.lower().lstrip(".") for e in extensions}
    if layout != "csv":
        lines = spark.read.text(path)
        keep_csv = layout != "auto"
        text_types = wanted if wanted is None or keep_csv else wanted - {"csv"}
        if text_types is not None:
            lines = lines.where(_has_extension(sorted(text_types)))
        elif not keep_csv:
            lines = lines.where(~_has_extension(["csv"]))
        lines = lines.select("value", F.col("_metadata.file_path").alias("source_file"))
        # blank lines are separators, not records
        parsed = parse_lines(lines.where(F.trim("value") != ""), layout, formats)
    if layout in ("auto", "csv") and (wanted is None or "csv" in wanted):
        rows = _read_csv(spark, path, formats)
        if rows is not None:
            parsed = rows if parsed is None else parsed.unionByName(rows)
    if parsed is None:
        raise ValueError(f"no readable log files under {path}")
    known = F.col("layout").isNotNull() & F.col("datetime").isNotNull()
    good = parsed.where(known).drop("layout", "raw_line")
    if not quarantine:
        return good
    return good, parsed.where(~known).select("source_file", "layout", "raw_line")


def _datetime_of(df: DataFrame, formats: Sequence[str]) -> Column:
    """Time from date + time, else timestamp, else the first column."""
    if {"date", "time"} <= set(df.columns):
        when = F.concat(F.col("date"), F.lit(" "), F.col("time"))
    elif "timestamp" in df.columns:
        when = F.col("timestamp")
    else:
        when = F.col(f"`{df.columns[0]}`")
    return parse_datetime(when.cast("string"), formats)


def with_datetime(df: DataFrame, formats: Sequence[str] = DEFAULT_FORMATS) -> DataFrame:
    """Add ``datetime``, null where the time cannot be read."""
    return df.withColumn("datetime", _datetime_of(df, formats))


def standardize(df: DataFrame, formats: Sequence[str] = DEFAULT_FORMATS) -> DataFrame:
    """Canonical names and a ``datetime``; rows without a readable time are dropped."""
    present = {RENAMES.get(c, c) for c in df.columns}
    for name in ("ip", "status"):
        if name not in present:
            raise ValueError(f"column {name!r} is required")
    if "datetime" in df.columns:
        df = df.where(F.col("datetime").isNotNull())
    else:
        # parse and drop in one step: a filter on the parsed time would be pushed below the
        # projection and parse it again
        readable = F.array_compact(F.array(_datetime_of(df, formats)))
        df = df.select("*", F.explode(readable).alias("datetime"))
    return df.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in df.columns})
