"""Document fingerprints from closed syncmers.

A text is cut into units (words; scripts without spaces by character, long runs every 16
characters), and each window of ``k`` units is kept when its least inner run of ``s`` units, by
hash, stands at either edge. Whether a window is kept depends on its own units alone, so an
edit touches only the windows that hold it. ``k - 1`` empty units stand before the text, so that
any text of one word has an anchor.

The main path is built-in expressions only. A null or empty text, or one of spaces, has no
anchors and the fingerprint ''. Two fingerprints without anchors have likeness 1.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window, functions as F

K, S = 5, 1
_CHARACTER = r"぀-ヿ㐀-䶿一-鿿가-힯"
UNIT = rf"[{_CHARACTER}]|[^\s{_CHARACTER}]{{1,16}}"
_LAST = 2**63 - 1
# Ranges of ids that the rows are dealt to; also the rows the driver sees.
MAX_RANGES = 2000


def _with_anchors(df: DataFrame, text: str, out: str, k: int, s: int,
                  positions: bool = False) -> DataFrame:
    """Add the anchors of a text column: distinct hashes in order of first appearance."""
    units, inner, hashes = f"_{out}_units", f"_{out}_inner", f"_{out}_hashes"
    df = df.withColumn(units, F.regexp_extract_all(F.col(text), F.lit(UNIT), F.lit(0)))
    df = df.withColumn(hashes, F.concat(F.array_repeat(F.lit(_LAST), k - 1), F.transform(
        units, lambda unit: F.xxhash64(unit).bitwiseAND(F.lit(_LAST - 1)))))
    if s == 1:
        df = df.withColumn(inner, F.col(hashes))
    else:
        df = df.withColumn(inner, F.transform(
            F.sequence(F.lit(0), F.size(hashes) - s),
            lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(s)])))
    width = k - s

    def closed(i: Column) -> Column:
        run = [F.get(inner, i + j) for j in range(width + 1)]
        return F.least(*run) == F.least(run[0], run[-1])

    windows = F.filter(F.sequence(F.lit(0), F.size(hashes) - k), closed)
    df = df.withColumn(f"_{out}_at", F.when(F.size(hashes) >= k, windows)
                       .otherwise(F.array().cast("array<int>")))
    found = F.transform(f"_{out}_at", lambda i: F.hash(
        *[F.get(hashes, i + j) for j in range(k)]))
    if positions:
        found = F.transform(f"_{out}_at", lambda i: F.struct(
            (i - (k - 1)).alias("position"),
            F.hash(*[F.get(hashes, i + j) for j in range(k)]).alias("anchor")))
        return df.withColumn(out, found).drop(units, inner, hashes, f"_{out}_at")
    return df.withColumn(out, F.array_distinct(found)).drop(units, inner, hashes, f"_{out}_at")


def anchors(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K,
            s: int = S) -> DataFrame:
    """One row per anchor: id, position (unit of its first word; negative at the start), anchor."""
    rows = df.select(df[id_col].alias("_id"), F.coalesce(df[text_col], F.lit("")).alias("_text"))
    rows = _with_anchors(rows, "_text", "_found", k, s, positions=True)
    return rows.select(F.col("_id").alias(id_col), F.inline("_found"))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of anchors."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(1.0))


def as_text(found: str) -> Column:
    """Anchors as fixed-width hexadecimal numbers, in order."""
    return F.array_join(F.transform(found, lambda a: F.lpad(
        F.lower(F.hex(a.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def _dealt(rows: DataFrame, ranges: int) -> DataFrame:
    """Rows with their range of ids, and a second time in the range before if they lead theirs.

    Ranges come from quantiles of the ids; null ids follow all others. The driver sees one
    row per range.
    """
    cuts = rows.select(F.percentile_approx(
        "_id", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10 * ranges)).first()[0]
    cuts = sorted(set(cuts or []))
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    own = F.when(F.col("_id").isNull(), F.lit(-1)).otherwise(
        F.size(F.filter(bounds, lambda b: b < F.col("_id"))))
    edges = rows.groupBy(own.alias("range")).agg(F.max("_id").alias("lead")).orderBy(
        F.desc("range")).collect()
    ahead = {edge["lead"]: edges[i - 1]["range"] for i, edge in enumerate(edges)}
    leads = [x for key, value in ahead.items() if key is not None
             for x in (F.lit(key).cast("long"), F.lit(value))]
    lent = F.lit(None).cast("int")
    if leads:
        lent = F.element_at(F.create_map(*leads), F.col("_id"))
    if None in ahead:
        lent = F.when(F.col("_id").isNull(), F.lit(ahead[None])).otherwise(lent)
    places = F.array(F.struct(own.alias("range"), F.lit(False).alias("lent")),
                     F.struct(lent.alias("range"), F.lit(True).alias("lent")))
    return rows.select("*", F.inline(F.filter(places, lambda p: p["range"].isNotNull())))


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                 s: int = S, ranges: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited form, whose last third is its successor's start.

    The successor is the row next by descending id (repeated ids by hash of the text, null
    ids last; after the last row the first). Ids are whole numbers. Texts are shuffled once, to
    ranges of ids; only the first row of a range is copied to another.
    """
    spark = df.sparkSession
    if ranges is None:
        ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(2, min(ranges, MAX_RANGES))
    rows = df.select(df[id_col].cast("long").alias("_id"),
                     F.coalesce(df[text_col].cast("string"), F.lit("")).alias("_text"))
    rows = _dealt(_with_anchors(rows, "_text", "_anchors", k, s), ranges)
    order = Window.partitionBy("range").orderBy(
        "lent", F.desc_nulls_last("_id"), F.xxhash64("_text"))
    rows = rows.select("*", F.lead("_text").over(order).alias("_next"),
                       F.lead("_anchors").over(order).alias("_next_anchors"))
    rows = rows.where(~F.col("lent")).drop("lent", "range").withColumn(
        "_n", F.length("_text").cast("long"))
    third = F.floor(F.col("_n") / 3).cast("int")
    rows = rows.withColumn("_edited", F.concat(
        F.left("_text", F.col("_n").cast("int") - third), F.left("_next", third)))
    rows = _with_anchors(rows.drop("_text", "_next"), "_edited", "_edited_anchors", k, s)
    return rows.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_chars"),
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        as_text("_anchors").alias("fingerprint"),
        as_text("_edited_anchors").alias("edited_fingerprint"),
        likeness("_anchors", "_edited_anchors").alias("near_edited"),
        likeness("_anchors", "_next_anchors").alias("near_next"))


