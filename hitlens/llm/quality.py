"""Quality rules kept as a ledger of failure bits and measurements.

Every document is measured once and every rule evaluated once: the ledger holds one narrow row per
document, its measurements and a long whose bit n tells that rule n fails. Policies are named,
numbered sets of rules, hence bit masks: a verdict is ``failures & mask = 0``, and a new policy, or
what a policy would keep without one of its rules, is told from the ledger without a text. Ablations
add up documents by distinct bit patterns first, so that a source of any size is a few rows.
``reassess`` evaluates rules with other limits on the measurements that are stored.

Words are runs of other signs than space and U+0009 to U+000D; lines end at line feeds, and only lines
with a word count. Three-word windows are compared as 64-bit hashes. Only built-in expressions run on
the documents; a text is one row, whatever its length, with work of n log n in its words. Null and empty
texts have no words and fail by their number. Repeated rows and ids have rows of their own, null ids
stay; an empty table gives an empty result. Other columns are ignored unless kept by name, which then
may not be that of a measurement.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Separators of words, signs that count as symbols.
_SPACES, _SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
_WORD, _SHOUT = r"[^\x20\x09-\x0D]", r"\p{Lu}{2,}"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_shouts", "n_marks")


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition on measurements that both Spark and other engines read."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A numbered version of a set of rules, by name."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def column(self) -> str:
        return f"{self.name}_v{self.version}"

    def mask(self, rules: Sequence[Rule]) -> int:
        at = {rule.name: n for n, rule in enumerate(rules)}
        return sum(1 << at[name] for name in set(self.rules))


# The place of a rule is its bit: new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 12 * n_words"),
    Rule("shouting", "10 * n_shouts > 3 * n_words"),
    Rule("exclaiming", "10 * n_marks > 3 * n_words"),
)
BASE = Policy("base", 1, ("few_words", "repeated_words"))
WEB = Policy("web", 1, tuple(rule.name for rule in RULES))
POLICIES = (BASE, WEB)


def _count(values: Column) -> Column:
    return F.size(values).cast("long")


def measure(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            keep: Sequence[str] = ()) -> DataFrame:
    """Documents -> (id_col, kept columns, measurements).

    ``n_dup_lines`` are lines equal to an earlier one, ``n_repeat_words`` words in a three-word window
    that the text holds twice or more, ``n_shouts`` runs of capitals, ``n_marks`` exclamation marks.
    """
    taken = {id_col, *keep} & set(MEASURES)
    if taken:
        raise ValueError(f"names of measurements: {sorted(taken)}")
    rows = df.select(df[id_col], *[df[c] for c in keep],
                     F.coalesce(df[text_col].cast("string"), F.lit("")).alias("_text"))
    # each step is a projection of its own: the arrays are computed once
    rows = rows.withColumns({
        "_words": F.filter(F.split("_text", _SPACES), lambda w: w != ""),
        "_lines": F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(_WORD))})
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    inner = F.greatest(F.size("_hashes") - 2, F.lit(0))
    rows = rows.withColumn("_windows", F.zip_with(
        F.zip_with(F.slice("_hashes", 1, inner), F.slice("_hashes", 2, inner),
                   lambda a, b: F.xxhash64(a, b)),
        F.slice("_hashes", 3, inner), lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = F.size("_sorted") - 1
    twice = F.filter(
        F.zip_with(F.slice("_sorted", 1, pairs), F.slice("_sorted", 2, pairs),
                   lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
        lambda both: both.isNotNull())
    inside = F.transform(F.array_distinct(F.flatten(twice)), lambda i: F.array(i, i + 1, i + 2))
    return rows.select(
        id_col, *keep, _count(F.col("_words")).alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        (_count(F.col("_lines")) - _count(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.when(F.col("_sorted").isNull(), F.lit(0).cast("long")).otherwise(
            _count(F.array_distinct(F.flatten(inside)))).alias("n_repeat_words"),
        _count(F.col("_lines")).alias("n_lines"),
        F.regexp_count("_text", F.lit(_SHOUT)).cast("long").alias("n_shouts"),
        F.regexp_count("_text", F.lit("!")).cast("long").alias("n_marks"))


def reassess(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add, or replace, ``failures`` by the rules' conditions on stored measurements."""
    if len(rules) > 63:
        raise ValueError("a long has room for 63 rules")
    bits = F.lit(0).cast("long")
    for n, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << n).cast("long")).otherwise(
            F.lit(0).cast("long")))
    return measured.withColumn("failures", bits)


def ledger(df: DataFrame, rules: Sequence[Rule] = RULES, **columns) -> DataFrame:
    """Documents -> (id, kept columns, measurements, ``failures``)."""
    return reassess(measure(df, **columns), rules)


def write_ledger(rows: DataFrame, path: str) -> DataFrame:
    """The ledger as a table; whatever asks it later reads its columns alone."""
    rows.write.parquet(path)
    return read_ledger(rows.sparkSession, path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def verdicts(rows: DataFrame, policies: Sequence[Policy] = POLICIES,
             rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add a boolean column ``<name>_v<version>`` per policy: whether it keeps the document."""
    return rows.withColumns({
        p.column: F.col("failures").bitwiseAND(F.lit(p.mask(rules)).cast("long")) == 0 for p in policies})


def kept(df: DataFrame, policy: Policy = WEB, rules: Sequence[Rule] = RULES, *,
         text_col: str = "text") -> DataFrame:
    """The documents a policy keeps, with all their columns."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                     F.col(f"`{text_col}`").alias("_own"))
    judged = verdicts(ledger(rows, rules, id_col="_row", text_col="_own"), [policy], rules)
    return judged.where(F.col(policy.column)).select("_row.*")


def _patterns(rows: DataFrame, keys: Sequence[str], mask: int) -> DataFrame:
    """Documents by key and failing bits under a mask: at most as many rows as patterns occur."""
    return rows.groupBy(*keys, F.col("failures").bitwiseAND(F.lit(mask).cast("long")).alias("_bits")).agg(
        F.count("*").alias("_n"))


def ablations(rows: DataFrame, policy: Policy = WEB, rules: Sequence[Rule] = RULES,
              keys: Sequence[str] = ()) -> DataFrame:
    """One row per key and rule of the policy: documents, kept by the policy, ``failing`` the rule,
    ``only`` failing this one (kept by the policy without it), ``kept_alone`` by the rule alone."""
    wanted = [n for n, rule in enumerate(rules) if rule.name in policy.rules]
    listed = F.array(*[F.struct(F.lit(rules[n].name).alias("rule"), F.lit(1 << n).cast("long").alias("_bit"))
                       for n in wanted])
    each = _patterns(rows, keys, policy.mask(rules)).select("*", F.inline(listed))

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("_n")).otherwise(0)).alias(name)

    fails = F.col("_bits").bitwiseAND(F.col("_bit")) != 0
    return each.groupBy(*keys, "rule").agg(
        F.sum("_n").alias("documents"), total(F.col("_bits") == 0, "kept"), total(fails, "failing"),
        total(F.col("_bits") == F.col("_bit"), "only"), total(~fails, "kept_alone"))


def rules_met(rows: DataFrame, rules: Sequence[Rule] = RULES, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: names of rules that some document fails, and of those that every one fails."""
    def named(bits: str) -> Column:
        return F.filter(F.array(*[F.when(
            F.col(bits).bitwiseAND(F.lit(1 << n).cast("long")) != 0, F.lit(rule.name))
            for n, rule in enumerate(rules)]), lambda name: name.isNotNull())

    found = rows.groupBy(*keys).agg(F.bit_or("failures").alias("_any"), F.bit_and("failures").alias("_all"),
                                    F.count("*").alias("documents"))
    return found.select(*keys, "documents", named("_any").alias("failed_by_some"),
                        named("_all").alias("failed_by_all"))


def judged(df: DataFrame, policy: Policy = WEB, **columns) -> DataFrame:
    """Documents with measurements, ``failures``, ``base_failed`` and ``kept``.

    ``kept`` is the policy's verdict on documents that pass the base rules.
    """
    rows = verdicts(ledger(df, **columns), [BASE, policy])
    return rows.withColumns({"base_failed": ~F.col(BASE.column),
                             "kept": F.col(BASE.column) & F.col(policy.column)}).drop(
        BASE.column, policy.column)


def oracle(table: str = "documents", policy: Policy = WEB, rules: Sequence[Rule] = RULES) -> str:
    """DuckDB SQL for ``judged``; repeated windows by their words."""
    bits = " + ".join(f"case when {rule.fails} then {1 << n} else 0 end" for n, rule in enumerate(rules))
    return rf"""
with d as (select doc_id, row_number() over () r, coalesce(text, '') t from {table}),
w as (select r, unnest(ws) w, generate_subscripts(ws, 1) p from (
  select r, regexp_extract_all(t, '{_WORD}+') ws from d)),
s as (select r, p, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o s
  from w window o as (partition by r order by p)),
v as (select r, p from (select r, p, count(*) over (partition by r, s) n from s where s is not null)
  where n > 1),
rep as (select r, count(distinct p + j)::bigint n from v, (values (0), (1), (2)) j(j) group by r),
num as (select r, count(*)::bigint n, sum(length(w))::bigint c from w group by r),
lines as (select r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) l from d),
m as (select doc_id, coalesce(num.n, 0) n_words, coalesce(num.c, 0) word_chars,
  len(regexp_extract_all(t, '{_SYMBOLS}'))::bigint n_symbols,
  (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(rep.n, 0) n_repeat_words,
  len(l)::bigint n_lines, len(regexp_extract_all(t, '{_SHOUT}'))::bigint n_shouts,
  len(regexp_extract_all(t, '!'))::bigint n_marks
  from d join lines using (r) left join num using (r) left join rep using (r)),
f as (select *, ({bits})::bigint failures from m)
select *, failures & {BASE.mask(rules)} <> 0 base_failed,
  failures & {BASE.mask(rules) | policy.mask(rules)} = 0 kept from f"""
