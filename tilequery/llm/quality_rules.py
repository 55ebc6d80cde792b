"""Operator 8: quality rules as one native projection.

A table of thresholds is compiled into a single Spark projection. No Python runs on
the executors and nothing is shuffled: every row is judged where it is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# White space that separates words (space and the controls 9 to 13),
# and the characters counted as symbols.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the be to of and that have with "
    "der die das und ist nicht von mit "
    "le la les et est des que pour "
    "el los las es de y en por"
).split()
#: As written inside and at the start of a sentence.
STOP_FORMS = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: reject where `metric` is outside [low, high]."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def rejects(self) -> str:
        tests = []
        if self.low is not None:
            tests.append(f"({self.metric}) < {self.low}")
        if self.high is not None:
            tests.append(f"({self.metric}) > {self.high}")
        return "(" + " OR ".join(tests) + ")"


#: Ratios are kept as integer comparisons scaled by 1000, so that SQL engines agree to the last bit.
RULES = (
    Rule("words", "n_words", 10, 1_000_000),
    Rule("word_length", "1000 * word_chars - 2000 * n_words", 0, None),
    Rule("word_length_max", "1000 * word_chars - 15000 * n_words", None, 0),
    Rule("symbols", "10 * n_symbols - n_words", None, 0),
    Rule("stop_words", "n_words - 200 * n_stop_words", None, 0),
    Rule("duplicate_lines", "10 * n_dup_lines - 3 * n_lines", None, 0),
    Rule("repeats", "10 * n_repeat_words - 2 * n_words", None, 0),
    Rule("capitals", "10 * n_upper_words - 4 * n_words", None, 0),
)


def _let(value: str, name: str, body: str) -> str:
    """Bind an expression once, so that a lambda below doesn't evaluate it again for each element."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Low bits of a window's hash that hold its position instead.
POSITION_BITS = 20


def _repeat_words(words: str) -> str:
    """Words covered by five-word windows that occur twice or more.

    Window hashes, with positions in their low bits, are sorted as plain numbers; neighbours
    with equal high bits are compared word by word. If all of these are equal, they are the
    repeated windows, and over their sorted positions a window adds min(5, next - own) words.
    If some aren't (a collision), or positions don't fit, windows are sorted by hash and
    words. Elements are read one by one: slice() would copy the whole array for each window.
    """
    five = ", ".join(f"{words}[i + {k}]" for k in range(5))
    covered = "aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least(5, coalesce(b - a, 5))), 0, (a, x) -> a + x)"
    positions = f"sequence(0, size({words}) - 5)"
    windows = f"sort_array(transform({positions}, i -> struct(xxhash64({five}) AS h, concat_ws(' ', {five}) AS w, i AS i)))"
    marked = (
        "sort_array(array_distinct(flatten(filter(zip_with(s, slice(s, 2, size(s)), "
        "(a, b) -> IF(a.h = b.h AND a.w = b.w, array(a.i, b.i), NULL)), x -> x IS NOT NULL))))"
    )
    exact = _let(windows, "s", _let(marked, "p", covered))
    low = (1 << POSITION_BITS) - 1
    hashes = f"sort_array(transform({positions}, i -> (xxhash64({five}) & {~low}L) | CAST(i AS BIGINT)))"
    place = lambda x: f"CAST({x} & {low}L AS INT)"
    alike = (
        f"filter(zip_with(h, slice(h, 2, size(h)), (a, b) -> IF(shiftright(a, {POSITION_BITS}) = shiftright(b, {POSITION_BITS}), "
        f"struct({place('a')} AS i, {place('b')} AS j), NULL)), x -> x IS NOT NULL)"
    )
    equal = " AND ".join(f"{words}[x.i + {k}] = {words}[x.j + {k}]" for k in range(5))
    fast = _let("sort_array(array_distinct(flatten(transform(z, x -> array(x.i, x.j)))))", "p", covered)
    found = _let(hashes, "h", _let(alike, "z", f"CASE WHEN size(z) = 0 THEN 0 WHEN forall(z, x -> {equal}) THEN {fast} ELSE {exact} END"))
    return f"CASE WHEN size({words}) < 6 THEN 0 WHEN size({words}) > {low} THEN {exact} ELSE {found} END"


def _words(text: str) -> str:
    bare = f"trim(BOTH ' \t\n\x0b\x0c\r' FROM {text})"
    return f"CASE WHEN {bare} = '' THEN array() ELSE split({bare}, '[\\\\x20\\\\x09-\\\\x0D]+') END"


def measures(text: str) -> Column:
    """One struct of all counts of a text; every part of it is a built-in expression."""
    stops = ", ".join(f"'{w}'" for w in STOP_FORMS)
    lines = f"filter(split({text}, '\n'), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
    counts = {
        "n_words": "size(w)",
        "word_chars": "length(array_join(w, ''))",
        "n_symbols": f"regexp_count({text}, '[{SYMBOLS}]')",
        "n_lines": "size(l)",
        "n_dup_lines": "size(l) - size(array_distinct(l))",
        "n_stop_words": f"size(filter(w, x -> x IN ({stops})))",
        "n_upper_words": "size(filter(w, x -> length(x) > 1 AND x = upper(x) AND x <> lower(x)))",
        "n_repeat_words": _repeat_words("w"),
    }
    body = "struct(" + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in counts.items()) + ")"
    return F.expr(_let(_words(text), "w", _let(lines, "l", body)))


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Judge every whole text by the base rule and the threshold table.

    Returns the columns `keep`, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_stop_words, n_upper_words, base_failed, failed_rules
    (names of the rules that reject) and kept.

    A null text has no words: its counts are 0 and base_failed is true. Repeated rows
    are judged each for itself; an empty table gives an empty table; other columns of
    the input are ignored, whatever their names.
    """
    m = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text_"))
    m = m.select(*keep, measures("text_").alias("m")).select(*keep, "m.*")
    m = m.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    names = F.array(*[F.when(F.expr(r.rejects()), F.lit(r.name)) for r in rules]) if rules else F.array().cast("array<string>")
    m = m.withColumn("failed_rules", F.filter(names, lambda x: x.isNotNull()))
    return m.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_upper_words", "base_failed", "failed_rules",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.withColumn("failed_rules", F.array_join("failed_rules", ","))


def _oracle() -> str:
    rejects = ", ".join(f"CASE WHEN {r.rejects()} THEN '{r.name}' END" for r in RULES)
    stops = ", ".join(f"'{w}'" for w in STOP_FORMS)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d
), win AS (
  SELECT k, i, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM w)
), rep AS (
  SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt
  FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n > 1
), r AS (
  SELECT k, sum(CASE WHEN nxt IS NULL THEN 5 ELSE least(5, nxt - i) END)::BIGINT AS n FROM rep GROUP BY k
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines,
    len(list_filter(w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words,
    len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x)))::BIGINT AS n_upper_words
  FROM w LEFT JOIN r USING (k)
), b AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
         array_to_string(list_filter([{rejects}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM m
)
SELECT *, (NOT base_failed AND failed_rules = '') AS kept FROM b
"""


ORACLE = _oracle()
