"""Line-first cleaning: rules judge single lines, failing lines go, and a text that loses too much of itself goes too.

Only column functions are used. Repeated words are found on hashes of five-word windows: the windows of a text are
sorted with their positions, and those with an equal neighbour mark the words they cover.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.plans.barrier import computed_once

# White space that separates words, and the characters counted as symbols.
SPACE = " \t\n\x0b\f\r"
_SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Phrases of site furniture, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "we use cookies", "accept cookies", "privacy policy", "terms of service",
    "terms of use", "terms and conditions", "enable javascript", "javascript is disabled", "lorem ipsum",
    "subscribe to our newsletter", "sign up for our newsletter", "powered by wordpress", "share on facebook",
    "share on twitter", "share this article", "click here to", "copyright ©", "licensed under the",
    "released under the",
)
NAVIGATION = (
    "home", "about", "about us", "contact", "contact us", "menu", "login", "log in", "sign in", "sign up", "register",
    "search", "next", "previous", "back", "back to top", "skip to content", "read more", "more", "share", "sitemap",
    "site map", "help", "faq", "news", "blog", "archive", "archives", "categories", "tags", "comments", "reply", "print",
)


@dataclass(frozen=True)
class LineRules:
    """``max_lost_percent``: share of its word characters that a text may lose with its failing lines.

    A line fails as boilerplate (holds a phrase and has at most ``boilerplate_words`` words), as navigation (a known
    entry, or ``menu_parts`` or more entries between bars), by symbols (more than ``symbol_percent`` of its characters)
    or by punctuation (fewer than ``open_words`` words and no closing sign at the end).
    """

    max_lost_percent: int = 50
    boilerplate_words: int = 25
    menu_parts: int = 4
    menu_part_words: int = 3
    symbol_percent: int = 20
    open_words: int = 3
    closing_signs: str = ".!?…:;\"'”’»)。！？"


def _length_of(text: Column, characters: str) -> Column:
    """How many of the ASCII characters the text holds: each is one byte, and one that is not there costs one search."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c))
    return F.octet_length(text) - F.octet_length(rest)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE_RUN), lambda w: w != "")


def _line_facts(line: Column) -> Column:
    """What the rules look at, worked out once per line: lambdas repeat whatever they refer to twice."""
    trimmed = F.btrim(line, F.lit(SPACE))
    return F.struct(line.alias("line"), trimmed.alias("trimmed"), F.lower(trimmed).alias("low"), _length_of(line, "|").alias("bars"))


def _with_words(facts: Column) -> Column:
    """Adds the number of words: the parts of the trimmed line."""
    n = F.when(facts["trimmed"] == "", 0).otherwise(F.size(F.split(facts["trimmed"], _SPACE_RUN)))
    return F.struct(facts["line"].alias("line"), facts["low"].alias("low"), facts["bars"].alias("bars"), n.alias("n"))


def _facts_fail(facts: Column, rules: LineRules) -> Column:
    n, low, line = facts["n"], facts["low"], facts["line"]
    phrases = "|".join(BOILERPLATE)  # holds no character with a meaning in patterns
    boilerplate = (n <= rules.boilerplate_words) & low.rlike(phrases)
    menu = (facts["bars"] + 1 >= rules.menu_parts) & F.forall(
        F.split(line, r"\|"), lambda p: F.size(_words(p)) <= rules.menu_part_words)
    symbols = _length_of(line, SYMBOLS) * 100 > F.char_length(line) * rules.symbol_percent
    ends = F.lit(rules.closing_signs).contains(F.right(low, F.lit(1)))
    return (n > 0) & (boilerplate | low.isin(*NAVIGATION) | menu | symbols | ((n < rules.open_words) & ~ends))


def judged_lines(text: Column, rules: LineRules = LineRules()) -> Column:
    """The lines of a text, each with ``line``, ``wordy`` (has a word) and ``fails``: whether any rule is against it. Lines
    without words never fail."""
    facts = F.transform(F.transform(F.split(text, "\n"), _line_facts), _with_words)
    return F.transform(facts, lambda x: F.struct(
        x["line"].alias("line"), (x["n"] > 0).alias("wordy"), _facts_fail(x, rules).alias("fails")))


def _repeat_windows(df: DataFrame) -> DataFrame:
    """``_quality_n_repeat_words`` from ``_quality_words``. Each array is generated once, since lambdas refer to it many times."""
    hashes = F.transform("_quality_words", lambda w: F.xxhash64(w))
    df = df.withColumn("_quality_hashes", computed_once(hashes)).drop("_quality_words")
    last = F.size("_quality_hashes") - WINDOW
    windows = F.when(last > 0, F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("_quality_hashes", i + k) for k in range(WINDOW)])))
    df = df.withColumn("_quality_windows", computed_once(windows)).drop("_quality_hashes")
    repeats = F.size(F.array_distinct("_quality_windows")) < F.size("_quality_windows")
    placed = F.when(repeats, F.sort_array(F.transform("_quality_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_quality_placed", computed_once(placed)).drop("_quality_windows")

    def same(one: Column, other: Column) -> Column:
        return F.coalesce(one["h"] == other["h"], F.lit(False))

    twins = F.filter("_quality_placed", lambda x, j: same(x, F.get("_quality_placed", j - 1)) | same(x, F.get("_quality_placed", j + 1)))
    starts = F.sort_array(F.transform(twins, lambda x: x["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(x - acc["at"], F.lit(WINDOW))).alias("n")),
        lambda acc: acc["n"])
    return df.withColumn("_quality_n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_quality_placed")


def judge(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text") -> DataFrame:
    """The documents with the column ``_quality``: counts, the verdict and the text without its failing lines.

    One row per input row and no shuffle. A null text has no words and fails. A column ``_quality`` of the input is
    replaced. Fields: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, n_failed_lines, lost_chars (word characters of failing lines), kept and
    clean (the remaining lines, joined).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [c for c in docs.columns if c != "_quality"]
    df = docs.select(
        *own, F.col(text_col).alias("_quality_text"), computed_once(_words(text)).alias("_quality_words"))
    df = df.withColumns({"_quality_n_words": F.size("_quality_words").cast("bigint"),
                         "_quality_word_chars": F.char_length(F.array_join("_quality_words", "")).cast("bigint")})
    df = _repeat_windows(df)
    text = F.coalesce(F.col("_quality_text"), F.lit(""))
    df = df.withColumn("_quality_lines", computed_once(judged_lines(text, rules)))
    wordy = F.transform(F.filter("_quality_lines", lambda x: x["wordy"]), lambda x: x["line"])
    failed = F.filter("_quality_lines", lambda x: x["fails"])
    lost = F.aggregate(failed, F.lit(0).cast("bigint"), lambda acc, x: acc + _word_chars(x["line"]))
    clean = F.array_join(F.transform(F.filter("_quality_lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
    base_failed = (F.col("_quality_n_words") < 10) | (F.col("_quality_n_repeat_words") * 100 > F.col("_quality_n_words") * 20)
    facts = [
        F.col("_quality_n_words").alias("n_words"), F.col("_quality_word_chars").alias("word_chars"),
        _length_of(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size(wordy) - F.size(F.array_distinct(wordy))).cast("bigint").alias("n_dup_lines"),
        F.col("_quality_n_repeat_words").alias("n_repeat_words"), base_failed.alias("base_failed"),
        F.size(failed).cast("bigint").alias("n_failed_lines"), lost.alias("lost_chars"), clean.alias("clean"),
    ]
    df = df.withColumn("_quality_facts", computed_once(F.struct(*facts)))
    fits = F.col("_quality_facts.lost_chars") * 100 <= F.col("_quality_facts.word_chars") * rules.max_lost_percent
    return df.select(*own, F.struct(
        "_quality_facts.*", (~F.col("_quality_facts.base_failed") & fits).alias("kept")).alias("_quality"))


def _word_chars(text: Column) -> Column:
    return (F.char_length(text) - _length_of(text, SPACE)).cast("bigint")


def clean_documents(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text") -> DataFrame:
    """The documents that are kept, without their failing lines; all other columns as they were."""
    kept = judge(docs, rules, text_col).where("_quality.kept")
    return kept.select(*[F.col("_quality.clean").alias(c) if c == text_col else F.col(c) for c in docs.columns])


def quality_digest(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select(F.col(id_col).alias("doc_id"), *[F.col(f"_quality.{f}").alias(f) for f in fields])


def quality_sql(rules: LineRules = LineRules()) -> str:
    """The digest as SQL for DuckDB."""
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    word = r"'[^\x20\x09-\x0D]+'"
    space = "concat(" + ", ".join(f"chr({ord(c)})" for c in SPACE) + ")"
    symbols = text(SYMBOLS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {word}) AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win), range({WINDOW}) AS r(k)
  WHERE n > 1 GROUP BY doc_id),
line AS (
  SELECT doc_id, x, len(regexp_extract_all(x, {word})) AS n, lower(trim(x, {space})) AS low
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)),
judged AS (
  SELECT doc_id, x, length(translate(x, {space}, '')) AS chars, n > 0 AND (
    (n <= {rules.boilerplate_words} AND regexp_matches(low, {text("|".join(BOILERPLATE))}))
    OR low IN ({", ".join(map(text, NAVIGATION))})
    OR (len(string_split(x, '|')) >= {rules.menu_parts} AND len(list_filter(string_split(x, '|'),
        lambda p: len(regexp_extract_all(p, {word})) > {rules.menu_part_words})) = 0)
    OR (length(x) - length(translate(x, {symbols}, ''))) * 100 > length(x) * {rules.symbol_percent}
    OR (n < {rules.open_words} AND NOT contains({text(rules.closing_signs)}, right(low, 1)))) AS fails, n
  FROM line),
lines AS (
  SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT x) FILTER (n > 0) AS n_dup_lines,
    coalesce(sum(chars) FILTER (fails), 0) AS lost FROM judged GROUP BY doc_id),
facts AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {space}, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, {symbols}, '')) AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, lost
  FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost * 100 <= word_chars * {rules.max_lost_percent} AS kept
FROM facts"""
