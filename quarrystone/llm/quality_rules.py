"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Frequent function words of the four languages, as they are written within and at the start of sentences.
STOP_WORDS = tuple(
    x
    for w in (
        "the of and to in is that for it was on are as with be at this have from or by not a an you he "
        "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
        "de la que el en y a los se del las un por con no una su para es al lo como más "
        "le et les des à une du dans pour qui est sur au par ne pas plus il ce sont"
    ).split()
    for x in dict.fromkeys((w, w.capitalize()))
)


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= feature <= high; a feature over nothing (null) passes, as does a text of fewer words than the rule asks for."""

    feature: str
    low: float | None
    high: float | None
    words: int = 0


#: The production table. Ratios are to words, or to lines with a word for line features. A text of fewer than 50 words may lack function words by chance.
RULES = (
    Rule("n_words", 20, None),
    Rule("repeat_ratio", None, 0.3),
    Rule("mean_word_length", 2, 15),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_ratio", 0.01, None, words=50),
    Rule("dup_line_ratio", None, 0.5),
    Rule("shout_ratio", None, 0.2),
)


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row breaks."""
    broken = []
    for r in rules:
        fails = F.lit(False)
        if r.low is not None:
            fails = fails | (F.col(r.feature) < r.low)
        if r.high is not None:
            fails = fails | (F.col(r.feature) > r.high)
        if r.words:
            fails = fails & (F.col("n_words") >= r.words)
        broken.append(F.when(fails, F.lit(r.feature)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def _let(value: Column, f) -> Column:
    """f(value), with value evaluated once a row."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeat_words(h: Column) -> Column:
    """Words within windows that occur twice or more; h has a hash for each window, by its first word."""

    def covered(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        starts = F.sort_array(F.transform(at, lambda j: F.get(s, j)["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(starts, zero, lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(by_hash, covered))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (text and any columns) with the counts, base_failed, broken (rules) and kept.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, broken, kept; columns of these names in docs are replaced. A
    null text has no words and fails; rows are judged one by one, so repeated
    rows get equal verdicts and an empty table gives an empty result. A feature
    that equals a bound passes (ties). A text is judged whole; its windows are
    an array of one number a word. Windows are compared by 64-bit hashes within
    their text.
    """
    text = F.coalesce("text", F.lit(""))
    t = docs.select(F.struct(*docs.columns).alias("_row"), text.alias("_text")).withColumn("_words", F.array_remove(F.split("_text", BLANK), ""))
    n = F.size("_words")
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
    t = t.withColumn("_h", F.when(n > WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    t = t.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_h")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.isin(*STOP_WORDS))).alias("_stop"),
        F.regexp_count("_text", F.lit("!!")).alias("_shout"),
        F.size("_lines").alias("_n_lines"),
    )
    # a generator of one row: filters on the verdict don't get below it, where each would count anew
    t = t.select("_row", F.inline(F.array(counts)))
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    t = t.withColumns(
        {
            "repeat_ratio": over("n_repeat_words", "n_words"),
            "mean_word_length": over("word_chars", "n_words"),
            "symbol_ratio": over("n_symbols", "n_words"),
            "stop_ratio": over("_stop", "n_words"),
            "shout_ratio": over("_shout", "n_words"),
            "dup_line_ratio": over("n_dup_lines", "_n_lines"),
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )
    t = t.withColumn("broken", compiled(rules))
    t = t.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "broken", "kept"]
    return t.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in added], *added)


def op3_threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SQL_OF = {
    "n_words": "n_words",
    "repeat_ratio": "n_repeat_words / n_words",
    "mean_word_length": "word_chars / n_words",
    "symbol_ratio": "n_symbols / n_words",
    "stop_ratio": "stop / n_words",
    "dup_line_ratio": "n_dup_lines / n_lines",
    "shout_ratio": "shout / n_words",
}


def _passes(r: Rule) -> str:
    bounds = [f"{_SQL_OF[r.feature]} {op} {x}" for op, x in ((">=", r.low), ("<=", r.high)) if x is not None]
    return f"(n_words < {r.words} or {' and '.join(bounds)})"


OP3_SQL = f"""
with w as (
  select doc_id, coalesce(text, '') as text, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
), win as (
  select r, i, array_to_string(words[i:i+{WINDOW - 1}], ' ') as win from (select r, words, unnest(range(1, len(words) - {WINDOW - 2})) as i from w where len(words) >= {WINDOW})
), rep as (
  select r, i from (select *, count(*) over (partition by r, win) as c from win) where c > 1
), covered as (
  select r, count(distinct i + j)::bigint as n from rep, (select unnest(range({WINDOW})) as j) group by r
), lines as (
  select r, l from (select r, unnest(string_split(text, chr(10))) as l from w) where regexp_matches(l, '[^\\x20\\x09-\\x0D]')
), dup as (
  select r, count(*)::bigint as n_lines, (count(*) - count(distinct l))::bigint as n from lines group by r
), f as (
  select w.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0) as n_dup_lines,
    coalesce(covered.n, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
    len(list_filter(words, lambda x: list_contains([{", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}], x))) as stop,
    len(regexp_extract_all(text, '!!')) as shout
  from w left join covered using (r) left join dup using (r)
), b as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {" and ".join(_passes(r) for r in RULES)} as kept
from b
"""
