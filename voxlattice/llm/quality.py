"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common function words of the corpus languages (English, French, German, Spanish). Fixed values.
STOP_WORDS = (
    "the of and to in a is that it for was on with as are "
    "le la les de des du et en un une que est pour qui dans "
    "der die das und in den von zu mit ist im für auf nicht ein eine "
    "el los las de que y en un una por con para es se del"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails where the metric lies outside [least, most]; None leaves that side open."""

    metric: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.3),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every metric beside them, in nested projections that Catalyst keeps apart (each array is made once).

    Null counts as empty. Words are runs of non-blank characters; lines are separated by newlines and counted if they
    hold a word; repeated words are those in a three-word window found twice or more in the text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({"_text": body, "_w": _words(body)})
    grams = F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("p")))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({"_s": F.sort_array(grams), "_lines": lines})
    same = lambda x, i: (F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"])
    rows = rows.withColumn("_d", F.array_compact(F.transform("_s", lambda x, i: F.when(same(x, i), x["p"]))))
    covered = F.array_union(F.array_union("_d", F.transform("_d", lambda p: p + 1)), F.transform("_d", lambda p: p + 2))
    blank = F.length(F.translate("_text", " \t\n\x0b\x0c\r", ""))
    symbols = F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))
    rows = rows.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": blank.cast("long"),
            "n_symbols": symbols.cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.size(covered).cast("long"),
            "n_stop_words": F.size(F.filter("_w", lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS)))).cast("long"),
        }
    )
    of = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    rows = rows.withColumns({"mean_word_chars": of("word_chars", "n_words"), "symbol_ratio": of("n_symbols", "n_words"), "stop_word_ratio": of("n_stop_words", "n_words"), "dup_line_ratio": of("n_dup_lines", "n_lines")})
    return rows.drop("_text", "_w", "_s", "_lines", "_d")


def failed(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row of measures() breaks."""
    broken = []
    for r in rules:
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (F.col(r.metric) < r.least)
        if r.most is not None:
            bad = bad | (F.col(r.metric) > r.most)
        broken.append(F.when(bad, F.lit(r.metric)))
    return F.array_compact(F.array(*broken))


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least_words: int = 50, most_repeat: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, kept, failed_rules) of every row; null and empty texts have no words and fail.

    To filter by the verdict use keep(): a filter on these columns would be pushed below the arrays and repeat them.
    """
    rows = measures(docs.select(F.col(doc_id), F.col(text)), text)
    rows = rows.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))).withColumn("failed_rules", failed(rules))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return rows.select(doc_id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "failed_rules")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least_words: int = 50, most_repeat: int = 50, text: str = "text") -> DataFrame:
    """The rows that pass, with their own columns only."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    rows = measures(packed, "text")
    passed = (F.col("n_words") >= least_words) & (100 * F.col("n_repeat_words") <= most_repeat * F.col("n_words")) & (F.size(failed(rules)) == 0)
    # a filter on a column that isn't deterministic stays above the projection; pushed below, it would repeat its arrays
    return rows.select("row", passed.alias("passed"), F.monotonically_increasing_id().alias("at")).where("passed and at >= 0").select("row.*")
