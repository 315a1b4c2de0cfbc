"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Function words of the supported languages.
STOP_WORDS = {
    "en": "the of and to in is that for it with as was on are by be this from at a".split(),
    "fr": "la le de et les des en un une du dans que qui pour est pas sur au avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine".split(),
    "es": "de la que el en y los del se las por un para con no una su al lo".split(),
}
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [least, most]; either bound may be absent."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: Base rules decide ``base_failed``; all others the verdict on what remains.
BASE_RULES = [Rule("few_words", "n_words", least=50), Rule("repetition", "repeat_word_ratio", most=0.5)]
RULES = [
    Rule("mean_word_length", "mean_word_chars", least=2.5, most=12.0),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("stop_words", "stop_word_ratio", least=0.04),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5),
]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measures(df: DataFrame, text: str = "text", out: str = "q") -> DataFrame:
    """``df`` and a struct column ``out`` of the measures of each whole text; null is a text without words.

    Words of a text are split once; 3-word windows are sorted within their row together with their
    positions, so equal windows are neighbours and no row is exploded or shuffled.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    base = df.select(
        "*",
        F.filter(F.split(whole, SPACE), lambda w: w != "").alias("__words"),
        F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        F.length(F.regexp_replace(whole, f"[^{SYMBOLS}]+", "")).cast("long").alias("__symbols"),
    )
    windows = F.transform(
        F.sequence(F.lit(0), F.size("__words") - 3),
        lambda i: F.concat_ws(" ", F.get(F.col("__words"), i), F.get(F.col("__words"), i + 1), F.get(F.col("__words"), i + 2)),
    )
    hashed = F.transform(windows, lambda w, i: F.struct(F.xxhash64(w).alias("h"), w.alias("w"), i.alias("p")))
    base = base.withColumn(
        "__sorted", F.when(F.size("__words") >= 3, F.sort_array(hashed)).otherwise(F.array().cast("array<struct<h:bigint,w:string,p:int>>"))
    )

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & (a["w"] == b["w"]), F.lit(False))

    repeated = F.filter("__sorted", lambda x, i: same(x, F.get(F.col("__sorted"), i - 1)) | same(x, F.get(F.col("__sorted"), i + 1)))
    base = base.withColumn("__places", F.sort_array(F.transform(repeated, lambda x: x["p"])))
    places = F.col("__places")
    # a window covers 3 words, less where the next repeated window begins sooner
    covered = F.aggregate(
        F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, x: total + x,
    )
    bare = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))
    counted = base.select(
        *df.columns,
        F.struct(
            F.size("__words").cast("long").alias("n_words"),
            F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
            F.col("__symbols").alias("n_symbols"),
            F.size("__lines").cast("long").alias("n_lines"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
            F.size(F.filter("__words", lambda w: bare(w).isin(stop))).cast("long").alias("n_stop_words"),
        ).alias(out),
    )
    return counted


def metric(name: str, out: str = "q") -> Column:
    m = lambda x: F.col(f"{out}.{x}")
    return {
        "n_words": lambda: m("n_words").cast("double"),
        "repeat_word_ratio": lambda: _ratio(m("n_repeat_words"), m("n_words")),
        "mean_word_chars": lambda: _ratio(m("word_chars"), m("n_words")),
        "symbol_ratio": lambda: _ratio(m("n_symbols"), m("n_words")),
        "stop_word_ratio": lambda: _ratio(m("n_stop_words"), m("n_words")),
        "dup_line_ratio": lambda: _ratio(m("n_dup_lines"), m("n_lines")),
    }[name]()


def fails(rule: Rule, out: str = "q") -> Column:
    value, tests = metric(rule.metric, out), []
    if rule.least is not None:
        tests.append(value < rule.least)
    if rule.most is not None:
        tests.append(value > rule.most)
    return tests[0] | tests[1] if len(tests) == 2 else tests[0]


def judge(df: DataFrame, text: str = "text", base_rules: list[Rule] = BASE_RULES, rules: list[Rule] = RULES, out: str = "q") -> DataFrame:
    """``df`` with ``out`` (measures), ``base_failed``, ``failed_rules`` and ``kept``.

    Null or empty text: no words, so it fails the base rules. Repeated rows get equal verdicts; an empty
    table stays empty. Columns of ``df`` named like a result column give way to it.
    """
    df = df.drop(out, "base_failed", "failed_rules", "kept")
    measured = measures(df, text, out)
    base = F.lit(False)
    for rule in base_rules:
        base = base | fails(rule, out)
    broken = F.filter(F.array(*[F.when(fails(r, out), F.lit(r.name)) for r in [*base_rules, *rules]]), lambda x: x.isNotNull())
    measured = measured.select("*", base.alias("base_failed"), broken.alias("failed_rules"))
    return measured.withColumn("kept", F.size("failed_rules") == 0)
