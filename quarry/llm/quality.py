"""Quality rules: a threshold table compiled into one Spark projection.

``METRICS`` are counts and ratios of a text; ``RULES`` is the table, one row per rule: name, metric, lowest and highest
value that pass, and the languages' worth of stop words behind the stop-word ratio. ``measure`` adds the metrics and
``verdict`` compiles the table into columns; no user function runs anywhere, and nothing is shuffled.

Defined cases: a null text has no words and fails the base rule, as an empty one does; repeated rows and ties get equal
answers; very long texts take time in proportion to n log n of their words; an empty table gives an empty result; other
columns, whatever their names, are passed through by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, SPACE_CHARS, count_chars, text_or_empty, words

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by at this from or an have not "
    "de la le et les des en un une du que qui dans pour par sur pas est au avec ce il "
    "der die und das den von zu mit sich auf für ist im nicht ein eine dem es auch als "
    "el los las del se por con para su al lo como más una no"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    low: float | None = None
    high: float | None = None


BASE = (Rule("few_words", "n_words", low=50), Rule("repeated_windows", "repeat_ratio", high=0.5))
RULES = (
    Rule("word_length", "mean_word_length", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.05),
    Rule("stop_words", "stop_ratio", low=0.06),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
)


def measure(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add the metrics of the text as columns ``prefix + name``."""
    p = f"{prefix}_ql_"
    text = text_or_empty(text_col)
    df = df.withColumns({f"{p}words": words(text), f"{p}lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))})
    w, n = F.col(f"{p}words"), F.size(f"{p}words")
    # a window is known by the hash of its three words, and each hash by where it stands
    three = F.arrays_zip(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), F.slice(w, 2, F.greatest(n - 2, F.lit(0))), F.slice(w, 3, F.greatest(n - 2, F.lit(0))))
    df = df.withColumn(f"{p}windows", F.transform(three, lambda x: F.xxhash64(x)))
    hashes = F.col(f"{p}windows")
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(f"{p}sorted", F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), placed))
    s = F.col(f"{p}sorted")
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn(f"{p}at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    at = F.col(f"{p}at")
    # a repeated window covers three words, or as many as there are up to the next repeated window
    covered = F.aggregate(F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    lines = F.col(f"{p}lines")
    counts = {
        "n_words": n.cast("long"),
        "word_chars": (F.length(text) - count_chars(text, SPACE_CHARS)).cast("long"),
        "n_symbols": count_chars(text, SYMBOLS).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
    }
    df = df.withColumns({prefix + k: v for k, v in counts.items()})
    c = {k: F.col(prefix + k) for k in counts}
    ratios = {
        "mean_word_length": _ratio(c["word_chars"], c["n_words"]),
        "symbol_ratio": _ratio(c["n_symbols"], c["word_chars"]),
        "stop_ratio": _ratio(c["n_stop_words"], c["n_words"]),
        "dup_line_ratio": _ratio(c["n_dup_lines"], c["n_lines"]),
        "repeat_ratio": _ratio(c["n_repeat_words"], c["n_words"]),
    }
    return df.withColumns({prefix + k: v for k, v in ratios.items()}).drop(*[f"{p}{x}" for x in ("words", "lines", "windows", "sorted", "at")])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def broken(rules: tuple[Rule, ...], prefix: str = "") -> Column:
    """Names of the rules that a text breaks, in the table's order."""
    tests = []
    for r in rules:
        x = F.col(prefix + r.metric)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (x < r.low)
        if r.high is not None:
            bad = bad | (x > r.high)
        tests.append(F.when(bad, F.lit(r.name)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def verdict(df: DataFrame, text_col: str = "text", *, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES, prefix: str = "") -> DataFrame:
    """``df`` with the metrics, ``base_failed``, ``broken_rules`` and ``kept``."""
    df = measure(df, text_col, prefix).withColumns({f"{prefix}base_failed": F.size(broken(base, prefix)) > 0, f"{prefix}broken_rules": broken(base + rules, prefix)})
    return df.withColumn(f"{prefix}kept", F.size(f"{prefix}broken_rules") == 0)


def keep_good(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that pass every rule, with its own columns."""
    # a filter is not moved below a row number: the metrics are computed once, and not again inside the condition
    judged = verdict(df, text_col, prefix="_ql_", **options).withColumn("_ql_row", F.monotonically_increasing_id())
    return judged.filter(F.col("_ql_kept") & (F.col("_ql_row") >= 0)).select(*[f"`{c}`" for c in df.columns])
