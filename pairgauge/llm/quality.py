"""Quality rules: a threshold table compiled into one native projection.

``measures`` adds counts of a text, ``verdicts`` one boolean a rule; both are built-in
expressions only, so the whole operator is one scan with no shuffle.
Null and empty texts have no words: all counts are 0 and they fail. Rows are judged one by
one, so ties, repeated rows and extra columns have no effect; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for as with was be on by are this at from or "
    "le la les des et du un une est que dans pour qui sur pas au avec "
    "der die das und von den mit ein eine ist nicht zu auf für sich "
    "el los las y del se por con para una como es no lo"
).split()


@dataclass(frozen=True)
class Rule:
    """``low`` and ``high`` bound measure in hundredths of ``per`` (or as it is, without)."""

    name: str
    measure: str
    per: str | None = None
    low: int | None = None
    high: int | None = None

    def failed(self) -> Column:
        value = F.col(self.measure) * (100 if self.per else 1)
        unit = F.col(self.per) if self.per else F.lit(1)
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (value < unit * self.low)
        if self.high is not None:
            bad = bad | (value > unit * self.high)
        return bad


#: The two rules of the base verdict.
BASE = (Rule("too_short", "n_words", low=50), Rule("repetitive", "n_repeat_words", "n_words", high=50))
#: The production table.
RULES = (
    Rule("short_words", "word_chars", "n_words", low=200),
    Rule("long_words", "word_chars", "n_words", high=1500),
    Rule("symbols", "n_symbols", "word_chars", high=5),
    Rule("stop_words", "n_stop_words", "n_words", low=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
)


def _repeat_words(ws: Column) -> Column:
    """Words that lie in a window of three found twice or more, by sorting the windows."""

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1), x + 3) - x))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))

    def count(w: Column) -> Column:
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(F.sort_array(windows(w)), lambda s: let(F.sort_array(twice(s)), covered)))

    return let(ws, count)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    ws = words(F.col(text))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    two = let(lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup")))
    three = let(
        ws,
        lambda w: F.struct(
            F.size(w).alias("n"),
            _repeat_words(w).alias("repeat"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("stop"),
        ),
    )
    bare = df.withColumns({"_w": three, "_l": two})
    return bare.withColumns(
        {
            "n_words": F.col("_w.n").cast("long"),
            "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_lines": F.col("_l.n").cast("long"),
            "n_dup_lines": F.col("_l.dup").cast("long"),
            "n_repeat_words": F.col("_w.repeat").cast("long"),
            "n_stop_words": F.col("_w.stop").cast("long"),
        }
    ).drop("_w", "_l")


def verdicts(measured: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Adds base_failed, kept and failed_rules (names in the table's order)."""
    named = F.array_compact(F.array(*[F.when(r.failed(), F.lit(r.name)) for r in (*base, *rules)]))
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | r.failed()
    return measured.withColumns({"base_failed": base_failed, "failed_rules": named}).withColumn("kept", F.size("failed_rules") == 0)


def filter_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass every rule, with their own columns only.

    A plain filter would be pushed below the projection, and with it a copy of every measure for each
    rule that reads it; a generator in between keeps the measures where they are worked out once."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    judged = verdicts(measures(rows, "_text"))
    kept = F.explode_outer(F.when(F.col("kept"), F.array("_row")))
    return judged.select(kept.alias("_row")).filter("_row IS NOT NULL").select("_row.*")
