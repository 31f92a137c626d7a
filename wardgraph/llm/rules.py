"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

``statistics`` adds the measures of a text, ``verdict`` compiles a table of bounds
on them into one boolean column; both are plain column expressions, so a filter
by rules is one pass over the texts without a shuffle.

Repeated three-word windows are found within the row: each window is packed into
one long (hash above, position below), the longs are sorted, neighbours of equal
hash are held against each other word by word, and the positions that remain say
which words are covered.

Defined cases: a null or empty text has 0 for every count and ratio and fails the
base rule; an input column that has the name of a measure is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgraph.llm.common import LINE_WORD, plain, words

WINDOW = 3
SYMBOLS = "[^#*$%&|<>]+"
# Frequent function words of the languages in use.
STOP_WORDS = {
    "en": "the and of to in is that it for on with as was at by be this are or an from",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine",
    "fr": "de la le et les des en un une du que est pour qui dans par sur au",
    "es": "de la que el en y los se del las un por con no una su para es al",
}
# Bounds (measure, least, most) beyond the base rule; null is no bound.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 12.0),
    ("symbols_per_word", None, 0.1),
    ("stop_word_share", 0.02, None),
    ("dup_line_share", None, 0.9),
    ("letter_share", 0.6, None),
)


def packed_windows(w: Column, n: Column, bits: Column) -> Column:
    """All windows of the array ``w`` of ``n`` words as longs, hash above and position in the lowest ``bits``, in order."""
    packed = F.transform(
        F.sequence(F.lit(0), (n - WINDOW).cast("int")),
        lambda i: F.call_function("shiftleft", F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]), bits).bitwiseOR(i.cast("long")),
    )
    return F.when(n >= WINDOW, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>"))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of a text and the ratios made of them.

    The steps stand in columns of their own (``_rule_*``, dropped at the end), so
    that the text is cut into words once.
    """
    df = docs.withColumn("_rule_words", words(F.col(text))).withColumn("_rule_n", F.size("_rule_words").cast("long"))
    df = df.withColumn("_rule_bits", F.ceil(F.log2(F.col("_rule_n") + 1)).cast("int"))
    df = df.withColumn("_rule_packed", packed_windows(F.col("_rule_words"), F.col("_rule_n"), F.col("_rule_bits")))
    w, packed, bits = F.col("_rule_words"), F.col("_rule_packed"), F.col("_rule_bits")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    df = df.withColumn("_rule_mask", mask)
    mask = F.col("_rule_mask")

    def place(x: Column) -> Column:
        return x.bitwiseAND(mask).cast("int")

    def same(x: Column, y: Column) -> Column:
        """Windows of equal hash with equal words; null at either end of the array is no window."""
        equal_hash = F.call_function("shiftrightunsigned", x, bits) == F.call_function("shiftrightunsigned", y, bits)
        equal_words = F.lit(True)
        for k in range(WINDOW):
            equal_words = equal_words & (F.get(w, place(x) + k) == F.get(w, place(y) + k))
        return F.coalesce(equal_hash & equal_words, F.lit(False))

    marked = F.transform(packed, lambda x, i: F.when(same(x, F.get(packed, i - 1)) | same(x, F.get(packed, i + 1)), place(x)))
    df = df.withColumn("_rule_at", F.sort_array(F.filter(marked, lambda x: x.isNotNull())))
    at = F.col("_rule_at")
    covered = F.aggregate(
        F.transform(at, lambda x, i: F.least(F.lit(WINDOW), x - F.coalesce(F.get(at, i - 1), F.lit(-WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    lines = F.filter(F.split(plain(text), "\n", -1), lambda x: x.rlike(LINE_WORD))
    df = df.withColumn("_rule_lines", lines)
    stop = F.array(*[F.lit(x) for x in sorted({y for v in STOP_WORDS.values() for y in v.split()})])
    n, body = F.col("_rule_n"), F.array_join("_rule_words", "")
    chars = F.length(body).cast("long")
    counts = {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": F.length(F.regexp_replace(plain(text), SYMBOLS, "")).cast("long"),
        "n_lines": F.size("_rule_lines").cast("long"),
        "n_dup_lines": (F.size("_rule_lines") - F.size(F.array_distinct("_rule_lines"))).cast("long"),
        "n_repeat_words": covered,
        "n_letters": F.length(F.regexp_replace(body, r"[^\p{L}]+", "")).cast("long"),
        "n_stop_words": F.size(F.filter(F.transform(w, F.lower), lambda x: F.array_contains(stop, x))).cast("long"),
    }
    # A filter on a measure would be pushed below and repeat the steps word by
    # word; it stops at a generator.
    kept = [c for c in docs.columns if c not in counts]
    df = df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in counts.items()]))))

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    ratios = {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "stop_word_share": ratio("n_stop_words", "n_words"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "letter_share": ratio("n_letters", "word_chars"),
        "repeat_word_share": ratio("n_repeat_words", "n_words"),
    }
    return df.withColumns(ratios)


def verdict(bounds) -> Column:
    """One boolean column: all measures within their bounds."""
    good = F.lit(True)
    for name, least, most in bounds:
        if least is not None:
            good = good & (F.col(name) >= least)
        if most is not None:
            good = good & (F.col(name) <= most)
    return good


def judge(docs: DataFrame, text: str = "text", bounds=THRESHOLDS) -> DataFrame:
    """Documents with their measures, ``base_failed`` and ``kept``."""
    df = statistics(docs.drop(*[c for c in ("base_failed", "kept") if c in docs.columns]), text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(bounds))
