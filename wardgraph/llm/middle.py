"""Fill-in-the-middle: texts cut in three at unit borders by one match of a counted pattern.

A unit is a word with the white space before it, or the white space at the end of a
text. ``regexp_count`` gives a row's number of units n; two borders a <= b are drawn
from a digest of the row's id. The row's own pattern, ``unit{a}``, ``unit{b-a}`` and
the rest as groups, matches the whole text once, and the replacement puts the three
groups into the order of the form, each behind its mark. Units and counts are
possessive: the matcher walks the text once, without a stack that grows with it.

A text that holds a mark stays plain, so the first of each mark in an output is
the one put there, and ``restore`` finds the parts again.

Defined cases: null and empty texts have no units, stay plain and give the empty
text; a null id draws like the empty text; rows of equal id draw alike; an empty
table gives an empty table. Input columns with the names of added columns are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgraph.llm.common import plain

# Unlike the members one by one, ranges keep the row's pattern short to compile.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ANY_MARK = "<[PSM]>"
SEED = 42
# Of 100 texts, those that are cut, and of 100 that are cut, those with the suffix first.
RATE, SPM_RATE = 50, 80
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
GROUP = {"prefix": 1, "middle": 2, "suffix": 3}
OUTPUT = ["n", "form", "output", "prefix_chars", "middle_chars"]


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 from the digest of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _template(form: str) -> str:
    return "".join(f"{MARKS[part]}${GROUP[part]}" for part in ORDERS[form])


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Documents with ``n`` (units), ``form`` (plain, psm or spm), ``output``, ``prefix_chars`` and ``middle_chars`` (null if plain)."""
    names = [c for c in docs.columns if c not in OUTPUT]
    h1, h2, h3, h4 = draws(F.col(doc_id), seed)
    drawn = docs.select(*names, plain(text).alias("_fim_text"), F.regexp_count(plain(text), F.lit(UNIT)).cast("long").alias("n"), h1.alias("_fim_h1"), h2.alias("_fim_h2"), h3.alias("_fim_h3"), h4.alias("_fim_h4"))
    stays = (F.col("_fim_text") == "") | F.col("_fim_text").rlike(ANY_MARK) | (F.col("_fim_h3") % 100 >= rate)
    form = F.when(stays, "plain").when(F.col("_fim_h4") % 100 < spm_rate, "spm").otherwise("psm")
    a, b = F.col("_fim_h1") % (F.col("n") + 1), F.col("_fim_h2") % (F.col("n") + 1)
    cut = drawn.select("*", form.alias("form"), F.least(a, b).alias("_fim_a"), F.greatest(a, b).alias("_fim_b"))
    pattern = F.concat(F.lit(rf"(?s)\A((?:{UNIT}){{"), F.col("_fim_a"), F.lit(rf"}}+)((?:{UNIT}){{"), F.col("_fim_b") - F.col("_fim_a"), F.lit(r"}+)(.*+)\z"))
    ordered = F.when(F.col("form") == "spm", F.lit(_template("spm"))).otherwise(F.lit(_template("psm")))
    made = cut.withColumn("output", F.when(F.col("form") == "plain", F.col("_fim_text")).otherwise(F.regexp_replace("_fim_text", pattern, ordered)))
    return made.select(*names, "n", "form", "output", *[F.char_length(part_of(F.col("output"), F.col("form"), p)).cast("long").alias(f"{p}_chars") for p in ("prefix", "middle")])


def part_of(output: Column, form: Column, part: str) -> Column:
    """A part of an output; null if the form is plain."""
    parts = F.split(output, ANY_MARK, -1)
    place = {name: order.index(part) + 2 for name, order in ORDERS.items()}
    return F.when(form == "plain", F.lit(None)).when(form == "spm", F.get(parts, F.lit(place["spm"] - 1))).otherwise(F.get(parts, F.lit(place["psm"] - 1)))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    return F.when(form == "plain", output).otherwise(F.concat(*[part_of(output, form, p) for p in ("prefix", "middle", "suffix")]))
