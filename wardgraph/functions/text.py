"""Text and list expressions."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words meaning that there is no allergy.
NO_ALLERGY = [
    "none",
    "no known allergies",
    "nkda",
    "no known drug allergies",
    "n/a",
    "na",
    "nil",
    "no allergies",
]

# English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've
now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

WORD = "[\\p{L}\\p{N}_]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it.

    Inside conditions and lambdas Spark computes an expression again at each
    place it stands.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(c: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def folded(c: Column) -> Column:
    """A to Z as a to z, everything else as it is, so that every byte keeps its place."""
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def normalize(c: Column) -> Column:
    """Lower case, trimmed, single spaces."""
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def clean(c: Column) -> Column:
    """Without ``___`` marks and line breaks."""
    return squeeze(F.replace(c, F.lit("___"), F.lit("")))


def split_list(c: Column, pattern: str = ",") -> Column:
    """Parts of the text, trimmed, blanks dropped."""
    parts = F.transform(F.split(c, pattern), trimmed)
    return F.filter(parts, lambda p: p != "")


def distinct_ignoring_case(items: Column) -> Column:
    """The first spelling of each item, in order."""
    pairs = F.transform(items, lambda x: F.struct(F.lower(x).alias("n"), x.alias("x")))

    def with_new(kept: Column, e: Column) -> Column:
        return F.when(F.exists(kept, lambda k: k["n"] == e["n"]), kept).otherwise(F.array_append(kept, e))

    none = F.array().cast("array<struct<n:string,x:string>>")
    return F.aggregate(pairs, none, with_new, lambda kept: F.transform(kept, lambda k: k["x"]))


def allergies(c: Column) -> Column:
    """Allergy names: split on ``,``, ``;``, ``|`` and "and"; none-words dropped."""
    parts = split_list(F.coalesce(c, F.lit("")), "[,;|]|\\sand\\s")
    known = distinct_ignoring_case(F.filter(parts, lambda x: ~F.lower(x).isin(NO_ALLERGY)))
    whole = F.lower(trimmed(c))
    return F.when(whole.isin(NO_ALLERGY), F.array().cast("array<string>")).otherwise(known)


def vitals_map(c: Column) -> Column:
    """``"k: v, k: v"`` as a map; the last of equal keys wins, parts without ``:`` are dropped."""
    pairs = F.filter(split_list(F.coalesce(c, F.lit(""))), lambda p: F.contains(p, F.lit(":")))
    none = F.create_map().cast("map<string,string>")

    def with_pair(known: Column, p: Column) -> Column:
        halves = F.split(p, ":", 2)
        key = F.translate(trimmed(halves[0]), " /", "__")
        return F.map_concat(F.map_filter(known, lambda k, _: k != key), F.create_map(key, trimmed(halves[1])))

    return F.aggregate(pairs, none, with_pair)


def complaint_known(current: Column, new: Column) -> Column:
    """True when the new complaint adds nothing to the current one."""

    def adds_nothing(added: Column) -> Column:
        old = normalize(current)
        parts = F.transform(F.split(F.coalesce(current, F.lit("")), "[,;]"), normalize)
        overlaps = F.exists(
            parts, lambda p: (p != "") & (F.contains(p, added) | F.contains(added, p))
        )
        return (added == "") | ((old != "") & (F.contains(old, added) | overlaps))

    return let(normalize(new), adds_nothing)


def merge_complaint(current: Column, new: Column) -> Column:
    """The triage complaint with the note's complaint added where it is new."""
    blank = F.trim(F.coalesce(current, F.lit(""))) == ""
    return (
        F.when(complaint_known(current, new), current)
        .when(blank, new)
        .otherwise(F.concat_ws(", ", current, new))
    )


def remove_stop_words(c: Column, separators: str = "|:") -> Column:
    """Text without English stop words; separators stay, with one space on each side.

    A stop word with an apostrophe is two words to the splitter, so only its
    parts can match.
    """
    return squeeze(_without_stop_words(c, separators))


def kept_words(c: Column, separators: str = "|:") -> Column:
    """The words of ``remove_stop_words`` as a list.

    A text may be cut into pieces that end in white space: the lists of the
    pieces, one after the other, are the list of the text.
    """
    return F.filter(F.split(_without_stop_words(c, separators), "\\s+"), lambda w: w != "")


def _without_stop_words(c: Column, separators: str) -> Column:
    stop = [w for w in STOP_WORDS if "'" not in w]
    pieces = F.regexp_extract_all(c, F.lit(f"{WORD}+|[^{WORD[1:]}+"), F.lit(0))
    bare = F.array_join(F.filter(pieces, lambda w: ~F.lower(w).isin(stop)), "")
    return F.regexp_replace(F.regexp_replace(bare, "\\s+", " "), f"\\s*([{separators}])\\s*", " $1 ")


def join_diagnoses(items: Column) -> Column:
    return F.array_join(items, " | ")


def diagnosis_query_text(c: Column) -> Column:
    """Free text of a diagnosis search in the form that was embedded."""
    return remove_stop_words(F.array_join(split_list(c, "[,\\n;|]+"), " | "), "|:,;")


def node_key(label: Column, *candidates: Column) -> Column:
    """``label_`` and the first known identifier."""
    return F.concat(label, F.lit("_"), F.coalesce(*candidates, F.lit("unknown")))


def map_text(m: Column, hidden: list[str]) -> Column:
    """``"k: v, k: v"`` without null values and without the hidden keys."""
    shown = F.map_filter(m, lambda k, v: v.isNotNull() & ~k.isin(hidden))
    return F.array_join(
        F.transform(F.map_entries(shown), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", "
    )


def chunk_by_words(c: Column, size: int, overlap: int) -> Column:
    """Chunks of ``size`` words parted by one space; each begins ``overlap`` words before the last one's end."""
    words = F.filter(F.split(c, "\\s+"), lambda w: w != "")
    count = F.size(words)
    step = size - overlap
    # The last chunk is the first that reaches the end.
    last = F.greatest(F.lit(0), F.ceil((count - size) / F.lit(step)).cast("int"))
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    chunks = F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))
    return F.when(c.isNotNull(), chunks)


# --- lines of stored bundles -------------------------------------------------


def parse_lab(line: Column) -> Column:
    """Fields of a lab line ``name=value (ref: lo-hi) [flag] specimen, category``.

    Reference and flag may be missing. The value then ends at the first space, where
    specimen and category begin; its unit is the rest of the value and holds no space. Text after the
    last comma is the category, and the only part without a comma is one too.
    Null for a line without ``=``.
    """
    measured = "(?s)^[^=]*=(.*)$"
    rest = trimmed(F.regexp_extract(line, measured, 1))
    # The tail begins after the flag, else after the reference, else after the value.
    marked = "(?s)^(.*?)\\s*(?:\\(ref:([^)]*)\\)\\s*(\\[[^\\]]*\\])?|(\\[[^\\]]*\\]))(.*)$"
    has_mark = rest.rlike(marked)
    plain_value = "(?s)^(\\S*)(.*)$"
    value = F.when(has_mark, F.regexp_extract(rest, marked, 1)).otherwise(F.regexp_extract(rest, plain_value, 1))
    tail = trimmed(F.when(has_mark, F.regexp_extract(rest, marked, 5)).otherwise(F.regexp_extract(rest, plain_value, 2)))
    flag = F.concat(F.regexp_extract(rest, marked, 3), F.regexp_extract(rest, marked, 4))
    return F.when(
        F.contains(line, F.lit("=")),
        F.struct(
            trimmed(F.regexp_extract(line, "^([^=]*)=", 1)).alias("test_name"),
            trimmed(value).alias("value"),
            trimmed(F.regexp_extract(rest, marked, 2)).alias("ref_range"),
            (flag != "").alias("is_abnormal"),
            trimmed(F.regexp_extract(tail, "(?s)^(.*),", 1)).alias("specimen"),
            trimmed(F.regexp_extract(tail, "([^,]*)$", 1)).alias("category"),
        ),
    )


def parse_micro(line: Column) -> Column:
    """Group and finding of a microbiology line: ``"{test}: {specimen}"``, or Other."""
    text = trimmed(line)
    pattern = "(?s)^([^:]*):(.*?)→(.*)$"
    matched = text.rlike(pattern)
    group = F.concat(
        trimmed(F.regexp_extract(text, pattern, 2)), F.lit(": "), trimmed(F.regexp_extract(text, pattern, 1))
    )
    arrow_first = F.contains(text, F.lit(":")) & F.contains(text, F.lit("→"))
    return F.when(
        text != "",
        F.struct(
            F.when(matched, group).when(~arrow_first, F.lit("Other")).alias("grp"),
            F.when(matched, trimmed(F.regexp_extract(text, pattern, 3))).otherwise(text).alias("finding"),
        ),
    )


def parse_sensitivity(finding: Column) -> Column:
    """Organism, antibiotic and sensitivity of a finding ``organism | antibiotic=value``."""
    part = F.get(F.split(finding, "\\|"), F.lit(1))
    usable = F.contains(part, F.lit("="))
    return F.struct(
        trimmed(F.get(F.split(finding, "\\|"), F.lit(0))).alias("organism"),
        F.when(usable, trimmed(F.regexp_extract(part, "^([^=]*)=", 1))).alias("antibiotic"),
        F.when(usable, trimmed(F.regexp_extract(part, "(?s)^[^=]*=(.*)$", 1))).alias("sensitivity"),
    )
