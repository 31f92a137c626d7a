"""Reading discharge notes with column expressions.

Every function takes text columns and returns a column; ``note_rules`` holds
the headings and patterns. No note leaves its row, so reading notes needs no
shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgraph.functions import note_rules as R
from wardgraph.functions.text import clean, folded, let, squeeze, trimmed

# Any text with line breaks: as little as will do, and all there is. The plain
# dot is many times faster here than a class of all characters.
SHORTEST = "(?s:.*?)"
REST = "(?s:.*)"


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def redacted(c: Column) -> Column:
    """True for blanks and for at most three underscores and spaces."""
    return F.coalesce(trimmed(c).rlike("^[_ ]{0,3}$"), F.lit(True))


def readable(c: Column) -> Column:
    """Cleaned text; null where it is redacted or nothing is left."""
    return let(c, lambda t: F.when(~redacted(t), _blank_to_null(clean(t))))


def find(c: Column, pattern: str, flags: str = "(?i)", group: int = 1) -> Column:
    """Group of the first match; null without one. The group must not be empty."""
    return F.nullif(F.regexp_extract(c, flags + pattern, group), F.lit(""))


def first_of(c: Column, patterns: list[str]) -> Column:
    """Value of the first pattern in the list that matches."""
    return F.coalesce(*[find(c, p) for p in patterns])


def leftmost(c: Column, patterns: list[str]) -> Column:
    """Value of the match that begins first, whichever pattern it is of; of equal places the first pattern's."""
    either = "|".join(f"(?:{p})" for p in patterns)
    return F.coalesce(*[find(c, either, group=k + 1) for k in range(len(patterns))])


def _heading_forms(start: str) -> list[str]:
    return list(dict.fromkeys([start, start.replace(":", ""), start.replace(":", ".*:")]))


def _plain_words(start: str) -> bool:
    """True for words, ``\\s*`` and ``|``: what lower case letters say as well in a folded text."""
    return start.isascii() and not re.search(r"[\\^$.\[\](){}*+?]", re.sub(r"\\s[*+]?", "", start)) and all(start.split("|"))


def from_heading(c: Column, start: str, low: Column | None = None) -> Column:
    """The note from a heading on; null without it. The forms are tried in order.

    ``low`` is the folded note. There a search for given words skips most of the
    text, which one for any case can't, so each word is searched alone and the
    first place counts. Places are counted in bytes from the end.
    """
    if not _plain_words(start):
        return F.coalesce(*[find(c, f"(?:{s}){REST}", "(?im)", 0) for s in _heading_forms(start)])
    low = folded(c) if low is None else low

    def rest(form: str) -> Column:
        # A list of the one match there can be is null without it; an empty text would need a second search.
        found = [F.get(F.regexp_extract_all(low, F.lit(s.lower() + REST), F.lit(0)), F.lit(0)) for s in form.split("|")]
        left = [F.octet_length(t) for t in found]
        return F.greatest(*left) if len(left) > 1 else left[0]

    left = F.coalesce(*[rest(s) for s in _heading_forms(start)])
    return F.substring(c.cast("binary"), -left, F.octet_length(c)).cast("string")


def section_body(tail: Column, start: str, end: str) -> Column:
    """Text after the heading that ``tail`` begins with, up to a next one or the end."""
    head = "|".join(_heading_forms(start))

    def upto(e: str) -> Column:
        return F.regexp_extract(tail, f"(?im)\\A(?:{head})({SHORTEST})(?:{e}|\\z)", 1)

    bare = end.replace(":", "")
    body = upto(end) if bare == end else F.when(tail.rlike(f"(?i)(?:{end})"), upto(end)).otherwise(upto(bare))
    return F.coalesce(trimmed(body), F.lit(""))


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\\n"), trimmed), lambda x: x != "")


def _filled_list(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def with_sections(df: DataFrame, text: str, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Add one column per section, named ``s_`` and the section's name.

    The text from the heading on is a column first, so that each pattern runs
    over a note once.
    """
    kept = df.columns
    low = df.withColumn("_low", folded(F.col(text)))
    tails = low.select(*kept, *[from_heading(F.col(text), r[0], F.col("_low")).alias(f"_t_{n}") for n, r in rules.items()])
    return tails.select(*kept, *[section_body(F.col(f"_t_{n}"), *r).alias(f"s_{n}") for n, r in rules.items()])


# --- head of the note ------------------------------------------------------------


def allergy_lines(c: Column) -> Column:
    named = F.transform(
        F.filter(lines(c), lambda x: ~redacted(x)),
        lambda x: F.when(F.contains(x, F.lit("No Known")), F.lit(R.NO_ALLERGIES)).otherwise(clean(x)),
    )
    return _filled_list(named)


def head(c: Column, allergies: Column) -> Column:
    values = {k: readable(find(c, p)) for k, p in R.HEAD_FIELDS.items()}
    values["Attending"] = F.nullif(values["Attending"], F.lit("."))
    return F.struct(*[v.alias(k) for k, v in values.items()], allergy_lines(allergies).alias("Allergies"))


# --- clinical summary --------------------------------------------------------------


def procedure_list(c: Column) -> Column:
    bare = F.transform(lines(c), lambda x: F.regexp_replace(x, "^___\\s+", ""))
    kept = F.filter(bare, lambda x: ~redacted(x) & (F.lower(x) != "none"))
    return _filled_list(F.transform(kept, clean))


def itemised(c: Column) -> Column:
    """Items of a list: a bullet, a number or a blank line begins a new one."""
    mark = "\u0001"
    begun = F.regexp_replace(c, "(?:\\A|\\n)[ \\t]*(?:[-•]|\\d+\\.)[ \\t]+(?=\\S)", mark)
    parted = F.regexp_replace(begun, "\\n\\s*\\n", mark)
    bare = F.transform(F.split(parted, mark), lambda x: F.regexp_replace(clean(x), "^(?:[-•]\\s*)?(?:\\d+\\.\\s*)?", ""))
    return F.filter(F.transform(bare, trimmed), lambda x: ~redacted(x))


def _habits(family: Column) -> Column:
    return _filled_list(F.array(*[clean(F.coalesce(find(family, f"({p})"), F.lit(""))) for p in R.HABIT_SENTENCES]))


def social_history(social: Column, family: Column) -> Column:
    """Sentences of the social history, and those on habits under family history."""
    own = F.when(
        ~redacted(social),
        F.transform(
            F.filter(F.transform(F.split(social, "\\.\\s+"), trimmed), lambda s: s != ""),
            lambda s: clean(F.concat(F.regexp_replace(s, "\\.$", ""), F.lit("."))),
        ),
    )
    own = F.coalesce(own, F.array().cast("array<string>"))
    return _blank_to_null(
        let(
            own,
            lambda told: F.array_join(
                F.concat(told, F.filter(_habits(family), lambda s: ~F.array_contains(told, s))), " "
            ),
        )
    )


def family_history(family: Column) -> Column:
    rest = family
    for p in R.HABIT_SENTENCES:
        rest = F.regexp_replace(rest, "(?i)" + p, "")
    rest = F.regexp_replace(clean(rest), "(?i)\\s+(?:alcohol|smoking|drug\\s+use)\\s+", " ")
    return readable(rest)


def summary(complaint: Column, procedures: Column, past: Column, social: Column, family: Column) -> Column:
    done = procedure_list(procedures)
    return F.struct(
        _blank_to_null(clean(complaint)).alias("Chief Complaint"),
        _blank_to_null(F.array_join(done, ", ")).alias("Major Surgical or Invasive Procedure"),
        itemised(past).alias("Past Medical History"),
        social_history(social, family).alias("Social History"),
        family_history(family).alias("Family History"),
    )


# --- vital signs ---------------------------------------------------------------------


def _number(c: Column) -> Column:
    """A number as written, without a lone point or leading zeros; other text as it is."""
    return F.regexp_replace(F.regexp_replace(c, "\\.$", ""), "^0+(?=\\d)", "")


def _oxygen(value: Column, text: Column) -> Column:
    """``97%RA`` for a bare number or ``97RA`` on room air; ranges and percents stay."""
    bare = F.regexp_replace(value, "(?i)\\s*RA$", "")
    plain = bare.rlike("^\\d+$") & F.contains(F.upper(text), F.lit("RA"))
    return F.when(plain, F.concat(bare, F.lit("%RA"))).otherwise(trimmed(value))


def vitals(line: Column) -> Column:
    """Vital signs of a line: compact form, else VS form, else one by one."""
    return let(line, _vitals)


def _vitals(text: Column) -> Column:
    compact = text.rlike(R.COMPACT_VITALS)
    vs = text.rlike("(?i)" + R.VS_VITALS)

    def pick(compact_group: int, vs_group: int, name: str) -> Column:
        return (
            F.when(compact, F.regexp_extract(text, R.COMPACT_VITALS, compact_group))
            .when(vs, F.replace(F.regexp_extract(text, "(?i)" + R.VS_VITALS, vs_group), F.lit(" "), F.lit("")))
            .otherwise(leftmost(text, R.SINGLE_VITALS[name]))
        )

    rate = pick(4, 4, "Respiratory Rate")
    return F.struct(
        _number(pick(1, 1, "Temperature")).alias("Temperature"),
        _number(pick(2, 3, "Heart Rate")).alias("Heart Rate"),
        pick(3, 2, "Blood Pressure").alias("Blood Pressure"),
        _number(F.when(~redacted(rate), rate)).alias("Respiratory Rate"),
        _oxygen(pick(5, 5, "SpO2"), text).alias("SpO2"),
        F.when(~compact & ~vs, _number(first_of(text, R.SINGLE_VITALS["Glucose"]))).alias("Glucose"),
    )


# --- present illness ------------------------------------------------------------------


def hpi_summary(hpi: Column) -> Column:
    told = F.regexp_replace(hpi, f"(?i)(?:{R.ED_PART}){REST}\\z", "")
    told = clean(told)
    return _blank_to_null(F.regexp_replace(told, "(?i)\\s+In the ED[^.]*$", ""))


def ed_labs(hpi: Column) -> Column:
    """Laboratory values of the emergency department as a map."""
    return let(_ed_lab_text(hpi), _ed_labs)


def _ed_lab_text(hpi: Column) -> Column:
    return F.coalesce(find(hpi, f"(Labs\\s+(?:were\\s+)?(?:notable|significant)\\s+for{REST})"), hpi)


def _ed_labs(labs: Column) -> Column:
    pairs = [F.struct(F.lit(k).alias("k"), find(labs, p).alias("v")) for k, p in R.ED_LABS.items()]
    none = F.when(labs.rlike("(?i)" + R.NO_LEUKOCYTOSIS.replace(" ", "\\s+")), F.lit(R.NO_LEUKOCYTOSIS))
    pairs.append(F.struct(F.lit("Leukocytosis").alias("k"), none.alias("v")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["v"].isNotNull()))


def ed_treatment(hpi: Column) -> Column:
    return let(find(hpi, R.ED_TREATMENT), _treatments)


def _treatments(told: Column) -> Column:
    parts = [F.regexp_extract_all(told, F.lit(R.TREATMENT), F.lit(i)) for i in range(1, 6)]
    drugs = F.transform(
        F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)]),
        lambda d: F.concat_ws(" ", *[_blank_to_null(trimmed(d[f"g{i}"])) for i in range(5)]),
    )
    cocktail = F.when(told.rlike("(?i)\\ba\\s+GI\\s+cocktail\\b"), F.array(F.lit(R.COCKTAIL)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(drugs, none), F.coalesce(cocktail, none)))


def hpi(c: Column) -> Column:
    imaging = let(clean(first_of(c, R.ED_IMAGING)), lambda i: F.when(i != "", i))
    findings = F.struct(
        clean(find(c, R.ED_GENERAL)).alias("General"),
        vitals(find(c, R.ED_VITALS)).alias("Vitals"),
        imaging.alias("Imaging"),
        ed_treatment(c).alias("Initial Treatment"),
        F.lit(None).cast("string").alias("ICU/MICU Status"),
    )
    return F.struct(hpi_summary(c).alias("Summary"), findings.alias("ED Findings"), ed_labs(c).alias("ED Labs"))


# --- physical examination ----------------------------------------------------------------

_ALL_PARTS = "|".join(R.EXAM_PARTS.values())


def _exam_part(c: Column, words: str, ends: str) -> Column:
    pattern = f"(?im)^[ \\t]*(?:{words})[: \\t-]+({SHORTEST})(?=^[ \\t]*(?:{ends})[: \\t-]+|\\z)"
    found = _filled_list(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), clean))
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), found), -1)


def exam(c: Column) -> Column:
    """Parts of an examination; a part runs to the next line that begins another."""
    line = first_of(c, R.EXAM_VITALS_LINE)
    pulses = f"{_ALL_PARTS}|PULSES|GU"
    parts = {"General": None, "Vitals": vitals(line)}
    for name, words in R.EXAM_PARTS.items():
        parts[name] = _exam_part(c, words, f"{_ALL_PARTS}|GU" if name == "Extremities" else pulses)
    parts["Extremities"] = F.coalesce(parts["Extremities"], _exam_part(c, "PULSES", pulses))
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def exam_texts(c: Column, admission: Column, discharge: Column) -> tuple[Column, Column]:
    """Text of both examinations; a combined one serves for both."""
    combined = F.coalesce(
        trimmed(find(c, f"(?:{R.COMBINED_EXAM})({SHORTEST})(?:{R.COMBINED_EXAM_END}|\\z)")), F.lit("")
    )
    both = c.rlike("(?i)" + R.COMBINED_EXAM.split("|")[0])
    first = F.when(both, combined).when(admission != "", admission).otherwise(combined)
    return first, F.when(both, combined).otherwise(discharge)


# --- results -------------------------------------------------------------------------------


def lab_values(c: Column) -> Column:
    """Laboratory values as a map from kept name to value; the first value of a name wins."""
    return let(c, _lab_values)


def _lab_values(c: Column) -> Column:
    # One pass over the text. Within a run of name characters only its first one is tried:
    # where that leads to no value, no later one does.
    lines = F.regexp_extract_all(c, F.lit(f"(?i)(?:\\G|(?<![A-Z\\s/()]))(?:{R.LAB_LINE})"), F.lit(0))
    known = F.create_map(*[F.lit(x) for kv in R.LAB_NAMES.items() for x in kv])
    listed = F.array(*[F.lit(k) for k in R.LAB_NAMES])

    def kept_name(n: Column) -> Column:
        def of(name: Column) -> Column:
            inside = F.get(F.filter(listed, lambda k: F.contains(name, k)), F.lit(0))
            return F.coalesce(F.try_element_at(known, name), F.try_element_at(known, inside), name)

        return let(F.upper(squeeze(n)), of)

    part = "(?i)" + R.LAB_LINE
    found = F.transform(
        lines, lambda x: F.struct(kept_name(F.regexp_extract(x, part, 1)).alias("n"), F.regexp_extract(x, part, 2).alias("v"))
    )
    extra = F.array(*[F.struct(F.lit(k).alias("n"), find(c, p).alias("v")) for k, p in R.EXTRA_LABS.items()])
    usable = F.filter(
        F.concat(found, extra), lambda e: e["v"].isNotNull() & (e["v"] != "") & ~e["n"].isin(R.NOT_LAB_NAMES)
    )
    none = F.create_map().cast("map<string,string>")
    return F.aggregate(
        usable,
        none,
        lambda m, e: F.when(F.map_contains_key(m, e["n"]), m).otherwise(F.map_concat(m, F.create_map(e["n"], e["v"]))),
    )


def microbiology(c: Column) -> Column:
    edited = F.regexp_replace(c, "\\s+", " ")
    for pattern, words in R.MICRO_EDITS:
        edited = F.regexp_replace(edited, pattern, words)
    return _blank_to_null(clean(edited))


def imaging_studies(imaging: Column, results: Column) -> Column:
    """Imaging studies with their findings."""
    return let(F.when(imaging != "", imaging).otherwise(results), _studies)


def _study(kind: Column, findings: Column) -> Column:
    row = lambda f: F.struct(
        kind.alias("Study Type"), F.lit(None).cast("string").alias("Date"), f.alias("Findings")
    )
    return let(readable(findings), lambda f: F.when(f.isNotNull(), row(f)))


def _studies(text: Column) -> Column:
    found = {k: find(text, p) for k, p in R.IMAGING_STUDIES.items()}
    for aside in R.ULTRASOUND_ASIDES:
        found["U/S"] = F.regexp_replace(found["U/S"], aside, "")
    found["U/S"] = let(clean(found["U/S"]), lambda f: F.when(f != "", f))
    ct = clean(find(text, "\\b" + R.CT_STUDY))
    all_studies = [_study(F.lit(k), v) for k, v in found.items()]
    all_studies.append(_study(squeeze(F.concat(F.lit("CT "), ct)), find(text, "\\b" + R.CT_STUDY, group=2)))
    return F.filter(F.array(*all_studies), lambda s: s.isNotNull())


# --- course and transition -----------------------------------------------------------------


def hospital_course(c: Column) -> Column:
    return let(find(c, f"Brief Hospital Course:({REST})"), _course)


def _course(tail: Column) -> Column:
    ends = F.coalesce(*[F.nullif(F.instr(tail, e), F.lit(0)) for e in R.COURSE_ENDS], F.length(tail) + 1)
    body = trimmed(F.substring(tail, F.lit(1), ends - 1))
    body = F.regexp_replace(squeeze(body), R.NEXT_SECTION_TAIL, "")
    return _blank_to_null(clean(body))


def _bracketless(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, "^(?:[-\\s]*)\\[?\\s*\\]?\\s*", ""))


def transitional(trans: Column, course: Column, past: Column, discharge_meds: Column) -> Column:
    """Code status, follow-up laboratory work, pending tests and new medications."""
    rows = F.filter(F.transform(lines(trans), clean), lambda x: ~x.rlike("^(?:#\\s+|=+$)"))
    return let(F.transform(rows, _bracketless), lambda bare: _transitional(bare, trans, course, past, discharge_meds))


def _transitional(bare: Column, trans: Column, course: Column, past: Column, discharge_meds: Column) -> Column:
    pending = F.filter(
        bare, lambda x: F.lower(x).rlike("follow-up") & F.lower(x).rlike("culture|test")
    )
    marked = [F.when(course.rlike("(?i)" + p), F.lit(k)) for k, p in R.SCREENINGS.items()]

    def says(c: Column) -> Column:
        all_words = F.lit(True)
        for w in R.BIOPSY_WORDS:
            all_words = all_words & F.contains(F.lower(c), F.lit(w))
        return all_words

    marked.append(F.when(says(course) | says(past), F.lit(R.BIOPSY_TEXT)))
    dose, every = find(discharge_meds, R.ACETAMINOPHEN), find(discharge_meds, R.ACETAMINOPHEN_EVERY)
    started = F.array(
        _blank_to_null(trimmed(F.regexp_replace(clean(find(trans, R.NEW_MEDICATION)), "(?i)\\s*\\(new\\)", ""))),
        F.concat(F.lit("Acetaminophen "), dose, F.lit(" mg PO Q"), F.coalesce(every, F.lit("6")), F.lit("H:PRN pain")),
    )
    biweekly = F.get(F.filter(bare, lambda x: F.lower(x).rlike("biweekly") & F.upper(x).rlike("BMP")), F.lit(0))
    followup = F.when(course.rlike("(?i)" + R.PCP_CHECK), F.lit(R.PCP_CHECK_TEXT)).otherwise(
        F.coalesce(clean(find(trans, R.FOLLOWUP_LABS)), biweekly)
    )
    none = F.array().cast("array<string>")
    changes = F.struct(_filled_list(started).alias("Start"), none.alias("Stop"), none.alias("Avoid"))
    null = F.lit(None).cast("string")
    return F.struct(
        null.alias("Antibiotic Plan"),
        changes.alias("Medication Changes"),
        null.alias("Equipment Changes"),
        followup.alias("Follow-up Labs"),
        F.array_distinct(_filled_list(F.concat(pending, F.array(*marked)))).alias("Pending Tests"),
        clean(find(trans, R.CODE_STATUS)).alias("Code Status"),
        null.alias("Legal Guardian"),
    )


# --- medications and discharge ---------------------------------------------------------------


def _numbered(c: Column) -> Column:
    return _filled_list(F.transform(F.regexp_extract_all(c, F.lit(R.NUMBERED), F.lit(1)), clean))


def admission_medications(c: Column) -> Column:
    return F.filter(_numbered(c), lambda x: ~F.startswith(x, F.lit(R.PREADMISSION)))


def discharge_medications(c: Column) -> Column:
    """Numbered items, each with the text of its own ``RX *name*`` entry."""
    entries = F.transform(
        F.regexp_extract_all(c, F.lit(f"(?i)RX\\s*\\*({SHORTEST})(?=\\n\\s*\\d+\\.\\s+|\\z)"), F.lit(1)),
        lambda e: F.concat(F.lit("RX *"), clean(e)),
    )

    def with_entries(rx: Column) -> Column:
        def with_entry(item: Column) -> Column:
            start = F.concat(F.lit("rx *"), F.lower(F.regexp_extract(item, "^([A-Za-z-]+)", 1)))
            own = let(start, lambda w: F.filter(rx, lambda e: (w != "rx *") & F.startswith(F.lower(e), w)))
            return F.concat_ws(" ", item, F.get(own, F.lit(0)))

        return F.transform(items, with_entry)

    outside = F.regexp_replace(c, f"(?i)RX\\s*\\*{SHORTEST}(?=\\n\\s*\\d+\\.\\s+|\\z)", "")
    items = F.filter(_numbered(outside), lambda x: ~x.rlike(R.TABLET_FRAGMENT))
    return let(entries, with_entries)


def _diagnosis_lines(c: Column, word: str, headers: list[str]) -> Column:
    by_comma = F.contains(c, F.lit(",")) & ~F.contains(c, F.lit("\n"))
    parts = F.split(c, "\\n")
    if word == "Secondary":
        parts = F.when(by_comma, F.split(c, ",")).otherwise(parts)
    bare = F.transform(
        parts, lambda x: trimmed(F.regexp_replace(F.regexp_replace(clean(x), f"(?i)^{word}[:\\s]*", ""), "^-\\s*", ""))
    )
    return F.filter(
        bare, lambda x: (F.length(x) > 1) & ~x.rlike("^(?:Primary|Secondary)") & ~F.upper(x).isin(headers) & ~x.rlike("^=+$")
    )


def discharge(
    c: Column, primary: Column, secondary: Column, condition: Column, instructions: Column, followup: Column,
    told: Column, imaging: Column,
) -> Column:
    """How and with what the patient left; ``told`` is the text searched for secondary diagnoses."""
    words = F.array(*[F.when(told.rlike("(?i)" + p), F.lit(k)) for k, p in R.SECONDARY_WORDS.items()])
    listed = _diagnosis_lines(secondary, "Secondary", ["SECONDARY DIAGNOSES", "DIAGNOSES"])
    named = let(listed, lambda d: F.when(F.size(d) > 0, d).otherwise(_filled_list(words)))
    stones = F.lit("Cholelithiasis")
    seen = F.exists(imaging, lambda s: F.contains(s["Findings"], stones))
    second = let(
        named, lambda d: F.when(seen & ~F.array_contains(d, stones), F.array_append(d, stones)).otherwise(d)
    )
    said = _blank_to_null(clean(instructions))
    later = F.coalesce(readable(followup), let(said, lambda t: clean(first_of(t, R.FOLLOWUP_SENTENCE))))
    return F.struct(
        _blank_to_null(clean(find(c, R.DISPOSITION))).alias("Disposition"),
        readable(find(c, R.FACILITY)).alias("Facility Name"),
        _diagnosis_lines(primary, "Primary", ["PRIMARY DIAGNOSIS", "DIAGNOSIS"]).alias("Primary Diagnoses"),
        second.alias("Secondary Diagnoses"),
        F.struct(*[clean(find(condition, p)).alias(k) for k, p in R.CONDITION_FIELDS.items()]).alias("Condition"),
        said.alias("Discharge Instructions"),
        later.alias("Follow-up"),
    )


