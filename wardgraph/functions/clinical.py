"""One-line descriptions of clinical facts.

Each function takes columns and returns the text that a bundle lists for one
fact. Blank parts are left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardgraph.functions.numbers import float_text, short_text

# Texts that stand in for what is missing.
UNKNOWN = "Unknown"
NO_CLASS = "No Classification"
NOT_AVAILABLE = "N/A"


def _filled(c: Column) -> Column:
    """The column, with empty text as null."""
    return F.nullif(c, F.lit(""))


def or_default(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def medicine(drug: Column, dose: Column, unit: Column, route: Column, per_day: Column) -> Column:
    """``drug [dose unit] [route] [{n}x/day]``."""
    amount = _filled(F.trim(F.concat_ws(" ", dose, unit)))
    frequency = F.concat(_filled(short_text(F.nullif(per_day, F.lit(0.0)))), F.lit("x/day"))
    return F.concat_ws(" ", or_default(drug, UNKNOWN), amount, _filled(route), frequency)


def previous_medicine(name: Column, drug_class: Column) -> Column:
    """``name - class``."""
    return F.concat(name, F.lit(" - "), or_default(drug_class, NO_CLASS))


def lab_result(
    label: Column,
    value: Column,
    unit: Column,
    lower: Column,
    upper: Column,
    flag: Column,
    fluid: Column,
    category: Column,
) -> Column:
    """``label=value+unit (ref: lo-hi) [flag] fluid, category``."""
    measured = F.coalesce(
        F.concat(float_text(value), F.coalesce(unit, F.lit(""))), F.lit(NOT_AVAILABLE)
    )
    ref = F.concat(F.lit("(ref: "), float_text(lower), F.lit("-"), float_text(upper), F.lit(")"))
    return F.concat_ws(
        " ",
        F.concat(or_default(label, UNKNOWN), F.lit("="), measured),
        ref,
        F.concat(F.lit("["), _filled(flag), F.lit("]")),
        _filled(F.concat_ws(", ", _filled(fluid), _filled(category))),
    )


def micro_result(
    specimen: Column,
    test: Column,
    organism: Column,
    antibiotic: Column,
    dilution: Column,
    interpretation: Column,
    comments: Column,
) -> Column:
    """``specimen: test → organism | antibiotic=dilution(interpretation)``.

    Without an organism the comments follow the arrow, or nothing does.
    """
    head = F.concat(or_default(specimen, UNKNOWN), F.lit(": "), or_default(test, UNKNOWN))
    sensitivity = F.concat(
        F.lit(" | "),
        _filled(antibiotic),
        F.lit("="),
        float_text(dilution),
        F.lit("("),
        _filled(interpretation),
        F.lit(")"),
    )
    grown = F.concat(_filled(organism), F.coalesce(sensitivity, F.lit("")))
    return F.concat_ws(" → ", head, F.coalesce(grown, _filled(comments)))


def chart_measurement(
    label: Column,
    value_text: Column,
    value: Column,
    unit: Column,
    item_unit: Column,
    param_type: Column,
    low: Column,
    high: Column,
) -> Column:
    """``label with value v+unit (normal range: lo-hi)``; the range only for numeric items."""
    shown = F.coalesce(float_text(value), value_text)
    measured = F.coalesce(F.concat(shown, F.coalesce(unit, item_unit, F.lit(""))), F.lit(NOT_AVAILABLE))
    normal = F.when(
        param_type == "Numeric",
        F.concat(F.lit("(normal range: "), float_text(low), F.lit("-"), float_text(high), F.lit(")")),
    )
    return F.concat_ws(" ", or_default(label, UNKNOWN), F.lit("with value"), measured, normal)


def icu_procedure(
    category: Column,
    description: Column,
    item: Column,
    value: Column,
    unit: Column,
    low: Column,
    high: Column,
) -> Column:
    """``category (description) - item with value v+unit (Ref: lo - hi)`` with open ranges."""
    what = F.concat_ws(
        " ",
        or_default(category, UNKNOWN),
        F.concat(F.lit("("), _filled(description), F.lit(")")),
        F.lit("-"),
        or_default(item, UNKNOWN),
    )
    amount = F.concat(
        F.lit("with value "), float_text(F.nullif(value, F.lit(0.0))), F.coalesce(unit, F.lit(""))
    )
    known = low.isNotNull() | high.isNotNull()
    ref = F.when(
        known,
        F.concat(
            F.lit("(Ref: "),
            F.coalesce(float_text(low), F.lit("0")),
            F.lit(" - "),
            F.coalesce(float_text(high), F.lit("∞")),
            F.lit(")"),
        ),
    )
    return F.concat_ws(" ", what, amount, ref)


def drg_key(hadm_id: Column, drg_type: Column, drg_code: Column) -> Column:
    return F.concat_ws("_", hadm_id.cast("string"), drg_type, drg_code)


def drg_name(drg_type: Column) -> Column:
    return F.concat(drg_type, F.lit("_DRG"))


def left_ed_for_home(disposition: Column) -> Column:
    """True when the ED disposition says the patient left without admission."""
    # Words of an ED discharge.
    words = ["HOME", "DISCHARGED", "AGAINST ADVICE", "LEFT", "AMA"]
    return F.coalesce(F.upper(disposition).rlike("|".join(words)), F.lit(False))
