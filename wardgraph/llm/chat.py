"""Chat formatting: layouts told by schema fingerprints, one template, exact loss spans.

A fingerprint is the hash of nested field paths, whatever the types of their values.
``LAYOUTS`` declares for each known layout its paths and where roles and texts stand.
Of a table (``table_turns``, by its schema) or a JSON record (``record_turns``) those
paths are hashed that a layout names; further fields change nothing. Either gives
canonical turns (conv_id, turn, role, text). ``format_turns`` writes a conversation's
turns in order between the template's marks, escapes control strings inside texts so
that they can be read back, and lists the spans of assistant texts in code points.

Defined cases: null texts and roles are empty; null conversation ids form one
conversation; turns of equal number are ordered by role and text, repeated turns stay;
if several layouts fit, the one that names most fields is taken, then the first; a
record without a fitting layout, without turns or that is no JSON object keeps one row
without turn, with the reason in ``unread``, and ``readable`` leaves it out; a table
without a fitting layout is an error; an optional field that is null gives no turn;
an empty table gives an empty table; other
columns, of whatever names, are left aside. Texts may be of any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template: <s>[ROLE]role[/ROLE]text</s> for each turn.
OPEN, MIDDLE, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"
# Control strings, parted after their first character; a backslash between the
# parts, or one more where there are some, makes text of them.
CONTROL = r"([<\[])(\\*)(/?s>|/?ROLE\]|/?INST\]|<?/?SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?ROLE\]|/?INST\]|<?/?SYS>>)"


@dataclass(frozen=True)
class Layout:
    """Field paths (``a.b``, ``list[].c``), those that may be missing, and where turns come from.

    ``turns``: (role, path) in order, or ``items``: (list, role field, text field).
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    roles: dict = field(default_factory=dict, hash=False)

    def fingerprints(self) -> list[str]:
        """One for each choice of optional paths."""
        return [fingerprint([*self.paths, *extra]) for k in range(len(self.optional) + 1) for extra in combinations(self.optional, k)]


LAYOUTS = (
    Layout("rows", ("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), items=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), items=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction", ("instruction", "output"), ("system", "input"), turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt", ("prompt", "response"), ("system",), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("completion", ("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
)


def fingerprint(paths: list[str]) -> str:
    """Hash of nested field paths, each once and in order."""
    return hashlib.md5("\n".join(sorted(set(paths))).encode()).hexdigest()


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a table's schema."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return [at]


def record_paths(value: Column, layouts) -> Column:
    """Those paths of a variant that some layout names, sorted; null unless it is an object."""
    named = sorted({p for x in layouts for p in (*x.paths, *x.optional)})
    fields = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))

    def held(path: str) -> Column:
        if "[]." in path:
            name, key = path.split("[].", 1)
            items = F.try_variant_get(value, f"$.{name}", "array<map<string,variant>>")
            return F.exists(items, lambda x: F.array_contains(F.map_keys(x), key))
        *above, key = path.split(".")
        own = F.map_keys(F.try_variant_get(value, "$." + ".".join(above), "map<string,variant>")) if above else fields
        return F.array_contains(own, key)

    return F.when(fields.isNotNull(), F.filter(F.array(*[F.when(held(p), F.lit(p)) for p in named]), lambda p: p.isNotNull()))


def record_layout(paths: Column, layouts) -> Column:
    """Number of the layout whose fingerprint the record's paths have, among the paths it names; null if none.

    Of several the one that names most of the record's paths, then the first.
    """
    found = []
    for n, layout in enumerate(layouts):
        if not layout.items and not layout.turns:
            continue
        own = F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, (*layout.paths, *layout.optional)))))
        known = F.md5(F.array_join(own, "\n")).isin(layout.fingerprints())
        found.append(F.when(known, F.struct((-F.size(own)).alias("fewer"), F.lit(n).alias("n"))))
    return F.array_min(F.array(*found))["n"]


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _role(role: Column, layout: Layout) -> Column:
    for old, new in layout.roles.items():
        role = F.when(role == old, new).otherwise(role)
    return role


def _turns(layout: Layout, get_text, get_items) -> Column:
    """The turns of a record as an array; ``get_*`` read a path or a list of (role, text)."""
    if layout.items:
        return F.transform(get_items(layout.items), lambda x: _turn(_role(x["role"], layout), x["text"]))
    turns = F.array(*[_turn(F.lit(role), get_text(path)) for role, path in layout.turns])
    there = F.array(*[get_text(path).isNotNull() if path in layout.optional else F.lit(True) for _, path in layout.turns])
    return F.filter(turns, lambda x, i: F.get(there, i))


def _rows(df: DataFrame, *more: str) -> DataFrame:
    explode = F.posexplode_outer if more else F.posexplode
    return df.select("conv_id", *more, explode("turns").alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text", *more)


def table_turns(df: DataFrame, conv_id: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """Canonical turns of a table; the layout is selected by the fingerprint of those paths of its schema that it names."""
    paths = schema_paths(df.schema)
    fits = []
    for n, layout in enumerate(layouts):
        own = [p for p in paths if p in (*layout.paths, *layout.optional)]
        if fingerprint(own) in layout.fingerprints():
            fits.append((-len(own), n, layout))
    if not fits:
        raise ValueError(f"no layout has the fields {sorted(paths)}")
    layout = min(fits)[2]
    if not layout.items and not layout.turns:
        return df.select(F.col(conv_id).alias("conv_id"), "turn", "role", "text")

    def items(at):
        name, role, text = at
        return F.transform(F.col(name), lambda x: F.struct(x[role].cast("string").alias("role"), x[text].cast("string").alias("text")))

    return _rows(df.select(F.col(conv_id).alias("conv_id"), _turns(layout, lambda p: F.col(p).cast("string") if p in paths else F.lit(None).cast("string"), items).alias("turns")))


def record_turns(df: DataFrame, record: str = "record", conv_id: str = "conv_id", layouts=LAYOUTS, keep_unknown: bool = True) -> DataFrame:
    """Canonical turns of JSON records of mixed layouts; each record's fingerprint selects its mapping.

    A record that gives no turns is one row without turn, and ``unread`` says why; ``unread`` is null in all other rows.
    """
    value = F.try_parse_json(F.col(record))
    read = df.select(F.col(conv_id).alias("conv_id"), value.alias("value")).withColumn("paths", record_paths(F.col("value"), layouts))
    read = read.withColumn("layout", record_layout(F.col("paths"), layouts))

    def text(path):
        return F.try_variant_get("value", f"$.{path}", "string")

    def items(at):
        name, role, text = at
        found = F.try_variant_get("value", f"$.{name}", f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(found, lambda x: F.struct(x[role].alias("role"), x[text].alias("text")))

    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for n, layout in enumerate(layouts):
        if layout.items or layout.turns:
            turns = F.when(F.col("layout") == n, _turns(layout, text, items)).otherwise(turns)
    why = F.when(F.col("paths").isNull(), "no JSON object").when(F.col("layout").isNull(), "no known layout").when(F.coalesce(F.size("turns"), F.lit(0)) <= 0, "no turns")
    rows = _rows(read.withColumn("turns", turns).withColumn("unread", why), "unread")
    return rows if keep_unknown else rows.where(F.col("unread").isNull())


def readable(turns: DataFrame) -> DataFrame:
    """The turns of ``record_turns`` that were read, as ``format_turns`` takes them."""
    return turns.where(F.col("unread").isNull()).drop("unread")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): each conversation as one text, and the spans (start, end) of assistant texts in code points.

    A conversation is the unit of the result; its turns meet in one row.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))).withColumn("body", escape(F.col("text")))
    size = F.length("head") + F.length("body") + len(CLOSE)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).withColumn("end", F.sum(size.cast("long")).over(order) - len(CLOSE))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("end") - F.length("body")).alias("start"), "end"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(CLOSE)).alias("piece")))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss"))
    return grouped.select("conv_id", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), "loss")


def unescape(text: str) -> str:
    return re.sub(ESCAPED, r"\1\2\3", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    found = []
    for piece in formatted.split(CLOSE)[:-1]:
        role, _, text = piece.removeprefix(OPEN).partition(MIDDLE)
        found.append((unescape(role), unescape(text)))
    return found


BACK = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made: list[list] = [[] for _ in range(5)]
        for formatted, loss in zip(batch.column("formatted"), batch.column("loss")):
            formatted = formatted.as_py()
            turns, digest = read_turns(formatted), hashlib.sha256()
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode())
            learned, chars = hashlib.sha256(), 0
            for span in loss.as_py():
                text = unescape(formatted[span["start"] : span["end"]])
                learned.update(text.encode())
                chars += len(text)
            for out, value in zip(made, (len(turns), digest.hexdigest(), chars, learned.hexdigest(), len(formatted))):
                out.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(x, k) for x, k in zip(made, kinds)]], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of turns and of the text under the loss mask, read from the formatted texts."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_back, f"conv_id {kind}, {BACK}")
