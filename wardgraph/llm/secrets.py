"""Secret scan with a random forest that tells secrets from other long strings.

Every run of at least ``LEAST`` token characters with a digit in it is a candidate,
however many of them a word holds (compact JSON, query strings, minified code). A run
is cut at each ``=`` or ``:`` whose following part is a candidate by itself, so that a
name and its value part; what stands before a candidate in its word is its lead. Its
features are the candidate's length, the share and
transitions of character classes, how much of it the corpus's own words cover, its
path (the source), and the words beside it. The forest is trained from labelled
findings, on a bounded sample of ``MAX_ROWS``; everything runs on Spark's built-in
functions and its forest.

``sure_labels`` labels findings by format where that is beyond doubt: a quoted
digest of 32, 40 or 64 hexadecimal digits given to a name like token or key is a
secret; mail and web addresses, network addresses and numbers are none. Other
labelled findings can be given instead.

Defined cases: null and empty texts have no findings; a null source is the empty
path; rows of equal id each have their findings; without labels of both classes the
score is the share of secrets among the labels (0.5 without any); an empty table
gives an empty table. Columns other than id, text and source don't matter.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgraph.llm.common import words, written

LEAST = 16
MAX_ROWS = 5_000
TREES, DEPTH, SEED = 20, 6, 7
SECRET = 0.5
CHARS = r"A-Za-z0-9+/=_.@:\-"
TOKEN = rf"[{CHARS}]{{{LEAST},}}"
# Where a word turns from token characters to others or back.
EDGE = rf"(?<=[{CHARS}])(?=[^{CHARS}])|(?<=[^{CHARS}])(?=[{CHARS}])"
# Where a run is cut: at "=" or ":" (not that of "://"), if what follows up to the next one is a candidate.
CUT = rf"(?!://)[=:](?=[^=:]{{{LEAST}}})(?=[^=:0-9]*[0-9])"
# A token with a digit, which is no name.
VALUE = rf"(?<![{CHARS}])(?=[A-Za-z+/=_.@:\-]*[0-9]){TOKEN}"
# Pieces of a word that count as the lead of a candidate: name, quote, mark, quote.
LEAD = 4
# Corpus words of three letters or more, seen so often per million words, make the dictionary.
DICTIONARY_PER_MILLION = 20
# Names that secrets are given to, and paths that hold made-up ones.
NAMES = "token|secret|passw|pwd|api|key|auth|credential|bearer|private"
MADE_UP = "test|example|sample|spec|mock|fixture|demo"

FEATURES = [
    "length", "digit_share", "upper_share", "hex_share", "letter_digit_changes", "case_changes", "vowel_changes", "distinct_share", "marks_share",
    "coverage", "path_depth", "path_made_up", "name_before", "assigned", "quoted", "mail_like", "number_beside", "word_after",
]


def _share(candidate: Column, pattern: str) -> Column:
    return F.regexp_count(candidate, F.lit(pattern)) / F.length(candidate)


def dictionary(docs: DataFrame, text: str = "text", per_million: int = DICTIONARY_PER_MILLION) -> DataFrame:
    """Frequent words of the whole corpus, in lower case."""
    each = docs.select(F.explode_outer(words(F.col(text), r"[A-Za-z]{3,}")).alias("word")).filter("word IS NOT NULL")
    counts = written(each.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n")), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return written(counts.join(total, F.col("n") * 1_000_000 >= per_million * F.col("total")).select("word"), "dictionary")


def _values(piece: Column) -> Column:
    """The candidates of a run, each with the text of the run before it."""
    cuts = F.split(piece, CUT, -1)
    each = F.transform(cuts, lambda x, i: F.struct(i.alias("cut"), x.alias("candidate"), F.when(i > 0, F.concat(F.get(cuts, i - 1), F.lit("="))).otherwise("").alias("head")))
    return F.filter(each, lambda x: (F.length(x["candidate"]) >= LEAST) & x["candidate"].rlike("[0-9]"))


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc, place, part, path, word, candidate, lead, before, named, after): every candidate with the position of its word in the text and its own among the pieces of the word."""
    w, pieces = F.col("w"), F.col("pieces")
    each = docs.filter(F.col(text).rlike(TOKEN)).select(F.col(doc_id).alias("doc"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("path"), words(F.col(text)).alias("w"))
    each = each.select("doc", "path", "w", F.posexplode_outer("w").alias("place", "word")).filter(F.col("word").rlike(TOKEN) & F.col("word").rlike("[0-9]"))
    beside = {"before": -1, "named": -2, "after": 1}
    each = each.select("doc", "place", "path", "word", *[F.coalesce(F.get(w, F.col("place") + k), F.lit("")).alias(c) for c, k in beside.items()])
    each = each.withColumn("pieces", F.split("word", EDGE, -1)).select("*", F.posexplode("pieces").alias("piece", "run")).filter(F.col("run").rlike(f"^{TOKEN}$") & F.col("run").rlike("[0-9]"))
    ahead = F.array_join(F.slice(pieces, F.greatest(F.col("piece") - LEAD, F.lit(0)) + 1, F.least(F.col("piece"), F.lit(LEAD))), "")
    each = each.select("doc", "place", "path", "word", *beside, "piece", ahead.alias("ahead"), F.explode(_values(F.col("run"))).alias("value"))
    # Other candidates are no names.
    lead = F.regexp_replace(F.when(F.col("value.cut") > 0, F.col("value.head")).otherwise(F.col("ahead")), VALUE, "")
    return each.select("doc", "place", F.struct("piece", "value.cut").alias("part"), "path", "word", F.col("value.candidate").alias("candidate"), lead.alias("lead"), *beside)


def _name() -> Column:
    """What a candidate is given to: its lead if that assigns something to a name, else the words before it too."""
    lead, beside = F.col("lead"), F.regexp_replace(F.concat_ws(" ", "named", "before"), VALUE, "")
    return F.when(lead.rlike(r"[A-Za-z]\w*\W*[=:]"), lead).otherwise(F.concat_ws(" ", beside, lead))


def featured(found: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates with their features."""
    c = F.col("candidate")
    parts = found.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all("candidate", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("part"))
    covered = parts.join(known, F.lower("part") == F.col("word")).groupBy("candidate").agg(F.sum(F.length("part")).alias("covered"))
    joined = found.join(covered, "candidate", "left")
    made = {
        "length": F.length(c),
        "digit_share": _share(c, "[0-9]"),
        "upper_share": _share(c, "[A-Z]"),
        "hex_share": _share(c, "[0-9a-fA-F]"),
        "letter_digit_changes": _share(c, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "case_changes": _share(c, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "vowel_changes": _share(c, "(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])"),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "marks_share": _share(c, r"[+/=_.@:\-]"),
        "coverage": F.coalesce(F.col("covered"), F.lit(0)) / F.length(c),
        "path_depth": F.regexp_count("path", F.lit("/")),
        "path_made_up": F.col("path").rlike(f"(?i){MADE_UP}"),
        "name_before": _name().rlike(f"(?i){NAMES}"),
        "assigned": F.concat("before", "lead", "candidate").rlike("[=:]"),
        "quoted": F.col("lead").rlike("[\"'`][^A-Za-z0-9]*$"),
        "mail_like": c.rlike(r"@[A-Za-z0-9\-]+\."),
        "number_beside": F.col("before").rlike("[0-9]") | F.col("after").rlike("[0-9]"),
        "word_after": F.col("after").rlike(r"^\p{L}"),
    }
    return joined.select("doc", "place", "part", "path", "word", "candidate", "lead", "before", "named", "after", *[made[f].cast("double").alias(f) for f in FEATURES])


def sure_labels(found: DataFrame) -> Column:
    """1 for a secret, 0 for none, null where the format does not say."""
    c, name = F.col("candidate"), _name()
    digest = c.rlike("^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$")
    secret = digest & name.rlike(rf"(?i)(?:{NAMES})\w*\W*[=:]") & F.col("lead").rlike("[\"']$")
    none = c.rlike(r"@|^[0-9.:\-]+$|://")
    return F.when(secret, 1.0).when(none, 0.0)


def train(found: DataFrame, label: Column, max_rows: int = MAX_ROWS):
    """A forest from up to ``max_rows`` labelled findings (those of least hash), or the share of secrets where one class is missing."""
    labelled = found.withColumn("label", label).filter("label IS NOT NULL").withColumn("order", F.xxhash64("doc", "place", "part", "candidate"))
    sample = written(labelled.select("label", "order", *FEATURES).orderBy("order", *FEATURES).limit(max_rows), "labelled")
    secrets, total = sample.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if secrets == 0 or secrets == total:
        return secrets / total if total else 0.5
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features").fit(rows)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", label: Column | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc, place, part, path, candidate, score, secret): all candidates with the forest's share of votes for a secret."""
    found = written(featured(candidates(docs, text, doc_id, source), dictionary(docs, text)), "findings")
    model = train(found, sure_labels(found) if label is None else label, max_rows)
    if isinstance(model, float):
        scored = found.withColumn("score", F.lit(model))
    else:
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
        scored = model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), 1))
    return scored.select("doc", "place", "part", "path", "candidate", "score", (F.col("score") >= SECRET).alias("secret"))
