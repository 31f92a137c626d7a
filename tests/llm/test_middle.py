"""Fill-in-the-middle beside a plain version, on hard rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from wardgraph.llm import middle

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
HARD = [
    (1, " \n\t"), (2, None), (3, ""), (4, "a <P> b"), (5, "x " * 200_000), (6, "  é\U0001f600 $1 \\ b  "), (7, "  a b \x0b c\r\n"), (None, "a b c d"),
    (8, "ends with <"), (9, "P> starts and <S ends"), (10, "one"), (10, "one"), (10, "other words of the same id"), (11, "}{2}+ (a) [b \x1c c d"),
]


def plain_version(doc_id, text, rate=50):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", text, None, None
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@pytest.mark.parametrize("rate", [50, 100])
def test_like_the_plain_version_and_back(spark, rate):
    rows = HARD + [(100 + i, " ".join(f"w{j}" for j in range(i))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = middle.transform(docs, rate=rate).withColumn("back", middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(made) == len(rows)
    for r in made:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == plain_version(r.doc_id, r.text, rate)
        assert r.back == (r.text or "")
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y", 5)], "doc_id long, text string, form string, output string, other int")
    assert middle.transform(docs).columns == ["doc_id", "text", "other", "n", "form", "output", "prefix_chars", "middle_chars"]
    assert middle.transform(docs).collect()[0]["n"] == 3
    assert middle.transform(docs.limit(0)).collect() == []
