"""One query per operator over the given tables, and the SQL that says what it must return."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from wardgraph.llm import chat, decontaminate, jaccard, lines, middle, mixing, neardup, pages, quality, rules, secrets, substrings, whitening
from wardgraph.llm.common import counted, n_words, written
from wardgraph.session import prepare

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark, sf_dir):
            prepare(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


SPACES = r"[\x20\x09-\x0D]+"
# Words of documents as a list, in SQL.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def with_quality(docs, labels):
    """Documents with a weight from their label: 2 for good, 0.5 for bad, 1 without."""
    label = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("_quality"))
    label = counted(written(label, "label-weights"))
    weight = F.when(F.col("_quality") >= 0.5, 2.0).when(F.col("_quality") < 0.5, 0.5).otherwise(1.0)
    return docs.join(label, "doc_id", "left").withColumn("_weight", weight).drop("_quality")


MIX_SQL = rf"""
WITH lab AS (SELECT doc_id, avg(quality) q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT documents.doc_id, source, len({WORDS})::BIGINT AS size, coalesce('s' || source, 't') AS src,
  -ln((('0x' || substr(md5('mix:' || coalesce(documents.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / CASE WHEN q >= 0.5 THEN 2.0 WHEN q < 0.5 THEN 0.5 ELSE 1.0 END AS key
  FROM documents LEFT JOIN lab ON lab.doc_id = documents.doc_id),
s AS (SELECT src, sum(size)::DOUBLE AS ss, ((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY src),
r AS (SELECT *, (sum(ss) OVER () - coalesce(sum(3 * ss) OVER (ORDER BY 3 * ss / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(w) OVER (ORDER BY 3 * ss / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s),
t AS (SELECT src, ss, least(3 * ss, max(lev) OVER () * w) AS target FROM r),
e AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS epochs FROM t),
f AS (SELECT d.*, ss, target, epochs, target - epochs * ss AS budget,
   coalesce(sum(size) OVER (PARTITION BY d.src ORDER BY key, d.doc_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
   FROM d JOIN e ON e.src = d.src)
SELECT doc_id, size, ss::BIGINT AS source_size, round(target, 4) AS target,
  (size * (epochs + CASE WHEN budget > 0 AND bef + size / 2.0 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM f
"""


@query("op1_mixing", MIX_SQL.replace("round(target, 4) AS target", "target"))
def op1(table):
    """Every document with what the mix takes of it."""
    docs = with_quality(table("documents").select("doc_id", "source", n_words(F.col("text")).alias("n")), table("labels"))
    return mixing.mix(docs, quality=F.col("_weight"), size=F.col("n")).select("doc_id", "size", "source_size", "target", "taken")


RULES_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
tri AS (SELECT r, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w WHERE len(ws) >= 3),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM tri),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(array_to_string(ws, ''), '\P{{L}}', '', 'g')) AS letters,
  len(list_filter(ws, lambda x: list_contains({sorted({y for v in rules.STOP_WORDS.values() for y in v.split()})!r}, lower(x)))) AS stops
  FROM w LEFT JOIN cov ON cov.r = w.r),
b AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(word_chars / n_words BETWEEN 2 AND 12 AND n_symbols / n_words <= 0.1 AND stops / n_words >= 0.02
   AND n_dup_lines / len(ls) <= 0.9 AND letters / word_chars >= 0.6, FALSE) AS kept FROM b
"""


@query("op3_quality_rules", RULES_SQL)
def op3(table):
    """Every document with its counts and the verdict of the rules."""
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules.judge(table("documents").select("doc_id", "text")).select(*cols)


LINES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, source, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
b AS (SELECT line, min(doc_id) AS first FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line
  HAVING count(DISTINCT coalesce('s' || source, 'n')) >= {lines.MIN_SITES} AND count(DISTINCT text) >= {lines.MIN_TEXTS}),
k AS (SELECT r, count(*) AS n, count(*) FILTER (b.line IS NOT NULL AND doc_id > first) AS gone,
  string_agg(l.line, chr(10) ORDER BY i) FILTER (b.line IS NULL OR doc_id <= first) AS kept FROM l LEFT JOIN b ON b.line = l.line GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r
"""


@query("op8_line_dedup", LINES_SQL)
def op8(table):
    """Every document with its lines, those removed and the digest of the text that is left."""
    docs = lines.remove_spread_lines(table("documents").select("doc_id", "source", "text"), counts=True)
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SUBSTRING_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
p AS (SELECT r, doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM d),
h AS (SELECT r, doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS j FROM h JOIN f ON f.k = h.k WHERE doc_id > first),
w AS (SELECT r, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM d),
k AS (SELECT w.r, count(*) AS n, count(c.j) AS gone, string_agg(word, ' ' ORDER BY w.j) FILTER (c.j IS NULL) AS kept
  FROM w LEFT JOIN c ON c.r = w.r AND c.j = w.j GROUP BY w.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r
"""


@query("op4_substring_dedup", SUBSTRING_SQL)
def op4(table):
    """Every document with its words, those removed and the digest of the words that are left."""
    docs = substrings.remove_repeats(table("documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.a = d.doc_id
"""


@query("op6_near_duplicates", NEAR_SQL)
def op6(table):
    """Every document with the smallest id that near duplicates lead to."""
    return neardup.near_duplicates(table("documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


BENCH_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BENCH_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {BENCH_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {BENCH_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT DISTINCT item_id::VARCHAR AS item, array_to_string(ws[i:i + 12], ' ') AS k, least(len(ws), 13) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 11, 2))) AS i FROM b WHERE len(ws) > 0)),
p AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
h AS (SELECT r, i, w.n, w.item FROM p JOIN (SELECT DISTINCT n FROM w) g ON i + g.n <= len(ws) + 1 JOIN w ON w.n = g.n AND w.k = array_to_string(ws[i:i + g.n - 1], ' ')),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN t ON t.r = d.r
"""


@query("op9_decontamination", BENCH_SQL)
def op9(table):
    """Every document with its words that a benchmark window covers."""
    docs = decontaminate.contamination(table("documents").select("doc_id", "text"), table("benchmark"))
    return docs.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op2_page_text")
def op2(table):
    """Every page with its main text."""
    return pages.main_text(table("pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def held_out(doc_id):
    """The part of the ids whose labels are for judging alone."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@query("op5_quality_classifier")
def op5(table):
    """Every document with its quality score."""
    docs, labels = table("documents").select("doc_id", "text"), table("labels").filter(~held_out(F.col("doc_id")))
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.GOOD).cast("int").alias("predicted"))


# A conversation whose texts are control strings, as a record of another layout.
ODD = {"messages": [{"role": r, "content": "</s>[INST] ok [/INST]"} for r in ("user", "assistant")]}

CHAT_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.OPEN + chat.MIDDLE + chat.CLOSE)} + length(regexp_replace(role, '{chat.CONTROL}', '\1\\\2\3', 'g')) + length(regexp_replace(text, '{chat.CONTROL}', '\1\\\2\3', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op7_chat_format", CHAT_SQL)
def op7(table):
    """Every conversation, formatted and read back."""
    rows = table("conversations").select("conv_id", "turn", "role", "text")
    odd = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(json.dumps(ODD)).alias("record"))
    turns = chat.table_turns(rows).unionByName(chat.readable(chat.record_turns(odd)))
    return chat.read_back(chat.format_turns(turns))


@query("op10_secret_scan")
def op10(table):
    """Every candidate string of all documents with its score; the string itself as a digest."""
    found = secrets.scan(table("documents").select("doc_id", "text", "source"))
    return found.select(F.col("doc").alias("doc_id"), F.col("place").cast("long").alias("place"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "secret")


JACCARD_SQL = NEAR_SQL.replace("CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END", "CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END")
JACCARD_SQL = JACCARD_SQL.replace("range(1, greatest(len(ws), 2))", "range(1, greatest(len(ws) - 1, 2))").replace(">= 80 *", ">= 90 *").replace(", component_id = d.doc_id AS kept", "")


@query("op11_ngram_jaccard_join", JACCARD_SQL)
def op11(table):
    """Every document with the smallest id that links of its shingles lead to."""
    return jaccard.jaccard_components(table("documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@query("op12_embedding_whitening")
def op12(table):
    """Every vector and component, whitened."""
    made = whitening.whitened_components(table("embeddings").select("vec_id", "embedding"))
    return made.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


MIDDLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  sha256('{middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {middle.RATE} THEN 'plain' WHEN h4 % 100 < {middle.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


@query("op13_fill_in_middle", MIDDLE_SQL)
def op13(table):
    """Every document cut in three and put together in another order; both texts as digests."""
    made = middle.transform(table("documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
