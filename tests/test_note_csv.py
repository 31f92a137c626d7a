"""CSV files with line breaks in quotes, read in splits of any size."""

import pytest

from wardgraph.sources import files

SCHEMA = "note_id string, subject_id bigint, text string"
SPLIT = "spark.sql.files.maxPartitionBytes"


def texts(n):
    kinds = ['plain {i}', 'two\nlines {i}', 'a "quoted" word, {i}\n\n"\nend', '""\n', ',\n' * 40 + '{i}', 'x' * 300 + '\r\ny {i}', 'é – {i}\n"']
    return [kinds[i % len(kinds)].replace("{i}", str(i)) for i in range(n)]


def write(path, rows, header, end="\n"):
    def cell(x):
        x = "" if x is None else str(x)
        return '"' + x.replace('"', '""') + '"' if any(c in x for c in '",\n\r') else x

    body = [header, *[",".join(cell(x) for x in r) for r in rows]]
    path.write_bytes((end.join(body) + end).encode())


@pytest.fixture
def split_bytes(spark):
    before = spark.conf.get(SPLIT)
    yield lambda n: spark.conf.set(SPLIT, str(n))
    spark.conf.set(SPLIT, before)


@pytest.mark.parametrize("size", [64, 700, 10_000_000])
def test_rows_of_one_file_in_any_splits(spark, tmp_path, split_bytes, size):
    made = [(f"n{i}", i, t) for i, t in enumerate(texts(120))]
    made[5] = ("n5", None, None)
    write(tmp_path / "notes.csv", made, "note_id,subject_id,text")
    split_bytes(size)
    got = files.notes_csv_scan(spark, str(tmp_path / "notes.csv"), SCHEMA)
    assert sorted(map(tuple, got.collect())) == sorted(made)
    lines = spark.read.text(str(tmp_path / "notes.csv"), lineSep="\n")
    if size < 1000:
        assert lines.rdd.getNumPartitions() > 10


def test_a_record_over_many_splits(spark, tmp_path, split_bytes):
    made = [("a", 1, "start"), ("b", 2, "line\n" * 2000 + '"end"'), ("c", 3, "stop")]
    write(tmp_path / "n.csv", made, "note_id,subject_id,text")
    split_bytes(500)
    assert sorted(map(tuple, files.notes_csv_scan(spark, str(tmp_path / "n.csv"), SCHEMA).collect())) == made


def test_headers_of_each_file(spark, tmp_path):
    write(tmp_path / "a.csv", [("a", 1, "x\ny")], "note_id,subject_id,text", end="\r\n")
    write(tmp_path / "b.csv", [("u\nv", "b", "more", "two")], "text,note_id,other,subject_id")
    write(tmp_path / "c.csv", [(3, "c")], "subject_id,note_id")
    write(tmp_path / "d.csv", [], "note_id,subject_id,text")
    (tmp_path / "e.csv").write_bytes(b"")
    got = files.notes_csv_scan(spark, str(tmp_path), SCHEMA)
    assert sorted(map(tuple, got.collect())) == [("a", 1, "x\ny"), ("b", None, "u\nv"), ("c", 3, None)]


def test_lines_are_split_and_moved_by_split(spark, tmp_path):
    write(tmp_path / "a.csv", [("a", 1, "x\ny")], "note_id,subject_id,text")
    scan = files.notes_csv_scan(spark, str(tmp_path), SCHEMA)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" not in plan and "FileScan text" in plan
    # No text moves by its file alone, which would be one task for one large file.
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning(file" in x and "block" not in x and "of#" not in x]
    assert all("record" not in x and "value" not in x for x in moved)
    assert files.optional(spark, lambda: files.notes_csv_scan(spark, str(tmp_path / "none"), SCHEMA), SCHEMA).collect() == []


def test_text_files_in_line_order(spark, tmp_path):
    lines = spark.createDataFrame([(k % 7, k, f"{k % 7} {k:04}") for k in range(500)], "subject_id int, n int, line string").repartition(5)
    files.text_sink(lines, str(tmp_path / "report"), ["subject_id", "n"], "line")
    found = [x for f in sorted((tmp_path / "report").glob("part-*")) for x in f.read_text().splitlines()]
    assert found == sorted(found) and len(found) == 500


def test_texts_are_delivered_by_many_tasks(spark, tmp_path, monkeypatch):
    """No task writes all texts; texts come back whole from all the files."""
    from wardgraph.suite import tables
    from wardgraph.suite.views import Views

    rows = [(i, 'a "quoted"\nline, %d\n' % i, "en") for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(tables, "_path", lambda v, name: str(tmp_path / name))
    got = tables.s4_notes(Views(spark, str(tmp_path))).collect()
    assert len(list((tmp_path / "texts.csv").glob("part-*.csv"))) > 1
    assert sorted((r.doc_id, r.chars, r.lang) for r in got) == [(i, len(t), k) for i, t, k in rows]
