"""One file a document: all or none, whatever tasks are tried again, run twice or fail."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import files, folders


def tree(folder):
    return {os.path.relpath(os.path.join(at, name), folder): open(os.path.join(at, name)).read() for at, _, names in os.walk(folder) for name in names if not name.startswith(".")}


def test_files_appear_together_and_replace_each_other(spark, tmp_path):
    rows = spark.createDataFrame([(f"b{i % 3}/f{i}.json", f"text {i} é") for i in range(40)], "path string, content string").repartition(5)
    assert files.write(rows, str(tmp_path)).count() == 0
    assert tree(tmp_path) == {f"b{i % 3}/f{i}.json": f"text {i} é" for i in range(40)}
    files.write(spark.createDataFrame([("b0/f0.json", "new"), ("x", None)], "path string, content string"), f"file:{tmp_path}")
    got = tree(tmp_path)
    assert got["b0/f0.json"] == "new" and got["x"] == "" and len(got) == 41 and not [x for x in os.listdir(tmp_path) if x.startswith(".staging")]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    @F.udf("string")
    def broken(i):
        if i == 39:
            raise ValueError("no")
        return "x"

    rows = spark.range(40).repartition(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), broken("id").alias("content"))
    with pytest.raises(Exception, match="no"):
        files.write(rows, str(tmp_path / "out"))
    # A task that was still running when the job was given up may stage a file after that, in a hidden folder.
    assert [x for x in os.listdir(tmp_path / "out") if not x.startswith(".staging-")] == []


def test_of_a_task_that_ran_twice_one_attempt_counts(tmp_path):
    class Row:
        def __init__(self, path, content):
            self.path, self.content = path, content

    writer = files.FilesWriter(str(tmp_path), "run")
    first, second = (writer.write(iter([Row("a", x), Row("d/b", x)])) for x in ("one", "two"))
    other = writer.write(iter([Row("c", "c"), Row("../out", "no")]))
    assert tree(tmp_path / ".staging-run") != {} and first.attempt != second.attempt
    writer.commit([second, None, other])
    got = tree(tmp_path)
    lost = got.pop(next(x for x in got if x.startswith(files.NOT_SAVED)))
    assert {k: v for k, v in got.items() if k in ("a", "d/b", "c")} == {"a": "two", "d/b": "two", "c": "c"} and "../out" in lost
    assert not (tmp_path / ".staging-run").exists() and not (tmp_path.parent / "out").exists()
    again = files.FilesWriter(str(tmp_path / "none"), "run")
    again.write(iter([Row("a", "x")]))
    again.abort([])
    assert tree(tmp_path / "none") == {}


def test_documents_that_cannot_be_saved_are_rows(spark, tmp_path):
    rows = [("1", "a.pdf", True, "{}"), ("2", "A.txt", True, None), ("3", "a", False, "[]"), ("4", "n" * 300 + ".pdf", True, "{}")]
    d = spark.createDataFrame(rows, "doc_id string, name string, valid boolean, result string")
    got = {x["doc_id"]: (x["saved_path"], bool(x["error"])) for x in folders.write_documents(d, str(tmp_path)).collect()}
    assert got["1"] == (f"{tmp_path}/valid/a.json", False) and got["2"] == (f"{tmp_path}/valid/A_2.json", False) and got["3"] == (f"{tmp_path}/validation_failed/a.json", False)
    assert got["4"] == (None, True)
    assert tree(tmp_path / "valid") == {"a.json": "{}", "A_2.json": "null"}
