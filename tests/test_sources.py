"""Readers and writers on awkward files."""

from __future__ import annotations

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.sources import files, paged


def written(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_lines_end_at_line_feeds_alone(spark, tmp_path):
    rows = [{"id": "1", "text": "a\u0085b c"}, {"id": "2", "text": "d"}]
    path = written(tmp_path, "x.jsonl", "\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    assert [(r["id"], r["text"]) for r in files.read_strict(spark, path, "id string, text string").orderBy("id").collect()] == [("1", "a\u0085b c"), ("2", "d")]


def test_one_line_is_one_row(spark, tmp_path):
    path = written(tmp_path, "x.jsonl", '{"id": "1"}')
    assert files.read_any(spark, path, "id string").count() == 1


def test_an_array_or_an_object_a_file(spark, tmp_path):
    path = written(tmp_path, "x.json", '[{"id": "1"},\n {"id": "2"}]')
    assert files.read_any(spark, path, "id string").count() == 2


def test_strict_and_lenient(spark, tmp_path):
    path = written(tmp_path, "x.jsonl", '{"id": "1"}\nbroken\n{"id": "2"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_strict(spark, path, "id string").collect()
    rows = files.read_lenient(spark, path, "id string").select("id", "_bad").collect()
    assert sorted(str(r["id"]) for r in rows) == ["1", "2", "None"]
    assert [r["_bad"] for r in rows if r["id"] is None] == ["broken"]


def test_csv_fields_with_quotes_and_line_feeds(spark, tmp_path):
    rows = [("1", 'he said "yes", twice'), ("2", "two\nlines"), ("3", " padded ")]
    folder = str(tmp_path / "c")
    files.write_csv(spark.createDataFrame(rows, "id string, text string"), folder)
    assert sorted(tuple(r) for r in files.read_csv(spark, [folder], "id string, text string").collect()) == rows


def test_folders_give_labels(spark, tmp_path):
    written(tmp_path, "d/one.jsonl", '{"id": "1"}\n')
    written(tmp_path, "d/deep/two.jsonl", '{"id": "2"}\n')
    written(tmp_path, "d/other.txt", "x")
    assert sorted((r["id"], r["label"]) for r in files.read_folder(spark, str(tmp_path / "d"), "id string").collect()) == [("1", "one"), ("2", "two")]


def test_ids_resolve_over_names(spark):
    rows = spark.createDataFrame([(None, "u", 0), ("", None, 1), ("a", "b", 2), (" ", "", 3)], "id string, uid string, row_index long")
    found = rows.select(files.resolved_id(rows.columns, "row_index").alias("id")).collect()
    assert [r["id"] for r in found] == ["u", "1", "a", "3"]


def test_routing_must_be_whole(spark):
    texts = spark.createDataFrame([("1", "t")], "id string, text string")
    row = lambda k, i, s: spark.createDataFrame([(k, i, s, ["n"])], "id string, top_k_indices array<int>, top_k_scores array<double>, top_k_node_names array<string>")
    assert files.checked_routing(row("1", [1, 2], [0.5, 0.5]), texts).first()["top_k_node_names"] is None
    with pytest.raises(Exception, match="differ in length"):
        files.checked_routing(row("1", [1, 2], [0.5]), texts).collect()
    with pytest.raises(Exception, match="no text"):
        files.checked_routing(row("2", [1], [0.5]), texts).collect()


def test_centroids_of_arrays(spark, tmp_path):
    data = io.BytesIO()
    np.save(data, np.arange(6, dtype=np.float32).reshape(2, 3))
    path = written(tmp_path, "c.npy", data.getvalue())
    assert [r["c"] for r in files.read_centroids(spark, path).orderBy("node_id").collect()] == [[0, 1, 2], [3, 4, 5]]


def test_cluster_dictionaries_in_either_orientation(spark):
    one = spark.createDataFrame([({"cluster1": ["s1", "s2"]},)], "m map<string,array<string>>")
    other = spark.createDataFrame([({"s3": ["cluster1", "cluster2"]},)], "m map<string,array<string>>")
    assert sorted(tuple(r) for r in files.cluster_members(one).unionByName(files.cluster_members(other)).collect()) == [("cluster1", "s1"), ("cluster1", "s2"), ("cluster1", "s3"), ("cluster2", "s3")]


def test_resume_leaves_what_is_not_written(spark, tmp_path):
    rows = spark.range(10)
    files.write_json(rows.where("id < 4"), str(tmp_path / "out"))
    assert files.not_yet_written(rows, spark, str(tmp_path / "out"), "id long", "id").agg(F.min("id")).first()[0] == 4


def test_pages_are_retried():
    calls = []

    def fetch(offset, length):
        calls.append(offset)
        if len(calls) < 3:
            raise TimeoutError
        return [{"id": offset}]

    assert paged.fetch_page(fetch, 5, 1, 3, 0) == [{"id": 5}]
    calls.clear()
    with pytest.raises(TimeoutError):
        paged.fetch_page(fetch, 5, 1, 2, 0)
