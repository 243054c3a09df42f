"""The registered queries: against SQL where there is some, and the pipeline against its parts."""

from __future__ import annotations

import pytest
from compare import FOLDER, same

import corpus_pipeline
from lodestone.llm import near_dedup, queries, secret_scan


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name])


COLUMNS = {
    "op1": {"doc_id", "held_out", "lang_pred", "score"},
    "op2": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op3": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op4": {"page_id", "host", "path", "rule", "verdict"},
    "op5": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op6": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op7": {"doc_id", "n_shingles", "component_id", "kept"},
    "op8": {"query_id", "rank", "vec_id", "score"},
    "op9": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op10": {"doc_id", "source", "copies"},
}


@pytest.mark.parametrize("name", [n for n in queries.queries() if n.startswith("op")])
def test_columns_and_rows(spark, name):
    frame = queries.queries()[name](spark, FOLDER)
    assert COLUMNS[name.split("_")[0]] <= set(frame.columns)
    rows = {"documents": spark.read.parquet(f"{FOLDER}/documents.parquet").count(), "pages": spark.read.parquet(f"{FOLDER}/pages.parquet").count()}
    n = frame.count()
    kind = name.split("_")[0]
    if kind in ("op4", "op5"):
        assert n == rows["pages"]
    elif kind == "op9":
        assert n >= rows["documents"]
    elif kind != "op8":
        assert n == rows["documents"]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    junk = spark.createDataFrame([(10_000, "123 !!", "en", "src0", 6), (10_001, None, None, None, None)], docs.schema)
    copies = docs.limit(3).withColumn("doc_id", docs["doc_id"] + 20_000)
    first = docs.unionByName(junk).unionByName(copies)
    columns, at = first.columns, {}
    frame = first
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, FOLDER)
        at[name] = frame.toPandas()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert frame.columns == columns
            assert dict(frame.dtypes) == dict(first.dtypes)
    before = set(first.toPandas()["doc_id"])
    assert before - set(at["language_id"]["doc_id"]) == {10_000, 10_001}
    kept = near_dedup.near_duplicates(first.where("doc_id < 10000 or doc_id >= 20000")).where("kept").toPandas()
    assert set(at["near_dedup"]["doc_id"]) == set(kept["doc_id"])
    assert not any(i >= 20_000 for i in at["near_dedup"]["doc_id"])
    assert len(at["secret_scan"]) == len(at["near_dedup"])
    again = secret_scan.report(spark.createDataFrame(at["secret_scan"][["doc_id", "text"]])).agg({"n_assign": "sum", "n_hex": "sum", "n_access": "sum"}).first()
    assert sum(again) == 0
    assert set(at["mixing"]["doc_id"]) == set(at["secret_scan"]["doc_id"])
    assert len(at["mixing"]) >= len(at["secret_scan"])
    assert set(at["packing"]["doc_id"]) == set(at["mixing"]["doc_id"])
    ends = at["packing"].groupby("sequence_id")["length"].sum()
    assert ends.max() <= 4096


def test_pipeline_on_odd_rows(spark):
    """Ids that come twice, nulls, and an empty table pass through all stages; no text of its own is lost."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = "many words of one kind that make a text and go on for a while "
    rows = [(1, long * 3, "en", "a", 1), (2, "nothing like the first text at all, dear reader", "en", "a", 1), (2, "une phrase tout autre que les deux premieres ici", "fr", None, 1), (3, long * 3, None, "b", None), (4, None, "en", "b", 1), (None, "a row without any id is kept", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        at = frame
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            at = stage(spark, at, FOLDER)
            if k == 1:
                assert sorted((r["doc_id"] or 0) for r in at.collect()) == ([0, 1, 2, 2] if frame is docs else [])
        pieces = at.collect()
        assert {r["doc_id"] for r in pieces} == ({None, 1, 2} if frame is docs else set())
