from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import warc
from lodestone.llm.shared import shared_folder

EVIL = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
ROWS = [(1, "http://a", EVIL), (2, None, EVIL), (3, "http://c\r\nWARC-Type: revisit", None), (4, "u", ""), (7, "z", "é😀" * 10), (9, None, "WARC/1.1\r\nContent-Length: 10\r\n\r\n"), (10, "w", "y" * 200_000)]


def expected(rows, least=0):
    first, out = {}, {}
    for k, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least:
            first[data] = min(k, first.get(data, k))
    for k, _, html in rows:
        data = (html or "").encode()
        head = first.get(data, k)
        out[k] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if head == k else "revisit", None if head == k else head)
    return out


@pytest.mark.parametrize("least", [0, 50])
def test_round_trip(spark, least):
    frame = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    found = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(frame, least=least).collect()}
    assert found == expected(ROWS, least)


@pytest.mark.parametrize("split", [31, 512, 8 << 20])
def test_payloads_at_any_split(spark, split):
    """Splits that cut magic, headers and payloads give the same records."""
    folder = shared_folder(spark)
    warc.write(spark.createDataFrame(ROWS[:6], "page_id long, url string, html string").coalesce(1), folder)
    found = {r["id"]: r for r in warc.records(spark, folder, split=split).collect()}
    assert bytes(found[1]["payload"]).decode() == EVIL
    assert bytes(found[7]["payload"]).decode() == "é😀" * 10
    assert found[2]["record_type"] == "revisit"
    assert found[2]["refers_to"] == 1
    assert found[3]["url"] == "http://c%0D%0AWARC-Type: revisit"
    assert found[1]["url"] == "http://a"


@pytest.mark.parametrize("seed", range(5))
def test_pointer_jumping_is_a_walk(seed):
    rng = random.Random(seed)
    at = sorted(rng.sample(range(1, 500), 60))
    at = [0, *at] if seed else at
    after = [rng.choice([x for x in [*at, 10_000] if x > a] or [10_000]) if rng.random() < 0.95 else a + 1 for a in at]
    place, walked = dict(zip(at, after, strict=True)), set()
    x = 0
    while x in place:
        walked.add(x)
        x = place[x]
    assert [a for a, keep in zip(at, warc.reachable(np.array(at), np.array(after)), strict=True) if keep] == sorted(walked)
    assert warc.reachable(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(4, "u", "same"), (4, "u", "same"), (5, "u", "same"), (None, "n", "same")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS size", "2 AS digest")
    found = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(frame).collect()), key=str)
    assert found == [(4, "response", None), (4, "response", None), (5, "revisit", 4), (None, "response", None)]
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_a_payload_that_changed_is_an_error(spark, tmp_path):
    folder = f"{tmp_path}/a"
    warc.write(spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string").coalesce(1), folder)
    part = next(p for p in (tmp_path / "a").iterdir() if p.name.startswith("part"))
    data = part.read_bytes().replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")
    for p in (tmp_path / "a").iterdir():
        p.unlink()
    part.write_bytes(data)
    with pytest.raises(Exception, match="not the one that was written"):
        warc.records(spark, folder).collect()


@pytest.mark.parametrize("split", [512, 8 << 20])
def test_headers_of_any_length(spark, split):
    """A url beyond 65,536 bytes loses neither its record nor those after it."""
    rows = [(1, "a", "one"), (2, "http://u/" + "x" * 300_000, EVIL), (3, "b", "WARC/1.1\r\n" * 3_000), (4, "c", "four")]
    folder = shared_folder(spark)
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    found = sorted((r["id"], r["url"], bytes(r["payload"]).decode()) for r in warc.records(spark, folder, split=split).collect())
    assert found == rows


@pytest.mark.parametrize("keep", [-3, 5])
def test_a_file_that_is_cut_short_is_an_error(spark, tmp_path, keep):
    folder = f"{tmp_path}/a"
    warc.write(spark.createDataFrame([(1, "u", "one"), (2, "v", "two")], "page_id long, url string, html string").coalesce(1), folder)
    part = next(p for p in (tmp_path / "a").iterdir() if p.name.startswith("part"))
    data = part.read_bytes()[:keep]
    for p in (tmp_path / "a").iterdir():
        p.unlink()
    part.write_bytes(data)
    with pytest.raises(Exception, match="not at the file's end"):
        warc.records(spark, folder).collect()


@pytest.mark.parametrize("seed", range(4))
def test_chains_by_splits_are_walks(spark, seed):
    """Random candidates in several files: what the chain from byte 0 reaches, however places are dealt to splits."""
    rng = random.Random(seed)
    rows, wanted = [], set()
    for f in range(3):
        length = 2_000
        at = [0, *sorted(rng.sample(range(1, length), 80))]
        after = [rng.choice([x for x in at if x > a][:6] or [length]) for a in at]
        rows += [(f"f{f}", a, a + 1, 1, n) for a, n in zip(at, after, strict=True)] + [(f"f{f}", length, -1, -1, -1)]
        x, to = 0, dict(zip(at, after, strict=True))
        while x != length:
            wanted.add((f"f{f}", x))
            x = to[x]
    frame = spark.createDataFrame(rows, "path string, at long, body long, size long, next long")
    for split in (7, 100, 5_000):
        assert {(r["path"], r["at"]) for r in warc.chained(frame, split).collect()} == wanted


def test_a_file_without_a_first_record_is_an_error(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part-0").write_bytes(b"x" * 3_000)
    with pytest.raises(Exception, match="not at the file's end"):
        warc.records(spark, f"{tmp_path}/a", split=512).collect()
