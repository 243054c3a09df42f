"""WARC archives: written by Spark's text writer, read back by verifying the chain of record boundaries.

Every split of an archive is searched for places that look like the start of a record; each gives a candidate and, by
its Content-Length, its successor. A payload may hold the magic too. Pointer jumping over the candidates of a split
tells where the chain leaves it, for each place where it may come in; these few jumps from split to split are followed
from the file's first byte, and only candidates that the chain of successors then reaches are kept.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import cut, partitions, shared_folder

MAGIC = b"WARC/1.1\r\n"
#: What the text writer puts after a row is what ends a record.
_END = "\r\n\r\n"
#: Bytes first read beyond a split for the end of a header; each further read is twice as long.
_BEYOND = 1 << 16
#: Revisits whose ids may be broadcast to the writer; beyond it the pages are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def payload_digest(payload: Column) -> Column:
    """SHA-1 of the UTF-8 bytes in base32, upper case without padding (20 bytes need none)."""
    digest = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def deduplicated(pages: DataFrame, key: str, url: str, payload: str, least: int) -> DataFrame:
    """id, url, payload, size, digest, refers_to: null for responses, else the least id with an equal payload.

    Only ids and digests are shuffled. The ids that refer to another are broadcast where there are few, so that the
    payloads stay where they were read. Null ids neither refer nor are referred to.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    own = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), body.alias("payload")).withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", payload_digest(F.col("payload")))
    # Equal digest and size stand for equal payloads.
    ids = own.select("id", "size", "digest").where((F.col("size") >= least) & F.col("id").isNotNull())
    groups = ids.groupBy("digest", "size").agg(F.min("id").alias("refers_to"), F.max("id").alias("last")).where("last > refers_to").select("digest", "size", "refers_to")
    revisits = ids.join(groups, ["digest", "size"]).where("id > refers_to").select("id", "digest", "refers_to").distinct()
    few = revisits.count() <= BROADCAST_ROWS
    return own.join(F.broadcast(revisits) if few else revisits, ["id", "digest"], "left")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> None:
    """Write one record a row to text files in the folder: responses with their payload, revisits without.

    Control characters in a url are percent-encoded, so that a url cannot end a header. A null url has no header.
    """
    found = deduplicated(pages, key, url, payload, least)
    revisit = F.col("refers_to").isNotNull()
    target = F.col("url")
    for c, code in (("%0D", "\r"), ("%0A", "\n")):
        target = F.replace(target, F.lit(code), F.lit(c))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    head = F.concat(
        F.lit(MAGIC.decode()),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">\r\n"),
        line("WARC-Target-URI", target),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\n"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.lit("X-Payload-Length: "), F.col("size").cast("string"), F.lit("\r\n"),
        F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("size")).cast("string"), F.lit("\r\n\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    found.select(head.alias("value")).write.option("lineSep", _END).text(folder)


def _open(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path.replace("file:///", "/", 1) if path.startswith("file:/") else path)
    return system.open_input_file(place)


def _parse(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")[1:]
    return {name.strip().lower().decode(): value.strip().decode("utf-8", "replace") for name, _, value in (x.partition(b":") for x in lines)}


def _length_line(head: bytes) -> tuple[int, int]:
    """Where the last Content-Length line of these header lines begins, and its number; (-1, 0) where there is none."""
    end = len(head)
    while end > 0:
        begin = head.rfind(b"\r\n", 0, end) + 2
        if begin < 2:
            break
        name, _, value = head[begin:end].partition(b":")
        if name.strip().lower() == b"content-length":
            value = value.strip()
            return (begin, int(value)) if value.isdigit() else (-1, 0)
        end = begin - 2
    return -1, 0


def candidates(spark: SparkSession, folder: str, split: int = 8 << 20) -> DataFrame:
    """(path, at, body, size, next): every place that looks like a record, with its successor's place; and for each file
    its length as a place without a successor, where the chain of its records has to end.

    One task reads one split and, for headers that begin in it, what they need beyond it. Headers may be of any length.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length").where("length > 0")
    splits = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, length, start in zip(part["path"], part["length"], part["start"], strict=True):
                out = [(path, length, -1, -1, -1)] if start == 0 else []
                with _open(path) as file:
                    data = file.read_at(min(length - start, split + len(MAGIC) - 1), start)
                    at, end, more = data.find(MAGIC), -1, _BEYOND
                    while 0 <= at < split:
                        if end < at:  # else the blank line after the last place is the first one after this place too
                            end = data.find(b"\r\n\r\n", at)
                            while end < 0 and start + len(data) < length:
                                seen = len(data)
                                data += file.read_at(min(more, length - start - seen), start + seen)
                                end, more = data.find(b"\r\n\r\n", max(at, seen - 3)), 2 * more
                            if end < 0:
                                break  # nor has any later place one
                            line, size = _length_line(data[at:end])
                            line += at if line >= 0 else 0
                        if line >= at + len(MAGIC) and (after := start + end + 4 + size + 4) <= length:
                            out.append((path, start + at, start + end + 4, size, after))
                        at = data.find(MAGIC, at + 1)
                yield pd.DataFrame(out, columns=["path", "at", "body", "size", "next"])

    return splits.repartition(partitions(spark), "path", "start").mapInPandas(run, "path string, at long, body long, size long, next long")


def _jumps(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The place among `at`, which ascends, of each successor; len(at) where it is not there."""
    n = len(at)
    jump = np.searchsorted(at, after)
    return np.where((jump < n) & (at[np.minimum(jump, n - 1)] == after), jump, n) if n else jump


def reachable(at: np.ndarray, after: np.ndarray, start: int = 0) -> np.ndarray:
    """Which of the sorted places the chain from `start` reaches, by pointer jumping: 2^k successors in the k-th round."""
    n = len(at)
    jump = np.append(_jumps(at, after), n)
    seen = np.append(at == start, False)
    while True:
        before = seen.sum()
        seen[jump[np.flatnonzero(seen)]] = True
        jump = jump[jump]
        if seen.sum() == before:
            break
    return seen[:n]


#: Where a chain ends: at the file's length, or nowhere that a record could begin.
_DONE, _LOST = -2, -1


def exits(at: np.ndarray, after: np.ndarray, high: int) -> np.ndarray:
    """For each of the sorted places of a split, which ends at `high`, where the chain from it first leaves the split."""
    n = len(at)
    jump = _jumps(at, after)
    last = np.where(after >= high, after, _LOST)
    last[after < 0] = _DONE  # the place at the file's length
    jump = np.where(jump < n, jump, np.arange(n))
    while (jump[jump] != jump).any():
        jump = jump[jump]
    return last[jump]


def chained(found: DataFrame, split: int) -> DataFrame:
    """The candidates that the chain from their file's first byte reaches; an error where it does not end at its length.

    A task holds the candidates of one split, and of a file the places where a chain may enter its splits: the
    candidates of one split mostly leave it at one place, so that these are a row or two for each split.
    """
    found = found.withColumn("part", F.floor(F.col("at") / split))
    fields = "path string, part long"

    def leaves(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at", ignore_index=True)
        path, part = frame["path"].iloc[0], int(frame["part"].iloc[0])
        ends = np.unique(exits(frame["at"].to_numpy(), frame["next"].to_numpy(), (part + 1) * split))
        enters = ends[ends >= 0].tolist() + [0] * bool((frame["next"] < 0).any())  # each file begins at 0
        return pd.DataFrame({"path": path, "part": [x // split for x in enters], "enter": enters}).astype({"part": "int64", "enter": "int64"})

    enters = found.groupBy("path", "part").applyInPandas(leaves, f"{fields}, enter long").distinct()

    def passes(frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        """Where a chain that enters at these places leaves."""
        frame = frame.sort_values("at", ignore_index=True)
        at, enter = frame["at"].to_numpy(dtype=np.int64), own["enter"].to_numpy(dtype=np.int64)
        leave = np.full(len(enter), _LOST)
        if len(at) and len(enter):
            place = np.minimum(np.searchsorted(at, enter), len(at) - 1)
            leave = np.where(at[place] == enter, exits(at, frame["next"].to_numpy(), (int(frame["part"].iloc[0]) + 1) * split)[place], _LOST)
        return own.assign(leave=leave)

    jumps = found.groupBy("path", "part").cogroup(enters.groupBy("path", "part")).applyInPandas(passes, f"{fields}, enter long, leave long")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        to = dict(zip(frame["enter"].tolist(), frame["leave"].tolist(), strict=True))
        seen, at = [], 0
        while at >= 0:
            seen.append(at)
            at = to.get(at, _LOST)
        if at != _DONE:
            raise ValueError(f"{frame['path'].iloc[0]}: the records that follow byte {seen[-1]} end within its split, not at the file's end")
        return pd.DataFrame({"path": frame["path"].iloc[0], "part": [x // split for x in seen], "enter": seen})

    entered = jumps.groupBy("path").applyInPandas(walk, f"{fields}, enter long")

    def keep(frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(frame):
            return frame[:0]
        frame = frame.sort_values("at", ignore_index=True)
        return frame[reachable(frame["at"].to_numpy(), frame["next"].to_numpy(), int(own["enter"].iloc[0])) & (frame["next"] >= 0)]

    return found.groupBy("path", "part").cogroup(entered.groupBy("path", "part")).applyInPandas(keep, "path string, at long, body long, size long, next long, part long").drop("part")


def records(spark: SparkSession, folder: str, split: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """The records of the archives in the folder: id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Size and digest of a response are those of the payload read; a record whose payload has another digest than its
    header says is an error, and so is a file whose records do not end at its length. For a revisit they are the
    header's, and the payload is null. Payloads are read by splits of the verified places. Ids are whole numbers.
    """
    kept = chained(cut(candidates(spark, folder, split)), split)
    schema = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: int(digits) if (digits := x.removeprefix("<urn:page:").removesuffix(">")) else None
        for part in parts:
            for path, group in part.groupby("path", sort=False):
                out, held = [], 0
                with _open(path) as file:
                    for at, body, size in zip(group["at"].tolist(), group["body"].tolist(), group["size"].tolist(), strict=True):
                        data = file.read_at(body - at + size, at)
                        head, payload = _parse(data[: body - at - 4]), data[body - at :]
                        kind, said = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if digest != said:
                                raise ValueError(f"{path} at {at}: the payload is not the one that was written")
                        else:
                            size, digest, payload = int(head["x-payload-length"]), said, None
                        row = (number(head["warc-record-id"]), head.get("warc-target-uri"), kind, number(head["warc-refers-to"]) if kind == "revisit" else None, size, digest)
                        out.append(row + (payload,) * with_payload)
                        held += len(data)
                        if held > 16 << 20:
                            yield _frame(out, with_payload)
                            out, held = [], 0
                yield _frame(out, with_payload)

    dealt = kept.repartition(partitions(spark), "path", F.floor(F.col("at") / split))
    return dealt.mapInPandas(run, schema)


def _frame(rows: list[tuple], with_payload: bool) -> pd.DataFrame:
    names = ["id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    return frame.astype({"id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back: one row a page, without the payload.

    A null payload is empty. Of equal payloads of at least `least` bytes, that with the least id is the response; rows
    that repeat this id are responses too. A row without an id is a response.
    """
    folder = shared_folder(pages.sparkSession)
    write(pages, folder, key, url, payload, least)
    return records(pages.sparkSession, folder, with_payload=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
