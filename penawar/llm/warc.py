"""WARC archives: writing pages as records, and reading archives back by boundary-chain verification.

Writing. Payload digests and lengths are computed at the scan; the smallest page_id of each
digest (grouped aggregation) is the response, the others revisit it. Only pages that may be
revisits are shuffled to learn their response. A record is a string (header lines, blank line,
payload) and Spark's text writer ends it with the two CRLFs of the format, so the archives may lie
in any store. A file takes ``file_records`` records at most.

Reading. The record magic may also stand inside a payload, so a file can't simply be cut at it.
Each task emits, for every magic in its files whose header can be read, the candidate's offset and
its successor's (offset + header + Content-Length + 4). From the file start, pointer jumping keeps
the records that are reachable: a round adds the jump of every reached record and doubles the
jumps, so n records take log2(n) rounds of joins on (file, offset). Candidates in payloads are on
no chain from the start. A chain that breaks (a damaged archive) ends there.

Pages: a null html is an empty payload; a null url writes no target header; control characters of
a url become spaces; rows that repeat the smallest page_id of a payload are all responses; a null
page_id is never the smallest and comes back as null. Only page_id, url and html are read. An empty
table writes no record and reads back none.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penawar.llm.common import columns_of, maybe_in, shared_path, written
from penawar.session import ship_package

# fixed values of the format
MAGIC = "WARC/1.0\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
FILE_RECORDS = 1000
DATE = "2000-01-01T00:00:00Z"


def with_digest(df: DataFrame, payload: str, out: str) -> DataFrame:
    """``df`` plus the upper-case base32 of the SHA-1 of a string column: 20 bits (5 hex digits) make 4 letters. Digest
    and parts are columns of their own, so that each is computed once."""
    df = df.withColumn("_sha", F.sha1(payload))
    df = df.withColumn("_parts", F.array(*[F.conv(F.substring("_sha", i + 1, 5), 16, 10).cast("int") for i in range(0, 40, 5)]))
    letter = lambda part, s: F.substr(F.lit(BASE32), F.shiftright(part, s).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    letters = [letter(F.get("_parts", F.lit(i)), s) for i in range(8) for s in (15, 10, 5, 0)]
    return df.withColumn(out, F.concat(*letters)).drop("_sha", "_parts")


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, _h, bytes, digest, refers_to): refers_to is null for responses."""
    payload = F.coalesce("html", F.lit(""))
    d = columns_of(pages, "page_id", "url", "html").select(
        "page_id", "url", payload.alias("html"), F.octet_length(payload).cast("long").alias("bytes"), F.xxhash64(payload).alias("_h"))
    known = written(with_digest(d, "html", "digest").select("page_id", "bytes", "digest", "_h"), "warc-digests")
    # payloads that are there more than once, under different ids
    firsts = (known.where(F.col("bytes") >= least_bytes).groupBy("digest", "_h")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "_h", "first"))
    firsts = written(firsts, "warc-firsts")
    may = maybe_in(firsts)
    names = firsts.select(F.col("digest").alias("_digest"), "first")
    # hot payloads: the planner can split the pages' side of this join
    found = with_digest(d.where(may), "html", "digest")
    found = found.join(names, F.col("digest") == F.col("_digest"), "left")
    other = (F.col("first").isNotNull()) & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return (with_digest(d.where(~may), "html", "digest").withColumn("refers_to", F.lit(None).cast("long"))
            .unionByName(found.withColumn("refers_to", F.when(other, F.col("first"))).drop("_digest", "first")))


def record(date: str = DATE) -> Column:
    """A page of ``plan_records`` as the text of its record, without the CRLFs that end it."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    none = F.lit("")
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", page("page_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x1F\x7F]", " ")), none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", page("refers_to")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(none),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, none).otherwise(F.col("html")))


def write_warc(pages: DataFrame, path: str, file_records: int = FILE_RECORDS, least_bytes: int = 0) -> None:
    """Write the archives of ``pages`` into the folder ``path``."""
    (plan_records(pages, least_bytes).select(record().alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records).text(path))


# ---- reading ----------------------------------------------------------------------------

_CANDIDATE = ("path string, at long, next long, size long, type string, page_id long, refers_to long, url string, "
              "payload_bytes long, payload_digest string")
_HEAD = re.compile(rb"(?:[^\r\n]+\r\n)*\r\n")
_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def candidates_of(content: bytes) -> list[tuple]:
    """(at, next, type, page_id, refers_to, url, bytes, digest) for every magic with a header that can be read.

    A payload's digest is computed from its bytes; a revisit has those that it states of its response's."""
    out, at, magic = [], -1, MAGIC.encode()
    while (at := content.find(magic, at + 1)) >= 0:
        m = _HEAD.match(content, at + len(magic))
        if not m:
            continue
        head = {}
        for row in content[at + len(magic):m.end() - 4].split(b"\r\n"):
            name, _, value = row.partition(b":")
            head[name.strip().lower()] = value.strip()
        length = head.get(b"content-length", b"")
        if not length.isdigit():
            continue
        end = m.end() + int(length)
        if content[end:end + 4] != b"\r\n\r\n":
            continue
        text = {k: v.decode("utf-8", "replace") for k, v in head.items()}
        ids = [_PAGE.fullmatch(text.get(k, "")) for k in (b"warc-record-id", b"warc-refers-to")]
        if text.get(b"warc-type") == "revisit":
            stated = text.get(b"warc-payload-length", "")
            size, digest = int(stated) if stated.isdigit() else None, text.get(b"warc-payload-digest", "").removeprefix("sha1:")
        else:
            size, digest = int(length), base64.b32encode(hashlib.sha1(memoryview(content)[m.end():end]).digest()).decode()
        out.append((at, end + 4, text.get(b"warc-type"), *(int(i[1]) if i else None for i in ids), text.get(b"warc-target-uri"), size, digest))
    return out


def _candidate_task(batches):
    names = ["path", "at", "next", "size", "type", "page_id", "refers_to", "url", "payload_bytes", "payload_digest"]
    kinds = [pa.string(), *[pa.int64()] * 3, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for i in range(batch.num_rows):  # a file at a time
            path, content = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
            rows = [(path, c[0], c[1], len(content), *c[2:]) for c in candidates_of(content)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)


def reachable(links: DataFrame) -> DataFrame:
    """(file, at) on the chain from offset 0 of each file, by pointer jumping over (file, at, next).

    All tables here grow with the archives, so no side of a join may be broadcast on a guess of its size."""
    most = links.groupBy("file").count().agg(F.max("count").alias("n")).first()["n"] or 0  # one number
    reached = links.where("at = 0").select("file", "at")
    places, jumps, done = links.select("file", "at").hint("merge"), links.select("file", "at", "next"), 1
    while done < most:
        step = reached.join(jumps.hint("merge"), ["file", "at"]).select("file", F.col("next").alias("at"))
        reached = written(reached.unionByName(step).distinct().join(places, ["file", "at"], "left_semi"), "warc-reached")
        done *= 2
        if done < most:
            after = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
            jumps = written(jumps.join(after.hint("merge"), ["file", "next"]).select("file", "at", F.col("far").alias("next")), "warc-jumps")
    return reached


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in the folder ``path``: path, at, type, page_id, refers_to, url, payload_bytes,
    payload_digest."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    cand = files.mapInArrow(_candidate_task, _CANDIDATE).withColumn("file", F.xxhash64("path"))
    cand = written(cand, "warc-candidates")
    kept = reachable(cand.select("file", "at", "next"))
    return cand.join(kept.hint("merge"), ["file", "at"], "left_semi").drop("file", "next", "size")


def round_trip(pages: DataFrame, file_records: int = FILE_RECORDS, least_bytes: int = 0) -> DataFrame:
    """Write the archives into the shared folder and read them back: one row per page."""
    path = shared_path(pages.sparkSession, "warc")
    write_warc(pages, path, file_records, least_bytes)
    return (read_warc(pages.sparkSession, path)
            .select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"))
