"""WARC archives: writing pages as records, and reading them back by boundary-chain verification.

Writing: Spark's text writer makes each file, with the end of a record as its line end. Of pages with equal payloads the
one with the largest id is a response, and the others are revisits of it that keep the payload's length and digest but
not the payload. Only pages whose payload occurs again are shuffled, and of these only the largest with its payload.

Reading: archives are not compressed, so Spark deals them to tasks by byte ranges (`spark.sql.files.maxPartitionBytes`),
and a file of any size is read by many tasks. A task gives each place of its range that might begin a record (each magic)
and its successor, the place where a record of the length in its header would end. A payload may hold the magic, even a
whole record, so candidates prove nothing alone. Each range follows its own candidates by pointer jumping to where they
leave it; pointer jumping over these exits, range to range, from each file's first byte gives the one place where the
chain enters a range, and from there the range marks its reached candidates. Only these are records. A record with the
magic in its payload consists of several pieces, which are read again, for the files that have any, and put together.

Nulls and edges: null html is the empty payload; equal payloads include empty ones. A null url is written as an empty
one; control characters and spaces of a url are percent-encoded. Rows with a null page_id are records without a number:
they revisit the largest id with the same payload, and are responses if no id has it. Where an id has several rows, each
becomes a record, and with equal payloads each is a response if the id is the largest. An empty table gives no records
and no rows. Other columns are ignored. An archive whose chain breaks raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sketches import Filter
from .storage import new_path, scratch, shared, written
from .words import U64, encoded, mix, parts

MAGIC = b"WARC/1.0\r\n"
_END = "\r\n\r\n"
_TARGET = "urn:loam:page:"
_LENGTH = re.compile(rb"(?mi)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$")


def _digest(payload: bytes) -> bytes:
    return hashlib.sha1(payload).digest()


def _names(digests: list[bytes]) -> pa.Array:
    return pa.array([base64.b32encode(x).decode() for x in digests], pa.string())


def _codes(digests: list[bytes]) -> np.ndarray:
    """64 bits of each digest."""
    return np.frombuffer(b"".join(x[:8] for x in digests), U64)


def _own_code(code: np.ndarray, number: pa.Array) -> np.ndarray:
    """A 64-bit name of payload and id."""
    return mix(code ^ mix(number.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)))


def _escaped(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "")


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def digests(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (base32 SHA-1), code and own (64 bits of the payload, and of payload and id)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in parts(batch, "html"):
                found, ids = [_digest(x) for x in texts], batch.column("page_id").slice(at.start, len(texts))
                code = _codes(found)
                columns = [ids, pa.array([len(x) for x in texts], pa.int64()), _names(found), pa.array(code.view(np.int64)), pa.array(_own_code(code, ids).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "payload_bytes", "payload_digest", "code", "own"])

    return _pages(pages).select("page_id", "html").mapInArrow(hashed, "page_id long, payload_bytes long, payload_digest string, code long, own long")


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to: the largest id of the same payload, if that is another.

    Two filters tell, in the scan, payloads that occur once (nothing is missing then) and pages that aren't the largest
    (their html is dropped). What a filter lets through too much is put right by the join.
    """
    rows = written(digests(pages), "warc-digests")
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max(F.struct("page_id", "own", "code")).alias("largest"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1 and largest.page_id is not null").select("payload_digest", "largest.*"), "warc-repeated")
    both = shared(pages.sparkSession, (Filter.of(groups, "code"), Filter.of(groups, "own")))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, largest = both.value
        for batch in batches:
            for at, texts in parts(batch, "html"):
                n = len(texts)
                found, ids = [_digest(x) for x in texts], batch.column("page_id").slice(at.start, n)
                code = _codes(found)
                again = repeated.has(code.view(np.int64))
                dropped = again & ~largest.has(_own_code(code, ids).view(np.int64)) & (np.array([len(x) for x in texts]) >= least_bytes)
                html = [None if d else x.decode() for d, x in zip(dropped.tolist(), texts, strict=True)]
                urls = [_escaped(x) for x in batch.column("url").slice(at.start, n).to_pylist()]
                columns = [ids, pa.array(urls, pa.string()), pa.array(html, pa.string()), pa.array([len(x) for x in texts], pa.int64()), _names(found), pa.array(again)]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "html", "payload_bytes", "payload_digest", "again"])

    listed = _pages(pages).mapInArrow(told, "page_id long, url string, html string, payload_bytes long, payload_digest string, again boolean")
    alone = listed.where("not again").drop("again").withColumn("refers_to", F.lit(None).cast("long"))
    joined = listed.where("again").drop("again").join(groups.select("payload_digest", F.col("page_id").alias("_largest")), "payload_digest", "left")
    other = F.col("_largest").isNotNull() & ~F.col("_largest").eqNullSafe(F.col("page_id")) & (F.col("payload_bytes") >= least_bytes)
    return alone.unionByName(joined.withColumn("refers_to", F.when(other, F.col("_largest"))).drop("_largest"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write archives of pages to path, a file or more for each task."""
    with scratch(pages.sparkSession):
        rows = with_revisits(pages, least_bytes)
        http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(_END))
        revisit = F.col("refers_to").isNotNull()
        block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
        profile = "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"
        head = F.concat(
            F.lit(MAGIC.decode() + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
            F.lit("\r\nWARC-Record-ID: <" + _TARGET), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.col("url"),
            F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
            F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <" + _TARGET), F.col("refers_to"), F.lit(">\r\n" + profile))).otherwise(F.lit("\r\n")),
            F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(_END),
        )
        rows.select(F.concat(head, block).alias("value")).write.option("lineSep", _END).text(path)


def _span(piece: bytes) -> int:
    """Bytes from behind the magic to where the record would end; -1 if the piece doesn't begin with a header."""
    end = piece.find(b"\r\n\r\n")
    size = _LENGTH.search(piece[:end]) if end >= 0 else None
    return end + 4 + int(size[1]) + 4 if size else -1


_FIELDS = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "html": pa.string()}
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"


def _number(name: str) -> int | None:
    digits = name.strip("<>").rpartition(":")[2]
    return int(digits) if digits.lstrip("-").isdigit() else None


def parsed(record: bytes, html: bool) -> tuple | None:
    """The fields of a record, given from behind its magic; None for other types than response and revisit.

    Length and digest of a response are made anew from its payload; those of a revisit are what its headers say.
    """
    front, _, block = record.partition(b"\r\n\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in front.decode("utf-8", "replace").split("\r\n"))}
    kind = head.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block[:-4].partition(b"\r\n\r\n")
    number, url = _number(head.get("warc-record-id", "")), head.get("warc-target-uri", "")
    if kind == "response":
        return number, url, kind, None, len(payload), base64.b32encode(_digest(payload)).decode(), payload.decode("utf-8", "replace") if html else None
    size = _LENGTH.search(http)
    return number, url, kind, _number(head.get("warc-refers-to", "")), int(size[1]) if size else 0, head.get("warc-payload-digest", "").removeprefix("sha1:"), None


def _record_columns(records: list[tuple | None]) -> list[pa.Array]:
    none = (None,) * len(_FIELDS)
    columns = zip(*(x or none for x in records), strict=True) if records else ((),) * len(_FIELDS)
    return [pa.array(c, k) for c, k in zip(columns, _FIELDS.values(), strict=True)]


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file (hash of its path), size (the file's), block (where the task's byte range begins), place (order), piece.

    Pieces are what stands between two magics; the first of a file, before its first magic, is empty in a whole archive.
    """
    rows = spark.read.option("lineSep", MAGIC.decode()).option("pathGlobFilter", "part-*").text(path)
    return rows.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("piece"))


def _starts(bases: DataFrame) -> DataFrame:
    """file, block, base: where each range's first piece begins. bases: file, block, total (bytes of its pieces and magics)."""
    before = F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return bases.select("file", "block", F.coalesce(before, F.lit(0)).alias("base"))


def _placed(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A range's pieces in order, and where each begins."""
    table = table.sort_by("place")
    length = table["bytes"].to_numpy() + len(MAGIC)
    return table, int(table["base"][0].as_py()) + np.cumsum(length) - length


def followed(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Where the chain from each candidate at `at` leaves the range, by pointer jumping. to: successors, -1 for none."""
    place = np.searchsorted(at, to)
    inside = (to >= 0) & (np.append(at, -2)[place] == to)
    jump = np.where(inside, place, np.arange(len(at)))
    for _ in range(max(1, len(at)).bit_length()):
        jump = jump[jump]
    return to[jump]


def reached(at: np.ndarray, to: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which candidates the chain from the entries passes, by pointer jumping: the marked set takes in its images, and the map is squared."""
    n = len(at)
    place = np.searchsorted(at, to)
    jump = np.append(np.where((to >= 0) & (np.append(at, -2)[place] == to), place, n), n)
    seen = np.append(np.isin(at, entries), False)
    for _ in range(max(1, n).bit_length()):
        seen[jump[seen]] = True
        seen[n] = False
        jump = jump[jump]
    return seen[:n]


def _ends(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.where(after >= 0, at + after + len(MAGIC), -1)


def entered(edges: DataFrame) -> DataFrame:
    """file, at: where the chain from each file's first byte enters ranges. edges: file, at, leaves.

    Only candidates at which some chain leaves its range can be such places, so the map that is squared is small.
    """
    jump = edges.join(edges.select("file", F.col("leaves").alias("at")).distinct(), ["file", "at"]).select("file", "at", "leaves")
    first = edges.where(F.col("at") == len(MAGIC)).select("file", "at", "leaves")
    jump = written(jump.unionByName(first).distinct(), "warc-jumps")
    seen, n = first.select("file", "at"), -1
    while True:
        seen = written(seen.unionByName(seen.join(jump, ["file", "at"]).select("file", F.col("leaves").alias("at"))).distinct().join(edges.select("file", "at"), ["file", "at"], "left_semi"), "warc-entered")
        now = seen.count()
        if now == n:
            return seen
        n = now
        jump = written(jump.join(jump.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("further")), ["file", "leaves"], "left").select("file", "at", F.coalesce("further", "leaves").alias("leaves")), "warc-jumps")


def chained(rows: DataFrame) -> DataFrame:
    """file, place, at, ends (the record's), begins (it begins a record), alone (the record is this piece).

    rows: file, size, block, place, bytes, after (what _span gives). An error if some file's chain doesn't reach its end.
    """
    totals = written(rows.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("total"), F.max("size").alias("size")), "warc-ranges")
    based = written(rows.select("file", "block", "place", "bytes", "after").join(_starts(totals), ["file", "block"]), "warc-based")

    def follow(table: pa.Table) -> pa.Table:
        table, at = _placed(table)
        after = table["after"].to_numpy()
        to = _ends(at, after)
        some = np.flatnonzero(after >= 0)
        return pa.table({"file": table["file"].take(some), "block": table["block"].take(some), "at": at[some], "leaves": followed(at, to)[some]})

    edges = written(based.groupBy("file", "block").applyInArrow(follow, "file long, block long, at long, leaves long"), "warc-edges")
    entries = edges.join(entered(edges), ["file", "at"]).groupBy("file", "block").agg(F.collect_list("at").alias("entries"))
    # A range that the chain doesn't enter, or enters late, begins with pieces of the record that ends at the next entry.
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(0, Window.unboundedFollowing)
    last = F.max("size").over(Window.partitionBy("file")) + len(MAGIC)
    known = totals.join(entries, ["file", "block"], "left").withColumn("next", F.coalesce(F.first(F.array_min("entries"), ignorenulls=True).over(ahead), last))
    known = written(known.select("file", "block", "entries", "next"), "warc-entries")

    def mark(table: pa.Table) -> pa.Table:
        table, at = _placed(table)
        length, after = table["bytes"].to_numpy(), table["after"].to_numpy()
        to = _ends(at, after)
        begins = reached(at, to, np.array(table["entries"][0].as_py() or [], np.int64))
        owner = np.maximum.accumulate(np.where(begins, np.arange(len(at)), -1))
        ends = np.where(owner >= 0, to[owner], table["next"].to_numpy())
        return pa.table({"file": table["file"], "place": table["place"], "at": at, "ends": ends, "begins": begins, "alone": begins & (to == at + length + len(MAGIC))})

    marked = based.join(known, ["file", "block"]).groupBy("file", "block").applyInArrow(mark, "file long, place long, at long, ends long, begins boolean, alone boolean")
    marked = written(marked, "warc-marked")
    whole = marked.where("begins").select("file", F.col("ends").alias("end")).join(totals.groupBy("file").agg((F.max("size") + len(MAGIC)).alias("end")), ["file", "end"]).count()
    if whole != totals.where(F.col("size") > 0).select("file").distinct().count():
        raise ValueError("the chain of records doesn't reach an archive's end")
    return marked


def read(spark: SparkSession, path: str, html: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, html (null in a revisit, or if not asked for) of an archive's records."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in parts(batch, "piece"):
                after = [_span(x) for x in texts]
                fields = [parsed(x, html) if a == len(x) else None for x, a in zip(texts, after, strict=True)]
                own = batch.slice(at.start, len(texts))
                columns = [*(own.column(c) for c in ("file", "size", "block", "place")), pa.array([len(x) for x in texts], pa.int64()), pa.array(after, pa.int64()), *_record_columns(fields)]
                yield pa.RecordBatch.from_arrays(columns, ["file", "size", "block", "place", "bytes", "after", *_FIELDS])

    def put_together(table: pa.Table) -> pa.Table:
        record = MAGIC.join(x.as_py() for x in table.sort_by("at")["piece"])
        return pa.table(dict(zip(_FIELDS, _record_columns([parsed(record, html)]), strict=True)))

    def positions(table: pa.Table) -> pa.Table:
        table, at = _placed(table)
        return pa.table({"file": table["file"], "at": at, "piece": table["piece"]})

    with scratch(spark) as own:
        rows = written(pieces(spark, path).mapInArrow(parse, f"file long, size long, block long, place long, bytes long, after long, {_RECORD}"), "warc-pieces")
        marked = chained(rows)
        own.keep(rows, marked)
        out = rows.join(marked.where("alone").select("file", "place"), ["file", "place"]).where("record_type is not null").select(*_FIELDS)
        more = marked.where("not alone and at >= 10")
        if not more.isEmpty():
            some = pieces(spark, path).join(written(more.select("file").distinct(), "warc-files"), "file", "left_semi")
            again = written(some.withColumn("bytes", F.octet_length("piece").cast("long")), "warc-again")
            totals = again.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("total"))
            placed = again.join(_starts(totals), ["file", "block"]).groupBy("file", "block").applyInArrow(positions, "file long, at long, piece binary")
            joined = placed.join(more.select("file", "at", "ends"), ["file", "at"])
            cut = written(joined.groupBy("file", "ends").applyInArrow(put_together, _RECORD).where("record_type is not null"), "warc-put-together")
            own.keep(cut)
            out = out.unionByName(cut)
    return out


def round_trip(pages: DataFrame, least_bytes: int = 0, html: bool = True) -> DataFrame:
    """Write archives to the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, least_bytes)
    return read(pages.sparkSession, path, html)

