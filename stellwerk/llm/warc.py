"""Pages as WARC archives, and archives read back with segmented records put together.

A page's record is a ``response`` holding an HTTP message in chunked transfer framing. Of pages
with equal payloads of at least ``min_bytes`` the one with the smallest id is a response, the
others are ``revisit`` records without a body that refer to it. A message longer than a segment
goes on in ``continuation`` records that name the first one.

Payloads are text, so records are too: archives are written with Spark's text writer, whose line
separator is the end of a WARC record. Reading takes whole archive files, whose size is bounded by
``records_per_file`` and the segment length.

Nulls and repeats: a null html is an empty payload, a null url an empty one. Pages with a null id are
always responses and nobody refers to them. Each of several rows with the smallest id is a response, and
revisits refer to one of them. An empty table gives no archive records.

A revisit's ``WARC-Refers-To`` is the id of a response in the archives. Reading takes what is whole: where an
archive is damaged, a row of type ``damaged`` names the archive and the place, and reading goes on at the next
record or gzip member that can be found.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stellwerk.llm.batches import stored

MIN_BYTES = 100
SEGMENT_CHARS = 65_536
CHUNK_CHARS = 8_192
RECORDS_PER_FILE = 1_000
_BATCH_BYTES = 8 << 20

# Fixed values of the formats.
_VERSION = "WARC/1.1"
_END_OF_RECORD = "\r\n\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP_TYPE = "application/http; msgtype=response"

DAMAGED = "damaged"

_RECORD_FIELDS = (
    "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, "
    "origin_id string, segment int, total_length bigint, block binary"
)


def with_roles(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, leads, refers_to``: what each page's record is to hold.

    ``leads`` holds for one response of each payload that revisits refer to. Only ids and digests are grouped.
    The join's many-sided key, the digest of a payload that very many pages share, is split by adaptive
    execution, for the other side has one row per digest.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumn(
        "digest", F.sha2(F.col("payload"), 256)
    )
    shared = stored(
        pages.filter((F.octet_length(payload) >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy(F.sha2(payload, 256).alias("digest"), "page_id")
        .agg(F.count("*").alias("copies"))
        .groupBy("digest")
        .agg(F.min(F.struct("page_id", "copies")).alias("first"), F.sum("copies").alias("pages"))
        .filter("pages > 1")
        .select("digest", F.col("first.page_id").alias("first"), F.col("first.copies").alias("copies")),
        "warc-shared",
    )
    is_first = F.coalesce(F.col("first") == F.col("page_id"), F.lit(False))
    roles = rows.join(shared, "digest", "left").withColumn("leads", is_first)
    if not shared.filter("copies > 1").isEmpty():
        # Rows that repeat a smallest id: one of them leads.
        repeated = is_first & (F.col("copies") > 1)
        place = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
        roles = roles.filter(~F.coalesce(repeated, F.lit(False))).unionByName(roles.filter(repeated).withColumn("leads", place == 1))
    return roles.select(
        "page_id", "url", "payload", "digest", "leads", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to")
    )


def _record(fields: list[tuple[str, object]], block: str) -> str:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"{_VERSION}\r\n{head}Content-Length: {len(block.encode())}\r\n\r\n{block}"


def chunked(payload: str, chunk_chars: int = CHUNK_CHARS) -> str:
    """The payload in chunked transfer framing, cut between characters."""
    parts = (payload[i : i + chunk_chars] for i in range(0, len(payload), chunk_chars))
    return "".join(f"{len(part.encode()):x}\r\n{part}\r\n" for part in parts) + "0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """Undo chunked transfer framing; None where the framing is broken or ends early."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.match(rb"[0-9A-Fa-f]+", body[at:end]) if end >= 0 else None
        if not size:
            return None
        length = int(size[0], 16)
        if not length:
            return b"".join(parts)
        at = end + 2
        if body[at + length : at + length + 2] != b"\r\n":
            return None
        parts.append(body[at : at + length])
        at += length + 2


def page_records(
    name: str, url: str, payload: str, digest: str, refers_to: str | None, date: str, segment_chars: int = SEGMENT_CHARS
) -> list[str]:
    """The WARC records of one page: one, or one per segment."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common = [("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *common]
        fields += [("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>"), ("Content-Type", _HTTP_TYPE)]
        return [_record(fields, f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload.encode())}\r\n\r\n")]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n{chunked(payload)}"
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *common, ("Content-Type", _HTTP_TYPE)]
    if len(block) <= segment_chars:
        return [_record(first, block)]
    parts = [block[i : i + segment_chars] for i in range(0, len(block), segment_chars)]
    records = [_record([*first, ("WARC-Segment-Number", 1)], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:segment:{number}>"), ("WARC-Date", date)]
        fields += [("WARC-Target-URI", url), ("WARC-Segment-Number", number), ("WARC-Segment-Origin-ID", f"<{name}>")]
        if number == len(parts):
            fields.append(("WARC-Segment-Total-Length", len(block.encode())))
        records.append(_record(fields, part))
    return records


def write_archives(
    pages: DataFrame,
    path: str,
    date: str = "2024-01-01T00:00:00Z",
    min_bytes: int = MIN_BYTES,
    segment_chars: int = SEGMENT_CHARS,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write gzipped WARC archives of ``page_id, url, html`` to a folder."""
    rows = with_roles(pages, min_bytes).withColumn("copy", F.monotonically_increasing_id())

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            columns = (batch.column(c) for c in ("page_id", "copy", "url", "payload", "digest", "leads", "refers_to"))
            for page_id, copy, url, payload, digest, leads, refers_to in zip(*columns, strict=True):
                refers_to, page_id, digest = refers_to.as_py(), page_id.as_py(), digest.as_py()
                # A record that others refer to is named by its payload, so that they know its name.
                name = f"urn:page:{'' if page_id is None else page_id}:{digest if leads.as_py() else copy.as_py()}"
                target = None if refers_to is None else f"urn:page:{refers_to}:{digest}"
                text = payload.as_py()
                out += page_records(name, url.as_py(), text, digest, target, date, segment_chars)
                held += len(text)
                if held > _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    rows.mapInArrow(records, "value string").write.option("lineSep", _END_OF_RECORD).option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", records_per_file).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[int, dict[str, str] | None, bytes]]:
    """Place, header fields (names in lower case) and block of each record of one archive.

    A record that is cut off or has no right length comes as its place with None for the fields; what follows
    is read from where an empty line and the begin of a record come next, be it in a broken record's block.
    """
    at = 0
    while at < len(data):
        fields = None
        if data.startswith(b"WARC/", at) and (head_end := data.find(_END_OF_RECORD.encode(), at)) >= 0:
            lines = data[at:head_end].decode("utf-8", "replace").split("\r\n")[1:]
            fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
            start, length = head_end + 4, fields.get("content-length", "")
            end = start + int(length) if length.isascii() and length.isdigit() else len(data) + 1
            # A block is followed by empty lines, unless it ends the archive.
            if end > len(data) or not _END_OF_RECORD.encode().startswith(data[end : end + 4]):
                fields = None
        if fields is not None:
            yield at, fields, data[start:end]
            at = end
            while data[at : at + 1] in (b"\r", b"\n"):
                at += 1
        else:
            yield at, None, b""
            following = data.find(b"\r\n\r\nWARC/", at + 1)
            at = len(data) if following < 0 else following + 4


_MEMBER = b"\x1f\x8b\x08"


def _gunzip(data: bytes) -> bytes:
    """All members of a gzip file, of a damaged one what can be read; data that isn't gzip is returned as it is."""
    if data[:2] != _MEMBER[:2]:
        return data
    parts, at = [], 0
    while at >= 0:
        stream, begin = zlib.decompressobj(31), at
        try:
            while at < len(data) and not stream.eof:
                parts.append(stream.decompress(data[at : at + 65_536]))
                at += 65_536
            parts.append(stream.flush())
            at = min(at, len(data)) - len(stream.unused_data)
        except zlib.error:
            at = begin + 1
        at = data.find(_MEMBER, at)
    return b"".join(parts)


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 10 else None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of every archive below ``path``, continuation records by themselves.

    Damage is a row of type ``damaged`` whose ``target_uri`` is the archive, and ``total_length`` the place in its
    unpacked bytes.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, pa.string()) for n in ("record_id", "record_type", "target_uri", "payload_digest", "refers_to", "origin_id")]
            + [("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary())]
        )
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                out, held = [], 0
                for at, fields, block in parse_archive(_gunzip(content.as_py())):
                    if fields is None:
                        out.append((None, DAMAGED, archive, None, None, None, None, at, block))
                        continue
                    get = fields.get
                    number, total = get("warc-segment-number"), get("warc-segment-total-length")
                    out.append(
                        (
                            *(get(f, "").strip("<>") or None for f in ("warc-record-id", "warc-type", "warc-target-uri")),
                            get("warc-payload-digest"),
                            *(get(f, "").strip("<>") or None for f in ("warc-refers-to", "warc-segment-origin-id")),
                            _number(number),
                            _number(total),
                            block,
                        )
                    )
                    held += len(block)
                    if held > _BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(records, _RECORD_FIELDS)


def reassembled(records: DataFrame) -> DataFrame:
    """One row per response or revisit; ``complete`` says whether all segments are there, in full length.

    Only segmented records are shuffled; a group holds the segments of one record.
    """
    whole = records.filter("segment IS NULL").select(
        "record_id", "record_type", "target_uri", "payload_digest", "refers_to", "block", (~F.col("record_type").eqNullSafe(DAMAGED)).alias("complete")
    )
    head = F.col("segment") == 1
    parts = F.array_sort(F.collect_list(F.struct("segment", "block")))
    joined = (
        records.filter("segment IS NOT NULL")
        .groupBy(F.coalesce("origin_id", "record_id").alias("record_id"))
        .agg(
            *(F.max(F.when(head, F.col(c))).alias(c) for c in ("record_type", "target_uri", "payload_digest", "refers_to")),
            parts.alias("parts"),
            F.max("total_length").alias("total"),
        )
        .withColumn("block", F.aggregate("parts", F.lit(b""), lambda sofar, part: F.concat(sofar, part["block"])))
        .withColumn(
            "complete",
            (F.array_max("parts.segment") == F.size("parts"))
            & (F.array_min("parts.segment") == 1)
            & F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False)),
        )
        .select("record_id", "record_type", "target_uri", "payload_digest", "refers_to", "block", "complete")
    )
    return whole.unionByName(joined)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, record_type, target_uri, refers_to, payload, payload_bytes, payload_digest, intact``.

    A revisit has no payload; length and digest are those of the payload it stands for. ``intact`` is
    false where segments are missing, the framing is broken or the payload differs from its digest. Whether a
    revisit's response is there, ``revisits_checked`` says. Damage in an archive is a row of type ``damaged``.
    """

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("record_type", "block", "payload_digest", "complete")
        for batch in batches:
            out = []
            for kind, block, stated, complete in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                head, _, body = block.partition(b"\r\n\r\n")
                stated = (stated or "").removeprefix("sha256:")
                if kind == "revisit":
                    length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                    out.append((None, int(length[1]) if length else None, stated, complete))
                    continue
                if kind == DAMAGED:
                    out.append((None, None, None, False))
                    continue
                is_chunked = re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head)
                payload = unchunked(body) if is_chunked else body
                if payload is None:
                    out.append((None, None, stated, False))
                else:
                    digest = hashlib.sha256(payload).hexdigest()
                    out.append((payload, len(payload), digest, complete and digest == stated))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("record_id", "record_type", "target_uri", "refers_to")]
                + [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string(), pa.bool_()))],
                ["record_id", "record_type", "target_uri", "refers_to", "payload", "payload_bytes", "payload_digest", "intact"],
            )

    return reassembled(read_records(spark, path)).mapInArrow(
        payloads,
        "record_id string, record_type string, target_uri string, refers_to string, payload binary, "
        "payload_bytes bigint, payload_digest string, intact boolean",
    )


def revisits_checked(payloads: DataFrame) -> DataFrame:
    """``payloads`` without the payloads themselves; a revisit is ``intact`` only if its response is, with the length
    and digest that the revisit states.

    The rows without payloads are written once. A response that very many revisits name is one row of the join's
    other side, so adaptive execution splits its revisits.
    """
    rows = stored(payloads.drop("payload"), "warc-digests")
    is_revisit = F.col("record_type").eqNullSafe("revisit") & F.col("refers_to").isNotNull()
    known = rows.filter((F.col("record_type") == "response") & F.col("record_id").isNotNull())
    known = known.groupBy(F.col("record_id").alias("refers_to")).agg(
        F.max(F.when(F.col("intact"), F.struct("payload_bytes", "payload_digest"))).alias("stands_for")
    )
    stated = F.coalesce(F.struct("payload_bytes", "payload_digest") == F.col("stands_for"), F.lit(False))
    revisits = rows.filter(is_revisit).join(known, "refers_to", "left").withColumn("intact", F.col("intact") & stated)
    return rows.filter(~is_revisit).unionByName(revisits.select(*rows.columns))


def page_digests(payloads: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, intact`` of archived pages, without damage."""
    number = lambda name: F.expr(f"try_cast(split({name}, ':')[2] AS bigint)")
    return payloads.filter(~F.col("record_type").eqNullSafe(DAMAGED)).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
        "intact",
    )
