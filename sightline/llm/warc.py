"""WARC archives: a writer with revisit records, and a reader that salvages what damage leaves."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import common

#: Fixed values of the format: base-32 digits, and the profile of a revisit of an equal payload.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Most repeated payloads that are sent to all executors, the most frequent ones, some 60 bytes each; bits of a digest by which the rest are told from
#: payloads that occur once.
SENT = 200_000
PREFIX_BITS = 20
#: Bytes of an archive that are aimed at, and bytes unpacked at a time.
ARCHIVE = 1 << 26
PIECE = 1 << 20

_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_START = re.compile(rb"WARC/1\.[01]\r?\n|\x1f\x8b\x08")
_ID = re.compile(r"-?[0-9]{1,19}")
_LINE_END = re.compile(rb"\r\n")
_BODY = re.compile(rb"\r\n\r\n")
_NAME = re.compile(rb"([^\r\n:]*):")
_HTTP_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)", re.I)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def base32(hexadecimal: Column) -> Column:
    """A SHA-1 in hexadecimal as base 32: five digits (20 bits) give four."""
    digits = "".join("0123456789ABCDEFGHIJKLMNOPQRSTUV")
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), digits, BASE32)


def _with_first(plain: DataFrame, groups: DataFrame) -> DataFrame:
    """plain(sha, ...) with the first page of its payload, null where that occurs once. The most frequent payloads are joined by broadcast. Of the others,
    if there are more than can be sent, only rows that share a digest's prefix with a repeated payload are shuffled."""
    frequent = common.materialise(groups.orderBy(F.desc("n"), "sha").limit(SENT).select("sha", "first", F.lit(True).alias("sent")), "frequent-payloads")
    rows = plain.join(F.broadcast(frequent), "sha", "left")
    rest = common.materialise(groups.join(F.broadcast(frequent.select("sha")), "sha", "left_anti").select("sha", "first"), "rarer-payloads")
    if rest.isEmpty():
        return rows.drop("sent")
    prefix = F.shiftright(F.conv(F.substring("sha", 1, 8), 16, 10).cast("long"), 32 - PREFIX_BITS)
    some = rest.select(prefix.alias("prefix")).distinct().withColumn("near", F.lit(True))  # at most 2**PREFIX_BITS rows
    marked = rows.withColumn("prefix", prefix).join(F.broadcast(some), "prefix", "left")
    asked = F.col("sent").isNull() & F.col("near").isNotNull()
    names = [*plain.columns, "first"]
    looked_up = marked.where(asked).select(*plain.columns).join(rest, "sha", "left")
    return marked.where(~asked).select(*names).unionByName(looked_up.select(*names))


def records(pages: DataFrame) -> DataFrame:
    """page_id, record: the text of one WARC record for each row of pages(page_id, url, html).

    Of records with equal payloads that with the smallest page_id is a response and the others are revisits without payload, which carry its full
    length in the HTTP header and its digest. A null html is an empty payload; a null url gives no target; a null page_id sorts
    after all others (alone with its payload, it is a response); repeated rows of the response are responses too.
    """
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    plain = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    groups = plain.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    all_rows = _with_first(plain, common.materialise(groups, "repeated-payloads"))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    name = lambda c: F.concat(F.lit("<urn:sightline:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    url = F.regexp_replace(F.regexp_replace("url", "[\r\n]", ""), " ", "%20")
    line = lambda key, value: F.concat(F.lit(key + ": "), value, F.lit("\r\n"))
    none = F.lit("")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", name(F.col("page_id"))), line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", url), none), F.coalesce(line("X-Page-Id", F.col("page_id").cast("string")), none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))), line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32(F.sha1(block.cast("binary"))))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", name(F.col("first"))), line("X-Refers-To-Page-Id", F.col("first").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return all_rows.select("page_id", F.concat(head, block, F.lit("\r\n\r\n")).alias("record"))


def write_archives(pages: DataFrame, folder: str, records_per_file: int | None = None) -> None:
    """Write plain archives below folder through Spark's own committer, of about ARCHIVE bytes by the mean size of a record. Its text sink ends each value
    with a line feed, which is the record's last byte. An empty table writes none."""
    if records_per_file is None:
        size = pages.agg(F.avg(F.coalesce(F.octet_length(pages["html"].cast("string")), F.lit(0)) + 600).alias("b")).first()["b"] or 600
        records_per_file = max(1, int(ARCHIVE / size))
    rows = records(pages).select(F.expr("substring(record, 1, length(record) - 1)").alias("value"))
    rows.write.option("maxRecordsPerFile", records_per_file).text(folder)


#: Header lines that a record has once.
ONCE = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: What parse() says of data that end within a record.
SHORT = "length does not lead to the end of a record"
OPEN = "no end of headers"


def parse(data, at: int) -> tuple[dict, int] | str:
    """The record of a version line at a place of bytes or a memory view and where it ends, or why it is not valid."""
    if not (start := _VERSION.match(data, at)):
        return "no version line"
    fields, at = {}, start.end()
    while not _LINE_END.match(data, at):
        if not (name := _NAME.match(data, at)):
            return "bad header line" if at < len(data) - 1 else OPEN
        end = _LINE_END.search(data, name.end())
        if not end:
            return OPEN
        key = bytes(name[1]).strip().lower().decode("latin-1")
        if key in fields and key in ONCE:
            return "a header line twice"
        fields[key] = bytes(data[name.end() : end.start()]).strip().decode("utf-8", "replace")
        at = end.end()
    if not (length := fields.get("content-length", "")).isascii() or not length.isdigit():
        return "no length"
    body, size = at + 2, int(length)
    if body + size + 4 > len(data):
        return SHORT
    if bytes(data[body + size : body + size + 4]) != b"\r\n\r\n":
        return "no end of a record where its length leads"
    block = data[body : body + size]
    if (digest := fields.get("warc-block-digest", "")).startswith("sha1:") and digest[5:] != base32_sha1(block):
        return "block digest differs"
    kind, payload = fields.get("warc-type", ""), block
    stated = None
    if "application/http" in fields.get("content-type", ""):
        middle = _BODY.search(block)
        header, payload = (block[: middle.start()], block[middle.end() :]) if middle else (block, block[:0])
        if m := _HTTP_LENGTH.search(header):
            stated = int(m[1])
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if digest and digest != base32_sha1(payload):
            return "payload digest differs"
        digest, stated = base32_sha1(payload), len(payload)
    page, first = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    if not all(x is None or _ID.fullmatch(x) for x in (page, first)):
        return "an id that is no number"
    return {"record_type": kind, "uri": fields.get("warc-target-uri"), "record_id": fields.get("warc-record-id"), "page_id": int(page) if page else None, "refers_to": int(first) if first else None, "payload_bytes": len(payload) if stated is None else stated, "payload_digest": digest, "payload": payload}, body + size + 4


class _Member:
    """What a gzip member at a place unpacks to, piece by piece: never more than a record and a piece at once if its records are sound."""

    def __init__(self, data, at: int) -> None:
        self.data, self.at, self.unpack = data, at, zlib.decompressobj(31)
        self.buffer, self.dropped, self.why, self.end, self.damage = bytearray(), 0, "", None, at

    def more(self) -> bool:
        """Unpack another piece; False at the end of the member or where it is damaged (why)."""
        if self.why or self.end is not None:
            return False
        waiting = self.unpack.unconsumed_tail
        if not waiting and self.at >= len(self.data):
            self.why, self.damage = "gzip: member cut off", len(self.data)
            return False
        if not waiting:
            waiting = self.data[self.at : self.at + PIECE]
            self.at += len(waiting)
        before = self.unpack.copy()
        try:
            self.buffer += self.unpack.decompress(waiting, PIECE)
        except zlib.error as e:
            self.why = f"gzip: {e}"
            self.damage = self.at
            with contextlib.suppress(zlib.error):  # again byte by byte, for what unpacks before the damage
                for at in range(len(waiting)):
                    self.damage = self.at - len(waiting) + at
                    self.buffer += before.decompress(waiting[at : at + 1])
            return True
        if self.unpack.eof:
            self.end = self.at - len(self.unpack.unused_data)
        return True

    def entries(self) -> Iterator[tuple[str, int, int | None, dict | str]]:
        """Records and gaps of the unpacked bytes with their places there. A gap at the end of a damaged member has no length."""
        at, gap, why = 0, None, ""  # gap counts from the member's beginning, at from the buffer's
        while True:
            if at >= len(self.buffer) and not self.more():
                break
            if at >= len(self.buffer):
                continue
            with memoryview(self.buffer) as view:
                one = parse(view, at)
                if not isinstance(one, str):
                    one[0]["payload"] = bytes(one[0]["payload"])
            if isinstance(one, str) and (one in (OPEN, SHORT) or len(self.buffer) - at < 1 << 16) and self.more():
                continue
            if not isinstance(one, str):
                if gap is not None:
                    yield "gap", gap, self.dropped + at - gap, why
                    gap = None
                yield "record", self.dropped + at, one[1] - at, one[0]
                at = one[1]
            else:
                if gap is None:
                    gap, why = self.dropped + at, one
                following = _START.search(self.buffer, at + 1)
                at = following.start() if following else max(at + 1, len(self.buffer) - 16)
            if at >= PIECE:
                del self.buffer[:at]
                self.dropped, at = self.dropped + at, 0
        if gap is not None and not self.why:
            yield "gap", gap, self.dropped + len(self.buffer) - gap, why
        elif self.why:
            yield "gap", self.dropped + at if gap is None else gap, None, self.why


def salvage(data) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", offset, length, record) and ("gap", offset, length, reason) in order of bytes or a memory view; the distinct ranges cover every byte once.

    Where a check fails, the next version line or gzip member that passes all checks is searched for, and the bytes before it are quarantined.
    The records and gaps of one gzip member have the member's range; a record's inner_offset and inner_length are its place in what the member
    unpacks to, and a gap's reason states its own. A damaged member gives the sound records before the damage; its range reaches to the next start that
    passes. An empty archive gives nothing.
    """
    at, gap, why = 0, None, ""
    held: list[tuple[str, dict | str]] = []  # of a damaged member, whose end is not known yet
    damage, given = 0, Counter()
    mark = lambda r: (r["record_id"], r["record_type"], r["payload_digest"], r["payload_bytes"])

    def close(end: int):
        if held:
            yield from ((kind, gap, end - gap, what) for kind, what in held)
        else:
            yield "gap", gap, end - gap, why

    while at < len(data):
        if bytes(data[at : at + 3]) == b"\x1f\x8b\x08":
            member = _Member(data, at)
            inside = []
            for kind, start, length, what in member.entries():
                place = f"{'?' if length is None else length} bytes at {start} of the member"
                inside.append((kind, what | {"inner_offset": start, "inner_length": length} if kind == "record" else f"{what}: {place}"))
            good = any(kind == "record" for kind, _ in inside)
            if good or member.end is not None:
                if gap is not None:
                    yield from close(at)
                    gap, held = None, []
                if member.end is not None:
                    yield from ((kind, at, member.end - at, what) for kind, what in inside or [("gap", "member without a record")])
                    at = member.end
                    continue
                gap, held, damage = at, inside, member.damage
                given = Counter(mark(what) for kind, what in inside if kind == "record")
            elif gap is None:
                gap, why = at, member.why
        else:
            one = parse(data, at)
            if not isinstance(one, str) and at < damage and given[mark(one[0])] > 0:
                given[mark(one[0])] -= 1  # stored without compression in the damaged member, which has given it
                at = one[1]
                continue
            if not isinstance(one, str):
                if gap is not None:
                    yield from close(at)
                    gap, held = None, []
                yield "record", at, one[1] - at, one[0]
                at = one[1]
                continue
            if gap is None:
                gap, why = at, one
        following = _START.search(data, at + 1)
        at = following.start() if following else len(data)
    if gap is not None:
        yield from close(len(data))


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row a record or gap of all archives below path: kind, path, offset, length, reason (of gaps), page_id, record_id, uri, record_type,
    payload_bytes, payload_digest, refers_to and, if asked for, payload. A record without a page id or a reference has null there; empty archives and folders
    without any give no rows. A task holds one archive at a time as it was read; a file must be below 2 GB."""
    extra = ", payload binary" if payload else ""

    def make():
        def each(batch):
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for kind, start, length, found in salvage(memoryview(data.as_buffer())):
                    r = found if kind == "record" else {"reason": found}
                    if payload and kind == "record":
                        r = r | {"payload": bytes(r["payload"])}
                    size += len(r.get("payload", b"")) if payload else 100
                    rows.append(r | {"kind": kind, "path": name, "offset": start, "length": length})
                    if size > 1 << 24:
                        yield columns(rows)
                        rows, size = [], 0
                if rows:
                    yield columns(rows)

        return each

    names = ["kind", "path", "offset", "length", "reason", "page_id", "record_id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", *["payload"] * payload]

    def columns(rows):
        return {c: [r.get(c) for r in rows] for c in names}

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return common.arrow_map(files, make, "kind string, path string, offset long, length long, reason string, page_id long, record_id string, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long" + extra)


def archive_round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of pages, as read back from archives written below folder.

    Null and empty html are empty payloads; see records() for null ids and urls and for repeated rows. An empty table gives no rows; other columns are ignored."""
    write_archives(pages, folder)
    read = read_archives(pages.sparkSession, folder)
    return read.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
