"""WARC archives: a writer, and a reader that salvages damaged files.

Every record is a gzip member of its own. Pages with equal payloads (of at least
`least_bytes`) are stored once: the one with the largest id is the response, the
others are revisits that refer to it. Files are written beside their name and then
moved to it; their rows are in order of id, so a task that runs again writes the
same files.

The reader checks member checksums, headers, lengths and digests. Where a check
fails it looks for the next gzip member or version line that begins a valid record,
goes on there, and reports the bytes between as a gap with its reason. Within a
member it does the same over what unpacked, also before damage; a record that fills
its damaged member alone goes with it. Archives, members and records may be of any
size: tasks open the files and unpack them step by step, holding one record at a time.
A payload of 2 GiB or more, which no column can hold, is read as null, its length and
digest as they are; a header of 1 GiB or more is a gap.

Null payload: empty. Null id: stored as a response of its own, id null when read.
Null target: empty. Rows that share the largest id: all are responses. Rows that
repeat id and payload: a record each. Empty table: no files, no rows. Only the three
named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calstack.llm.common import batches_of, small_batches, stored

#: Payload bytes after which a writer starts another file.
FILE_BYTES = 32 << 20
#: Longest header. A record longer than LARGE is looked for whole before it is held.
HEADER_BYTES, LARGE = 1 << 30, 16 << 20
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
GZIP = b"\x1f\x8b\x08"
MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
READ_BYTES, COLUMN_BYTES = 1 << 20, (1 << 31) - (1 << 16)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Record(NamedTuple):
    offset: int
    length: int
    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes


class Gap(NamedTuple):
    offset: int
    length: int
    reason: str


def headers(block: bytes) -> dict[str, str]:
    """Header lines after the first, by lower-case name; a line that begins with a
    blank goes on with the one before."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", block).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("malformed header")
        out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def record(kind: str, record_id: str, target: str, date: str, payload: bytes, size: int, digest: str, refers_to: str | None = None) -> bytes:
    """One record; `size` and `digest` are of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", target)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {target}", f"WARC-Date: {date}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Source:
    """Bytes of an archive, read as they are needed: `fetch` gives (start, length)."""

    def __init__(self, size: int, fetch: Callable[[int, int], bytes]) -> None:
        self.size, self.fetch = size, fetch
        self.first, self.held = 0, b""

    @classmethod
    def of(cls, content: bytes) -> Source:
        made = cls(len(content), lambda start, length: content[start : start + length])
        made.held = content
        return made

    def read(self, start: int, length: int) -> bytes:
        at = start - self.first
        if at < 0 or at + length > len(self.held):
            if start >= self.size or (self.first <= start and self.first + len(self.held) >= self.size):
                return self.held[max(0, at) : at + length] if at >= 0 else b""
            self.first, self.held = start, self.fetch(start, max(length, READ_BYTES))
            at = 0
        return self.held[at : at + length]

    def reaches(self, stop: int) -> bool:
        return stop <= self.size

    def find(self, pattern: re.Pattern, at: int) -> int | None:
        """Where the pattern is next found, from `at` on."""
        while part := self.read(at, READ_BYTES):
            if found := pattern.search(part):
                return at + found.start()
            if len(part) < 17:
                return None
            at += len(part) - 16
        return None


class Member(Source):
    """What the gzip member at a place of a source unpacks to, as it is needed; `damage`
    is None unless it is cut or its checksum does not hold, `end` where it ends."""

    def __init__(self, source: Source, at: int) -> None:
        self.source, self.at, self.end = source, at, at
        self.machine, self.damage = zlib.decompressobj(31), None
        self.first, self.held = 0, bytearray()

    def more(self) -> bool:
        if self.damage or self.machine.eof:
            return False
        data = self.source.read(self.end, 4096 if self.end == self.at else 65536)
        if not data:
            self.damage = "truncated member"
            return False
        before = self.machine.copy()
        try:
            self.held += self.machine.decompress(data)
        except zlib.error:
            self.damage = "member does not unpack"
            try:  # what unpacks of the data before the damage
                for i in range(len(data)):
                    self.held += before.decompress(data[i : i + 1])
            except zlib.error:
                pass
            return True
        self.end += len(data) - len(self.machine.unused_data)
        return True

    def read(self, start: int, length: int) -> bytes:
        while self.first + len(self.held) < start + length and self.more():
            pass
        return bytes(self.held[start - self.first : start - self.first + length])

    def reaches(self, stop: int) -> bool:
        """Whether it is so long, without holding it."""
        size, at = self.first + len(self.held), self.end
        if size >= stop or self.damage or self.machine.eof:
            return size >= stop
        machine = self.machine.copy()
        try:
            while size < stop and not machine.eof and (data := self.source.read(at, 65536)):
                size, at = size + len(machine.decompress(data)), at + len(data)
        except zlib.error:
            pass
        return size >= stop

    def drop(self, before: int) -> None:
        del self.held[: before - self.first]
        self.first = before


def parse(source: Source, at: int) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """(fields, HTTP fields, payload, end) of the plain record at `at`."""
    head = source.read(at, 2048)
    if not VERSION.match(head):
        raise ValueError("no version line")
    size = 2048
    while (stop := head.find(b"\r\n\r\n")) < 0 and len(head) == size and size < HEADER_BYTES:  # a long header
        size *= 8
        head = source.read(at, size)
    if stop < 0:
        raise ValueError("no end of header")
    fields = headers(head[:stop])
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 19):
        raise ValueError("no length")
    start, size = at + stop + 4, int(length)
    if size > LARGE and not source.reaches(start + size + 4):
        raise ValueError("length leads beyond the end")
    block = source.read(start, size + 4)
    if block[size:] != b"\r\n\r\n":
        raise ValueError("length does not lead to the record's end")
    block = block[:size]
    if (want := fields.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != base32_sha1(block):
        raise ValueError("block digest differs")
    http, payload = {}, block
    if fields.get("content-type", "").startswith("application/http"):
        first, _, payload = block.partition(b"\r\n\r\n")
        http = headers(first)
        if fields.get("warc-type") == "response" and (want := fields.get("warc-payload-digest", "")).startswith("sha1:") and want[5:] != base32_sha1(payload):
            raise ValueError("payload digest differs")
    return fields, http, payload, start + size + 4


def in_member(member: Member) -> Iterator[tuple[int, int, tuple | str]]:
    """(start, end, record or reason) of the records and gaps of a member."""
    pos, gap = 0, None
    while member.read(pos, 1):
        try:
            *made, end = parse(member, pos)
        except ValueError as e:
            gap = gap or (pos, str(e))
            after = member.find(VERSION, pos + 1)
            pos = member.first + len(member.held) if after is None else after
            member.drop(pos)
            continue
        if gap:
            yield gap[0], pos, gap[1]
            gap = None
        yield pos, end, tuple(made)
        member.drop(end)
        pos = end
    if gap:
        yield gap[0], pos, gap[1]


def salvage(archive: bytes | Source) -> Iterator[Record | Gap]:
    """The valid records of an archive in order, and the gaps between them. Of a
    damaged member the records that unpacked whole come first, then its gap. What is
    in a member has the member's place, and as length that of the bytes read up to it."""
    source, at = Source.of(archive) if isinstance(archive, bytes) else archive, 0
    gap: tuple[int, str] | None = None

    def before(stop: int) -> Iterator[Gap]:
        nonlocal gap
        if gap:
            yield Gap(gap[0], stop - gap[0], gap[1])
            gap = None

    def plain(at: int) -> Iterator[Record | Gap]:
        fields, http, payload, end = parse(source, at)
        yield from before(at)
        yield Record(at, end - at, fields, http, payload)
        return end

    def packed(at: int) -> Iterator[Record | Gap]:
        member, held, sure = Member(source, at), [], False

        def made() -> Iterator[Record | Gap]:
            for a, b, x in held:
                yield Gap(at, member.end - at, f"in the member, at byte {a} to {b}: {x}") if isinstance(x, str) else Record(at, member.end - at, *x)
            held.clear()

        for item in in_member(member):
            if any(isinstance(x, tuple) for _, _, x in held):  # a record that is not the member's last
                yield from before(at)
                yield from made()
                sure = True
            held.append(item)
        if member.damage and held and isinstance(held[-1][2], str):
            held.pop()  # its cut end
        alone = not sure and len(held) == 1 and held[0][0] == 0  # the member's checksum is its own
        if not sure and ((member.damage and alone) or ((member.damage or held) and not any(isinstance(x, tuple) for _, _, x in held))):
            raise ValueError(member.damage or held[0][2])
        yield from before(at)
        yield from made()
        if member.damage:
            raise ValueError(member.damage)
        return member.end

    while at < source.size:
        try:
            at = yield from (packed(at) if source.read(at, 3) == GZIP else plain(at))
        except ValueError as e:
            gap = gap or (at, str(e))
            after = source.find(MARK, at + 1)
            at = source.size if after is None else after
    yield from before(source.size)


def with_decisions(pages: DataFrame, id_col: str, payload_col: str, url_col: str, least_bytes: int) -> DataFrame:
    """(id, url, payload, size, sha1, keep): keep is the id of the response where another
    row holds it. Who keeps a payload is decided on ids and digests alone; the few rows
    that do not are then looked up by both, so no payload is a key that many rows share."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.unhex(F.sha1("payload")))
    names = rows.where(F.col("id").isNotNull() & (F.col("size") >= least_bytes)).select("sha1", "id")
    groups = names.groupBy("sha1").agg(F.max("id").alias("keep"), F.min("id").alias("least")).where("least < keep").select("sha1", "keep")
    groups = stored(groups, "payloads")  # so that the join's own exchange can split a hot payload
    revisits = stored(names.join(groups, "sha1").where("id < keep").distinct(), "revisits")
    joined = rows.join(revisits, ["id", "sha1"], "left")
    return joined.withColumn("payload", F.when(F.col("keep").isNull(), F.col("payload")))


def write(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> int:
    """Writes a record per row into archives under `path`, a folder that all
    executors share, and returns the number of records."""
    small_batches(pages.sparkSession)
    rows = with_decisions(pages, id_col, payload_col, url_col, least_bytes).sortWithinPartitions("id").select("id", "url", "payload", "size", "sha1", "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        part, number, done = f"{context.partitionId():06d}", 0, 0
        out, held, own = None, 0, ""

        def close() -> None:
            out.close()
            if store.get_file_info(own).type != fs.FileType.NotFound:
                store.delete_file(own)
            store.move(f"{own}.{context.taskAttemptId()}", own)

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    own = f"{root}/part-{part}-{number:04d}.warc.gz"
                    out = store.open_output_stream(f"{own}.{context.taskAttemptId()}", compression=None)
                payload = row["payload"] or b""
                digest = base64.b32encode(row["sha1"]).decode()
                name = f"urn:page:{'null' if row['id'] is None else row['id']}"
                keep = None if row["keep"] is None else f"urn:page:{row['keep']}"
                data = record("response" if keep is None else "revisit", name, row["url"], date, payload, row["size"], digest, keep)
                out.write(gzip.compress(data, 6, mtime=0))
                done, held = done + 1, held + len(payload)
                if held >= file_bytes:
                    close()
                    out, held, number = None, 0, number + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    with batches_of(pages.sparkSession, 64):
        return int(rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0)


SCHEMA = "file string, offset long, length long, gap string, type string, record_id string, target string, refers_to string, payload_digest string, payload_bytes long, payload binary"


ROWS = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("target", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def rows_of(file: str, archive: bytes | Source, payloads: bool) -> Iterator[pa.RecordBatch]:
    """The rows of one archive, some megabytes of payload at a time."""
    out, held = [], 0
    for x in salvage(archive):
        if isinstance(x, Gap):
            out.append({"file": file, "offset": x.offset, "length": x.length, "gap": x.reason})
        else:
            get, kind = x.fields.get, x.fields.get("warc-type", "")
            digest = get("warc-payload-digest", "").removeprefix("sha1:") or base32_sha1(x.payload)
            size = x.http.get("content-length", "") if kind == "revisit" else ""
            row = {"file": file, "offset": x.offset, "length": x.length, "type": kind, "record_id": get("warc-record-id", "").strip("<>"), "target": get("warc-target-uri"), "payload_digest": digest}
            row |= {"refers_to": get("warc-refers-to", "").strip("<>") or None, "payload_bytes": int(size) if size.isdigit() else len(x.payload), "payload": x.payload if payloads and kind != "revisit" and len(x.payload) < COLUMN_BYTES else None}
            out.append(row)
            held += len(x.payload)
        if held >= 8 << 20 or len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, schema=ROWS)
            out, held = [], 0
    yield pa.RecordBatch.from_pylist(out, schema=ROWS)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for every record, and for every gap (gap holds its reason). A revisit's
    payload is null, its digest and payload_bytes those of the full payload. Archives
    are opened by their tasks, through the file system of their path."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
                with store.open_input_file(at) as handle:
                    yield from rows_of(file, Source(size, lambda start, length, f=handle: f.read_at(length, start)), payloads)

    return files.select("path", "length").mapInArrow(opened, SCHEMA)
