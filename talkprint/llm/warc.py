"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

A monolithic archive is one gzip stream over all its records: nothing in it can
be reached without inflating everything before it.  The normaliser inflates
such a stream once, piece by piece, rewrites every record as a gzip member of
its own and puts an index of offsets beside the archive.  Afterwards any record
is one seek and one small inflate away.

Files go through ``pyarrow.fs``, so a folder is any URI that it knows (local or
shared path, hdfs, s3, ...).  Every attempt of a task writes under a name of its
own and only the rows that Spark commits name a file, so retries and lost
executors leave unread files at worst.
"""

import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkprint.llm.common import map_batches, utf8
from talkprint.sources.shared import scratch, settle

VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
PIECE = 1 << 20
MIN_REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
#: What the scheduler of a large cluster takes well; beyond it a task rewrites several archives.
MAX_TASKS = 20_000


def _open(uri: str):
    where, path = fs.FileSystem.from_uri(uri)
    return where, path


def _folder(uri: str) -> None:
    where, path = _open(uri)
    where.create_dir(path, recursive=True)


def record_id(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"null" if page_id is None else b"%d" % page_id)


def page_of(record: bytes) -> int | None:
    value = record.removeprefix(b"<urn:page:").removesuffix(b">")
    return None if value == b"null" else int(value)


def _header_text(value: str | None) -> bytes:
    """A header value on one line: white space and control characters as percent codes."""
    return b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes([c]) for c in (value or "").encode())


def head(fields: list[tuple[bytes, bytes]]) -> bytes:
    return VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in fields) + b"\r\n"


def response(page_id: int | None, url: str | None, payload: bytes, digest: bytes, date: str = DATE) -> bytes:
    """A response record; its payload follows an HTTP head that states the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        (b"WARC-Type", b"response"), (b"WARC-Record-ID", record_id(page_id)), (b"WARC-Date", date.encode()),
        (b"WARC-Target-URI", _header_text(url)), (b"WARC-Payload-Digest", b"sha256:" + digest),
        (b"Content-Type", b"application/http; msgtype=response"), (b"Content-Length", b"%d" % (len(http) + len(payload))),
    ]
    return head(fields) + http + payload + b"\r\n\r\n"


class Inflated:
    """The bytes of a gzip file of one or many members, read in bounded pieces."""

    def __init__(self, source):
        self.source, self.inflater, self.fed = source, zlib.decompressobj(31), False
        self.buffer, self.at = b"", 0

    def _more(self) -> bool:
        while True:
            if self.inflater.eof:
                rest = self.inflater.unused_data
                self.inflater, self.fed = zlib.decompressobj(31), False
            else:
                rest = self.inflater.unconsumed_tail
            rest = rest or self.source.read(PIECE)
            if not rest:
                if self.fed and not self.inflater.eof:
                    raise ValueError("the gzip stream ends early")
                return False
            self.fed = True
            got = self.inflater.decompress(rest, PIECE)
            if got:
                # What has been read goes once per piece, not at every record.
                self.buffer, self.at = self.buffer[self.at:] + got, 0
                return True

    def read(self, size: int) -> bytes:
        while len(self.buffer) - self.at < size:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        self.at += size
        return self.buffer[self.at - size:self.at]

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the archive."""
        found = self.buffer.find(mark, self.at)
        while found < 0:
            seen = len(self.buffer) - self.at
            if not self._more():
                if self.buffer[self.at:].strip():
                    raise ValueError("the archive ends inside a header")
                return None
            found = self.buffer.find(mark, max(0, seen - len(mark)))
        return self.read(found + len(mark) - self.at)


def parse_head(block: bytes) -> list[tuple[bytes, bytes]]:
    first, *lines = block.strip(b"\r\n").split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError(f"no record starts with {first[:40]!r}")
    return [(k.strip(), v.strip()) for k, _, v in (line.partition(b":") for line in lines)]


def _revisit(fields: list[tuple[bytes, bytes]], refers_to: int, http: bytes) -> bytes:
    """The record that stands for an equal payload: same head, the first record's id, only the HTTP head as block."""
    drop = {b"WARC-Type", b"Content-Length"}
    kept = [(k, v) for k, v in fields if k not in drop]
    kept = [
        (b"WARC-Type", b"revisit"), *kept, (b"WARC-Profile", REVISIT_PROFILE), (b"WARC-Refers-To", record_id(refers_to)),
        (b"Content-Length", b"%d" % len(http)),
    ]
    return head(kept) + http + b"\r\n\r\n"


def write_monolithic(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a response record into archives that are one gzip stream each.

    Returns a row per record: ``archive, place`` (its number in the archive),
    ``page_id, payload_bytes, digest``.  Null html is an empty payload.  An
    archive is closed after ``FILE_BYTES`` of records.
    """
    _folder(folder)

    def run(batches):
        out = name = deflate = None
        written = place = 0

        def close():
            out.write(deflate.flush())
            out.close()

        for b in batches:
            rows = [[], [], b["id"], [], []]
            for page_id, url, payload in zip(b["id"], b["url"], b["html"], strict=True):
                if out is None or written > FILE_BYTES:
                    if out is not None:
                        close()
                    name, written, place = f"{folder}/mono-{uuid.uuid4().hex}.warc.gz", 0, 0
                    where, path = _open(name)
                    out, deflate = where.open_output_stream(path, compression=None), zlib.compressobj(3, zlib.DEFLATED, 31)
                digest = hashlib.sha256(payload).hexdigest()
                record = response(page_id, url, payload, digest.encode())
                out.write(deflate.compress(record))
                rows[0].append(name)
                rows[1].append(place)
                rows[3].append(len(payload))
                rows[4].append(digest)
                written += len(record)
                place += 1
            yield rows
        if out is not None:
            close()

    narrow = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), utf8(html_col).alias("html"))
    return map_batches(narrow, run, "archive string, place long, page_id long, payload_bytes long, digest string")


def revisits(records: DataFrame, at_least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``archive, place, refers_to`` of the records that repeat a payload.

    Of equal payloads of ``at_least`` bytes the smallest page id stays a
    response; rows that share that id stay responses too.  Null ids are never
    the smallest; a payload that only null ids have is not revisited.  The count
    per digest is combined before the shuffle, and only digests that occur
    twice are joined back.
    """
    large = records.where(F.col("payload_bytes") >= at_least)
    firsts = settle(
        large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("refers_to"))
        .where("n > 1 and refers_to is not null").select("digest", "refers_to"), "warc-firsts",
    )
    return large.join(firsts, "digest").where("page_id is null or page_id <> refers_to").select("archive", "place", "refers_to")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite monolithic archives record by record and index them.

    ``archives``: ``archive`` and ``changes``, an array of (place, refers_to)
    for records to turn into revisits (null: none).  Each archive is one row and
    is streamed, so memory is bounded by one piece, whatever its size.  Returns
    ``archive`` (the new file), ``sidecar`` (its index of tab-separated offset,
    length, type and record id) and ``records``.
    """
    _folder(folder)

    def rewrite(name: str, changes: dict[int, int]) -> tuple[str, str, int]:
        where, path = _open(name)
        target = f"{folder}/norm-{uuid.uuid4().hex}.warc.gz"
        to, to_path = _open(target)
        place = offset = 0
        with (
            where.open_input_stream(path, compression=None) as source, to.open_output_stream(to_path, compression=None) as out,
            to.open_output_stream(to_path + ".idx", compression=None) as index,
        ):
            stream = Inflated(source)
            while (block := stream.until(b"\r\n\r\n")) is not None:
                fields = parse_head(block)
                by_name = {k.lower(): v for k, v in fields}
                kind, length = by_name[b"warc-type"], int(by_name[b"content-length"])
                deflate, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0

                def put(data: bytes, last: bool = False) -> None:
                    nonlocal size
                    got = deflate.compress(data) + (deflate.flush() if last else b"")
                    size += len(got)
                    out.write(got)

                if (refers_to := changes.get(place)) is not None:
                    kind, http = b"revisit", stream.until(b"\r\n\r\n")
                    put(_revisit(fields, refers_to, http), last=True)
                    length -= len(http)
                    while length:
                        length -= len(stream.read(min(length, PIECE)))
                else:
                    put(head(fields))
                    while length:
                        data = stream.read(min(length, PIECE))
                        length -= len(data)
                        put(data)
                    put(b"\r\n\r\n", last=True)
                if stream.read(4) != b"\r\n\r\n":
                    raise ValueError(f"{name}: record {place} is longer than it says")
                index.write(b"%d\t%d\t%s\t%s\n" % (offset, size, kind, by_name[b"warc-record-id"]))
                offset += size
                place += 1
        return target, f"{target}.idx", place

    def run(batches):
        for b in batches:
            for name, changes in zip(b["archive"], b["changes"], strict=True):
                target, sidecar, n = rewrite(name, {c["place"]: c["refers_to"] for c in changes or ()})
                yield [[target], [sidecar], [n]]

    return map_batches(archives.select("archive", "changes"), run, "archive string, sidecar string, records long")


def fetch(source, offset: int, length: int) -> tuple[dict[bytes, bytes], bytes]:
    """Header fields and block of the record that the index puts at ``offset``."""
    source.seek(offset)
    data = zlib.decompress(source.read(length), 31)
    end = data.index(b"\r\n\r\n") + 4
    return {k.lower(): v for k, v in parse_head(data[:end])}, data[end:-4]


def read_indexed(files: DataFrame) -> DataFrame:
    """Read archives back through their sidecars (columns ``archive, sidecar``).

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``.
    A response's digest is computed from its payload and must equal its header;
    a revisit states digest and length of the payload that it stands for.
    """

    def rows(name: str, sidecar: str) -> Iterator[tuple]:
        where, path = _open(name)
        at, at_path = _open(sidecar)
        with where.open_input_file(path) as source, at.open_input_stream(at_path, compression=None) as index:
            rest = b""
            while True:
                got = index.read(PIECE)
                *lines, rest = (rest + got).split(b"\n")
                for line in lines:
                    offset, length, kind, rid = line.split(b"\t")
                    fields, block = fetch(source, int(offset), int(length))
                    end = block.index(b"\r\n\r\n") + 4
                    http = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in block[:end].split(b"\r\n")[1:])}
                    digest, size = fields[b"warc-payload-digest"].removeprefix(b"sha256:"), int(http[b"content-length"])
                    refers_to = None
                    if kind == b"revisit":
                        refers_to = page_of(fields[b"warc-refers-to"])
                    elif len(block) - end != size or hashlib.sha256(memoryview(block)[end:]).hexdigest().encode() != digest:
                        raise ValueError(f"{name}: payload of {rid!r} does not match its header")
                    yield page_of(rid), size, digest.decode(), kind.decode(), refers_to
                if not got:
                    return

    def run(batches):
        for b in batches:
            for name, sidecar in zip(b["archive"], b["sidecar"], strict=True):
                some = []
                for row in rows(name, sidecar):
                    some.append(row)
                    if len(some) == 5000:
                        yield list(zip(*some, strict=True))
                        some = []
                if some:
                    yield list(zip(*some, strict=True))

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return map_batches(files.select("archive", "sidecar"), run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, at_least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write, normalise with revisits, and return ``archive, sidecar, records`` of the finished files.

    ``folder`` defaults to a fresh one in the session's shared folder.  Only ids
    and digests are shuffled; payloads stay in their files.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    records = settle(write_monolithic(pages, f"{folder}/monolithic"), "warc-records")
    changed = revisits(records, at_least).groupBy("archive").agg(F.collect_list(F.struct("place", "refers_to")).alias("changes"))
    files = settle(records.select("archive").distinct().join(changed, "archive", "left"), "warc-changes")
    return settle(normalise(_spread(files), f"{folder}/archives"), "warc-files")


def _spread(files: DataFrame) -> DataFrame:
    """A task per archive, as far as ``MAX_TASKS`` go.

    A row stands for a whole file, so the number is stated: by the bytes of its rows AQE would put them all into one task.
    """
    return files.repartition(min(max(files.count(), 1), MAX_TASKS), "archive")


def round_trip(pages: DataFrame, folder: str | None = None, at_least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Archive every page and read all of it back."""
    return read_indexed(_spread(archive_pages(pages, folder, at_least)))
