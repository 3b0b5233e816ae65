"""WARC archives: a writer with revisit records, and a reader that salvages what it can from damaged files.

Writer: records are dealt to segment files of bounded size, one gzip member a record. Of the records with equal payloads (of at least ``min_bytes``) that
with the largest id is the response and the others revisit it. Every task writes files under names of its own and returns
their paths; only paths in the written manifest are read, so files of lost or repeated tasks do no harm.

Reader: walks a file member by member (or record by record, where it isn't compressed) as a stream. When a member doesn't inflate, a header is
broken, or a length or digest check fails, the records before the fault stay, the reader goes back to the start of the broken record and looks
on from there for the next version line, in the member's inflated bytes as far as they go, and then for the next gzip magic or version line of
the file. The bytes between are logged as a quarantined gap. It holds one record, or, without payloads, a window of the file.

Defined cases: a null payload is empty; null ids are written and read back as null; rows with equal id and payload are written as often as they occur, all
as responses if that id is the largest; empty tables give no files and an empty result; other columns are ignored; an empty or
hopeless file gives one gap; a header of more than ``HEADER`` bytes is broken (urls of over half as many are cut when they are written); a payload of more than ``ROW`` bytes, which no row
can hold, comes back null with its length and digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densigrid.llm.common import file_store, salted_join, shared_dir, written

# Fixed values of the WARC 1.1 format
VERSION = b"WARC/1.1\r\n"
VERSION_MARK = b"WARC/1."
MAGIC = b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-record:"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

# start and stop are places in the file. Within a gzip member, start is that of the member, stop how far the file was read for the row, and
# inner_start and inner_stop are places in the inflated bytes.
RECORDS = "kind string, path string, start long, stop long, inner_start long, inner_stop long, record_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, reason string"
WINDOW = 1 << 20
HEADER = 1 << 23
ROW = 1 << 30


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: five hex digits make four base32 digits."""
    code = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(code, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE32_HEX, BASE32)


def encode_record(record_id: int | None, payload: bytes, digest: str, refers_to: int | None, url: str | None = None) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP header, with the length of the payload, and leaves out the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    name = lambda i: f"<{ID_PREFIX}{'none' if i is None else i}>"
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(record_id)), ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url:
        # a reader takes longer headers for broken ones
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A").encode()[: HEADER // 2].decode(errors="ignore")))
    if refers_to is not None:
        head += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", REVISIT)]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, segment_bytes: int = 32 << 20, level: int = 3) -> DataFrame:
    """Writes (id long, url string, payload binary) and returns the written manifest (path, records, bytes)."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    own = pages.select("id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    own = own.withColumn("digest", sha1_base32(F.col("payload")))
    large = F.length("payload") >= min_bytes
    groups = own.where(large).groupBy("digest").agg(F.max("id").alias("main"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("digest", "main")
    # One payload may be shared by very many pages. Ids go to Python as text: whole numbers beside nulls would lose digits there.
    dealt = salted_join(own, groups, "digest", "id", pages.count(), "left").select(
        F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.when(large & ~F.col("id").eqNullSafe(F.col("main")), F.col("main")).cast("string").alias("refers_to"),
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = file_store(folder)
        store.create_dir(base, recursive=True)
        whole = lambda x: int(x) if isinstance(x, str) else None
        out, path, records, size = None, "", 0, 0
        done = []
        for rows in batches:
            for r in rows.itertuples(index=False):
                if out is None:
                    path, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = encode_record(whole(r.id), bytes(r.payload), r.digest, whole(r.refers_to), r.url)
                data = pack.compress(data) + pack.flush()
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= segment_bytes:
                    out.close()
                    done.append((f"{folder}/{path}", records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", records, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return written(dealt.mapInPandas(write, "path string, records long, bytes long"), "warc-manifest")


class Source:
    """Random access to a file through windows of bounded size."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""
        self.known: dict[bytes, tuple[int, int]] = {}  # of each mark the last search: from where, and the place found

    def read(self, start: int, n: int) -> bytes:
        if not (self.at <= start and start + n <= self.at + len(self.held)):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(max(n, WINDOW))
        return self.held[start - self.at : start - self.at + n]

    def find(self, mark: bytes, start: int) -> int:
        """The first place of the mark at or after ``start``, or the end of the file."""
        begin, found = self.known.get(mark, (0, -1))
        if begin <= start <= found:
            return found
        at, found = start, self.size
        while at < self.size:
            part = self.read(at, WINDOW)
            if (x := part.find(mark)) >= 0:
                found = at + x
                break
            at += max(1, len(part) - len(mark) + 1) if at + len(part) < self.size else self.size
        self.known[mark] = (start, found)
        return found


class Bad(Exception):
    """A check that failed, with its reason."""


class Stream:
    """The bytes of a file from a place on, or those of the gzip member there, in order. A copy is a place to go back to."""

    def __init__(self, src: Source, at: int, zipped: bool):
        self.src, self.at, self.pos, self.held = src, at, 0, b""  # pos: the place of the first byte held
        self.unzip = zlib.decompressobj(31) if zipped else None
        self.waiting, self.done, self.fault = b"", False, ""

    def copy(self) -> Stream:
        other = Stream.__new__(Stream)
        other.__dict__ |= self.__dict__
        if self.unzip is not None and not self.done:
            other.unzip = self.unzip.copy()
        return other

    def _more(self) -> bytes:
        if self.unzip is None:
            raw = self.src.read(self.at, min(WINDOW, self.src.size - self.at))
            self.at += len(raw)
            self.done = self.at >= self.src.size
            return raw
        raw = self.waiting or self.src.read(self.at, min(1 << 16, self.src.size - self.at))
        if not self.waiting:
            self.at += len(raw)
        if not raw:
            self.done, self.fault = True, "member cut short"
            return b""
        before = self.unzip.copy()
        try:
            out = self.unzip.decompress(raw, WINDOW)
        except zlib.error:
            out, k = b"", 0  # byte by byte up to the fault
            try:
                while k < len(raw):
                    out += before.decompress(raw[k : k + 1])
                    k += 1
            except zlib.error:
                pass
            self.at -= len(raw) - k
            self.waiting, self.done, self.fault = b"", True, "member does not inflate"
            return out
        self.waiting = self.unzip.unconsumed_tail
        if self.unzip.eof:
            self.done = True
            self.at -= len(self.unzip.unused_data)
            self.waiting = b""
        return out

    def hold(self, n: int) -> bytes:
        """Holds ``n`` bytes if there are so many; returns all that is held."""
        parts, have = [self.held], len(self.held)
        while have < n and not self.done:
            parts.append(self._more())
            have += len(parts[-1])
        if len(parts) > 1:
            self.held = b"".join(parts)
        return self.held

    def skip(self, n: int) -> None:
        self.held = self.held[n:]
        self.pos += n

    def seek(self, mark: bytes) -> bool:
        """Goes on to the next place of the mark; False, with everything passed over, if there is none."""
        while True:
            if (x := self.hold(len(mark)).find(mark)) >= 0:
                self.skip(x)
                return True
            if self.done:
                self.skip(len(self.held))
                return False
            self.skip(max(0, len(self.held) - len(mark) + 1))
            self.hold(len(self.held) + 1)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise Bad("header line")
        out[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    return out


def _record_number(text: str | None) -> int | None:
    name = (text or "").strip("<>").removeprefix(ID_PREFIX)
    digits = name.removeprefix("-")
    return int(name) if digits.isascii() and digits.isdigit() and len(digits) < 20 and -(1 << 63) <= int(name) < 1 << 63 else None


def _base32(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def take_record(s: Stream, keep_payload: bool = True) -> dict:
    """The record at the stream's place, checked; the stream goes on to the end of it. The payload is digested as it passes, and held only if it is kept."""
    if not s.hold(len(VERSION_MARK)).startswith(VERSION_MARK):
        raise Bad("version line")
    n = 1 << 12
    while (end := s.hold(n).find(b"\r\n\r\n")) < 0:
        if n >= HEADER or s.done:
            raise Bad("header has no end")
        n *= 4
    head = _fields(s.held[:end])
    s.skip(end + 4)
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Bad("content length")
    left = int(length)
    first = s.hold(min(left, HEADER))[: min(left, HEADER)]
    http, blank, _ = first.partition(b"\r\n\r\n")
    # Without an HTTP header there is no payload.
    ahead = len(http) + len(blank)
    whole, own, size, kept = hashlib.sha1(), hashlib.sha1(), 0, []
    kind = head.get("warc-type", "")
    keep = keep_payload and kind != "revisit" and left - ahead <= ROW
    while left:
        part = s.hold(min(left, WINDOW))[: min(left, WINDOW)]
        if not part:
            raise Bad("block length")
        whole.update(part)
        body = part[ahead:]
        ahead -= len(part) - len(body)
        own.update(body)
        size += len(body)
        if keep:
            kept.append(body)
        s.skip(len(part))
        left -= len(part)
    if s.hold(4)[:4] != b"\r\n\r\n":
        raise Bad("block length")
    s.skip(4)
    want = head.get("warc-block-digest")
    if want and want != "sha1:" + _base32(whole):
        raise Bad("block digest")
    digest, payload = head.get("warc-payload-digest", "").removeprefix("sha1:"), b"".join(kept) if keep else None
    if kind == "revisit":
        told = _fields(http).get("content-length", "") if blank else ""
        size = int(told) if told.isascii() and told.isdigit() else -1
    elif kind == "response":
        if digest and digest != _base32(own):
            raise Bad("payload digest")
        digest = _base32(own)
    return {"kind": "record", "record_id": _record_number(head.get("warc-record-id")), "record_type": kind, "refers_to": _record_number(head.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest, "payload": payload}


def _member(src: Source, at: int, keep_payload: bool) -> tuple[Iterator[dict], Stream]:
    """The records and inner gaps of the gzip member at ``at``, and the stream that is at its end when they have been taken."""
    s = Stream(src, at, True)

    def walk() -> Iterator[dict]:
        lost, why = None, ""
        while s.hold(1):
            begin, before = s.pos, s.copy()
            try:
                rec = take_record(s, keep_payload)
            except Bad as e:
                if lost is None:
                    lost, why = begin, s.fault or str(e)
                s.__dict__ |= before.__dict__
                s.skip(1)
                s.seek(VERSION_MARK)
                continue
            if lost is not None:
                yield {"kind": "gap", "inner_start": lost, "inner_stop": begin, "reason": why}
                lost = None
            s.hold(1)  # sees the end of the member, so that its place in the file is known
            yield rec | {"inner_start": begin, "inner_stop": s.pos}
        if lost is not None or s.fault:
            yield {"kind": "gap", "inner_start": s.pos if lost is None else lost, "inner_stop": s.pos, "reason": s.fault or why}

    return walk(), s


def salvage(src: Source, keep_payload: bool = True) -> Iterator[dict]:
    """Records and gaps of a file, in order. Gaps say which bytes were passed over, and why."""
    at, lost, why = 0, None, ""
    while at < src.size:
        good, reason, stop, after = False, "neither member nor version line", at, at + 1

        def ended():
            nonlocal lost
            if lost is not None and lost < at:
                yield {"kind": "gap", "start": lost, "stop": at, "reason": why}
            lost = None

        if src.read(at, 3) == MAGIC:
            found, s = _member(src, at, keep_payload)
            held: list[dict] = []  # gaps before the first record
            for x in found:
                if not good and x["kind"] == "gap":
                    held.append(x)
                    continue
                if not good:
                    good = True
                    yield from ended()
                    for gap in held:
                        yield gap | {"start": at, "stop": s.at}
                yield x | {"start": at, "stop": s.at}
            if good and not s.fault:
                at = s.at
                continue
            reason, stop, after = held[-1]["reason"] if held else "empty member", s.at, s.at if s.fault else at + 1
            if not good and not s.fault and not held:  # a member without a byte
                good, at = True, s.at
                continue
        elif src.read(at, len(VERSION_MARK)) == VERSION_MARK:
            s = Stream(src, at, False)
            try:
                rec = take_record(s, keep_payload)
            except Bad as e:
                reason = str(e)
            else:
                yield from ended()
                yield rec | {"start": at, "stop": at + s.pos}
                at += s.pos
                continue
        if good:  # a member that broke after good records: its inner gap is logged; go on in the file
            nearest = min(src.find(MAGIC, at + 1), src.find(VERSION_MARK, max(after, at + 1)))
            lost, why, at = stop, reason, nearest
            continue
        if lost is None:
            lost, why = at, reason
        at = min(src.find(MAGIC, at + 1), src.find(VERSION_MARK, at + 1))
    if lost is not None and lost < src.size:
        yield {"kind": "gap", "start": lost, "stop": src.size, "reason": why}
    elif src.size == 0:
        yield {"kind": "gap", "start": 0, "stop": 0, "reason": "empty file"}


def read_archives(manifest: DataFrame, parts: int | None = None, keep_payload: bool = True) -> DataFrame:
    """Records and gaps (columns RECORDS) of the files in ``manifest`` (path)."""
    names = [x.split(" ")[0] for x in RECORDS.split(", ")]
    spread = manifest.select("path").repartition(parts or manifest.sparkSession.sparkContext.defaultParallelism * 2, "path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path in rows["path"]:
                store, inner = file_store(path)
                held, size = [], 0
                with store.open_input_file(inner) as f:
                    for rec in salvage(Source(f, f.size()), keep_payload):
                        held.append(rec | {"path": path})
                        size += 200 + len(rec.get("payload") or b"")
                        if size > 8 << 20:
                            yield _frame(held, names)
                            held, size = [], 0
                yield _frame(held, names)

    return spread.mapInPandas(read, RECORDS)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    """Each column as objects from the start: whole numbers beside nulls would lose digits as floats."""
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})
