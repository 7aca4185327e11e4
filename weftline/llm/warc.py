"""WARC archives compressed with a dictionary (.warc.zst): writer and reader.

An archive starts with a skippable frame that holds a Zstandard dictionary, built from
the archive's own first records; each record follows in a frame of its own.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, open_fs, shared_dir, ship

#: First four bytes of the skippable frame with the dictionary.
MAGIC = 0x184D2A5D
#: Bytes of records after which an archive is closed, and that its dictionary is built from at most.
ARCHIVE_BYTES, SAMPLE_BYTES, DICT_BYTES = 32 << 20, 2 << 20, 64 << 10
LEVEL = 3
#: Bytes of an archive that are decompressed at a time.
PIECE = 16 << 10
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(url: str | None) -> str:
    return quote(url or "about:blank", safe="%:/?#[]@!$&'()*+,;=~-._")


def record_id(page_id: int | None, url: str | None, digest: str, place: str = "") -> str:
    """The id of a record; place tells records apart that are alike in all else."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest} {place}')}>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, place: str = "", refers_to: int | None = None, refers_url: str | None = None, refers_id: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A record of WARC/1.1. Its block is an HTTP head and, in a response, the payload.

    A revisit names the page that it refers to, the page's URL and date, and the id of the
    page's record where only one record is that page's.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url, digest, place)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers_to}"]
        if refers_id:
            head.append(f"WARC-Refers-To: {refers_id}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo() -> bytes:
    block = b"software: weftline\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo')}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on the samples; on too few of them, the samples themselves; of none, nothing."""
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """The bytes of an archive: the first records wait for the dictionary that is built from them."""

    def __init__(self) -> None:
        self.waiting, self.size, self.out, self.compressor = [warcinfo()], 0, [], None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        if self.compressor is None:
            self.waiting.append(data)
            if self.size >= SAMPLE_BYTES:
                self._start()
        else:
            self.out.append(self.compressor.compress(data))

    def _start(self) -> None:
        # A record that is longer than a sixteenth of the sample gives its first part to it.
        d = build_dictionary([x[: SAMPLE_BYTES // 16] for x in self.waiting[1:]])
        if d is not None:
            raw = zstandard.ZstdCompressor(level=19).compress(d.as_bytes())
            self.out.append(struct.pack("<II", MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True) if d else zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.out += [self.compressor.compress(x) for x in self.waiting]
        self.waiting = []

    def close(self) -> bytes:
        if self.compressor is None:
            self._start()
        return b"".join(self.out)


def read_records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, decompressed one by one."""
    at, d = 0, None
    while at + 8 <= len(data) and 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
        magic, size = struct.unpack_from("<II", data, at)
        if magic == MAGIC:
            raw = data[at + 8 : at + 8 + size]
            raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == b"\x28\xb5\x2f\xfd" else raw
            kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            d = zstandard.ZstdCompressionDict(raw, dict_type=kind)
        at += 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
    while at < len(data):
        one, parts = reader.decompressobj(), []
        while not one.eof:
            piece = data[at : at + PIECE]  # what is left over of it is copied, so it is small
            if not piece:
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """(page_id, url, html, digest, keeper, keeper_url, alone, named).

    Of equal payloads of at least `least` bytes the largest page_id is the response, and the
    keeper of the others, which revisit it; a keeper of null is a response. Rows that repeat
    the largest id are responses too; alone says that there is one of them only, and named
    that this row is such a one. Null ids never are the largest. Ids are integers of 64 bits.
    """
    html = F.coalesce(col(html_col), F.lit(""))
    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    # By digest and id first, so that the size of a group of copies folds before its digest's task.
    ids = rows.where(F.octet_length("html") >= least).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url"))
    top = F.max(F.struct("page_id", "n", "url")).alias("top")
    groups = ids.groupBy("digest").agg(top, F.sum("n").alias("n")).where("n > 1 AND top.page_id IS NOT NULL")
    # By the bytes of the digest, not by its text as above: a group of very many copies can be split.
    kept = groups.select(F.unhex("digest").alias("d"), "top")
    joined = rows.join(kept, F.unhex("digest") == F.col("d"), "left")
    again = F.coalesce(F.col("page_id") != F.col("top.page_id"), F.col("top").isNotNull())
    only = F.coalesce(F.col("top.n") == 1, F.lit(False))
    return joined.select("page_id", "url", "html", "digest", F.when(again, F.col("top.page_id")).alias("keeper"), F.when(again, F.col("top.url")).alias("keeper_url"), only.alias("alone"), (only & ~again).alias("named"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, **columns) -> int:
    """Writes a record for each row of pages into folder/part-N/N.warc.zst; returns how many.

    A task writes into a folder of its own that it renames as it ends: the first attempt
    to end counts, what failed ones left is never read. Null payloads are empty, null
    URLs about:blank.
    """
    ship(pages.sparkSession)

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = open_fs(folder)
        task = TaskContext.get()
        part = f"{task.partitionId():08d}"
        own, final = f"{top}/_attempt-{task.taskAttemptId()}-{uuid.uuid4().hex}", f"{top}/part-{part}"
        number, rows, archive = 0, 0, Archive()

        def flush() -> None:
            nonlocal number, archive
            fs.create_dir(own, recursive=True)
            with fs.open_output_stream(f"{own}/{number:05d}.warc.zst", compression=None) as f:
                f.write(archive.close())
            number, archive = number + 1, Archive()

        for pdf in parts:
            for page, url, html, digest, keeper, keeper_url, alone, named in zip(*(pdf[c] for c in pdf.columns), strict=True):
                page, keeper = (None if x is None else int(x) for x in (page, keeper))
                # Only the record that revisits may name has an id that others can work out.
                place = "" if named else f"{part} {rows}"
                refers_id = record_id(keeper, keeper_url, digest) if keeper is not None and alone else None
                archive.add(record("response" if keeper is None else "revisit", page, url, html.encode("utf-8", "surrogatepass"), digest, place, keeper, keeper_url, refers_id))
                rows += 1
                if archive.size >= archive_bytes:
                    flush()
        if rows and (archive.size or not number):
            flush()
        if number:
            from pyarrow.fs import FileType

            if fs.get_file_info(final).type == FileType.NotFound:
                try:
                    fs.move(own, final)
                except OSError:  # another attempt was first
                    if fs.get_file_info(final).type == FileType.NotFound:
                        raise
                    fs.delete_dir(own)
            else:
                fs.delete_dir(own)
        yield pd.DataFrame({"n": [rows]})

    found = deduplicated(pages, **columns)
    # Ids as text: pandas would keep nullable numbers as floats and lose digits.
    found = found.withColumns({c: F.col(c).cast("string") for c in ("page_id", "keeper")})
    return found.mapInPandas(of, "n long").agg(F.sum("n")).first()[0] or 0


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark, folder: str, with_payload: bool = True) -> DataFrame:
    """The response and revisit records under folder, their payloads checked against the digests.

    A revisit has no payload of its own; its length and digest are those of the page it
    refers to. A page_id is null where the record names none. A damaged record fails.
    """
    ship(spark)

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(0):
                data, found, size = content.as_py(), [], 0
                for raw in read_records(data):
                    head, block = parse(raw)
                    if head["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
                    revisit = head["warc-type"] == "revisit"
                    length = int(dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"content-length"])
                    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record {head.get('warc-record-id')}")
                    page, to = head.get("x-page-id"), head.get("x-refers-to-page")
                    found.append((page and int(page), head["warc-target-uri"], head["warc-type"], to and int(to), length, digest, payload if with_payload and not revisit else None))
                    size += len(payload)
                    if size > 8 << 20:
                        yield _batch(found)
                        found, size = [], 0
                yield _batch(found)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.zst").load(f"{folder}/part-*").select("content")
    return files.mapInArrow(of, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def archive_and_read(pages: DataFrame, with_payload: bool = False, **columns) -> DataFrame:
    """Writes pages to archives in the shared folder and reads these back.

    A record for each row, repeated rows included, each under a record id of its own. Null
    and empty payloads have no bytes, null URLs are about:blank, null ids are null again. Of
    equal payloads of 1000 bytes or more those with the largest id are responses, even if
    several rows have it. Payloads of any length are kept whole, one to a record. No rows:
    none. Other columns of pages, whatever their names, are not archived.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark)
    if not write_archives(pages, folder, **columns):
        return spark.createDataFrame([], RECORDS)
    return read_archives(spark, folder, with_payload)
