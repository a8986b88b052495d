"""Web archives: a converter from the legacy ARC format to WARC, with its reader and writers.

ARC files of both versions are read by their own rules: the version block names the version, header
lines of version 1 end with four fields (IP address, date, content type, length) and those of version 2
with nine, and the declared length says where the content ends. From each record an equivalent WARC
record is made: an identifier derived from what it identifies, the timestamp in the new form, response
or resource as the type, and SHA-1 digests of block and payload. Records whose payload has appeared
become revisits of one response.

Archives are lists of rows, each the bytes of a record but for its last line feed, that Spark's text
writer ends and puts into gzip files; a file has at most FILE_RECORDS records of up to LARGE bytes, or
LARGE_RECORDS larger ones, so it is read again whole. All reading and writing goes through Spark, so
archives can be in any store that it reaches.

Which records become revisits is decided on an index of keys and digests. The decisions go to the files
rather than the files to them: a conversion scans the archives with the places to leave out, and revisits,
which have no payload, are made from the index. (Where even the list of places is too long to be sent to
the scan, the compressed files are dealt by path to meet it, a few to a task.)

Payloads of at least LEAST_BYTES that are equal: the one with the largest key is the response. Defined
results: a null payload is empty; a null URL is written as an empty one's stand-in `urn:none`; records
with a null key count as smaller than all others, and of equal records (repeated rows) the last one by
file and place is the response; a file that isn't an ARC file, or whose declared lengths don't fit, fails
with its path; an empty table gives archives without records, and they an empty result; other columns
aren't read; very long payloads are written whole, up to what a row of Spark holds (2 GB); identifiers
come from a file's path below the archive folder and the record's place.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, small_batches, table

FILE_RECORDS, LEAST_BYTES = 1000, 1000
LARGE, LARGE_RECORDS = 1 << 20, 16
#: Lists of places are sent to the scan up to so many files and places; responses up to so many rows.
BROADCAST_FILES, BROADCAST_PLACES, BROADCAST_RESPONSES, FILES_A_TASK = 100_000, 2_000_000, 200_000, 8
#: The folders that write_arc makes, with the records of a file.
WRITTEN = (("small", FILE_RECORDS), ("large", LARGE_RECORDS))
#: Header fields after the URL, by version of the ARC format (fixed values).
ARC_FIELDS = {
    1: ["IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
KEY_HEADER = "X-Record-Key"


# Writing ARC


def _arc_first(name: str, version: int) -> bytes:
    fields = " ".join(["URL", *ARC_FIELDS[version]])
    block = f"{version} 0 geoloom\n{fields}\n".encode()
    line = {1: f"filedesc://{name} 0.0.0.0 20240101000000 text/plain {len(block)}", 2: f"filedesc://{name} 0.0.0.0 20240101000000 text/plain 200 - - 0 {name} {len(block)}"}
    return line[version].encode() + b"\n" + block


def _arc_record(url: str, key: int | None, body: bytes, version: int, name: str, date: str) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
    head += (f"{KEY_HEADER}: {key}\r\n" if key is not None else "") + "\r\n"
    content = head.encode() + body
    middle = "text/html" if version == 1 else f"text/html 200 {hashlib.sha1(body).hexdigest()} - 0 {name}"
    return f"{url} 192.0.2.1 {date} {middle} {len(content)}\n".encode() + content


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "20240101000000") -> None:
    """Legacy archives of a table of pages, tasks taking turns between the versions."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        version, name = task % 2 + 1, f"part-{task}"
        for batch in batches:
            rows: list[bytes] = []
            for k, u, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n % FILE_RECORDS == 0:
                    rows.append(_arc_first(name, version))
                    n += 1
                rows.append(_arc_record((u or "urn:none").replace("\n", "%0A").replace("\r", "%0D"), k, (body or "").encode(), version, name, date))
                n += 1
                if sum(map(len, rows[-64:])) > 4 << 20 or len(rows) >= 64:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    rows = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(payload).cast("string").alias("_payload"))
    large = F.coalesce(F.octet_length("_payload") > LARGE, F.lit(False))
    for (part, most), of in zip(WRITTEN, (~large, large), strict=True):
        _write(rows.where(of).mapInArrow(records, "record binary"), f"{path}/{part}", most)


def _rows(rows: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])


def _write(records: DataFrame, path: str, most: int = FILE_RECORDS) -> None:
    """Each row's bytes and a line feed, in gzip files of so many rows. A cast from binary to string keeps the
    bytes as they are."""
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\n").option("maxRecordsPerFile", most).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("path", "content")


# Reading ARC


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file: place, url, ip, date, mime, content."""
    at, place, version = 0, 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # what ends the record before
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not version:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC file begins with filedesc://")
            version = int(data[end + 1 : end + 2])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
        fields = line.rsplit(" ", len(ARC_FIELDS[version]))
        if len(fields) != len(ARC_FIELDS[version]) + 1 or not fields[-1].isdigit():
            raise ValueError(f"not a header line of ARC version {version}: {line[:200]!r}")
        size = int(fields[-1])
        if end + 1 + size > len(data):
            raise ValueError(f"{size} bytes are declared, {len(data) - end - 1} are left")
        if not line.startswith("filedesc://"):
            yield {"place": place, "url": fields[0], "ip": fields[1], "date": fields[2], "mime": fields[3], "content": data[end + 1 : end + 1 + size]}
        place += 1
        at = end + 1 + size


def _http_parts(record: dict) -> tuple[bytes, bytes]:
    """(HTTP header block, payload); other records have no header block."""
    content = record["content"]
    if record["url"].startswith("http") and content.startswith(b"HTTP/"):
        end = content.find(b"\r\n\r\n")
        if end >= 0:
            return content[: end + 4], content[end + 4 :]
    if content.startswith(b"HTTP/") and b"\r\n\r\n" in content:
        end = content.index(b"\r\n\r\n")
        return content[: end + 4], content[end + 4 :]
    return b"", content


def _header(block: bytes, name: str) -> str | None:
    for line in block.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == name.lower().encode():
            return v.strip().decode("latin-1")
    return None


# Writing WARC


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(path: str, place: int) -> str:
    h = hashlib.sha256(f"{path}#{place}".encode()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}"


def _below(path: str, folder: str) -> str:
    """A file's path below the archive folder, whatever the store is called."""
    bare = lambda p: p.split("://", 1)[-1].removeprefix("file:").strip("/")
    whole, top = f"/{bare(path)}", f"/{bare(folder)}/"
    at = whole.find(top)
    return whole[at + len(top) :] if at >= 0 else whole


def warc_date(date: str) -> str:
    """An ARC date of 14 digits, or fewer from the left, as a WARC timestamp."""
    d = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() and len(date) < 14 else date[:14]
    if not (len(d) == 14 and d.isdigit()):
        raise ValueError(f"not an ARC date: {date!r}")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(path: str, record: dict, refers_to: tuple[str, str, str] | None) -> bytes:
    """The equivalent WARC record, without its last line feed. path: the file's below the archive folder;
    refers_to: (identifier, URL, ARC date) of the response that it revisits."""
    head, payload = _http_parts(record)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return _warc(_record_id(path, record["place"]), record["url"], record["ip"], record["date"], record["mime"], digest, head if refers_to else record["content"], bool(head), refers_to)


def _warc(ident: str, url: str, ip: str, date: str, mime: str, digest: str, block: bytes, http: bool, refers_to: tuple[str, str, str] | None) -> bytes:
    kind = "revisit" if refers_to else "response" if http else "resource"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{ident}>",
        f"WARC-Date: {warc_date(date)}",
        f"WARC-Target-URI: {url}",
        f"WARC-IP-Address: {ip}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: {_sha1(block)}",
        f"Content-Type: {'application/http; msgtype=response' if http else mime}",
    ]
    if refers_to:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{refers_to[0]}>",
            f"WARC-Refers-To-Target-URI: {refers_to[1]}",
            f"WARC-Refers-To-Date: {warc_date(refers_to[2])}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r"


_INDEX = "path string, place int, record_id string, key long, url string, ip string, date string, mime string, digest binary, payload_bytes long, head binary"


def index_arc(spark: SparkSession, path: str, least: int = LEAST_BYTES) -> DataFrame:
    """(path, place, record_id, key, url, ip, date, mime, digest, payload_bytes, head) of every record of ARC
    files; the HTTP header block of those that may become revisits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out: list[list] = [[] for _ in range(11)]
                try:
                    below = _below(name, path)
                    for r in parse_arc(gzip.decompress(content.as_buffer())):
                        head, payload = _http_parts(r)
                        key = _header(head, KEY_HEADER)
                        row = (name, r["place"], _record_id(below, r["place"]), int(key) if key else None, r["url"], r["ip"], r["date"], r["mime"], hashlib.sha1(payload).digest(), len(payload), head if len(payload) >= least else None)
                        for c, v in zip(out, row, strict=True):
                            c.append(v)
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from e
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], [c.split()[0] for c in _INDEX.split(", ")])

    return _files(spark, path).mapInArrow(rows, _INDEX)


def revisits(index: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """The index rows of the records that become revisits, with to_id, to_url and to_date."""
    large = index.where(F.col("payload_bytes") >= least)
    order = F.struct(F.col("key").isNotNull(), F.coalesce("key", F.lit(0)), "path", "place", "record_id", "url", "date")
    chosen = large.groupBy("digest", "payload_bytes").agg(F.max(order).alias("_to"), F.count("*").alias("_n")).where("_n > 1")
    # The rows of a digest with very many copies are split over tasks as a skewed join.
    joined = large.join(chosen, ["digest", "payload_bytes"])
    return joined.where("record_id <> _to.record_id").select(*index.columns, F.col("_to.record_id").alias("to_id"), F.col("_to.url").alias("to_url"), F.col("_to.date").alias("to_date"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST_BYTES, folders: tuple[tuple[str, int], ...] = (("", FILE_RECORDS),)) -> None:
    """Converts ARC files to WARC files: each folder below arc_path, with so many records a file, to one of
    that name, and all revisits to one more."""
    scratch = Scratch(spark)
    index = scratch.written(index_arc(spark, arc_path, least), "arc-index")
    decided = scratch.written(revisits(index, least), "revisits")
    # A file has at most FILE_RECORDS records, so its list of places is bounded.
    places = decided.groupBy("path").agg(F.collect_list("place").alias("places"))
    size = places.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("places")).first()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, out = batch.column(0)[k].as_py(), set(batch.column(2)[k].as_py() or ())
                below, rows, held = _below(name, arc_path), [], 0
                for r in parse_arc(gzip.decompress(batch.column(1)[k].as_buffer())):
                    if r["place"] not in out:
                        rows.append(warc_record(below, r, None))
                        held += len(rows[-1])
                    if len(rows) >= 64 or held > 4 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    for part, most in folders:
        files = _files(spark, f"{arc_path}/{part}".rstrip("/"))
        if size["files"] <= BROADCAST_FILES and size["places"] <= BROADCAST_PLACES:
            met = files.join(F.broadcast(places), "path", "left")
        else:
            n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["files"] // FILES_A_TASK))
            met = files.repartition(n, "path").join(places.repartition(n, "path"), "path", "left")
        _write(met.select("path", "content", "places").mapInArrow(records, "record binary"), f"{warc_path}/{part or 'records'}", most)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_warc(i, u, ip, d, m, base64.b32encode(h).decode(), head or b"", bool(head), (to, tu, td)) for i, u, ip, d, m, h, head, to, tu, td in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield _rows(rows)

    made = decided.select("record_id", "url", "ip", "date", "mime", "digest", "head", "to_id", "to_url", "to_date")
    _write(made.mapInArrow(again, "record binary"), f"{warc_path}/revisits")
    scratch.remove("arc-index", "revisits")


# Reading WARC


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of every record."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:100]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        if end + 4 + size > len(data):
            raise ValueError(f"{size} bytes are declared, {len(data) - end - 4} are left")
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str, contents: bool = False) -> DataFrame:
    """(record_id, key, url, date, record_type, to_id, payload_bytes, payload_digest[, payload]) of every
    record. Digests are verified against the blocks; a revisit's digest is its own header's, and its size is
    null here (`resolved` takes it from the response)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out: list[list] = [[] for _ in range(9 if contents else 8)]
                for fields, block in parse_warc(gzip.decompress(content.as_buffer())):
                    if _sha1(block) != fields["warc-block-digest"]:
                        raise ValueError(f"{name}: a block doesn't have its digest")
                    kind, http = fields["warc-type"], fields["content-type"].startswith("application/http")
                    head, payload = _http_parts({"url": "", "content": block}) if http else (b"", block)
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    size = None if kind == "revisit" else len(payload)
                    if kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: a payload doesn't have its digest")
                    key = _header(head, KEY_HEADER)
                    row = [fields["warc-record-id"].strip("<>"), int(key) if key else None, fields["warc-target-uri"], fields["warc-date"], kind, fields.get("warc-refers-to", "").strip("<>") or None, size, digest, payload]
                    for c, v in zip(out, row, strict=False):
                        c.append(v)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                names = ["record_id", "key", "url", "date", "record_type", "to_id", "payload_bytes", "payload_digest", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=False)], names[: len(out)])

    return _files(spark, path).mapInArrow(rows, "record_id string, key long, url string, date string, record_type string, to_id string, payload_bytes long, payload_digest string" + ", payload binary" * contents)


def resolved(rows: DataFrame) -> DataFrame:
    """Rows of read_warc, with to_key: a revisit has the size of the response that it refers to, and that
    one's key; null where the response isn't among the rows."""
    again = rows.where("record_type = 'revisit'")
    wanted = again.select(F.col("to_id").alias("record_id")).distinct()
    to = rows.where("record_type <> 'revisit'").join(wanted, "record_id", "left_semi").select(F.col("record_id").alias("to_id"), F.col("key").alias("to_key"), F.col("payload_bytes").alias("_bytes"))
    few = wanted.limit(BROADCAST_RESPONSES + 1).count() <= BROADCAST_RESPONSES
    met = again.join(F.broadcast(to) if few else to, "to_id", "left").withColumn("payload_bytes", F.col("_bytes")).drop("_bytes")
    return met.unionByName(rows.where("record_type <> 'revisit'").withColumn("to_key", F.lit(None).cast("long")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    write_arc(small_batches(table(spark, sf_dir, "pages")), scratch.path("arc"))
    convert(spark, scratch.path("arc"), scratch.path("warc"), folders=WRITTEN)
    rows = scratch.written(read_warc(spark, scratch.path("warc")), "warc-index")
    scratch.remove("arc", "warc")  # what the query returns is in the index
    return resolved(rows).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("to_key").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to FROM m
"""
