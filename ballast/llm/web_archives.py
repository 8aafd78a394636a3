"""Legacy archive converter: ARC files, version 1 or 2, to equivalent WARC records.

``write_arc`` writes pages as ARC files, ``convert_arc`` reads ARC files by their declared lengths and
yields one row per capture with synthesised WARC fields, ``deduplicate`` names the response among captures with equal
payloads, ``write_warc`` writes WARC files and ``read_warc`` reads those back.  All files go through Spark's own readers and
writers; payload text is joined to headers inside the JVM, and a file is parsed record by record in one task, so a partition is written
as several files of some ``FILE_BYTES``, by the number of records that 99 of 100 records keep within it.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.functions.store import scratch_path, written

# The first record of an ARC file and the order of the header fields in each version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
CRLF = "\r\n"
WRITE = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
WARC_VERSION = "WARC/1.1"
FILE_BYTES = 16 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "page_id string, uri string, date string, ip string, mime string, head string, payload string, payload_bytes long, payload_digest string, record_id string"
RECORD = "record_type string, record_id string, refers_to_id string, page_id string, uri string, date string, payload string, payload_bytes long, payload_digest string"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _file_header(version: int) -> str:
    names = " ".join(ARC_FIELDS[version])
    body = f"{version} 0 crawl\n{names}\n\n"
    extra = " 200 - - 0 filedesc" if version == 2 else ""
    return f"filedesc://pages.arc 0.0.0.0 20240101000000 text/plain{extra} {len(body)}\n{body}"


def _arc_url(url: Column) -> Column:
    """A url as one field of a space-separated line: what would end the field or line is percent-encoded; none: ``-``."""
    out = F.coalesce(url.cast("string"), F.lit(""))
    out = F.regexp_replace(out, "%(?=20|0A|0D|09|25)", "%25")
    for char, code in ((" ", "%20"), ("\n", "%0A"), ("\r", "%0D"), ("\t", "%09")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return F.when(out == "", "-").otherwise(out)


def _one_line(value: Column) -> Column:
    """A text as part of a header line: line ends, and the sign that encodes them, as percent codes."""
    for char, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        value = F.replace(value, F.lit(char), F.lit(code))
    return value


def _page_id(head: str) -> str | None:
    found = _header(head, "X-Page-Id")
    return re.sub("%(25|0D|0A)", lambda m: chr(int(m[1], 16)), found) if found else None


def records_a_file(rows: DataFrame, size: Column) -> int:
    """How many records a file takes, so that nearly all files stay below ``FILE_BYTES``."""
    usual = rows.agg(F.percentile_approx(size + 1000, 0.99, 1000)).first()[0] or 1000
    return max(1, FILE_BYTES // int(usual))


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2), page_id: str = "page_id", url: str = "url", html: str = "html",
              date: str = "20240101000000") -> None:
    """Write pages as ARC files, the versions in turn by partition; the page id goes into an HTTP header of the capture.

    Null html is an empty payload, a null id an empty header, a null url ``-``.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}X-Page-Id: "),
                    _one_line(F.coalesce(F.col(page_id).cast("string"), F.lit(""))), F.lit(f"{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2))
    each = records_a_file(pages, F.octet_length(body))
    block = pages.select(_arc_url(F.col(url)).alias("url"), F.concat(head, body).alias("block"), F.spark_partition_id().alias("part"),
                         F.monotonically_increasing_id().alias("row"))
    lines, size = F.lit(None).cast("string"), F.octet_length("block").cast("string")
    for k, version in enumerate(versions):
        middle = " 200 - - 0 pages.arc " if version == 2 else " "
        record = F.concat(F.when(F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) % each == 0, F.concat(F.lit(_file_header(version)), F.lit("\n"))).otherwise(""),
                          F.col("url"), F.lit(f" 0.0.0.0 {date} text/html{middle}"), size, F.lit("\n"), F.col("block"))
        lines = F.when(F.col("part") % len(versions) == k, record).otherwise(lines)
    block.select(lines.alias("value")).write.options(lineSep="\n", maxRecordsPerFile=each, **WRITE).text(path)


def _opened(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each capture; the version in the file's first record says how its lines are cut."""
    at, names, begun = 0, ARC_FIELDS[1], False
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line:
            at = end + 1
            continue
        fields = line.split(" ")
        size = int(fields[-1])
        block = data[end + 1:end + 1 + size]
        if len(block) < size:
            raise ValueError(f"an ARC record declares {size} bytes, {len(block)} are left")
        at = end + 1 + size
        if not begun and line.startswith("filedesc:"):  # later ones are captures of such a url
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            names, begun = ARC_FIELDS[version], True
            continue
        begun = True
        # a url may hold spaces in files of careless writers: the other fields are counted from the end
        extra = len(fields) - len(names)
        yield dict(zip(names, [" ".join(fields[:extra + 1]), *fields[extra + 1:]])), block


def _http(block: bytes) -> tuple[str, bytes]:
    head, sep, payload = block.partition(b"\r\n\r\n")
    return (head.decode("utf-8", "replace"), payload) if sep and block.startswith(b"HTTP/") else ("", block)


def _header(head: str, name: str) -> str | None:
    found = re.search(rf"(?im)^{name}:[ ]*(.*?)\r?$", head)
    return found[1] if found else None


def _batches(rows: Iterator[tuple], names: list[str], most: int = 8 << 20) -> Iterator[pd.DataFrame]:
    batch, held = [], 0
    for row in rows:
        batch.append(row)
        held += 200 + sum(len(v) for v in row if isinstance(v, str))
        if held >= most:
            yield pd.DataFrame(batch, columns=names)
            batch, held = [], 0
    if batch:
        yield pd.DataFrame(batch, columns=names)


def _names(schema: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in schema.split(",")]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.regexp_extract("path", r"part-[0-9]+|[^/]*$", 0).alias("part"), F.regexp_extract("path", r"-c([0-9]+)\.", 1).alias("piece"), "content")


def convert_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per capture in the ARC files: page id, uri, WARC date, HTTP head, payload, its bytes and digest, a record id.

    The id is a name-based UUID of uri, page id, date, digest and the capture's place (file of the partition, number in it): repeated rows
    differ in it, and a rerun over the same partitions gives the same one.
    """

    def captures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                for part, piece, content in zip(batch["part"], batch["piece"], batch["content"]):
                    for place, (f, block) in enumerate(arc_records(_opened(content))):
                        head, payload = _http(block)
                        d, digest, key = f["Archive-date"].ljust(14, "0"), digest_of(payload), _page_id(head)
                        date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                        name = uuid.uuid5(uuid.NAMESPACE_URL, "|".join([f["URL"], key or "", d, digest, part, piece, str(place)]))
                        yield key, f["URL"], date, f["IP-address"], f["Content-type"], head, payload.decode("utf-8", "replace"), len(payload), digest, f"<urn:uuid:{name}>"

        return _batches(rows(), _names(CAPTURE))

    return _files(spark, path).mapInPandas(captures, CAPTURE)


def deduplicate(captures: DataFrame, least_bytes: int = 0, kind: str = "long") -> DataFrame:
    """Captures with refers_to_id: null for responses, for others the record id of the response with an equal payload.

    Of the captures with equal digests and at least ``least_bytes`` bytes the one with the smallest page id (then record id) is
    the response.  Only ids and digests are grouped; digests of many captures are one row on the grouped side.
    """
    key = F.struct(F.col("page_id").cast(kind).isNull().alias("n"), F.col("page_id").cast(kind).alias("p"), F.col("record_id").alias("r"))
    first = captures.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min(key).alias("k"), F.count("*").alias("c")) \
        .where("c > 1").select("payload_digest", F.col("k.r").alias("first_id"))
    found = captures.join(first, "payload_digest", "left")
    is_copy = (F.col("payload_bytes") >= least_bytes) & F.col("first_id").isNotNull() & (F.col("first_id") != F.col("record_id"))
    return found.withColumn("refers_to_id", F.when(is_copy, F.col("first_id"))).drop("first_id")


def write_warc(captures: DataFrame, path: str, each: int) -> None:
    """Write captures with refers_to_id as WARC files of ``each`` records at most: a response with its block, or a revisit with the HTTP head alone."""
    revisit = F.col("refers_to_id").isNotNull()
    block = F.concat(F.when(F.col("head") != "", F.concat("head", F.lit(CRLF * 2))).otherwise(""), F.when(revisit, "").otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    record = F.concat(
        F.lit(WARC_VERSION + CRLF), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("record_id")), line("WARC-Target-URI", F.col("uri")), line("WARC-Date", F.col("date")),
        line("WARC-IP-Address", F.col("ip")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.col("refers_to_id")), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        F.when(F.col("head") != "", line("Content-Type", F.lit("application/http; msgtype=response"))).otherwise(line("Content-Type", F.col("mime"))),
        line("Content-Length", F.octet_length(F.col("block")).cast("string")), F.lit(CRLF), F.col("block"))
    captures.withColumn("block", block).select(record.alias("value")).write.options(lineSep=CRLF * 2, maxRecordsPerFile=each, **WRITE).text(path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, cut by the declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record: " + first[:40])
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        yield fields, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; the payload of a response is checked against its digest, a revisit has none but tells its length."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                for content in batch["content"]:
                    for f, block in warc_records(_opened(content)):
                        head, payload = _http(block) if f["Content-Type"].startswith("application/http") else ("", block)
                        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        size, revisit = len(payload), f["WARC-Type"] == "revisit"
                        if revisit:
                            size = int(_header(head, "Content-Length"))
                        elif digest_of(payload) != digest:
                            raise ValueError(f"{f['WARC-Record-ID']}: the payload does not have the digest {digest}")
                        yield (f["WARC-Type"], f["WARC-Record-ID"], f.get("WARC-Refers-To"), _page_id(head), f["WARC-Target-URI"],
                               f["WARC-Date"], None if revisit else payload.decode("utf-8", "replace"), size, digest)

        return _batches(rows(), _names(RECORD))

    return _files(spark, path).mapInPandas(records, RECORD)


def convert(pages: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, str]:
    """Pages through ARC files to WARC files; the records read back, and the folder of the WARC files.

    Null html counts as empty, an empty table gives no records.  Repeated rows are captures of their own: one of them is the response
    if the page is the smallest of its payload, the others revisit it.
    """
    spark, kind = pages.sparkSession, pages.schema[page_id].dataType.simpleString()
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages.select(page_id, url, html), arc, page_id=page_id, url=url, html=html)
    captures = convert_arc(spark, arc)
    marked = deduplicate(captures.drop("payload", "head", "uri", "date", "ip", "mime"), least_bytes, kind).where("refers_to_id is not null").select("record_id", "refers_to_id").distinct()
    write_warc(captures.join(written(marked, "revisits"), "record_id", "left"), warc, records_a_file(pages, F.octet_length(F.coalesce(F.col(html).cast("string"), F.lit("")))))
    return read_warc(spark, warc), warc


def digest_rows(records: DataFrame, kind: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): records with the page that a revisit refers to, a row per record."""
    told = written(records.drop("payload"), "records")
    named = told.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").cast(kind).alias("refers_to"))
    columns = [F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"]
    alone = told.where("refers_to_id is null").withColumn("refers_to", F.lit(None).cast(kind)).select(*columns)  # most rows: they are not joined
    return alone.unionByName(told.where("refers_to_id is not null").join(named, "refers_to_id", "left").select(*columns))
