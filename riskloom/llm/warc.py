"""Content-addressed WARC archive.

``write_archive`` stores three things apart: payload bytes once per SHA-256
digest (recomputed and verified before they are stored), the exact header
block of every record, and the digest that ties them together.  A record whose
payload of at least ``MIN_REVISIT`` bytes was already archived under a smaller
page_id is a revisit of that record.  ``records`` reconstructs the original
records by joining headers and payloads and verifies the digests again;
``export_warc`` writes them as gzipped WARC files (a record ends with CRLF
CRLF, which is the line separator given to Spark's text writer), and
``read_warc`` parses such files by their Content-Length.  Payloads are stored
and shuffled deflated.

The first page of a digest is an aggregate with map-side combine; its table
and the payload table hold one row per digest and are written before the
joins, so Spark can split a digest that a third of the pages share.

Defined cases: null html is an empty payload; a null url is an empty target;
null page_ids come after all others (their records have no date of their own
and are never revisited unless no page with an id has the payload); of equal
page_ids with equal payloads all but one are revisits; empty table, empty
archive; extra columns are ignored.
"""
from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import BinaryType

from riskloom.llm.common import written

MIN_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"
#: Records per exported file; a file is parsed as a whole.
FILE_RECORDS = 500


@F.pandas_udf(BinaryType())
def packed(payload: pd.Series) -> pd.Series:
    """Payloads as they are stored and moved: deflated."""
    return payload.map(lambda b: zlib.compress(b, 6), na_action="ignore")


@F.pandas_udf(BinaryType())
def unpacked(blob: pd.Series) -> pd.Series:
    return blob.map(zlib.decompress, na_action="ignore")


def _header(kind: Column, page: Column, uri: Column, digest: Column, size: Column, refers: Column,
            number: Column) -> Column:
    """The header block of a record, without the empty line that ends it.
    Line ends inside a url are percent-coded."""
    url = F.regexp_replace(F.regexp_replace(F.coalesce(uri, F.lit("")), "\r", "%0D"), "\n", "%0A")
    name = F.coalesce(page.cast("string"), F.lit("none"))
    fields = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(":"), number.cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.concat(F.lit("X-Page-ID: "), F.coalesce(page.cast("string"), F.lit(""))),
        F.concat(F.lit("X-Payload-Length: "), size.cast("string"))]
    revisit = [F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.coalesce(refers.cast("string"), F.lit("none")), F.lit(":0>")),
               F.lit(f"WARC-Profile: {PROFILE}")]
    tail = [F.lit("Content-Type: text/html"),
            F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit("0")).otherwise(size.cast("string")))]
    return F.when(kind == "revisit", F.concat_ws(EOL, *fields, *revisit, *tail)).otherwise(
        F.concat_ws(EOL, *fields, *tail))


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Archive ``pages`` (page_id, url, html) below ``path``: headers/ and
    payloads/."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"),
                       F.octet_length("payload").cast("long").alias("size"))
    order = F.struct(F.col("page_id").isNull().alias("late"), "page_id", F.coalesce("url", F.lit("")).alias("url"))
    stored = rows.select("digest", packed("payload").alias("packed")).groupBy("digest").agg(F.first("packed").alias("packed"))
    checked = F.when(F.sha2(unpacked("packed"), 256) == F.col("digest"), F.col("packed")).otherwise(
        F.raise_error(F.lit("a payload does not have its digest")).cast("binary"))
    stored.select("digest", checked.alias("packed")).write.parquet(f"{path}/payloads")
    # rows of one digest, page and url are told apart by a count, not by a group in one task
    same = rows.groupBy("digest", "page_id", "url", "size").agg(F.count(F.lit(1)).alias("n"))
    same = written(same, "warc-rows")
    firsts = written(same.groupBy("digest").agg(F.min(order).alias("first"), F.sum("n").alias("all"))
                     .where("all > 1"), "warc-firsts")
    marked = same.join(firsts, "digest", "left").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("number"))
    is_first = F.col("first").isNull() | ((order == F.col("first")) & (F.col("number") == 0))
    kind = F.when(is_first | (F.col("size") < min_revisit), F.lit("response")).otherwise(F.lit("revisit"))
    marked = marked.select("page_id", "url", "digest", "size", "number", kind.alias("kind"),
                           F.col("first.page_id").alias("refers"))
    marked.select("page_id", "digest", _header(
        F.col("kind"), F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"), F.col("refers"),
        F.col("number")).alias("header")).write.parquet(f"{path}/headers")


def field(header: Column, name: str) -> Column:
    """A header field's value, null if there is none."""
    value = F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(header.contains(f"{EOL}{name}: "), value)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload) of every stored payload."""
    return spark.read.parquet(f"{path}/payloads").select("digest", unpacked("packed").alias("payload"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, digest, payload) of every archived record, payloads
    joined back by digest and verified."""
    headers = spark.read.parquet(f"{path}/headers")
    whole = headers.join(spark.read.parquet(f"{path}/payloads"), "digest").select(
        "page_id", "header", "digest", unpacked("packed").alias("payload"))
    payload = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.lit("an archived payload does not have its digest")).cast("binary"))
    return whole.select("page_id", "header", "digest", payload.alias("payload"))


def export_warc(spark: SparkSession, path: str, out: str, file_records: int = FILE_RECORDS) -> None:
    """Write the archive below ``path`` as WARC files: revisit records carry
    their header alone."""
    rows = records(spark, path)
    block = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit("")).otherwise(F.col("payload").cast("string"))
    # each row is one record up to the CRLF CRLF that ends it
    (rows.select(F.concat("header", F.lit(EOL + EOL), block).alias("value"))
     .write.option("lineSep", EOL + EOL).option("maxRecordsPerFile", file_records).option("compression", "gzip").text(out))


def parse(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(header, payload) of each record of a WARC file."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        header = data[at:stop].decode("utf-8", "surrogatepass")
        size = next(int(x[16:]) for x in header.split(EOL) if x.startswith("Content-Length: "))
        yield header, data[stop + 4:stop + 4 + size]
        at = stop + 4 + size
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"a WARC record does not end at byte {at}")
        at += 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload) of every record of the WARC files below ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                found = list(parse(gzip.decompress(content.as_py())))
                yield pa.RecordBatch.from_pydict({
                    "header": pa.array([h for h, _ in found], pa.string()),
                    "payload": pa.array([p for _, p in found], pa.binary())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, "header string, payload binary")


def described(found: DataFrame, archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the
    records read from WARC files; the payload of a revisit is looked up in
    ``archive`` (digest, payload) by its digest."""
    h = F.col("header")
    rows = found.select(
        field(h, "X-Page-ID").alias("page"), field(h, "WARC-Type").alias("record_type"),
        F.regexp_extract(field(h, "WARC-Refers-To"), "^<urn:page:(-?[0-9]+):0>$", 1).alias("refers"),
        F.regexp_extract(field(h, "WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1).alias("stated"), "payload")
    rows = rows.select("page", "record_type", "refers", "stated",
                       F.octet_length("payload").cast("long").alias("own_size"), F.sha2("payload", 256).alias("own"))
    sizes = written(archive.select(F.sha2("payload", 256).alias("stated"),
                                   F.octet_length("payload").cast("long").alias("size")), "warc-sizes")
    full = rows.join(sizes, "stated", "left")
    revisit = F.col("record_type") == "revisit"
    digest = F.when(revisit | (F.col("own") == F.col("stated")), F.col("stated")).otherwise(
        F.raise_error(F.lit("a WARC payload does not have its digest")))
    return full.select(
        F.expr("try_cast(page as bigint)").alias("page_id"),
        F.when(revisit, F.col("size")).otherwise(F.col("own_size")).alias("payload_bytes"),
        digest.alias("payload_digest"), "record_type", F.expr("try_cast(refers as bigint)").alias("refers_to"))
