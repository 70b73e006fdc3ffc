"""WARC: not-modified revisits take the body of the response they stand for.

Method. An as-of join by canonical URL: a revisit looks to the latest earlier full
response of its URL. Its validators (ETag, else Last-Modified) are checked
against that response's, and the headers a not-modified answer may change are
merged over the stored ones. The timeline of a URL is cut into spans, so that a URL
that holds a third of all captures is scanned by many tasks: the last response within a span by a window
over (URL, span), and the last one of the spans before by a window over one row a span.
Bodies never take part in the join; :func:`resolve` names the response whose body counts.

Defined cases: a null URL is a canonical URL of its own (empty). A revisit without earlier
response is ``missing``. Captures of one instant are ordered by record identifier; a revisit takes none of its
own instant. A response without validators, or a revisit without any, is ``unchecked``. A null
date never precedes or follows anything: such a revisit is ``missing``. Repeated revisits are
answered each; of responses of one URL and instant the largest record identifier counts (a null one
comes first). Where records carry ``http_status``, only a response of status 200 is a full one. Other extra columns play
no part. Empty tables give empty tables.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.session import ship

#: Headers that a 304 answer carries over the stored ones (RFC 9111, section 3.2, and 9110, 15.4.5).
MERGED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query keys that say where a visitor came from, not what is shown.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "ref", "fbclid", "gclid"]
SPANS = 64
#: Kind of records that cannot be read; bytes of blocks that a reader holds before it hands records on.
DAMAGED, BATCH_BYTES = "damaged", 32 << 20


def canonical_url(url: Column) -> Column:
    """Scheme, leading www., fragment, tracking keys and trailing slashes gone; the host in lower case."""
    u = F.coalesce(url, F.lit(""))
    u = F.regexp_replace(u, r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z]+://", "")
    u = F.regexp_replace(u, r"(\?|&)(" + "|".join(TRACKING) + r")=[^&]*", "$1")
    u = F.regexp_replace(u, r"&&+", "&")
    u = F.regexp_replace(u, r"\?&", "?")
    u = F.regexp_replace(u, r"[?&/]+$", "")
    host = F.lower(F.regexp_extract(u, r"^[^/?]*", 0))
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.substring(u, F.length(host) + 1, F.length(u)))


def resolve(records: DataFrame, spans: int = SPANS) -> DataFrame:
    """One row a revisit: record_id, canonical, response_id, status, headers (merged map).

    ``records``: record_id long, kind ('response' or 'revisit'), url string, date timestamp,
    headers map of lower-case names. ``status``: resolved, changed, unchecked or missing.
    """
    complete = F.coalesce(F.col("http_status") == 200, F.lit(False)) if "http_status" in records.columns else F.lit(True)
    r = records.where((F.col("kind") == "revisit") | ((F.col("kind") == "response") & complete)).select(
        "record_id", "kind", canonical_url(F.col("url")).alias("canonical"), F.unix_micros("date").alias("at"), "headers"
    )
    low, high = r.agg(F.min("at"), F.max("at")).first()
    width = max(1, ((high or 0) - (low or 0)) // spans + 1)
    r = r.withColumn("span", F.coalesce(((F.col("at") - F.lit(low or 0)) / width).cast("int"), F.lit(-1)))
    full = F.when((F.col("kind") == "response") & F.col("at").isNotNull(), F.struct("at", "record_id", F.col("headers").alias("stored")))
    # Strictly earlier: frames by range end before the row's own instant.
    here = Window.partitionBy("canonical", "span").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    within = r.withColumn("near", F.max_by(full, F.when(full.isNotNull(), F.struct("at", "record_id"))).over(here))
    last = r.where(full.isNotNull()).groupBy("canonical", "span").agg(F.max_by(full, F.struct("at", "record_id")).alias("last"))
    earlier = Window.partitionBy("canonical").orderBy("span").rangeBetween(Window.unboundedPreceding, -1)
    marks = r.select("canonical", "span").distinct().join(last, ["canonical", "span"], "left")
    far = marks.select("canonical", "span", F.max_by("last", F.when(F.col("last").isNotNull(), F.col("span"))).over(earlier).alias("far"))
    found = within.where(F.col("kind") == "revisit").join(far, ["canonical", "span"], "left")
    chosen = F.when(F.col("at").isNotNull(), F.coalesce("near", "far"))
    found = found.withColumn("from", chosen)
    a, b = F.col("headers"), F.col("from")["stored"]
    same = F.when(a["etag"].isNotNull() & b["etag"].isNotNull(), a["etag"] == b["etag"]).when(a["last-modified"].isNotNull() & b["last-modified"].isNotNull(), a["last-modified"] == b["last-modified"])
    status = F.when(F.col("from").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    permitted = F.map_filter(F.coalesce(a, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(MERGED))
    kept = F.map_filter(F.coalesce(b, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(permitted, k))
    merged = F.when(status.isin("resolved", "unchecked"), F.map_concat(kept, permitted)).otherwise(a)
    return found.select("record_id", "canonical", F.col("from")["record_id"].alias("response_id"), status.alias("status"), merged.alias("headers"))


def with_bodies(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with the body (binary or string column ``body``) of their response."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("response_id"), "body")
    return resolved.join(bodies, "response_id", "left")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log over a table of pages: a full response a page, a revisit for every third.

    Page p is fetched at second 2p after the epoch; its response has an ETag by page_id % 5 and a
    Last-Modified by page_id % 7 (absent at 0). A revisit of page p follows at second 2p + 1001 (where
    page_id % 11 = 0 it comes at 2p - 1, before any response of its page), asks by the plain URL, and carries validators of its page, but those of another version where page_id % 4 = 0.
    Record ids are 2p for responses and 2p + 1 for revisits.
    """
    p = F.col("page_id")
    version = F.when(p % 4 == 0, p + 1).otherwise(p)

    def headers(v: Column, revisit: bool) -> Column:
        fields = [
            ("etag", F.when(p % 5 != 0, F.concat(F.lit('"'), (v % 97).cast("string"), F.lit('"')))),
            ("last-modified", F.when(p % 7 != 0, F.concat(F.lit("day "), (v % 31).cast("string")))),
            ("date", F.concat(F.lit("second "), (2 * p + int(revisit)).cast("string"))),
            ("content-type", F.lit("text/plain" if revisit else "text/html")),
            ("cache-control", F.lit("no-cache") if revisit else F.lit("max-age=60")),
        ]
        m = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in fields]), F.array(*[x for _, x in fields]))
        return F.map_filter(m, lambda k, x: x.isNotNull())

    full = pages.select((2 * p).alias("record_id"), F.lit("response").alias("kind"), "url", F.timestamp_seconds(2 * p).alias("date"), headers(p, False).alias("headers"))
    again = pages.where(p % 3 == 0).select((2 * p + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.regexp_replace("url", "[?#].*$", "").alias("url"), F.timestamp_seconds(F.when(p % 11 == 0, 2 * p - 1).otherwise(2 * p + 1001)).alias("date"), headers(version, True).alias("headers"))
    return full.unionByName(again)


#: A record's first line, a header's end, and what has to follow a block: an empty line, then a record or the end.
_RECORD = re.compile(rb"WARC/1\.[01]\r?\n")
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_AFTER = re.compile(rb"\r?\n\r?\n\s*(?:WARC/1\.|\Z)")
#: Most bytes of a header, and of a block, which has to fit a value of a row.
HEAD_BYTES, BLOCK_BYTES = 1 << 20, (1 << 31) - 1
_MAGIC = b"\x1f\x8b\x08"


class _Source:
    """Bytes of a plain file or of one gzip member, made as they are asked for. ``held`` begins at the place reached."""

    def __init__(self, data: memoryview, at: int, packed: bool):
        self.data, self.at, self.held = data, at, bytearray()
        self.unpack = zlib.decompressobj(31) if packed else None
        self.rest, self.ended, self.torn = b"", False, False

    def fill(self, n: int) -> bool:
        """Whether ``n`` bytes are held; less only at the end."""
        while len(self.held) < n and not self.ended:
            self._more(n - len(self.held))
        return len(self.held) >= n

    def _more(self, n: int) -> None:
        if self.unpack is None:
            part = self.data[self.at : self.at + max(n, 1 << 16)]
            self.held += part
            self.at += len(part)
            self.ended = self.at >= len(self.data)
            return
        given = self.rest or bytes(self.data[self.at : self.at + (1 << 16)])
        if not self.rest:
            self.at += len(given)
        try:
            out = self.unpack.decompress(given, max(n, 1 << 16))
        except zlib.error:
            self.ended = self.torn = True
            return
        self.held += out
        self.rest = self.unpack.unconsumed_tail
        if self.unpack.eof:
            self.ended, self.at = True, self.at - len(self.unpack.unused_data)
        elif not out and not self.rest and self.at >= len(self.data):
            self.ended = self.torn = True

    def find_record(self) -> bool:
        """Go to the next first line of a record; all is passed over if there is none."""
        while True:
            found = _RECORD.search(self.held)
            if found:
                del self.held[: found.start()]
                return True
            del self.held[:-16]
            if not self.fill(len(self.held) + (1 << 16)) and not _RECORD.search(self.held):
                self.held.clear()
                return False


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(WARC headers in lower case, block) of each record of a file, plain or compressed by record.

    A length is good if what it takes is there, in its member if compressed, and an empty line and then another record or the end
    follow (so one that ends just where a later record's block ends is taken for good). A record without such a length is one of type ``damaged``, with no block, and reading goes on at the next record's first line, so that
    no neighbour is lost. A member that does not decompress gives one of them as well; reading goes on at the next one.
    """
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        for head, block in _records(_Source(view, 0, False)):
            yield (head, block) if block is not None else ({"warc-type": DAMAGED}, b"")
        return
    at, torn = 0, False
    while at < len(data):
        if data[at : at + 3] != _MAGIC:
            # Padding of zeros is no damage.
            nxt = data.find(_MAGIC, at)
            stop = nxt if nxt >= 0 else len(data)
            if data[at:stop].strip(b"\0") and not torn:
                yield {"warc-type": DAMAGED}, b""
                torn = True
            at = stop
            continue
        source, bad = _Source(view, at, True), False
        for head, block in _records(source):
            bad = block is None
            yield ({"warc-type": DAMAGED}, b"") if bad else (head, block)
            torn = False
        if source.torn:
            if not bad and not torn:
                yield {"warc-type": DAMAGED}, b""
            torn, at = True, (nxt if (nxt := data.find(_MAGIC, at + 1)) >= 0 else len(data))
        else:
            torn, at = False, source.at


def _records(source: _Source) -> Iterator[tuple[dict[str, str], bytes | None]]:
    while source.find_record():
        first = source.held.index(b"\n") + 1
        end, asked = None, 1 << 12
        while end is None and len(source.held) < HEAD_BYTES:
            whole = source.fill(asked)
            end, asked = _HEAD_END.search(source.held), asked * 4
            if not whole:
                break
        head, block = {}, None
        if end:
            for line in source.held[first : end.start()].split(b"\n"):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            length = head.get("content-length", "")
            if length.isascii() and length.isdigit() and len(length) <= 10 and int(length) <= BLOCK_BYTES:
                begin, stop = end.end(), end.end() + int(length)
                if source.fill(stop):
                    source.fill(stop + 64)
                    if _AFTER.match(bytes(source.held[stop : stop + 64])):
                        block = bytes(source.held[begin:stop])
                        del source.held[:stop]
        if block is None:
            del source.held[:first]
        yield head, block


def write_record(kind: str, url: str, date: str, record_id: str, http: bytes, compress: bool = True) -> bytes:
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    raw = head.encode() + http + b"\r\n\r\n"
    return gzip.compress(raw, mtime=0) if compress else raw


_FIELDS = "warc_id string, kind string, url string, date string, http_status int, headers map<string,string>, body binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of WARC files, and a row of kind ``damaged`` for each record that cannot be read.

    A file is one task's unit (2 GB at most, Spark's limit for a binary value); its records leave in batches of BATCH_BYTES.
    """
    ship(spark)

    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=[f.split()[0] for f in _FIELDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                rows, held = [], 0
                for head, block in parse_warc(cell.as_py()):
                    if head.get("warc-type") not in ("response", "revisit", DAMAGED):
                        continue
                    top, _, body = block.partition(b"\r\n\r\n")
                    first, *rest = top.decode("latin-1").split("\r\n")
                    status = first.split(" ")[1] if first.count(" ") else ""
                    pairs = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest) if k.strip()}
                    rows.append((head.get("warc-record-id"), head["warc-type"], head.get("warc-target-uri"), head.get("warc-date"), int(status) if len(status) == 3 and status.isascii() and status.isdigit() else None, list(pairs.items()), body))
                    held += len(block)
                    if held > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _FIELDS)
