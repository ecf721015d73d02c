"""WARC archives: a writer over Spark's text sink and a reader with boundary-chain verification.

Writing. A record is header, blank line, payload, and two line ends. Records are written as the lines
of a text table whose line separator is the record's end (CR LF CR LF), so plain Spark writers make
archives on any file system, in parallel.

Reading. Archives are read by byte ranges as text with the separator CR LF CR LF, bytes untouched. A
task knows only its pieces. It notes for every piece its length, and for every place that looks like the
start of a record a candidate with the offset of its successor (start + header + content length + 4).
Lengths of the ranges, added up, turn relative into file offsets. Where a payload ends in CR LF, separators
overlap, and a range that begins inside one may repeat or lose a piece: files whose lengths do not add up to
their size are read again as one range each. A payload may contain the magic, so
candidates are verified: the true records are those that pointer jumping reaches from offset 0. Each
round doubles the jump, all files and candidates at once.

Payloads that are one piece, the usual case, get digest and length from that piece without moving
bytes; others are put together from their pieces.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from workloom.llm.scratch import Scratch

END = "\r\n\r\n"
MIN_REVISIT = 100
#: Rows up to which the first holders of repeated payloads are broadcast to the writer.
BROADCAST_FIRSTS = 200_000
#: Bytes of a cell of the grid that assigns pieces to records of several pieces.
CELL = 1 << 16
DATE = "2024-01-01T00:00:00Z"

_MAGIC = re.compile(rb"WARC/1\.\d\r\n")
_FIELD = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r]*?)[ \t]*(?:\r\n|\Z)|[ \t][^\r]*(?:\r\n|\Z)")
PIECES = ("kind string, file string, range long, at long, bytes long, digest string, body long, length long, "
          "record_type string, record_id string, refers_to string, uri string, payload_digest string")
_ARROW = pa.schema([(part.split()[0], pa.int64() if part.split()[1] == "long" else pa.string()) for part in PIECES.split(", ")])


def record_uri(page_id):
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _safe(value):
    """Header values without control characters."""
    return F.regexp_replace(value, r"[\x00-\x20\x7F]", "%20")


def page_records(pages, page_id="page_id", url="url", html="html", minimum=MIN_REVISIT):
    """``pages`` as rows of one column ``value``: a WARC record without its final separator.

    Payload is the html in UTF-8, empty for null. Of equal payloads of at least ``minimum`` bytes the
    smallest page id is the response and the others refer to it. Pages without an id are responses of
    their own.
    """
    scratch = Scratch(pages.sparkSession, "warc-write")
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = (rows.filter((F.octet_length("payload") >= minimum) & F.col("page_id").isNotNull())
              .groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"))
    firsts = scratch.keep(firsts, "firsts")
    few = firsts.count() <= BROADCAST_FIRSTS
    rows = rows.join(F.broadcast(firsts) if few else firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id") > F.col("first"))
    number = F.when(revisit, 0).otherwise(F.octet_length("payload")).cast("string")

    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(line("WARC-Record-ID", record_uri(F.col("page_id"))), F.lit("")), line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", _safe(F.col("url"))), F.lit("")),
        F.when(revisit, line("WARC-Refers-To", record_uri(F.col("first")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        F.lit("Content-Length: "), number)
    payload = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    return rows.select(F.concat(header.cast("binary"), F.lit(END).cast("binary"), payload).cast("string").alias("value"))


def write_archives(records, path):
    """One archive per task below ``path``."""
    records.write.option("lineSep", END).text(path)


def _fields(piece, at):
    """Header fields from ``at`` to the end of the piece; None where something else than fields comes first."""
    out = {}
    while at < len(piece):
        found = _FIELD.match(piece, at)
        if not found:
            return None
        if found[1]:
            out.setdefault(found[1].lower().decode(), found[2].decode("utf-8", "replace"))
        at = found.end()
    return out


def _pieces(batches):
    """Rows of pieces and of candidates, offsets relative to the first piece of the byte range."""
    here, at = None, 0
    for batch in batches:
        files, ranges, values = (batch.column(i).to_pylist() for i in range(3))
        whole = batch.column(3).to_pylist()
        out = []
        for file, start, value, size in zip(files, ranges, values, whole, strict=True):
            if here != (file, start):
                here, at = (file, start), 0
            end = at + len(value) + len(END)
            out.append({"kind": "piece", "file": file, "range": start, "at": at, "bytes": len(value), "length": size, "digest": hashlib.sha256(value).hexdigest()})
            for magic in _MAGIC.finditer(value):
                fields = _fields(value, magic.end())
                if fields and re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
                    out.append({"kind": "start", "file": file, "range": start, "at": at + magic.start(), "body": end, "length": int(fields["content-length"]),
                                "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"),
                                "uri": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest")})
            at = end
        yield pa.RecordBatch.from_pylist(out, _ARROW)


def _ranges(spark, path):
    text = spark.read.option("lineSep", END).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("value"),
                       F.col("_metadata.file_size").alias("size"))


def _range_sizes(noted):
    pieces = noted.filter("kind = 'piece'")
    return pieces.groupBy("file", "range").agg(F.max(F.col("at") + F.col("bytes") + len(END)).alias("size"), F.max("length").alias("whole"))


def _uneven(sizes):
    """Files whose ranges do not add up. One range from offset 0 is right; it may end without a separator, or be unpacked."""
    files = sizes.groupBy("file").agg(F.sum("size").alias("read"), F.max("whole").alias("whole"), F.max("range").alias("last"))
    return [r.file for r in files.filter("(last > 0 AND read <> whole) OR read < whole").select("file").collect()]


def _undivided(spark, path, files):
    """The rows of ``files``, one range each: a session of its own plans ranges that are larger than any file."""
    other = spark.newSession()
    for name in ("maxPartitionBytes", "openCostInBytes"):
        other.conf.set(f"spark.sql.files.{name}", str(1 << 50))
    return _ranges(other, path).filter(F.col("file").isin(files))


def _chain(starts, scratch):
    """Candidates that are reached from offset 0 of their file: ``file, at``."""
    jump = scratch.keep(starts.select("file", "at", F.col("next").alias("to")), "jump")
    longest = jump.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reached = scratch.keep(jump.filter("at = 0").select("file", "at"), "reached")
    for _ in range(longest.bit_length()):
        more = jump.join(reached, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = scratch.keep(reached.union(more.join(starts.select("file", "at"), ["file", "at"], "left_semi")).distinct(), "reached")
        # Twice the distance; a jump beyond the last record ends.
        further = jump.select("file", F.col("at").alias("mid"), "to").alias("b")
        jump = scratch.keep(jump.alias("a").join(further, (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.mid")))
                            .select("a.file", "a.at", "b.to"), "jump")
    return reached


def read_records(spark, path, payloads=False):
    """Records of all archives below ``path``: ``file, at, record_type, record_id, refers_to, uri, payload_digest, bytes, digest``.

    ``bytes`` and ``digest`` (SHA-256) are those of the bytes read. With ``payloads`` the bytes
    themselves are added as ``payload``. A file that does not begin with a record has none; what
    follows a broken length is unreachable and left out. Compressed files are read whole by one task each.
    """
    scratch = Scratch(spark, "warc-read")
    raw = _ranges(spark, path)
    noted = scratch.keep(raw.mapInArrow(_pieces, PIECES), "pieces")
    sizes = _range_sizes(noted)
    uneven = _uneven(sizes)
    if uneven:
        undivided = _undivided(spark, path, uneven)
        again = scratch.keep(undivided.mapInArrow(_pieces, PIECES), "pieces")
        sizes = _range_sizes(again)
        if _uneven(sizes):
            raise ValueError(f"archives cannot be read as one range each: {_uneven(sizes)[:3]}")
        raw, noted = raw.filter(~F.col("file").isin(uneven)).union(undivided), noted.filter(~F.col("file").isin(uneven)).union(again)
        sizes = _range_sizes(noted)
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.keep(sizes.select("file", "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")), "bases")
    placed = noted.join(bases, ["file", "range"]).withColumns({"at": F.col("at") + F.col("base"), "body": F.col("body") + F.col("base")})
    pieces = placed.filter("kind = 'piece'").select("file", F.col("at").alias("body"), "bytes", "digest")
    starts = placed.filter("kind = 'start'").withColumn("next", F.col("body") + F.col("length") + len(END))
    starts = scratch.keep(starts.select("file", "at", "body", "length", "next", "record_type", "record_id", "refers_to", "uri", "payload_digest"), "starts")
    true = starts.join(_chain(starts, scratch), ["file", "at"], "left_semi")
    joined = scratch.keep(true.join(pieces, ["file", "body"], "left"), "records")
    names = ["file", "at", "body", "record_type", "record_id", "refers_to", "uri", "payload_digest"]
    nothing = hashlib.sha256(b"").hexdigest()
    single = joined.filter("length = 0 OR bytes = length").select(
        *names, F.col("length").alias("bytes"), F.when(F.col("length") == 0, nothing).otherwise(F.col("digest")).alias("digest"))
    several = joined.filter("NOT (length = 0 OR bytes <=> length)").select(*names, "length")
    several = scratch.keep(several, "several")
    out = single
    if not several.isEmpty():
        whole = _put_together(spark, raw, bases, several.select("file", "body", "length"))
        out = out.union(several.join(whole, ["file", "body"]).select(*names, F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest")))
    if payloads:
        wanted = joined.select("file", "body", "length")
        out = out.join(_put_together(spark, raw, bases, wanted).select("file", "body", "payload"), ["file", "body"], "left")
        out = out.withColumn("payload", F.coalesce("payload", F.lit("").cast("binary")))
    return out.drop("body")


def _offsets(batches):
    here, at = None, 0
    for batch in batches:
        places = []
        for file, start, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if here != (file, start):
                here, at = (file, start), 0
            places.append(at)
            at += len(value) + len(END)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(places, pa.int64())], ["file", "range", "value", "at"])


def _put_together(spark, raw, bases, records):
    """``file, body, payload`` of records by all pieces that begin inside them, met on a grid of file cells."""
    pieces = (raw.mapInArrow(_offsets, "file string, range long, value binary, at long").join(bases, ["file", "range"])
              .select("file", (F.col("at") + F.col("base")).alias("at"), "value").withColumn("cell", F.floor(F.col("at") / CELL)))
    last = F.floor((F.col("body") + F.greatest(F.col("length") - 1, F.lit(0))) / CELL)
    cells = records.withColumn("cell", F.explode(F.sequence(F.floor(F.col("body") / CELL), last)))
    inside = (F.col("at") >= F.col("body")) & (F.col("at") < F.col("body") + F.col("length"))
    met = cells.join(pieces, ["file", "cell"]).filter(inside)
    parts = F.sort_array(F.collect_list(F.struct("at", "value")))
    joined = F.aggregate(parts, F.lit("").cast("binary"), lambda a, p: F.concat(a, p["value"], F.lit(END).cast("binary")))
    # The last piece may reach into the separator: the payload is its first ``length`` bytes.
    return (met.groupBy("file", "body", "length").agg(joined.alias("all"))
            .select("file", "body", F.substring("all", F.lit(1), F.col("length").cast("int")).alias("payload")))


def page_verdicts(records):
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` from records that were read.

    A revisit gets the size of the response that it refers to, matched by record id.
    """
    ident = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(ident(c) != "", ident(c)).cast("long")
    rows = records.select(number(F.col("record_id")).alias("page_id"), number(F.col("refers_to")).alias("refers_to"), "record_type", "bytes", "digest",
                          F.regexp_replace("payload_digest", "^sha256:", "").alias("said"))
    responses = rows.filter("record_type = 'response'")
    sizes = responses.filter("page_id IS NOT NULL").groupBy("page_id").agg(F.max("bytes").alias("full")).withColumnRenamed("page_id", "refers_to")
    revisits = rows.filter("record_type = 'revisit'").join(sizes, "refers_to", "left")
    return (responses.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
            .union(revisits.select("page_id", F.col("full"), F.col("said"), "record_type", "refers_to")))
