"""WARC archives: writing, and reading by boundary-chain verification.

Writing.  One record per page: ``response`` with the page as the payload of an
HTTP message, or ``revisit`` (identical payload digest, no payload) where a
page with a smaller id has an equal payload of ``min_bytes`` or more.  Spark's
text sink writes the records, with a record's closing CRLF CRLF as separator,
so archives are plain WARC files in any store that Spark writes to.

Reading.  Spark's text source splits the archives at the magic ``WARC/1.1``,
wherever it stands, so large archives are read in pieces by many tasks.  The
magic may stand inside a payload too; which fragments are records follows from
the chain of lengths:

1. A task numbers the fragments of its piece, and emits for each with a header
   the offset its record starts at and the offset of its successor.  Offsets
   count from the start of the piece, and follow chains to its end.
2. Summed piece sizes turn them into file offsets.
3. Pointer jumping from offset 0 of each file, over the entries into pieces,
   doubles its reach each round, so rounds grow with the logarithm of the
   pieces of a file.
4. Each piece is walked from its entry: records that the chain passes are
   kept, others are parts of a payload (records whose payload holds the magic
   are put together from their fragments).

Payload digests are computed from the payload read back.  Fragments move to
Python as sizes and headers, payloads stay in the JVM.

Defined cases.  A null page is an empty payload.  Null ids are kept; such a
page is a revisit only if a page with an id has its payload.  Repeated rows
that have the smallest id are all responses.  Line ends in a URL are
percent-encoded.  An empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inspectkit.llm import corpus as C
from inspectkit.session import scratch_path

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

DATE = "2025-01-01T00:00:00Z"
FILE_RECORDS = 100_000
MIN_BYTES = 0


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits make four signs."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE32_DIGITS, BASE32)


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(value): each page's record without the closing line ends."""
    pages = pages.select(
        pages["page_id"].cast("long").alias("page_id"), F.coalesce(pages["url"].cast("string"), F.lit("")).alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"),
    )
    rows = pages.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    # the repeated payloads only, as a table whose size the planner knows: few
    # are broadcast, many joined by a shuffle with split hot digests
    firsts = rows.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = C.saved(firsts.where("n > 1").select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "first"), "firsts")
    rows = rows.join(firsts, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())

    def urn(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", "text/html; charset=utf-8"), F.lit("Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    rows = rows.select("page_id", "url", "html", "digest", "bytes", "first", revisit.alias("revisit"), http.alias("http"))
    block = F.concat("http", F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    length = F.octet_length("http") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return rows.select(F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("page_id")), line("WARC-Date", DATE), line("WARC-Target-URI", url),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", urn("first")), line("WARC-Profile", PROFILE))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("Content-Type", "application/http;msgtype=response"),
        F.lit("Content-Length: "), length.cast("string"), F.lit(END), block,
    ).alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, file_records: int = FILE_RECORDS) -> None:
    records(pages, min_bytes).write.option("lineSep", END).option("maxRecordsPerFile", file_records).text(path)


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics: (file, block, value), in file order
    within a task."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _field(head: Column, name: str, pattern: str) -> Column:
    return F.regexp_extract(head, f"(?:^|\\r\\n){name}: {pattern}(?:\\r\\n|$)", 1)


def _parsed(value: Column) -> dict[str, Column]:
    """What the columns of a whole record are, from the text after its magic."""
    head, both = F.substring_index(value, END, 1), F.substring_index(value, END, 2)
    size, length = F.octet_length(head), _field(head, "Content-Length", "([0-9]{1,18})").try_cast("long")
    return {
        "head": head, "size": F.octet_length(value).cast("long"), "head_size": size.cast("long"), "length": length,
        "http": F.substring(both, F.length(head) + 5, F.length(both)),
        "payload_size": length - (F.octet_length(both) - size),
        "payload_start": (F.octet_length(both) + 5).cast("int"),
    }


def _results(rows: DataFrame, *more: str) -> DataFrame:
    """Output columns of whole records (value: the text after the magic)."""
    rows = rows.withColumns(_parsed(F.col("value")))
    head = F.col("head")
    revisit = _field(head, "WARC-Type", "(\\w+)") == "revisit"
    payload = F.substring(F.col("value").cast("binary"), F.col("payload_start"), F.greatest(F.col("payload_size"), F.lit(0)).cast("int"))
    return rows.select(
        *more, "size", "head_size", "length",
        _field(head, "WARC-Record-ID", "<urn:page:(-?[0-9]+)>").try_cast("long").alias("page_id"),
        F.when(revisit, _field(F.col("http"), "Content-Length", "([0-9]{1,18})").try_cast("long")).otherwise(F.col("payload_size")).alias("payload_bytes"),
        F.when(revisit, _field(head, "WARC-Payload-Digest", "sha1:([A-Z2-7]{32})")).otherwise(base32_sha1(payload)).alias("payload_digest"),
        _field(head, "WARC-Type", "(\\w+)").alias("record_type"),
        _field(head, "WARC-Refers-To", "<urn:page:(-?[0-9]+)>").try_cast("long").alias("refers_to"),
    )


_M, _E = len(MAGIC), len(END)
BUCKET = 4 << 20  # offsets that are joined together


def _numbered(batches):
    """Adds to the fragments of each piece: line, rel (its magic's offset in the
    piece), next (its successor's) and the bytes up to its end."""
    here, line, at = None, 0, 0
    for b in batches:
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        file, block = col["file"].to_numpy(), col["block"].to_numpy()
        size, head = col["size"].to_numpy(), col["head_size"].to_numpy()
        length = col["length"].fill_null(-1).to_numpy()
        lines, starts = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        new = np.ones(len(size), bool)
        new[1:] = (file[1:] != file[:-1]) | (block[1:] != block[:-1])
        cuts = [*np.flatnonzero(new), len(size)]
        for x, y in zip(cuts[:-1], cuts[1:]):
            if (file[x], block[x]) != here:
                here, line, at = (file[x], block[x]), 0, 0
            steps = size[x:y] + _M
            starts[x:y] = at + np.cumsum(steps) - steps
            lines[x:y] = np.arange(line, line + y - x)
            line, at = line + y - x, at + int(steps.sum())
        headed = (length >= 0) & (head < size)
        rel = starts - _M
        follow = np.where(headed, starts + head + _E + length + _E, -1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lines), pa.array(rel), pa.array(follow), pa.array(starts + size)], names=[*b.schema.names, "line", "rel", "next", "stop"])


def _exits(batches):
    """Per candidate of a piece: the first offset on its chain beyond the piece."""
    for t in C.runs(batches, ("file", "block")):
        rel, follow = t["rel"].to_numpy(), t["next"].to_numpy()
        order = np.argsort(rel)
        rel, follow = rel[order], follow[order]
        end = int(t["stop"].to_numpy().max())
        out = np.full(len(rel), -1, np.int64)
        spot = np.searchsorted(rel, follow)
        for i in range(len(rel) - 1, -1, -1):
            if follow[i] > end - 1:
                out[i] = follow[i]
            elif follow[i] >= 0 and spot[i] < len(rel) and rel[spot[i]] == follow[i] and spot[i] > i:
                out[i] = out[spot[i]]
        good = np.flatnonzero((out >= 0) & (follow >= 0))
        base = t["base"][0].as_py()
        n = len(good)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t["file"][0].as_py())), pa.array(rel[good] + base), pa.array(out[good] + base)], names=["file", "at", "to"])


def _walk(batches):
    """Whether the chain from a piece's entry passes each fragment."""
    for t in C.runs(batches, ("file", "block")):
        t = t.sort_by("line")
        at, follow = t["at"].to_numpy(), t["next"].to_numpy()
        entry = t["entry"][0].as_py()
        passed = np.zeros(len(at), bool)
        if entry is not None:
            expected = entry
            for i, (a, f) in enumerate(zip(at.tolist(), follow.tolist())):
                if a == expected and f >= 0:
                    passed[i], expected = True, f
        t = t.drop_columns(["entry"]).append_column("passed", pa.array(passed))
        yield from t.to_batches()


def _reached(edges: DataFrame) -> DataFrame:
    """(file, at): the entries that the chains from offset 0 pass, by pointer
    jumping over ``edges`` (file, at, to)."""
    entries = edges.select("file", F.col("to").alias("at")).union(edges.where("at = 0").select("file", "at")).distinct()
    jumps = C.saved(edges.join(entries, ["file", "at"], "left_semi"), "jumps")
    reached, n = C.saved(jumps.where("at = 0").select("file", "at"), "reached"), -1
    known = jumps.select("file", "at")
    while (now := reached.count()) != n:
        n = now
        ahead = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at")).join(known, ["file", "at"], "left_semi")
        reached = C.saved(reached.union(ahead).distinct(), "reached")
        second = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jumps = C.saved(jumps.join(second, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "jumps")
    return reached


def _bucket(at: Column) -> Column:
    return F.floor(at / F.lit(float(BUCKET))).cast("long")


def _over_buckets(ranges: DataFrame, low: str, high: str) -> DataFrame:
    """One row for each bucket of offsets that the range [low, high) touches, so that
    offsets meet the ranges near them and not all of their file."""
    last = _bucket(F.greatest(F.col(high) - 1, F.col(low)))
    return ranges.withColumn("bucket", F.explode(F.sequence(_bucket(F.col(low)), last)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type
    and refers_to."""
    keys = "file long, block long"
    found = "size long, head_size long, length long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    rows = _results(_fragments(spark, path), "file", "block").mapInArrow(_numbered, f"{keys}, {found}, line long, rel long, next long, stop long")
    rows = C.saved(rows, "fragments")
    pieces = rows.groupBy("file", "block").agg(F.max("stop").alias("stop"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("file", "block", F.coalesce(F.sum(F.col("stop") + _M).over(before), F.lit(0)).alias("base"))
    rows = C.saved(rows.join(pieces, ["file", "block"]), "placed")
    small = rows.select("file", "block", "rel", "next", "stop", "base").repartition("file", "block").sortWithinPartitions("file", "block")
    edges = small.mapInArrow(_exits, "file long, at long, to long")
    entries = _reached(C.saved(edges, "edges"))

    placed = rows.select("file", "block", "line", (F.col("rel") + F.col("base")).alias("at"), F.when(F.col("next") >= 0, F.col("next") + F.col("base")).otherwise(-1).alias("next"), "size", "head_size", "length")
    spans = rows.groupBy("file", "block").agg(F.min(F.col("rel") + F.col("base")).alias("low"), F.max(F.col("stop") + F.col("base")).alias("high"))
    entries = entries.withColumn("bucket", _bucket(F.col("at")))
    entry = _over_buckets(spans, "low", "high").join(entries, ["file", "bucket"]).where("at >= low and at < high").groupBy("file", "block").agg(F.min("at").alias("entry"))
    walked = placed.join(entry, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block")
    walked = C.saved(walked.mapInArrow(_walk, "file long, block long, line long, at long, next long, size long, head_size long, length long, passed boolean"), "walked")
    whole_size = F.col("head_size") + F.col("length") + 2 * _E
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = walked.where(F.col("passed") & (F.col("size") >= whole_size)).select("file", "block", "line")
    result = rows.join(whole, ["file", "block", "line"]).select(*out)
    broken = walked.where(F.col("passed") & (F.col("size") < whole_size)).select("file", F.col("at").alias("start"), "next")
    if not broken.isEmpty():
        result = result.union(_put_together(spark, path, walked, C.saved(broken, "broken")).select(*out))
    return result


def _put_together(spark: SparkSession, path: str, walked: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payload holds the magic, from their fragments."""
    ranges = _over_buckets(broken.withColumnRenamed("next", "end"), "start", "end")
    parts = walked.withColumn("bucket", _bucket(F.col("at"))).join(ranges, ["file", "bucket"]).where("at >= start and at < end").select("file", "block", "line", "start", "at")
    parts = C.saved(parts, "parts")
    values = _fragments(spark, path).withColumns({"size": F.octet_length("value").cast("long"), "head_size": F.lit(0).cast("long"), "length": F.lit(None).cast("long")})
    values = values.mapInArrow(_numbered, "file long, block long, value string, size long, head_size long, length long, line long, rel long, next long, stop long")
    joined = values.select("file", "block", "line", "value").join(parts, ["file", "block", "line"])
    texts = joined.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
    return _results(texts.select(F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).alias("value")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(C.load(spark, sf_dir, "pages"), path)
    return read(spark, path)


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, translate(""" + " || ".join(f"to_base(('0x' || substr(h, {5 * i + 1}, 5))::INTEGER, 32, 4)" for i in range(8)) + f""",
    '{BASE32_DIGITS}', '{BASE32}') AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
