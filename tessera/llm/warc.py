"""WARC archives: records written by Spark's text writer, read back by boundary-chain verification.

Writing. One record a row; the payload is the page's HTML in UTF-8. Of rows with equal payloads of
``min_bytes`` or more, those with the smallest id are ``response`` records, the others ``revisit`` it
without a payload. Null HTML is an empty payload, a null URL an empty target, a null id an empty
record name (it never serves as what others refer to). Rows that repeat an id are written as often.
An empty table gives an archive without records. Only the three named columns are read.

Reading. Splits are cut at ``CRLF CRLF WARC/1.``, so that each task meets candidate records, and
each candidate names its successor by its Content-Length. Offsets in the file are the sums of what came
before. Only candidates that the chain from offset 0 reaches are records: magic in a payload is not.
Pieces whose candidates follow one another directly form a run, a node of the chain; pointer jumping over
runs takes as many rounds as the logarithm of the blocks of a file and the cut payloads in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage

CRLF = "\r\n"
#: What every version's first line begins with; then ``0`` or ``1``.
MAGIC = "WARC/1."
VERSION = "1\r\n"
END = "\r\n\r\n"
CUT = END + MAGIC
NAME = "urn:tessera:page:"
BUCKET = 1 << 20


def _b(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def first_of_equals(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(_digest, _first) of every payload that several rows share; the aggregate combines on the map side."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    keys = pages.filter(F.octet_length(html) >= min_bytes).select(F.sha2(html.cast("binary"), 256).alias("_digest"), F.col(id_col).alias("_id"))
    out = keys.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return stage(out.filter("_n > 1 AND _first IS NOT NULL").drop("_n"), "warc-equal")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100) -> None:
    """Write one WARC record for each row to text files under ``path``."""
    firsts = first_of_equals(pages, id_col, html_col, min_bytes)
    rows = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    rows = rows.withColumns({"_bytes": _b(F.col("_html")), "_digest": F.sha2(F.col("_html").cast("binary"), 256)})
    # small payloads have no key and take no part in the join
    large = rows.filter(F.col("_bytes") >= min_bytes).join(firsts, "_digest", "left")
    rows = large.unionByName(rows.filter(F.col("_bytes") < min_bytes).withColumn("_first", F.lit(None).cast(rows.schema["_id"].dataType)))
    revisit = F.coalesce(~F.col("_id").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(), F.lit(False))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("_html")))
    name = lambda c: F.concat(F.lit(f"<{NAME}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(f">{CRLF}"))
    record = F.concat(
        F.lit(f"{MAGIC}{VERSION}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: "), name(F.col("_id")), F.lit(f"WARC-Date: 1970-01-01T00:00:00Z{CRLF}WARC-Target-URI: "), F.regexp_replace("_url", r"[\x00-\x20\x7f]", "%20"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("_digest"), F.lit(CRLF),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("_first")), F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), _b(block).cast("string"), F.lit(END), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between cuts: raw bytes without the magic line, the block they were read in, their order there."""
    got = spark.read.option("lineSep", CUT).text(path)
    return got.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), F.col("value")
    )


def _parsed(pieces: DataFrame) -> DataFrame:
    """Header fields and payload of a piece taken as a whole record. ``value``: the piece as string."""
    opens = F.col("value").startswith(MAGIC)
    v = F.when(opens, F.expr(f"substr(value, {len(MAGIC) + 1})")).otherwise(F.col("value"))
    out = pieces.withColumns({"lead": F.when(opens, F.lit(len(MAGIC))).otherwise(0).cast("long"), "size": _b(F.col("value")), "v": v})
    known = F.col("v").rlike(r"\A[01]\r\n")  # the rest of the first line
    out = out.withColumn("head", F.when(known, F.substring_index("v", END, 1)))  # a payload that begins with the magic leaves a head alone
    out = out.withColumn("length", _field(F.col("head"), "Content-Length").try_cast("bigint"))
    out = out.withColumns({"h": _b(F.col("head")) + len(END), "n": _b(F.col("v"))})
    out = out.withColumn("body", F.when((F.col("length") >= 0) & (F.col("n") >= F.col("h") + F.col("length")), F.expr("substring(cast(v AS binary), cast(h + 1 AS int), cast(length AS int))").cast("string")))
    http = F.lower(_field(F.col("head"), "Content-Type")).startswith("application/http") & (F.instr("body", END) > 0)
    payload = F.when(http, F.expr(f"substring(cast(body AS binary), cast(octet_length(substring_index(body, '\\r\\n\\r\\n', 1)) + {len(END) + 1} AS int))").cast("string")).otherwise(F.col("body"))
    return out.withColumn("payload", payload)


def _record_fields(with_payload: bool) -> dict[str, Column]:
    kind, head = F.lower(_field(F.col("head"), "WARC-Type")), F.col("head")
    own = kind != "revisit"
    http_head = F.substring_index("body", END, 1)
    out = {
        "record_id": _field(head, "WARC-Record-ID"),
        "record_type": kind,
        "target_uri": _field(head, "WARC-Target-URI"),
        "refers_to_id": _field(head, "WARC-Refers-To"),
        "payload_bytes": F.when(own, _b(F.col("payload"))).otherwise(_field(http_head, "Content-Length").try_cast("bigint")),
        "payload_digest": F.when(own, F.sha2(F.col("payload").cast("binary"), 256)).otherwise(F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha256:", "")),
    }
    return out | ({"payload": F.when(own, F.col("payload"))} if with_payload else {})


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives under ``path``: file, offset and header fields, digest and size of the whole payload.

    For a revisit the size and digest are those that its headers give; it has no payload of its own.
    """
    fields = _record_fields(with_payload)
    pieces = _parsed(_scan(spark, path)).select(
        "file", "block", "k", "size", "lead", F.xxhash64("value").alias("hash"),
        (F.col("lead") + F.col("h") + F.col("length")).alias("ends"),  # where the record ends, from the piece's start
        F.col("body").isNotNull().alias("whole"), *[c.alias(n) for n, c in fields.items()],
    )
    pieces = stage(pieces, "warc-pieces")

    # offsets: sums within a block, then of the blocks before it
    in_block = Window.partitionBy("file", "block").orderBy("k")
    slim = pieces.select("file", "block", "k", "size", "lead", "ends", "hash", "whole")
    sums = slim.groupBy("file", "block").agg(F.sum(F.col("size") + len(CUT)).alias("all"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "block", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    slim = slim.withColumn("local", F.coalesce(F.sum(F.col("size") + len(CUT)).over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = slim.join(sums, ["file", "block"])
    # a record starts at its magic line, which the cut before its piece holds
    at = at.withColumn("off", F.col("base") + F.col("local") - F.when(F.col("lead") > 0, 0).otherwise(len(MAGIC)))
    at = at.withColumn("next", F.col("base") + F.col("local") + F.col("ends") + len(END))
    follows = F.coalesce(F.lead("off").over(in_block) == F.col("next"), F.lit(False))
    breaks = F.sum(F.when(F.col("_follows"), 0).otherwise(1)).over(in_block.rowsBetween(Window.unboundedPreceding, -1))
    at = at.withColumn("_follows", follows).withColumn("run", F.coalesce(breaks, F.lit(0)))
    at = stage(at.select("file", "block", "k", "run", "off", "next", "size", "hash", "whole", "_follows"), "warc-candidates")

    # a run ends where its last piece points; pointer jumping over runs from offset 0
    exits = at.filter(~F.col("_follows")).select("file", "block", "run", F.col("next").alias("to"))
    starts = at.select("file", F.col("block").alias("to_block"), F.col("run").alias("to_run"), F.col("off").alias("to"))
    hops = stage(exits.join(starts, ["file", "to"], "left").select("file", "block", "run", "to", "to_block", "to_run"), "warc-hops")
    entered = at.filter("off = 0").select("file", "block", "run", F.col("off").alias("entry"))
    entered, known = stage(entered, "warc-entered"), -1
    while (n := entered.count()) != known:
        known = n
        more = entered.join(hops, ["file", "block", "run"]).filter("to_run IS NOT NULL").select("file", F.col("to_block").alias("block"), F.col("to_run").alias("run"), F.col("to").alias("entry"))
        entered = stage(entered.unionByName(more).groupBy("file", "block", "run").agg(F.min("entry").alias("entry")), "warc-entered")
        far = hops.select("file", F.col("block").alias("to_block"), F.col("run").alias("to_run"), F.col("to").alias("t2"), F.col("to_block").alias("b2"), F.col("to_run").alias("r2"))
        hops = stage(hops.filter("to_run IS NOT NULL").join(far, ["file", "to_block", "to_run"]).select("file", "block", "run", F.col("t2").alias("to"), F.col("b2").alias("to_block"), F.col("r2").alias("to_run")), "warc-hops")
    reached = at.join(entered, ["file", "block", "run"], "left").withColumn("is_record", F.coalesce(F.col("off") >= F.col("entry"), F.lit(False)))
    reached = stage(reached.drop("entry"), "warc-reached")

    shown = ["file", F.col("off").alias("offset"), *fields]
    records = reached.filter("is_record AND whole").select("file", "block", "k", "off").join(pieces.drop("size", "lead", "hash", "ends", "whole"), ["file", "block", "k"]).select(*shown)
    cut = reached.filter("is_record AND NOT whole").select("file", F.col("off").alias("owner"), "next")
    if cut.isEmpty():
        return records
    return records.unionByName(_joined(spark, path, reached, cut, fields).select(*shown))


def _joined(spark: SparkSession, path: str, reached: DataFrame, cut: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Records whose payload holds cuts: their pieces put together again."""
    spans = cut.withColumn("bucket", F.explode(F.sequence(F.expr(f"owner div {BUCKET}"), F.expr(f"coalesce(next, owner) div {BUCKET}"))))
    parts = reached.withColumn("bucket", F.expr(f"off div {BUCKET}")).join(spans.withColumnRenamed("next", "stop"), ["file", "bucket"]).filter("off >= owner AND off < stop")
    parts = parts.select("file", "block", "hash", "size", "owner", "off")
    texts = _scan(spark, path).select("file", "block", F.xxhash64("value").alias("hash"), _b(F.col("value")).alias("size"), "value").join(parts.select("file", "block", "hash", "size").distinct(), ["file", "block", "hash", "size"])
    texts = texts.groupBy("file", "block", "hash", "size").agg(F.first("value").alias("value"))
    whole = parts.join(texts, ["file", "block", "hash", "size"]).groupBy("file", F.col("owner").alias("off"))
    whole = whole.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "value"))), lambda x: x["value"]), CUT).alias("value"))
    return _parsed(whole).select("file", "off", *[c.alias(n) for n, c in fields.items()])


def round_trip(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """Write the archives of ``pages`` to ``path``, read them back, and name each record's page."""
    write_archives(pages, path, id_col, url_col, html_col, min_bytes)
    page = lambda c: F.regexp_extract(c, f"<{NAME}(-?[0-9]+)>", 1).try_cast("bigint")
    got = read_archives(pages.sparkSession, path)
    return got.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to_id")).alias("refers_to"))
