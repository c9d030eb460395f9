"""WARC archives: written as one record per page, read back by boundary chains.

The reader cuts files wherever a line starts with the magic of a record, also inside payloads.
Every cut is a candidate: its header tells where the next record must start. Tasks
emit these offsets for the parts of files they scan; pointer jumping from the start
of each file reaches the true records only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedlens.sources.durable import durable

CRLF = "\r\n"
#: Bytes that start a record of any version 1. With the end of the line before, the
#: reader's separator; no line of a header starts like this, so no header is cut.
MAGIC = "WARC/1."
CUT = CRLF + MAGIC
#: Payloads below this are never replaced by a reference.
LEAST_BYTES = 0

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_URN = "urn:feedlens:response:"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of 40 hex digits: four digits of base32 for every five of hex."""

    def four(i: Column) -> Column:
        value = F.conv(F.substr(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substr(F.lit(_BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def _fields(*fields: tuple[str, Column]) -> Column:
    """Header lines; a null field is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in fields])


def _record(kind: Column, key: Column, url: Column, payload: Column, size: Column, digest: Column, identifier: Column, refers: Column, date: str) -> Column:
    """Text of a record without the empty lines behind it. A revisit keeps the
    HTTP header, which tells the size, and leaves out the payload."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(CRLF * 2))
    block = F.when(kind == "response", F.concat(http, payload)).otherwise(http)
    profile = F.when(kind == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    header = _fields(
        ("WARC-Type", kind),
        ("WARC-Record-ID", F.concat(F.lit("<"), identifier, F.lit(">"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.regexp_replace(url, r"[\x00-\x20\x7F]+", "%20")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        ("WARC-Profile", profile),
        ("WARC-Refers-To", F.concat(F.lit("<"), refers, F.lit(">"))),
        ("Page-Key", key),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(F.lit(f"{MAGIC}1{CRLF}"), header, F.lit(CRLF), block)


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES, date: str | None = None
) -> None:
    """Write a record per page below ``path``, whole again on every run.

    Of equal payloads of at least ``least_bytes`` bytes the page with the largest
    key is a response, the others revisit it; a null key is the smallest, and of
    rows with one key, address and payload a single one is the response. A null
    payload is empty. White space and control characters of an address become
    ``%20``. Only digests that occur twice are gathered, as a written table, so
    payloads are not shuffled while few are equal; Spark decides by its size.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    top = F.struct("key", "url")
    counted = rows.where(F.col("size") >= least_bytes).groupBy("digest", "key", "url").agg(F.count(F.lit(1)).alias("n"))
    held = counted.groupBy("digest").agg(F.max(F.struct(top.alias("top"), "n")).alias("head"), F.sum("n").alias("rows"))
    repeated = durable(held.where("rows > 1").select("digest", "head.top", F.col("head.n").alias("ties")), "warc-repeated")

    joined = rows.join(repeated, "digest", "left")
    is_top = F.struct("key", "url").eqNullSafe(F.col("top"))
    once = joined.where(~(is_top & (F.coalesce("ties", F.lit(0)) > 1)))
    once = once.withColumn("kind", F.when(F.col("top").isNull() | is_top, "response").otherwise("revisit"))
    if not repeated.where("ties > 1").isEmpty():
        tied = rows.join(repeated.where("ties > 1"), "digest").where(is_top).dropDuplicates(["digest"])
        number = F.explode(F.sequence(F.lit(1), F.col("ties")))
        tied = tied.select("*", number.alias("number")).withColumn("kind", F.when(F.col("number") == 1, "response").otherwise("revisit"))
        once = once.unionByName(tied.drop("number"))

    digest = base32_of_hex(F.col("digest"))
    as_text = F.url_encode(F.col("key").cast("string"))
    named = F.concat(F.lit(_URN), F.coalesce(F.url_encode(F.col("top.key").cast("string")), F.lit("")), F.lit(":"), digest)
    identifier = F.when(F.col("top").isNotNull() & (F.col("kind") == "response"), named).otherwise(F.concat(F.lit("urn:uuid:"), F.uuid()))
    refers = F.when(F.col("kind") == "revisit", named)
    text = _record(F.col("kind"), as_text, F.col("url"), F.col("payload"), F.col("size"), digest, identifier, refers, date)
    once.select(text.alias("value")).write.mode("overwrite").option("lineSep", CRLF * 2).text(path)


_HEAD = pa.schema(
    [
        ("file", pa.string()),
        ("block", pa.int64()),
        ("start", pa.int64()),
        ("stop", pa.int64()),
        ("next", pa.int64()),
        ("leaves", pa.int64()),
        ("lacks", pa.int64()),
        ("header", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ]
)


def _header_fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "replace").split(CRLF)[1:]
    pairs = (line.partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


def _described(header: bytes, block: bytes) -> tuple[bytes | None, int | None, str | None]:
    """Payload, its size and its digest. An HTTP message has its body as payload,
    another block is one as a whole; of a revisit all is as its headers state."""
    fields = _header_fields(header)
    http, _, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    if fields.get("warc-type") == "revisit":
        size = _header_fields(http).get("content-length", "")
        return None, int(size) if size.isascii() and size.isdigit() else None, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return body, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()


def _candidate(value: bytes, start: int) -> tuple:
    """``next, lacks, header, payload_bytes, payload_digest`` of what starts behind
    a magic, at ``start``: where the text behind the next magic must start, and how
    many bytes of the record lie behind the cut. Nulls if it is no header."""
    header, end, block = value.partition(b"\r\n\r\n")
    if not end and value.endswith(b"\r\n"):  # the block starts with a magic, so the cut took the empty line
        header, end = value[:-2], b"\r\n\r\n"
    length = _header_fields(header).get("content-length", "") if end and header[:1].isdigit() else ""
    if not (length.isascii() and length.isdigit()):
        return None, None, None, None, None
    following = start + len(header) + 4 + int(length) + 4 + len(MAGIC)
    lacks = max(0, int(length) - len(block))
    size, digest = (None, None) if lacks else _described(header, block[: int(length)])[1:]
    return following, lacks, header.decode("utf-8", "replace"), size, digest


def _leaves(starts: np.ndarray, following: np.ndarray) -> np.ndarray:
    """First place outside the block on the chain from every candidate, by
    pointer jumping; -1 where the chain breaks off inside."""
    n = len(starts)
    at = np.minimum(np.searchsorted(starts, following), n - 1)
    inside = (following >= 0) & (starts[at] == following)
    jump = np.where(inside, at, np.arange(n))
    while True:
        further = jump[jump]
        if (further == jump).all():
            return following[jump]
        jump = further


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, value``: the bytes between magics, in the order of the file
    within every block that Spark reads."""
    raw = spark.read.option("lineSep", CUT).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list]]:
    """``file, block, start of the first, values`` for the batches of a task. Starts
    count from the first byte the block holds. The first value of a file includes
    its magic."""
    last, start = None, 0
    for batch in batches:
        values = batch.column(2)
        blocks = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        first = 0
        while first < len(blocks):
            end = first + 1
            while end < len(blocks) and blocks[end] == blocks[first]:
                end += 1
            if blocks[first] != last:
                last, start = blocks[first], 0
            held = values.slice(first, end - first).to_pylist()
            yield *last, start, held
            start += sum(len(v) + len(CUT) for v in held)
            first = end


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, start, stop, next, leaves, lacks, header, payload_bytes,
    payload_digest`` for the text behind every magic. The first record of a file
    has ``start`` 0."""

    def flush(file: str, block: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            starts, stops, found = [r[0] for r in rows], [r[1] for r in rows], [r[2:] for r in rows]
            following = np.array([-1 if f[0] is None else f[0] for f in found], np.int64)
            leaves = _leaves(np.array(starts, np.int64), following)
            columns = [[file] * len(rows), [block] * len(rows), starts, stops, following, leaves, *zip(*(f[1:] for f in found))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), field.type) for c, field in zip(columns, _HEAD)], schema=_HEAD)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for file, block, start, values in _by_block(batches):
            if (file, block) != last:
                if last:
                    yield from flush(*last, rows)
                last, rows = (file, block), []
            for value in values:
                stop = start + len(value) + len(CUT)
                first = block == 0 and start == 0
                held, behind = (value.removeprefix(MAGIC.encode()), len(MAGIC)) if first else (value, start)
                rows.append((start, stop, *_candidate(held if not first or len(held) < len(value) else b"", behind)))
                start = stop
        if last:
            yield from flush(*last, rows)

    types = "file string, block long, start long, stop long, next long, leaves long, lacks long, header string, payload_bytes long, payload_digest string"
    return _pieces(spark, path).mapInArrow(scan, types)


def _bases(marks: DataFrame) -> DataFrame:
    """``file, block, base, total``: where each block starts, and the place that
    the last record of the file must lead to. A row per block of a file."""
    ends = marks.groupBy("file", "block").agg(F.max("stop").alias("size"))
    of_file = W.partitionBy("file")
    before = F.sum("size").over(of_file.orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    return ends.select("file", "block", F.coalesce(before, F.lit(0)).alias("base"), (F.sum("size").over(of_file) - len(CRLF)).alias("total"))


def _entries(marks: DataFrame, bases: DataFrame) -> DataFrame:
    """``file, at, block, start``: places at which the chains from the starts of
    files enter blocks, and their ends, which lie in no block. Pointer jumping:
    every round doubles the number of blocks that a jump crosses."""
    placed = marks.where("leaves >= 0").join(bases, ["file", "block"])
    at, to = F.col("base") + F.col("start"), F.col("base") + F.col("leaves")
    places = jumps = durable(placed.select("file", "block", "start", at.alias("at"), to.alias("to")), "warc-jumps")
    jumps = jumps.select("file", "at", "to")
    targets = jumps.select("file", F.col("to").alias("at")).distinct()
    reached = durable(jumps.where("at = 0").select("file", "at"), "warc-reached")
    jumps = durable(jumps.join(targets, ["file", "at"], "left_semi").unionByName(jumps.where("at = 0")), "warc-jumps")
    n = reached.count()
    while True:
        further = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = durable(reached.unionByName(further).distinct(), "warc-reached")
        more = reached.count()
        if more == n:
            return reached.join(places, ["file", "at"], "left").select("file", "at", "block", "start")
        n = more
        ahead = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = durable(jumps.join(ahead, ["file", "to"], "left").select("file", "at", F.coalesce("beyond", "to").alias("to")), "warc-jumps")


def verified(marks: DataFrame) -> DataFrame:
    """``file, block, start, owner, reached`` for every candidate: whether it is
    a record, and the place of the record that its text belongs to.

    Raises ``ValueError`` if the chain of a file does not end with the file.
    """
    bases = durable(_bases(marks), "warc-blocks")
    entries = durable(_entries(marks, bases), "warc-entries")
    ends = bases.groupBy("file").agg(F.max("total").alias("at"))
    broken = ends.join(entries, ["file", "at"], "left_anti").select("file").limit(3).collect()
    if broken:
        raise ValueError(f"chain of records does not end with the file: {[row.file for row in broken]}")

    def walk(of_block: pd.DataFrame) -> pd.DataFrame:
        rows = of_block.sort_values("start")
        starts, following = rows["start"].to_numpy(), rows["next"].to_numpy()
        reached = np.zeros(len(rows), bool)
        entry = rows["entry"].iloc[0]
        at = int(np.searchsorted(starts, entry)) if entry >= 0 else len(rows)
        while at < len(rows):  # a step per record
            reached[at] = True
            at = int(np.searchsorted(starts, following[at]))
        last = np.maximum.accumulate(np.where(reached, np.arange(len(rows)), -1))
        owner = np.where(last >= 0, starts[np.maximum(last, 0)], -1)
        return pd.DataFrame({"file": rows["file"], "block": rows["block"], "start": starts, "owner": owner, "reached": reached})

    entry = entries.where("block IS NOT NULL").select("file", "block", F.col("start").alias("entry"))
    narrow = marks.select("file", "block", "start", "next").join(entry, ["file", "block"], "left").fillna(-1, ["entry"])
    marked = narrow.groupBy("file", "block").applyInPandas(walk, "file string, block long, start long, owner long, reached boolean")
    placed = durable(marked.join(bases.select("file", "block", "base"), ["file", "block"]), "warc-marked")
    of_block = placed.where("owner >= 0").groupBy("file", "block").agg(F.max(F.col("base") + F.col("owner")).alias("last"))
    earlier = F.max("last").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    carried = bases.select("file", "block").join(of_block, ["file", "block"], "left").select("file", "block", earlier.alias("carried"))
    owner = F.when(F.col("owner") >= 0, F.col("base") + F.col("owner")).otherwise(F.col("carried"))
    return placed.join(carried, ["file", "block"]).select("file", "block", "start", (F.col("base") + F.col("start")).alias("at"), owner.alias("owner"), "reached")


def _gathered(spark: SparkSession, path: str, owned: DataFrame) -> DataFrame:
    """``file, at, payload`` of the records of ``owned`` (``file, block, start,
    owner, at``), put together from everything between their magics."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, start, values in _by_block(batches):
            starts = np.cumsum([start, *(len(v) + len(CUT) for v in values[:-1])])
            if block == 0 and start == 0:
                values[0] = values[0].removeprefix(MAGIC.encode())
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(values)), pa.array([block] * len(values), pa.int64()), pa.array(starts), pa.array(values, pa.binary())], ["file", "block", "start", "value"])

    pieces = _pieces(spark, path).mapInArrow(place, "file string, block long, start long, value binary").join(owned, ["file", "block", "start"])
    whole = pieces.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("pieces"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            described = []
            for pieces in batch.column(2).to_pylist():
                header, _, block = CUT.encode().join(p["value"] for p in pieces).partition(b"\r\n\r\n")
                described.append(_described(header, block[: int(_header_fields(header)["content-length"])]))
            columns = zip(*described) if described else ((), (), ())
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, (pa.binary(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["file", "at", "payload", "payload_bytes", "payload_digest"])

    return whole.mapInArrow(cut, "file string, at long, payload binary, payload_bytes long, payload_digest string")


def _field(name: str) -> Column:
    """A field of the header; names in either case, the first one counts."""
    found = F.regexp_extract("header", rf"(?i)\r\n{name}[ \t]*:[ \t]*([^\r\n]*?)[ \t]*(\r\n|$)", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, path: str, key_type: str = "long", payload: bool = False) -> DataFrame:
    """Every record below ``path``: ``file, at`` (offset of the record), its
    header fields, size and digest of the payload as read, whether that is the
    digest the header states, and the ``payload`` itself if asked for.

    A revisit has no payload of its own (null, digest and size as stated). Magics
    inside payloads are no records. An archive that breaks off, or has other bytes
    before, between or behind its records, raises ``ValueError``; no files give no rows.
    """
    marks = durable(candidates(spark, path), "warc-candidates")
    owned = durable(verified(marks), "warc-owners")
    heads = marks.join(owned.where("reached"), ["file", "block", "start"])
    if payload:
        kept = heads.drop("payload_bytes", "payload_digest").join(_gathered(spark, path, owned.drop("reached")), ["file", "at"])
    else:
        split = durable(heads.where("lacks > 0").select("file", F.col("at").alias("owner")), "warc-split")
        kept = heads.withColumn("payload", F.lit(None).cast("binary"))
        if not split.isEmpty():
            wanted = owned.drop("reached").join(split, ["file", "owner"], "left_semi")
            again = heads.where("lacks > 0").drop("payload_bytes", "payload_digest").join(_gathered(spark, path, wanted), ["file", "at"])
            kept = kept.where("lacks = 0").unionByName(again.select(kept.columns))
    kind = _field("WARC-Type")
    stated = F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "")
    refers = F.regexp_extract(_field("WARC-Refers-To"), f"^<{_URN}([^:]*):", 1)
    decoded = [F.url_decode(F.when(c != "", c)).cast(key_type) for c in (_field("Page-Key"), refers)]
    return kept.select(
        "file",
        F.greatest(F.col("at") - len(MAGIC), F.lit(0)).alias("at"),
        kind.alias("record_type"),
        _field("WARC-Record-ID").alias("record_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Date").alias("date"),
        decoded[0].alias("key"),
        decoded[1].alias("refers_to"),
        "payload_bytes",
        "payload_digest",
        F.when(kind != "revisit", stated == F.col("payload_digest")).alias("digest_ok"),
        "payload",
    )
