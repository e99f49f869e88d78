r"""WARC archives as a table of chunks.

A payload is never one value on its way to an archive or back (``chunk_table`` cuts it from the
row that holds it, which is in memory with its batch): it is a run of rows (record, chunk_no), each
with at most ``CHUNK`` bytes and the SHA-1 of everything up to its end. In an archive
each chunk is a segment record of its own (the first a response or revisit, the rest
continuations), so Spark's text writer and reader, with record marks for line ends,
write and read archives on any file system and split large ones. A payload that
holds the mark is cut inside it, so the mark only ever opens a record.

Reading gives the chunk table back; ``records`` sums it up with an open digest that
is carried from row to row. Chunks of records that have one chunk only are summed up
where they are read; only longer ones are sorted together.

Defined results: a null payload is empty; rows that repeat are records of their own;
among equal payloads of at least ``LEAST_SHARED`` bytes the row with the largest id
is the response (every repeat of it) and smaller ids revisit it; rows without an id
are responses; a record is named by its id, or by a number and its id where several rows have
the id (a reference to such a record names the id only); other columns are ignored; an empty table gives an archive without
records and no rows. Content that does not match its declared length or digest
raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirwise.llm.common import slices
from dirwise.session import saved

CHUNK = 1 << 16
LEAST_SHARED = 1000
MARK = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
CHUNKS = "record string, chunk_no long, kind string, target string, refers_to string, payload_bytes long, declared string, is_last boolean, digest string, chunk binary"
#: What a record's name begins with where its id stands on one row; references are made of it.
NAMED = "urn:page:0/"
#: Bytes of chunks handed to Spark at once.
FLUSH = 4 << 20


def cuts(payload: memoryview, size: int = CHUNK) -> Iterator[memoryview]:
    """Consecutive parts of a payload, none holding the mark; an empty payload is one empty part."""
    start = 0
    while True:
        end = min(start + size, len(payload))
        inside = bytes(payload[start:end]).find(MARK)
        if inside >= 0:
            end = start + inside + 1
        yield payload[start:end]
        start = end
        if start >= len(payload):
            return


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row[-1] or b"")
        if size >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


CHUNK_ROW = pa.schema([("record", pa.string()), ("chunk_no", pa.int64()), ("kind", pa.string()), ("target", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("declared", pa.string()), ("is_last", pa.bool_()), ("digest", pa.string()), ("chunk", pa.binary())])


def revisits(pages: DataFrame, id_col: str, payload_col: str, least: int = LEAST_SHARED) -> DataFrame:
    """id and refers_to of the rows whose payload a larger id holds too."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    marks = pages.where(F.octet_length(payload) >= least).select(F.col(id_col).alias("id"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n"))
    shared = marks.groupBy("sha", "n").agg(F.max("id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    return marks.join(shared, ["sha", "n"]).where("id < refers_to").select("id", "refers_to").distinct()


def chunk_table(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", chunk: int = CHUNK, least: int = LEAST_SHARED) -> DataFrame:
    """The pages' records as chunk rows. A record's name holds the page's id after the last slash; a revisit has one empty chunk."""
    again = revisits(pages, id_col, payload_col, least).withColumn("several", F.lit(False))
    several = pages.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(None).cast(again.schema["refers_to"].dataType).alias("refers_to"), F.lit(True).alias("several"))
    again = saved(again.unionByName(several).groupBy("id").agg(F.max("refers_to").alias("refers_to"), F.max("several").alias("several")))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"), F.col(url_col).cast("string").alias("url"))
    rows = rows.join(again, "id", "left").select(F.col("id").cast("string").alias("id"), "url", F.col("refers_to").cast("string").alias("refers_to"), "payload", (F.col("id").isNull() | F.coalesce("several", F.lit(False))).alias("several"))

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0

        def parts() -> Iterator[tuple]:
            nonlocal made
            for batch in slices(batches, 64):
                for i in range(batch.num_rows):
                    name, url, of, payload, several = (batch.column(c)[i] for c in range(5))
                    view, sha, of = memoryview(payload.as_buffer()), hashlib.sha1(), of.as_py()
                    record = f"urn:page:{task}-{made}/{name.as_py() or ''}" if several.as_py() else f"{NAMED}{name.as_py()}"
                    made += 1
                    declared = hashlib.sha1(view).hexdigest()
                    if of is not None:
                        yield record, 0, "revisit", url.as_py(), of, len(view), declared, True, declared, b""
                        continue
                    done = 0
                    for n, part in enumerate(cuts(view, chunk)):
                        sha.update(part)
                        done += len(part)
                        yield record, n, "response", url.as_py(), None, len(view), declared, done == len(view), sha.hexdigest(), bytes(part)

        yield from _batches(parts(), CHUNK_ROW)

    return rows.mapInArrow(run, CHUNKS)


def write(chunks: DataFrame, path: str, compression: str = "none") -> None:
    """Write the chunk table as archives: a segment record a chunk, in the order of the rows."""
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                first, kind = row["chunk_no"] == 0, row["kind"]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode() if first else b""
                head = [
                    ("WARC-Type", kind if first else "continuation"), ("WARC-Record-ID", f"<{row['record']}>" if first else f"<{row['record']}#{row['chunk_no'] + 1}>"),
                    ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Number", row["chunk_no"] + 1), ("WARC-Running-Digest", f"sha1:{row['digest']}"), ("WARC-Payload-Digest", f"sha1:{row['declared']}"),
                    ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + len(row["chunk"])),
                ]
                if row["target"] is not None:
                    head.append(("WARC-Target-URI", " ".join(row["target"].split())))
                if not first:
                    head.append(("WARC-Segment-Origin-ID", f"<{row['record']}>"))
                if row["is_last"]:
                    head.append(("WARC-Segment-Total-Length", row["payload_bytes"]))
                if kind == "revisit":
                    head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{NAMED}{row['refers_to']}>")]
                out.append(MARK + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + http + row["chunk"])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    chunks.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("compression", compression).text(path)


def _find(raw: memoryview, mark: bytes, start: int = 0, step: int = 1 << 14) -> int:
    """Place of the mark at or after ``start``, looked for piece by piece; a header may have any length."""
    for at in range(start, len(raw), step):
        found = bytes(raw[at : at + step + len(mark) - 1]).find(mark)
        if found >= 0:
            return at + found
    raise ValueError("a record without a header")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of all archives below ``path``. Every chunk's length is checked, and the digest of the first one."""
    def run(batches):
        def parts() -> Iterator[tuple]:
            for batch in slices(batches, 64):
                for value in batch.column(0):
                    raw = memoryview(value.as_buffer())
                    split = _find(raw, END)
                    head = dict(line.split(": ", 1) for line in bytes(raw[:split]).decode().split("\r\n"))
                    start = split + len(END)
                    stop = start + int(head["Content-Length"])
                    if bytes(raw[stop:]) != END:
                        raise ValueError(f"{head['WARC-Record-ID']}: its length is not {head['Content-Length']}")
                    number, kind, size = int(head["WARC-Segment-Number"]) - 1, head["WARC-Type"], None
                    if not number:
                        body = _find(raw, END, start) + len(END)
                        http = bytes(raw[start:body])
                        size = int(http[http.index(b"Content-Length: ") + 16 :].split(b"\r\n", 1)[0])
                        start = body
                    chunk = bytes(raw[start:stop])
                    running = head["WARC-Running-Digest"].removeprefix("sha1:")
                    if not number and kind != "revisit" and hashlib.sha1(chunk).hexdigest() != running:
                        raise ValueError(f"{head['WARC-Record-ID']}: its digest is not {running}")
                    record = head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"]).strip("<>")
                    refers = head["WARC-Refers-To"].strip("<>").removeprefix(NAMED) if kind == "revisit" else None
                    yield record, number, kind, head.get("WARC-Target-URI"), refers, size, head["WARC-Payload-Digest"].removeprefix("sha1:"), "WARC-Segment-Total-Length" in head, running, chunk

        yield from _batches(parts(), CHUNK_ROW)

    lines = spark.read.option("lineSep", MARK.decode()).text(path).where("value <> ''")
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: record, kind, target, refers_to, payload_bytes, payload_digest. Checks order, completeness and digests of all chunks."""
    light = F.when((F.col("chunk_no") == 0) & F.col("is_last"), F.lit(None).cast("binary")).otherwise(F.col("chunk"))
    together = chunks.withColumn("chunk", light).repartition("record").sortWithinPartitions("record", "chunk_no")

    def run(batches):
        sha = head = None
        size = count = 0
        for batch in slices(batches, 64):
            out = []
            for row in batch.to_pylist():
                number, last = row["chunk_no"], row["is_last"]
                if number == 0:
                    if head:
                        raise ValueError(f"{head['record']}: its last chunks are missing")
                    head, sha, size, count = row, hashlib.sha1(), 0, 0
                if not head or row["record"] != head["record"] or number != count:
                    raise ValueError(f"{row['record']}: chunk {number} does not follow")
                count += 1
                if row["chunk"] is None:  # the whole record, whose digest was taken where it was read
                    digest, size = row["digest"], head["payload_bytes"]
                else:
                    sha.update(row["chunk"])
                    size += len(row["chunk"])
                    digest = sha.hexdigest()
                    if digest != row["digest"]:
                        raise ValueError(f"{row['record']}: chunk {number} has another digest")
                if last:
                    if digest != head["declared"] or size != head["payload_bytes"]:
                        raise ValueError(f"{row['record']}: its payload is not the declared one")
                    out.append((head["record"], head["kind"], head["target"], head["refers_to"], size, digest))
                    head = None
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i == 4 else pa.string()) for i in range(6)], ["record", "kind", "target", "refers_to", "payload_bytes", "payload_digest"])
        if head:
            raise ValueError(f"{head['record']}: its last chunks are missing")

    return together.mapInArrow(run, "record string, kind string, target string, refers_to string, payload_bytes long, payload_digest string")
