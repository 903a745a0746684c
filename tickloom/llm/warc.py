"""WARC archives: records written with an index, and read back by sorted, coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import byte_bounded, utf8
from tickloom.session import shared_dir

#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Ranges nearer than this are read at once, up to the second number of bytes.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Part of an archive that one task reads.
PART_BYTES = 64 << 20

INDEX = "path string, offset long, length long, url string, digest string, record_type string"
_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])
_END = b"\r\n"
_LINE = str.maketrans({"\r": "%0D", "\n": "%0A"})


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(name: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member; a revisit has the headers of its payload only."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Target-URI: {url.translate(_LINE)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"" if refers_to else payload
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"".join([head, _END, _END, block, _END, _END])) + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(_END + _END)
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def page_name(page_id, copy: int) -> str:
    """The record's name; what could end a header line is escaped."""
    return f"urn:page:{'' if page_id is None else quote(str(page_id), safe='')}:{copy}"



def with_revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``(id, url, payload, copies, refers_to, first)``: which page's payload each page repeats.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one of the largest id is the response, and the others
    refer to it; ``first`` is false for those. Equal rows come as one with their number in ``copies``; of equal
    ids the largest url counts. Only ids, urls and digests are grouped; payloads move once, by the page.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.select("id", "url", "payload", F.sha1("payload").alias("sha"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), F.coalesce("url", F.lit("")).alias("place"))
    key = ["name", "place", "sha"]
    groups = rows.groupBy(*key).agg(F.max("id").alias("id"), F.max(F.octet_length("payload")).alias("size"))
    best = groups.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.max(F.struct("id", "name", "place")).alias("best"))
    linked = F.col("best").isNotNull()
    facts = groups.join(best, "sha", "left").select(
        *key, linked.alias("linked"), F.col("best.id").alias("refers_to"), (~linked | (F.struct("name", "place") == F.struct("best.name", "best.place"))).alias("first")
    )
    # the one move of payloads; equal rows meet in the tasks that read them first
    whole = rows.groupBy(*key).agg(F.first("id").alias("id"), F.first("url").alias("url"), F.first("payload").alias("payload"), F.count("*").alias("copies"))
    return whole.join(facts, key).select("id", "url", "payload", "copies", "refers_to", "first", "linked")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for every row of ``pages`` below ``folder`` and return the written index.

    The index has ``(path, offset, length, url, digest, record_type)`` and lists only archives that a finished task has
    written: names hold the task's attempt, so what a lost executor leaves behind is never read. Null payloads are empty;
    a null url is the empty one; repeated rows are records of their own, all but one of them revisits; an empty
    table gives an empty index.
    """

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root)
        number, out, offset, path = 0, None, 0, ""
        for batch in batches:
            index = []
            payloads = utf8(batch.column(2))
            for i, page in enumerate(batch.select(["id", "url", "copies", "refers_to", "first", "linked"]).to_pylist()):
                payload, url = payloads[i], page["url"] or ""
                digest = payload_digest(payload)
                best = page_name(page["refers_to"], 0)
                for copy in range(page["copies"]):
                    revisit = page["linked"] and (copy > 0 or not page["first"])
                    data = record(page_name(page["id"], copy), url, payload, digest, best if revisit else None)
                    if out is None or offset + len(data) > archive_bytes and offset:
                        if out is not None:
                            out.close()
                        path = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.gz"
                        number, out, offset = number + 1, store.open_output_stream(path, compression=None), 0
                    out.write(data)
                    index.append((path, offset, len(data), url, digest, "revisit" if revisit else "response"))
                    offset += len(data)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*index), _INDEX)], schema=_INDEX)
        if out is not None:
            out.close()

    rows = with_revisits(byte_bounded(pages), least_bytes, id_col, url_col, payload_col)
    index = f"{folder}/index.parquet"
    rows.mapInArrow(run, INDEX).write.parquet(index)
    return pages.sparkSession.read.schema(INDEX).parquet(index)


def coalesced(rows: list[dict], gap: int = GAP_BYTES, most: int = READ_BYTES):
    """Runs of sorted index rows that are read at once, with where they begin and end."""
    run: list[dict] = []
    begin = end = 0
    for x in rows:
        last = x["offset"] + x["length"]
        if run and (x["offset"] > end + gap or last - begin > most):
            yield begin, end, run
            run = []
        if not run:
            begin = end = x["offset"]
        run.append(x)
        end = max(end, last)
    if run:
        yield begin, end, run


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """The records of the index rows ``selected``: ``(name, url, record_type, refers_to, digest, payload_bytes, payload)``.

    Index rows are dealt by parts of archives and sorted; near ranges are read together. A response whose payload has not
    the digest of its header and of the index is an error.
    """
    columns = [("name", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]

    def fetch(store, path: str, rows: list[dict]):
        out = []
        with store.open_input_file(path) as file:
            for begin, end, run in coalesced(rows):
                data = file.read_at(end - begin, begin)
                for x in run:
                    headers, payload = parse(data[x["offset"] - begin : x["offset"] - begin + x["length"]])
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if digest != x["digest"] or kind == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"{path}: the record at {x['offset']} does not match its digest")
                    refers = headers.get("WARC-Refers-To")
                    size = int(headers["X-Payload-Length"])
                    out.append((headers["WARC-Record-ID"].strip("<>"), headers["WARC-Target-URI"], kind, refers and refers.strip("<>"), digest, size, payload if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), columns)], names=[n for n, _ in columns])
                out = []

    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            rows = batch.to_pylist()
            first = 0
            for i in range(1, len(rows) + 1):
                if i == len(rows) or rows[i]["path"] != rows[first]["path"]:
                    yield from fetch(store, rows[first]["path"], rows[first:i])
                    first = i

    part = F.floor(F.col("offset") / PART_BYTES)
    rows = selected.select("path", "offset", "length", "digest", part.alias("part")).repartition("path", "part").sortWithinPartitions("path", "offset")
    return rows.mapInArrow(run, "name string, url string, record_type string, refers_to string, digest string, payload_bytes long, payload binary")


def round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", **columns) -> DataFrame:
    """Archive ``pages`` in the shared folder and read all records back: ``(id_col, payload_bytes, payload_digest, record_type, refers_to)``."""
    import uuid

    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    folder = f"{shared_dir(spark)}/tickloom-warc/{uuid.uuid4().hex}"
    folder = folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder
    found = read_records(write_archives(pages, folder, least_bytes, id_col=id_col, **columns), folder)
    page = lambda name: F.nullif(F.url_decode(F.regexp_extract(name, r"^urn:page:(.*):\d+$", 1)), F.lit("")).cast(kind)
    return found.select(page("name").alias(id_col), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
