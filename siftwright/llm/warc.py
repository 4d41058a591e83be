"""WARC archives: written with revisit records, read back by boundary-chain verification.

Reading needs no index. Tasks scan byte ranges of the archives and emit, for each place
where a record may start, where its successor would start. Pointer jumping from each file's
start then keeps the records that are really reached, so the magic inside a payload is
never taken for a record. A chain is followed within its byte range by the task that
scanned it, so that jumping has as many rounds as the logarithm of a file's ranges.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm.workspace import Workspace, small

RANGE = 4 << 20  # bytes that a task scans for records
FILE = 64 << 20  # bytes after which a task begins another archive
_HELD = 8 << 20  # bytes of payloads that a reader holds
_MAGIC = b"WARC/1.0\r\n"
_LONGEST_HEADER = 1 << 16
_LONGEST_TARGET = 1 << 15  # the other fields of a header have less than a thousand bytes
_LENGTH = re.compile(rb"\r\nContent-Length: (\d{1,18})\r\n")
_FILES = "file string, n_bytes long"
_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(fields: dict) -> bytes:
    return _MAGIC + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items() if v is not None) + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: its header, its HTTP block (without the payload in a revisit), its end.

    A URL too long for a header that is found in one piece is in the block, as Content-Location.
    """
    # what could end a header line, or isn't ASCII, is percent-encoded; so is the percent sign
    target = None if url is None else quote(url, safe="!#$&'()*+,/:;=?@[]~")
    inside = target is not None and len(target) > _LONGEST_TARGET
    located = f"Content-Location: {target}\r\n" if inside else ""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{located}\r\n".encode()
    block = http if revisit else http + payload
    urn = "<urn:page:{}>".format
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": urn("" if page_id is None else page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if inside else target,
        "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": urn(refers_to) if revisit else None,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    return _header(fields) + block + b"\r\n\r\n"


def _writer(folder: str, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, done, out, name = TaskContext.get(), [], None, None
        for batch in batches:
            for page, url, html, ref, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    # a task that runs again writes other files; only those of its committed run are listed
                    name = f"{task.partitionId():06d}-{len(done):04d}-{uuid.uuid4().hex[:8]}.warc"
                    out = store.open_output_stream(f"{root}/{name}")
                out.write(record(page, url, (html or "").encode("utf-8", "surrogatepass"), ref, revisit))
                if out.tell() >= most:
                    done.append((name, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((name, out.tell()))
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], names=["file", "n_bytes"])

    return write


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def write_warc(pages: DataFrame, folder: str, work: Workspace, min_revisit_bytes: int = 0, file_bytes: int = FILE) -> DataFrame:
    """Write a record per row of pages (page_id, url, html); (file, n_bytes) to be read back.

    Of records with equal payloads of at least min_revisit_bytes, that with the largest
    page_id is a response and the others revisit it; smaller payloads are all responses.
    Defined results: a null html is an empty payload; a null url is left out; rows without
    page_id never have revisits refer to them and are responses if their whole group has
    no id; rows with the largest id repeated are all responses; an empty table writes no
    file; other columns aren't read. The returned rows must be written once before use:
    every evaluation of them writes archives anew.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    key = F.struct(F.sha1(_payload(F.col("html"))).alias("sha"), F.octet_length(_payload(F.col("html"))).alias("size"))
    # only groups of several rows are joined, and payloads are moved only if these are many
    firsts = rows.select(key.alias("key"), "page_id").where(F.col("key.size") >= min_revisit_bytes).groupBy("key").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = work.write(firsts.where((F.col("n") > 1) & F.col("first").isNotNull()).select("key", "first"), "repeated")
    joined = rows.withColumn("key", key).join(small(firsts, F.lit(80)), "key", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("ref"), revisit.alias("revisit")).mapInArrow(_writer(folder, file_bytes), _FILES)


def _parse(data: bytes, at: int) -> tuple[int, int] | None:
    """(start of the block, its length) of what may be a record at ``at``, else nothing."""
    if not data.startswith(_MAGIC, at):
        return None
    end = data.find(b"\r\n\r\n", at, at + _LONGEST_HEADER)
    length = _LENGTH.search(data, at, end + 4) if end >= 0 else None
    return (end + 4, int(length[1])) if length else None


def _scan(folder: str):
    """(file, part, at, exit): each candidate, and where its chain leaves the byte range."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, part, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{root}/{file}") as f:
                    f.seek(lo)
                    data = f.read(hi - lo + _LONGEST_HEADER)
                following, at = {}, data.find(_MAGIC)
                while 0 <= at < hi - lo:
                    if found := _parse(data, at):
                        following[at] = found[0] + found[1] + 4
                    at = data.find(_MAGIC, at + 1)
                leaves: dict[int, int] = {}
                for at in sorted(following, reverse=True):
                    to = following[at]
                    # a successor in this range that is no candidate ends the chain: it isn't real
                    leaves[at] = to if to >= hi - lo else leaves.get(to, -1)
                kept = sorted(at for at, to in leaves.items() if to >= 0)
                n = len(kept)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.string()), pa.array([part] * n, pa.int64()), pa.array([lo + at for at in kept], pa.int64()), pa.array([lo + leaves[at] for at in kept], pa.int64())],
                    names=["file", "part", "at", "exit"],
                )

    return scan


def _reader(folder: str):
    """The records from a verified start up to the end of its byte range."""
    names = [f.split()[0] for f in _RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, at, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out: list[tuple] = []
                held = 0
                with store.open_input_file(f"{root}/{file}") as f:
                    while at < hi:
                        f.seek(at)
                        head = f.read(4096)
                        while b"\r\n\r\n" not in head and len(head) < _LONGEST_HEADER and (more := f.read(4096)):
                            head += more
                        found = _parse(head, 0)
                        if not found:
                            raise ValueError(f"{file}: no record at {at}")
                        begin, size = found
                        block = head[begin : begin + size]
                        if len(block) < size:
                            f.seek(at + begin + len(block))
                            block += f.read(size - len(block))
                        if len(block) < size:
                            raise ValueError(f"{file}: the record at {at} is cut off")
                        out.append(_record(head[: begin - 4], block))
                        at += begin + size + 4
                        held += size + 500
                        if held >= _HELD:
                            yield _batch(out, names, kinds)
                            out, held = [], 0
                yield _batch(out, names, kinds)

    return read


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _record(head: bytes, block: bytes) -> tuple:
    from urllib.parse import unquote

    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    http, payload = block.split(b"\r\n\r\n", 1)
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    kind, told = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest(payload) != told):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what its record says")
    located = re.search(rb"\r\nContent-Location: ([^\r]*)", http)
    url = located[1].decode() if located else fields.get("WARC-Target-URI")
    return number(fields["WARC-Record-ID"]), None if url is None else unquote(url), kind, number(fields.get("WARC-Refers-To")), length, told, payload if kind == "response" else None


def read_warc(files: DataFrame, folder: str, work: Workspace, range_bytes: int = RANGE) -> DataFrame:
    """Every record of the archives ``files`` (file, n_bytes) in ``folder``.

    Columns: page_id, url, record_type, refers_to, payload_bytes, payload_digest and
    payload (null in a revisit). A response whose payload doesn't match its digest, a
    record that is cut off, and a chain that doesn't reach its file's end raise an error.
    """
    n = F.ceil(F.col("n_bytes") / range_bytes)
    ranges = files.select("file", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("part"))
    ranges = ranges.select("file", "part", (F.col("part") * range_bytes).alias("lo"), F.least(F.col("n_bytes"), (F.col("part") + 1) * range_bytes).alias("hi"))
    ranges = work.write(ranges, "ranges")
    links = work.write(_spread(ranges).mapInArrow(_scan(folder), "file string, part long, at long, exit long"), "links")
    jumps = links.select("file", "at", F.col("exit").alias("to"))
    reached = files.where(F.col("n_bytes") > 0).select("file", F.lit(0).cast("long").alias("at"))
    count = reached.count()
    for k in range(64):
        step = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = work.write(reached.unionByName(step).distinct(), f"reached-{k}")
        before, count = count, reached.count()
        if k:
            work.drop(f"reached-{k - 1}")
        if count == before:
            break
        # what is jumped over doubles each round
        further = jumps.select("file", F.col("at").alias("from"), F.col("to").alias("at")).join(jumps, ["file", "at"])
        jumps = work.write(further.select("file", F.col("from").alias("at"), "to"), f"jumps-{k}")
        if k:
            work.drop(f"jumps-{k - 1}")
    ends = reached.withColumnRenamed("at", "n_bytes")
    cut = files.where(F.col("n_bytes") > 0).join(ends, ["file", "n_bytes"], "left_anti").limit(1).collect()
    if cut:
        raise ValueError(f"the records of {cut[0]['file']} don't lead to its end")
    starts = reached.withColumn("part", F.floor(F.col("at") / range_bytes)).join(ranges, ["file", "part"]).where(F.col("at") < F.col("hi")).select("file", "at", "hi")
    return _spread(starts).mapInArrow(_reader(folder), _RECORDS)


def _spread(rows: DataFrame) -> DataFrame:
    """Byte ranges dealt to tasks evenly; a shuffle of a few bytes for each range."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *rows.columns[:2])


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, file_bytes: int = FILE, range_bytes: int = RANGE) -> DataFrame:
    """pages written as archives in the shared folder and read back, see both functions."""
    work = Workspace(pages.sparkSession, "warc")
    folder = work.store_path("archives")
    files = work.write(write_warc(pages, folder, work, min_revisit_bytes, file_bytes), "files")
    return read_warc(files, folder, work, range_bytes)
