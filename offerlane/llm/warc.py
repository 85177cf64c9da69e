"""WARC archives: a deterministic sharded writer and a reader.

Which record is a response and which a revisit, and where shards begin, is decided on slim keys (page id, digest, size):
a shard is a range of the keys' order, and the bounds are quantiles, by bytes, of a sample that a hash of the keys picks,
so they follow from the pages alone. Then every page moves once, to its shard's task, where records are sorted, written,
and files roll over when their compressed size passes a bound. Decisions travel to the same shards as rows of their own.

Tasks write under temporary names of their own; a second job, knowing from the tasks that succeeded which files count,
renames those and writes the manifest, which counts once its _SUCCESS is there. A lost executor or a second attempt
leaves nothing but files that no manifest names. Files, their names and their bytes follow from the pages.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlane.llm.common import checkpointed, look_up, shared_dir, ship

#: Bytes of payload in a shard, about; up to FEW shards are as small as LEAST_BYTES, so that small tables use several tasks.
SHARD_BYTES, LEAST_BYTES, FEW = 256 << 20, 4 << 20, 32
#: Shards at most (each a task; they grow beyond SHARD_BYTES after that), and keys sampled for each.
SHARDS, SAMPLED = 20_000, 16
#: Compressed bytes after which a file rolls over.
ROLL_BYTES = 32 << 20
#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 100
#: Bytes that a record has besides its payload, about.
HEAD_BYTES = 600
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 20


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri) if "://" in uri or uri.startswith("file:/") else "file://" + uri)


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _clean(url: str) -> str:
    """A url that can stand in a header line: blanks and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(page_id, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to=None) -> bytes:
    """One record as a gzip member of its own. With refers_to it is a revisit: only the HTTP head."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_clean(url)}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _info(name: str) -> bytes:
    block = b"software: offerlane\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, html, digest, n_bytes, key (orders by page id, nulls first, then digest, then url)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))
    return rows.select("*", F.concat(_prefix(), F.lpad(F.hex(F.xxhash64("url")), 16, "0")).alias("key"))


def _prefix() -> Column:
    ordered = F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(ordered, F.lit("-")), "digest")


def _bounds(slim: DataFrame, shards: int, total: int) -> list[str]:
    """The keys at which shards begin, but the first. A key whose copies outgrow a shard is split by fractions."""
    each = total / (shards * SAMPLED)
    size = F.col("n") * (F.col("n_bytes") + HEAD_BYTES)
    chance = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    # about SAMPLED keys a shard
    sample = sorted((r["key"], max(float(r["size"]), each)) for r in slim.select("key", size.alias("size")).where(chance < size / each).collect())
    step, at, bounds = sum(w for _, w in sample) / shards, 0.0, []
    for key, w in sample:
        while len(bounds) < shards - 1 and (wanted := (len(bounds) + 1) * step) < at + w:
            bounds.append(f"{key}{int((wanted - at) / w * 0xFFFFFFFF):08X}" if w > step else key)
        at += w
    return bounds


def _shard_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds a key has reached, by halving steps."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(bounds)), ",")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= key, at + step).otherwise(at))


def _revisits(slim: DataFrame, total: int) -> DataFrame:
    """(page_id, digest, first) of the records that revisit another. Nothing but ids and digests is shuffled."""
    able = slim.where(F.col("n_bytes") >= REVISIT_BYTES)
    firsts = able.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    found = look_up(able.select("page_id", "digest"), firsts, "digest", total)
    return found.where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()


_FILE = "shard int, nth int, name string, path string, records long, bytes long, sha256 string"
_NAMED = "shard int, nth int, name string, records long, bytes long, sha256 string"
_TYPES = {"shard": pa.int32(), "nth": pa.int32(), "name": pa.string(), "path": pa.string(), "records": pa.int64(), "bytes": pa.int64(), "sha256": pa.string()}


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _TYPES[k]) for k in names], names)


def _writer(attempts: str, roll_bytes: int):
    """Sorted rows (shard, page_id, digest, first, url, html, n_bytes) -> a row for each file written. A row without html
    says what the records of its page id and digest refer to."""

    def write(batches):
        files, base = _files(attempts)
        base = f"{base}/{uuid.uuid4().hex}"
        out, now, revisit, done = None, {}, (None, None, None), []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                now["sha256"] = now.pop("sha").hexdigest()
                done.append(dict(now))
                out = None

        def put(data: bytes, records: int):
            out.write(data)
            now["records"] += records
            now["bytes"] += len(data)
            now["sha"].update(data)

        for b in batches:
            for shard, page_id, digest, first, url, html, n_bytes in zip(*(c if i == 5 else c.to_pylist() for i, c in enumerate(b.columns))):
                if (payload := html.as_py()) is None:
                    revisit = (page_id, digest, first)
                    continue
                if out is None or shard != now["shard"] or now["bytes"] >= roll_bytes:
                    close()
                    nth = now["nth"] + 1 if shard == now.get("shard") else 0
                    name = f"pages-{shard:06d}-{nth:05d}.warc.gz"
                    now.update(shard=shard, nth=nth, name=name, path=f"{base}/{name}", records=0, bytes=0, sha=hashlib.sha256())
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(now["path"], compression=None)
                    put(_info(name), 0)
                put(record(page_id, url, payload, digest, n_bytes, revisit[2] if revisit[:2] == (page_id, digest) else None), 1)
        close()
        yield _batch(done, list(_TYPES))

    return write


def write_warc(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES, least_bytes: int = LEAST_BYTES, roll_bytes: int = ROLL_BYTES) -> str:
    """Write a record for each row of pages under root, and return the manifest's path (a folder of JSON lines).

    Of records with equal payloads of at least 100 bytes, that with the smallest page id is a response and the others
    revisit it; rows that repeat its id are responses too. A record without id is a revisit where an equal payload has an
    id. Null html counts as empty; a null url leaves its header out. Other columns aren't read. No pages give a manifest
    without files. The same pages give the same files, but for rows alike in id, url and payload that outgrow a shard:
    how many of them stand in each of several files hangs on how the table is split.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = _rows(pages, id_col, url_col, html_col)
    slim = checkpointed(rows.groupBy("page_id", "digest", "n_bytes", "key").agg(F.count(F.lit(1)).alias("n")))
    total = slim.agg(F.coalesce(F.sum(F.expr(f"n * (n_bytes + {HEAD_BYTES})")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("keys")).first()
    shards = min(SHARDS, max(1, -(-total["bytes"] // shard_bytes), min(FEW, total["bytes"] // least_bytes)))
    bounds = _bounds(slim, shards, total["bytes"])
    ends = F.sequence(_shard_of(_prefix(), bounds), _shard_of(F.concat(_prefix(), F.lit("~")), bounds))
    told = _revisits(slim, total["keys"]).select(F.explode(ends).alias("shard"), "page_id", "digest", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), F.lit(0).cast("long").alias("n_bytes"))
    fraction = F.lpad(F.hex(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 32))), 8, "0")
    dealt = rows.select(_shard_of(F.concat("key", fraction), bounds).alias("shard"), "page_id", "digest", F.lit(None).cast("long").alias("first"), "url", F.col("html").cast("binary").alias("html"), "n_bytes")
    order = ["shard", F.col("page_id").asc_nulls_first(), "digest", F.col("html").isNotNull(), F.col("url").asc_nulls_first()]
    both = dealt.unionByName(told).repartitionById(shards, F.col("shard")).sortWithinPartitions(*order)
    attempts = f"{root}/_attempts"
    both.mapInArrow(_writer(f"{attempts}/files", roll_bytes), _FILE).write.json(f"{attempts}/written")

    def commit(batches):
        files, base = _files(root)
        for b in batches:
            found = b.to_pylist()
            for r in found:
                if files.get_file_info(r["path"]).type == pafs.FileType.File:  # else an earlier attempt has moved it
                    files.move(r["path"], f"{base}/{r['name']}")
                elif files.get_file_info(f"{base}/{r['name']}").size != r["bytes"]:
                    raise FileNotFoundError(r["path"])
            yield _batch(found, [n for n in _TYPES if n != "path"])

    spark.read.schema(_FILE).json(f"{attempts}/written").mapInArrow(commit, _NAMED).write.json(f"{root}/manifest")
    files, base = _files(attempts)
    files.delete_dir(base)
    return f"{root}/manifest"


def _members(stream):
    """The decompressed gzip members of a file, one at a time."""
    inflate, held, pending = zlib.decompressobj(31), [], b""
    while data := pending or stream.read(_READ):
        pending = b""
        held.append(inflate.decompress(data))
        if inflate.eof:
            yield b"".join(held)
            pending, inflate, held = inflate.unused_data, zlib.decompressobj(31), []
    if held and any(held):
        raise ValueError("the archive ends inside a record")


def parse(member: bytes) -> dict | None:
    """A record's headers and payload, digests checked; None for warcinfo."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if fields["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    n_bytes = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != n_bytes or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload_bytes": n_bytes, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page"), "payload": payload if kind == "response" else None}


_ROW = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
_ROW_SQL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_warc(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """A row for each record that the manifest's files hold; records and digests are checked while reading. A task reads
    the files of a shard."""
    ship(spark)
    files, base = _files(root)
    if files.get_file_info(f"{base}/manifest/_SUCCESS").type != pafs.FileType.File:
        raise FileNotFoundError(f"{root} has no whole manifest")
    listed = spark.read.schema(_NAMED).json(f"{root}/manifest")
    shards = (listed.agg(F.max("shard").alias("n")).first()["n"] or 0) + 1
    keep = [k for k in _ROW if payloads or k != "payload"]
    schema = ", ".join(x for x in _ROW_SQL.split(", ") if payloads or not x.startswith("payload "))

    def read(batches):
        files, base = _files(root)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows: list[dict] = []
                size = 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        if (r := parse(member)) is not None:
                            rows.append(r)
                            size += len(member) if payloads else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _ROW[k]) for k in keep], keep)
                            rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _ROW[k]) for k in keep], keep)

    return listed.repartitionById(shards, F.col("shard")).select("name").mapInArrow(read, schema)


def archived(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write pages to archives under root (a new folder in the shared one by default), and read them back without payloads."""
    root = root or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, root)
    return read_warc(pages.sparkSession, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
