"""A deterministic sharded WARC writer and its reader."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import range_parts, stored

#: Payloads below so many bytes are never revisits.
LEAST_REVISIT = 100
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _head(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _record_id(name: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'urn:page:{name}')}>"


def _uri(url: str | None, page: object) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record with headers and digests made anew; a revisit has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page if page is not None else digest)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url, page))]
    if page is not None:
        fields.append(("Page-ID", str(page)))
    if refers_to is not None:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _record_id(refers_to)), ("Refers-To-Page-ID", str(refers_to))]
    fields += [
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return _head(fields) + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    body = b"software: marketspark\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]
    return _head(fields) + body + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class _Roller:
    """Writes records of one shard under temporary names, a new file once ``roll`` compressed bytes are reached."""

    def __init__(self, root: str, shard: int, roll: int, date: str) -> None:
        self.files, self.path = _place(root)
        self.shard, self.roll, self.date = shard, roll, date
        self.attempt, self.nth, self.out = uuid.uuid4().hex, 0, None

    def add(self, page: int | None, data: bytes) -> dict | None:
        """The finished file's manifest row, if the record completes one."""
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.nth:05d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}-{self.name}"
            self.files.create_dir(f"{self.path}/_temporary", recursive=True)
            self.out = self.files.open_output_stream(f"{self.path}/{self.temporary}", compression=None)
            self.size, self.records, self.first, self.sha = 0, 0, page, hashlib.sha256()
            self._put(_info(self.name, self.date))
        self._put(data)
        self.records, self.last = self.records + 1, page
        return self.close() if self.size >= self.roll else None

    def _put(self, data: bytes) -> None:
        packed = _member(data)
        self.out.write(packed)
        self.sha.update(packed)
        self.size += len(packed)

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out, self.nth = None, self.nth + 1
        return {"name": self.name, "temporary": self.temporary, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest(), "first_id": self.first, "last_id": self.last}


_MANIFEST = "name string, temporary string, records long, bytes long, sha256 string, first_id long, last_id long"
_MANIFEST_ARROW = pa.schema([("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the rows whose payload an earlier page holds; only repeated digests are joined."""
    marks = pages.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").alias("n")).filter(F.col("n") >= LEAST_REVISIT)
    many = marks.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 AND refers_to IS NOT NULL").drop("n")
    return marks.join(many, "digest").filter("page_id IS NULL OR page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, root: str, roll: int = 64 << 20, shards: int | None = None, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row as gzipped WARC files under ``root``; returns the manifest.

    Rows are range-sorted by id into shards (null ids last), so the same rows and shard number give the same
    files byte for byte. Each task writes under names of its own attempt; only files in the manifest of
    successful tasks are renamed to their final names, by a second job that may be repeated; it is an error if a file
    is then missing or of another size. Pages without an id are dealt by their payload, all others by id. Equal payloads
    of 100 bytes or more: the smallest id is a response, larger ids revisit it; rows that share the smallest
    id are all responses. Null payloads are empty; a null id makes a record without page number.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    count = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), pages.rdd.getNumPartitions())
    none = F.lit(None).cast("string")
    tie = lambda digest: F.when(F.col("page_id").isNull(), F.xxhash64(digest)).otherwise(0).alias("tie")
    rows = rows.select("*", tie(F.sha2(F.col("html").cast("binary"), 256)))
    both = revisits(rows).select("page_id", F.lit(0).alias("kind"), none.alias("url"), F.col("digest").alias("body"), "refers_to", tie(F.col("digest")))
    both = both.unionAll(rows.select("page_id", F.lit(1).alias("kind"), "url", F.col("html").alias("body"), F.lit(None).cast("long").alias("refers_to"), "tie"))
    dealt = range_parts(both, count, "page_id", F.col("tie"), like=rows).withColumnRenamed("part", "shard")
    ranged = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "tie", "kind", F.xxhash64("body"), "body", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, known, page, at = None, {}, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if roller and roller.shard != row["shard"] and (done := roller.close()):
                    yield pa.RecordBatch.from_pylist([done], _MANIFEST_ARROW)
                if roller is None or roller.shard != row["shard"]:
                    roller = _Roller(root, row["shard"], roll, date)
                if (row["page_id"], row["tie"]) != (page, at):
                    known, page, at = {}, row["page_id"], row["tie"]
                if row["kind"] == 0:
                    known[row["body"]] = row["refers_to"]
                    continue
                payload = row["body"].encode()
                digest = hashlib.sha256(payload).hexdigest()
                if done := roller.add(page, record(page, row["url"], payload, digest, known.get(digest), date)):
                    yield pa.RecordBatch.from_pylist([done], _MANIFEST_ARROW)
        if roller and (done := roller.close()):
            yield pa.RecordBatch.from_pylist([done], _MANIFEST_ARROW)

    manifest = stored(ranged.select("shard", "page_id", "tie", "kind", "url", "body", "refers_to").mapInArrow(run, _MANIFEST), "warc-manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _place(root)
        for batch in batches:
            for row in batch.to_pylist():
                final, temporary = f"{path}/{row['name']}", f"{path}/{row['temporary']}"
                if files.get_file_info(temporary).type != fs.FileType.NotFound:
                    files.move(temporary, final)
                there = files.get_file_info(final)
                if there.type != fs.FileType.File or there.size != row["bytes"]:
                    raise ValueError(f"{row['name']} of the manifest is not there as it was written")
            yield batch

    return stored(manifest.repartition("name").mapInArrow(commit, _MANIFEST).drop("temporary"), "warc-committed")


class _Checked:
    """An open file that knows how much was read from it, and its digest."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source, self.size, self.sha = source, 0, hashlib.sha256()

    def read(self, size: int) -> bytes:
        data = self.source.read(size)
        self.size += len(data)
        self.sha.update(data)
        return data


def _records(source: _Checked) -> Iterator[bytes]:
    """The gzip members of an open file, one at a time."""
    press, parts, chunk = zlib.decompressobj(31), [], b""
    while chunk or (chunk := source.read(1 << 16)):
        parts.append(press.decompress(chunk))
        chunk = press.unused_data
        if press.eof:
            yield b"".join(parts)
            press, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> dict | None:
    """What a page's record says; digests are checked. None for other records."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = {k: int(fields[k]) if k in fields else None for k in ("Page-ID", "Refers-To-Page-ID")}
    return {"page_id": number["Page-ID"], "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number["Refers-To-Page-ID"], "payload": payload if fields["WARC-Type"] == "response" else None}


def read(manifest: DataFrame, root: str, payload: bool = False) -> DataFrame:
    """The page records of a manifest's files, one task per file or several; with their bytes if asked.

    A file that is missing, or whose bytes, digest or number of records are not those of the manifest, is an error.
    """
    schema = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema([*schema, ("payload", pa.binary())] if payload else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _place(root)
        for batch in batches:
            for wanted in batch.to_pylist():
                rows, size, count = [], 0, 0
                with files.open_input_stream(f"{path}/{wanted['name']}", compression=None) as file:
                    source = _Checked(file)
                    for data in _records(source):
                        if row := parse(data):
                            count += 1
                            if not payload:
                                row.pop("payload")
                            rows.append(row)
                            size += len(data) if payload else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if (count, source.size, source.sha.hexdigest()) != (wanted["records"], wanted["bytes"], wanted["sha256"]):
                    raise ValueError(f"{wanted['name']} is not the file of the manifest")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    return manifest.select("name", "records", "bytes", "sha256").repartition("name").mapInArrow(run, ddl)
