"""Deterministic sharded WARC archives: writer and reader.

Records are sorted by (page_id, payload digest) into shards whose bounds
depend on the data alone: a histogram of record sizes over the keys, refined
where a bin is too heavy, is cut into pieces of about ``shard_bytes``. One
task streams the sorted records of a shard into files, one gzip member per
record, and starts a new file when the compressed size passes
``roll_bytes``. Headers, record ids, block and payload digests are made
anew from the content, so that the same pages give the same files, bytes
and names, however they were partitioned.

Commit: every task attempt writes under a temporary name of its own; the
manifest lists the files of the attempts that Spark committed. They are
then moved to their final names (a move that was already made is skipped)
and, last, the manifest itself is moved into place. Readers follow the
manifest, so a writer that died leaves no archive rather than half of one.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.frames import batch, delete, stored, with_fallback

# Smaller payloads are never revisited: the revisit record would not be shorter.
LEAST_REVISIT = 100
SHARD_BYTES, ROLL_BYTES = 48 << 20, 16 << 20
# Tasks of the writer and the reader at most (shards and files are dealt over them).
MOST_TASKS = 20_000
# Bins of the first histogram and of each bin that is refined.
BINS, FINER = 1 << 14, 256
# What a record's headers add to its payload, about.
HEADER_BYTES = 600
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LARGEST = 2 ** 63 - 1

BIN = pa.schema([("item", pa.int64()), ("bin", pa.int64()), ("weight", pa.int64())])
FILE = pa.schema([("name", pa.string()), ("temporary", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])
RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary())])


# --- shards -------------------------------------------------------------------

@dataclass
class Bounds:
    """First keys (page_id, leading digest bits) of all shards, ascending."""
    page: np.ndarray
    bits: np.ndarray

    def shard(self, page: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Shard of each key: the last whose first key is not larger."""
        low, high = np.searchsorted(self.page, page, "left"), np.searchsorted(self.page, page, "right")
        out = high - 1
        split = low < high  # some shard starts inside this page_id
        for p in np.unique(page[split]):
            at = np.flatnonzero(page == p)
            first, last = low[at[0]], high[at[0]]
            out[at] = first + np.searchsorted(self.bits[first:last], bits[at], "right") - 1
        return np.maximum(out, 0)


def binned(keys: DataFrame, column: str, ranges: list[tuple], bins: int) -> dict[tuple[int, int], int]:
    """Weight per (number of the range, bin) of the rows (page, bits, weight)
    in ``ranges`` of ``column``: disjoint, ascending (low, high, page or
    None). The weights are added up in each task first."""
    low, high = (np.array([r[k] for r in ranges], np.int64) for k in (0, 1))
    pages = None if column == "page" else np.array([r[2] for r in ranges], np.int64)
    starts = Bounds(low, np.zeros(len(low), np.int64)) if pages is None else Bounds(pages, low)
    step = steps(low, high, bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            page, bits, weight = (b.column(c).to_numpy() for c in ("page", "bits", "weight"))
            x, at = page if pages is None else bits, starts.shard(page, bits)
            inside = (low[at] <= x) & (x <= high[at])
            if pages is not None:
                inside &= pages[at] == page
            at, x, weight = at[inside], x[inside], weight[inside]
            cell = at * bins + ((x.astype(np.uint64) - low[at].astype(np.uint64)) // step[at]).astype(np.int64)
            cells, place = np.unique(cell, return_inverse=True)
            for c, w in zip(cells.tolist(), np.bincount(place, weight).tolist()):
                total[c] = total.get(c, 0) + int(w)
        cell = np.array(list(total), np.int64)
        yield batch(BIN, item=cell // bins, bin=cell % bins, weight=list(total.values()))

    found = keys.mapInArrow(run, "item bigint, bin bigint, weight bigint").groupBy("item", "bin").agg(F.sum("weight").alias("weight"))
    return {(r["item"], r["bin"]): r["weight"] for r in found.collect()}


def steps(low: np.ndarray, high: np.ndarray, bins: int) -> np.ndarray:
    """Width of the bins of each range (unsigned: a range may span all integers)."""
    return (high.astype(np.uint64) - low.astype(np.uint64)) // np.uint64(bins) + np.uint64(1)


def shard_bounds(keys: DataFrame, shard_bytes: int) -> Bounds:
    """Bounds of shards of about ``shard_bytes`` over ``keys`` (page, bits,
    weight). Bins heavier than that are refined, by page_id and, inside one
    page_id, by the digest; the driver holds at most a bin per piece of the
    data of that size, and FINER or BINS for those being refined."""
    ends = keys.agg(F.min("page").alias("low"), F.max("page").alias("high")).first()
    pieces: list[tuple[int, int, int]] = []  # first page, first bits, weight
    for column in ("page", "bits"):
        if column == "page":
            todo, bins, single = [] if ends["low"] is None else [(ends["low"], ends["high"], None)], BINS, []
        else:
            todo, bins = [(0, 2 ** 32 - 1, p) for p in sorted(single)], FINER
        while todo:
            found, following = binned(keys, column, todo, bins), []
            step = steps(*(np.array([r[k] for r in todo], np.int64) for k in (0, 1)), bins)
            for (item, place), weight in sorted(found.items()):
                low = todo[item][0] + place * int(step[item])
                high = min(todo[item][1], low + int(step[item]) - 1)
                page = todo[item][2]
                if weight <= shard_bytes or (low == high and page is not None):
                    pieces.append((low, 0, weight) if page is None else (page, low, weight))
                elif low == high:
                    single.append(low)
                else:
                    following.append((low, high, page))
            todo, bins = following, FINER
    first, held = [], 0
    for page, bits, weight in sorted(pieces):
        if not first or held + weight > shard_bytes:
            first.append((page, bits))
            held = 0
        held += weight
    first = first or [(0, 0)]
    return Bounds(np.array([p for p, _ in first], np.int64), np.array([b for _, b in first], np.int64))


# --- records ------------------------------------------------------------------

def urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('|'.join(parts).encode()).digest()[:16], version=4)}>"


def header_value(text: str) -> str:
    """One header line's worth: blanks and control characters are escaped."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in text)


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as one gzip member (no time stamp: equal content, equal bytes)."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def response_id(digest: str) -> str:
    """Id of the one response that holds a payload others may refer to."""
    return urn("response", digest)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, own_id: str, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", date), ("Content-Type", "application/http;msgtype=response"),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if url:
        fields.append(("WARC-Target-URI", header_value(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", response_id(digest))]
    return member(fields, block)


# --- files --------------------------------------------------------------------

def uri_of(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as executors name it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


def file_system(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


class Roll:
    """Files of one shard under temporary names; a new one when the current
    one's compressed size has passed ``roll_bytes``."""

    def __init__(self, uri: str, attempt: str, shard: int, roll_bytes: int, date: str):
        self.fs, self.base = file_system(uri)
        self.attempt, self.shard, self.roll_bytes, self.date = attempt, shard, roll_bytes, date
        self.number, self.out, self.done = 0, None, []

    def open(self) -> None:
        self.name = f"shard-{self.shard:07d}-{self.number:05d}.warc.gz"
        self.temporary = f"_temporary/{self.attempt}/{self.name}"
        self.fs.create_dir(f"{self.base}/_temporary/{self.attempt}", recursive=True)
        self.out = self.fs.open_output_stream(f"{self.base}/{self.temporary}", compression=None)
        self.size, self.records, self.digest = 0, 0, hashlib.sha256()
        about = b"software: riskweave\r\nformat: WARC File Format 1.1\r\n"
        self.put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", urn("warcinfo", self.name)), ("WARC-Date", self.date),
                         ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], about))

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)

    def add(self, make) -> None:
        """Write ``make(id of a record at this place)``."""
        if self.out is None:
            self.open()
        self.put(make(urn(self.name, str(self.records))))
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.temporary, self.size, self.records, self.digest.hexdigest()))
            self.out, self.number = None, self.number + 1


def write_archive(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
                  least_revisit: int = LEAST_REVISIT, date: str = DATE) -> str:
    """Write one record per row of ``pages`` (page_id, url, html) to a new
    archive at ``path``; returns the path.

    The payload is the html in UTF-8, null as empty. Of records whose
    payloads are equal (by SHA-256) and of at least ``least_revisit`` bytes,
    that with the smallest page_id is a response and the others revisit it;
    shorter ones are all responses. A null page_id is larger than any; of
    rows that repeat page_id and payload the first in the order of urls
    (null first) counts as the smaller. Rows of one page_id and payload are
    streamed by one task: after the first they are short revisits. A null or
    empty url gives no target URI. No rows give an archive without files.
    An archive that is already at ``path`` raises.
    """
    spark = pages.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        raise ValueError(f"there is an archive at {path}")
    uri = uri_of(spark, path)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = with_fallback(pages, page_id="bigint", url="string", html="string").select(
        "page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    page = F.coalesce("page_id", F.lit(LARGEST))
    bits = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint")
    size = F.octet_length("payload").cast("bigint")
    keys, keys_path = stored(rows.select(page.alias("page"), "page_id", "digest", bits.alias("bits"), (size + HEADER_BYTES).alias("weight")), "warc-keys")
    bounds = shard_bounds(keys, shard_bytes)
    shards = len(bounds.page)
    tasks = min(shards, MOST_TASKS)

    @F.pandas_udf("bigint")
    def shard_of(page: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series(bounds.shard(page.to_numpy(), bits.to_numpy()))

    # Which (page_id, digest) revisit: decided on keys alone, so that payloads move once, with the sort.
    long = keys.where(F.col("weight") >= least_revisit + HEADER_BYTES)
    shared = long.groupBy("digest").agg(F.min("page").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    marks = long.select("page", "bits", "digest").distinct().join(shared, "digest").where("page <> keeper").select(
        "page", "bits", "digest", F.lit(None).cast("bigint").alias("page_id"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("binary").alias("payload"), F.lit(True).alias("mark"))
    records = rows.select(page.alias("page"), bits.alias("bits"), "digest", "page_id", "url", "payload", F.lit(False).alias("mark"))
    both = records.unionByName(marks).withColumn("shard", shard_of("page", "bits"))
    dealt = both.repartitionById(tasks, (F.col("shard") * tasks / shards).cast("int") if shards > tasks else F.col("shard").cast("int"))
    ordered = dealt.sortWithinPartitions("shard", "page", "digest", F.desc("mark"), F.col("url").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, roll, last, revisit = uuid.uuid4().hex, None, None, False
        for b in batches:
            get = [b.column(c) for c in ("shard", "page", "digest", "page_id", "url", "payload", "mark")]
            for i in range(b.num_rows):
                shard, page, digest, page_id, url, payload, mark = (c[i].as_py() for c in get)
                if roll is None or roll.shard != shard:
                    if roll is not None:
                        roll.close()
                        yield from listed(roll)
                    roll = Roll(uri, attempt, shard, roll_bytes, date)
                if mark:
                    last, revisit = (page, digest), True
                    continue
                revisit = revisit if last == (page, digest) else False
                kind = "revisit" if revisit else "response"
                known = len(payload) >= least_revisit
                roll.add(lambda own: record(page_id, url, payload, digest, kind, response_id(digest) if known and not revisit else own, date))
                last, revisit = (page, digest), known
        if roll is not None:
            roll.close()
            yield from listed(roll)

    manifest, manifest_path = stored(ordered.mapInArrow(run, "name string, temporary string, bytes bigint, records bigint, sha256 string"), "warc-manifest")
    commit(manifest, uri, path)
    delete(spark, keys_path)
    delete(spark, manifest_path)
    return path


def listed(roll: Roll) -> Iterator[pa.RecordBatch]:
    if roll.done:
        yield batch(FILE, **dict(zip(FILE.names, map(list, zip(*roll.done)))))


def commit(manifest: DataFrame, uri: str, path: str) -> None:
    """Move the listed files to their names, then the manifest into place."""
    spark = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        files, base = file_system(uri)
        for b in batches:
            for name, temporary, size in zip(*(b.column(c).to_pylist() for c in ("name", "temporary", "bytes"))):
                there = files.get_file_info(f"{base}/{name}")
                if there.type == fs.FileType.NotFound:
                    files.move(f"{base}/{temporary}", f"{base}/{name}")
                elif there.size != size:
                    raise ValueError(f"{name} is there with another size")
            yield b

    moved = manifest.mapInArrow(run, manifest.schema).select("name", "bytes", "records", "sha256")
    moved.write.mode("overwrite").parquet(f"{path}/_manifest")
    jvm = spark._jvm.org.apache.hadoop.fs
    target = jvm.Path(f"{path}/manifest")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.rename(jvm.Path(f"{path}/_manifest"), target):
        raise OSError(f"could not move the manifest of {path} into place")
    delete(spark, f"{path}/_temporary")


# --- reading ------------------------------------------------------------------

def members(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    left = b""
    while True:
        data = left or stream.read(chunk)
        if not data:
            return
        z, out = zlib.decompressobj(31), []
        while True:
            out.append(z.decompress(data))
            if z.eof:
                break
            data = stream.read(chunk)
            if not data:
                raise ValueError("the file ends inside a record")
        left = z.unused_data
        yield b"".join(out)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a record; the digests it states are checked."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = data[end + 4:end + 4 + int(fields["Content-Length"])]
    if data[end + 4 + len(block):] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError(f"wrong length of {fields['WARC-Record-ID']}")
    stated = fields.get("WARC-Block-Digest")
    if stated and stated != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"wrong block digest of {fields['WARC-Record-ID']}")
    return fields, block


def page_record(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    end = block.index(b"\r\n\r\n") + 4
    http = dict(line.split(": ", 1) for line in block[:end - 4].decode().split("\r\n")[1:])
    payload, size = block[end:], int(http["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"wrong payload of {fields['WARC-Record-ID']}")
    page = fields.get("X-Page-ID")
    return (fields["WARC-Record-ID"], fields["WARC-Type"], None if page is None else int(page), fields.get("WARC-Target-URI"), size, digest,
            fields.get("WARC-Refers-To"), payload if with_payload and fields["WARC-Type"] == "response" else None)


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per response and revisit record of the archive at ``path``:
    record_id, record_type, page_id, target_uri, payload_bytes and
    payload_digest (of the full payload), refers_to_id, payload (null for
    revisits). The files of the manifest are read, and their sizes and
    all digests checked; an archive without a manifest raises."""
    manifest = spark.read.parquet(f"{path}/manifest")
    uri, tasks = uri_of(spark, path), max(1, min(MOST_TASKS, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(uri)
        for b in batches:
            for name, size in zip(b.column("name").to_pylist(), b.column("bytes").to_pylist()):
                if files.get_file_info(f"{base}/{name}").size != size:
                    raise ValueError(f"{name} has another size than the manifest says")
                rows, held = [], 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for data in members(stream):
                        fields, block = parsed(data)
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        rows.append(page_record(fields, block, with_payload))
                        held += len(block) if with_payload else 0
                        if len(rows) >= 1000 or held >= 4 << 20:
                            yield batch(RECORD, **dict(zip(RECORD.names, map(list, zip(*rows)))))
                            rows, held = [], 0
                if rows:
                    yield batch(RECORD, **dict(zip(RECORD.names, map(list, zip(*rows)))))

    return manifest.select("name", "bytes").repartition(tasks).mapInArrow(
        run, "record_id string, record_type string, page_id bigint, target_uri string, payload_bytes bigint, payload_digest string, "
             "refers_to_id string, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``, the page_id of the response that a
    revisit refers to (null for responses)."""
    targets = records.where("record_type = 'response'").select(F.col("record_id").alias("target_id"), F.col("page_id").alias("target_page"))
    revisits = records.where("record_type = 'revisit'")
    used = revisits.select(F.col("refers_to_id").alias("target_id")).distinct()
    found = revisits.join(targets.join(used, "target_id"), F.col("refers_to_id") == F.col("target_id"), "left")
    return (records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("bigint"))
            .unionByName(found.withColumn("refers_to", F.col("target_page")).drop("target_id", "target_page")))
