"""WARC archives, a Zstandard frame for each record, with the dictionary in a leading skippable frame.

Writing: each task makes one archive. Its first frame is skippable and holds the dictionary, then come a frame with the
``warcinfo`` record and one for each page. Frames leave Spark through its text sink, so archives land in any store that
Spark writes to and a lost task leaves nothing behind; the sink's line end is an empty skippable frame, which readers of
Zstandard pass over. Of pages with equal payloads the one with the smallest identifier is the response, the others
revisit it; payloads below ``least`` bytes are always responses. Pages meet their group by digest; those of a digest that
many pages share are dealt out.

Reading: archives come as binary files, one at a time in a task (an archive is no larger than the split that it was
written from). The reader loads the dictionary, walks over the frames by their block headers, decodes one frame for each
record and checks: frame sizes and the dictionary's number, the version line, header lines, the fields that a record must
have, the length of the block and the blank lines behind, the length in the HTTP head and the payload's digest.

Defined results: null html is empty; a null identifier has no field in its record, sorts last and reads back as null; of
rows that repeat an identifier and a payload the first by place is the response; a null url becomes a URN of the record;
control characters in a url are escaped; an empty table gives no archive and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import ARROW_BYTES, Workspace, hot_keys, located, spread_join, trim

#: Pages of fewer bytes are never revisits.
LEAST = 100
#: The dictionary comes from so many pages, of each at most so many bytes; it only changes the size of archives.
SAMPLED, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 1 << 14, 1 << 16
LEVEL = 3
#: Fixed values of the format: marks of a frame, of skippable frames, and of the one that holds the dictionary.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, range(0x184D2A50, 0x184D2A60), 0x184D2A5D
#: An empty skippable frame, all ASCII: what Spark's text sink puts behind each frame.
BETWEEN = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

RECORDS = "archive string, at long, record_id string, record_type string, target_uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, refers_to_record string"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


# -- records ---------------------------------------------------------------------------------------------------------
def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""]
    return b"".join(("\r\n".join(lines).encode(), block, b"\r\n\r\n"))


def page_record(page: dict, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit that names the response and holds its HTTP head only."""
    payload, revisit = page["payload"], page["kind"] == "revisit"
    uri = page["url"] if page["url"] is not None else f"urn:uuid:{page['record']}"
    uri = "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in uri)
    fields = [("WARC-Type", page["kind"]), ("WARC-Record-ID", f"<urn:uuid:{page['record']}>"), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    fields += [("WARC-Payload-Digest", f"sha256:{page['digest']}"), ("Content-Type", "application/http; msgtype=response")]
    if page["page_id"] is not None:
        fields.append(("X-Page-ID", str(page["page_id"])))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{page['first_record']}>")]
        if page["first_id"] is not None:
            fields.append(("X-Refers-To-Page-ID", str(page["first_id"])))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(fields, head if revisit else head + payload)


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"no header line: {line[:60]!r}")
        out[name.decode().strip().lower()] = value.decode().strip()
    return out


def _number(fields: dict[str, str], name: str) -> int:
    value = fields.get(name, "")
    if not (value.isascii() and value.isdigit()):
        raise WarcError(f"{name} is {value!r}")
    return int(value)


def parse_record(raw: bytes) -> dict:
    """Fields of a record and its payload, checked."""
    end = raw.find(b"\r\n\r\n")
    version, *lines = raw[: max(end, 0)].split(b"\r\n")
    if end < 0 or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"no WARC record: {raw[:40]!r}")
    fields = _fields(lines)
    if lost := {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields):
        raise WarcError(f"fields are missing: {sorted(lost)}")
    length, start = _number(fields, "content-length"), end + 4
    if len(raw) != start + length + 4 or not raw.endswith(b"\r\n\r\n"):
        raise WarcError(f"the block has {len(raw) - start - 4} bytes, its header says {length}")
    kind = fields["warc-type"]
    out = {"record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "page_id": None, "refers_to": None, "refers_to_record": None}
    if kind not in ("response", "revisit"):
        return out | {"payload": raw[start : start + length], "payload_bytes": length, "payload_digest": None}
    for name, field in (("page_id", "x-page-id"), ("refers_to", "x-refers-to-page-id")):
        if field in fields:
            out[name] = int(fields[field])
    body = raw.find(b"\r\n\r\n", start, start + length) + 4
    if body < start + 4:
        raise WarcError("no HTTP head")
    said = _number(_fields(raw[start : body - 4].split(b"\r\n")[1:]), "content-length")
    payload = raw[body : start + length]
    label, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if label != "sha256" or len(digest) != 64:
        raise WarcError("no SHA-256 digest of the payload")
    if kind == "response" and (len(payload) != said or hashlib.sha256(payload).hexdigest() != digest):
        raise WarcError(f"the payload of {len(payload)} bytes doesn't fit its length {said} or digest")
    if kind == "revisit":
        if payload or "warc-refers-to" not in fields or fields.get("warc-profile") != PROFILE:
            raise WarcError("a revisit has a payload, or no reference or profile")
        out["refers_to_record"] = fields["warc-refers-to"].strip("<>")
    return out | {"payload": payload, "payload_bytes": said, "payload_digest": digest}


# -- frames ----------------------------------------------------------------------------------------------------------
def _skippable(mark: int, content: bytes) -> bytes:
    return mark.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def frame_end(data: memoryview, at: int) -> tuple[int, int]:
    """(mark, end) of the frame that begins at ``at``, by the sizes of its blocks."""

    def number(place: int, n: int) -> int:
        if place + n > len(data):
            raise WarcError(f"the archive ends inside the frame at {at}")
        return int.from_bytes(data[place : place + n], "little")

    mark = number(at, 4)
    if mark in SKIPPABLE:
        end = at + 8 + number(at + 4, 4)
    elif mark == FRAME:
        flags = number(at + 4, 1)
        single = flags >> 5 & 1
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = 0
        while not last:
            block = number(end, 3)
            last, kind = block & 1, block >> 1 & 3
            if kind == 3:
                raise WarcError(f"a block of no kind in the frame at {at}")
            end += 3 + (1 if kind == 1 else block >> 3)
        end += 4 * (flags >> 2 & 1)
    else:
        raise WarcError(f"no frame at {at}")
    if end > len(data):
        raise WarcError(f"the archive ends inside the frame at {at}")
    return mark, end


def records_of(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, record) of an archive: the leading skippable frame is the dictionary (plain or itself a frame), each other
    frame one record."""
    import zstandard

    data, at = memoryview(content), 0
    decoder, number = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        mark, end = frame_end(data, at)
        if mark == FRAME:
            frame = data[at:end]
            header = zstandard.get_frame_parameters(frame)
            if header.dict_id not in (0, number):
                raise WarcError(f"the frame at {at} needs dictionary {header.dict_id}, the archive has {number}")
            try:
                sized = header.content_size != zstandard.CONTENTSIZE_UNKNOWN
                yield at, decoder.decompress(frame) if sized else decoder.decompressobj().decompress(frame)
            except zstandard.ZstdError as e:
                raise WarcError(f"the frame at {at} can't be decoded: {e}") from e
        elif mark == DICTIONARY and at == 0:
            held = bytes(data[8:end])
            if held[:4] == FRAME.to_bytes(4, "little"):
                held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
            dictionary = zstandard.ZstdCompressionDict(held)
            decoder, number = zstandard.ZstdDecompressor(dict_data=dictionary), dictionary.dict_id()
        at = end


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; their plain content where they are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


# -- tables ----------------------------------------------------------------------------------------------------------
def _payload(html: str) -> Column:
    return F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")


def _uuid(at: str) -> Column:
    """The number of a record: a digest of its place (file and row), as a UUID."""
    digest = F.md5(F.concat_ws(":", f"{at}.file", f"{at}.n").cast("binary"))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def decide(pages: DataFrame, work: Workspace, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) to what their records need: page_id, url, payload, digest, kind, record, first_id,
    first_record."""
    rows = located(pages, work)
    digest = F.sha2(_payload("row.html"), 256).alias("digest")
    sized = work.keep(rows.select("at", F.col("row.page_id").cast("long").alias("page_id"), digest), "digests")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "at")).alias("first")
    groups = work.keep(sized.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")), "groups")
    hot = hot_keys(groups, "digest", "n", sized.count())
    whole = rows.select("at", F.col("row.page_id").cast("long").alias("page_id"), F.col("row.url").cast("string").alias("url"), _payload("row.html").alias("payload"), digest)
    met = spread_join(whole, groups.drop("n"), "digest", hot, F.col("at"))
    again = (F.octet_length("payload") >= least) & (F.col("at") != F.col("first.at"))
    return met.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), _uuid("at").alias("record"), F.col("first.page_id").alias("first_id"), _uuid("first.at").alias("first_record"))


def write_archives(decided: DataFrame, samples: list[bytes], folder: str, date: str = DATE) -> None:
    """Archives of the rows of ``decide`` below ``folder``, one a task."""
    dictionary = train_dictionary(samples)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary)
        encoder = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        opened = False
        for batch in batches:
            frames = []
            if len(batch) and not opened:
                opened = True
                number = uuid.uuid5(uuid.NAMESPACE_OID, batch.column("record")[0].as_py())
                about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{number}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
                frames = [_skippable(DICTIONARY, dictionary), encoder.compress(_record(about, b"format: WARC File Format 1.1\r\n"))]
            frames += [encoder.compress(page_record(page, date)) for page in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])
        trim()

    # The cast keeps the bytes as they are.
    framed = decided.mapInArrow(each, "frame binary").select(F.col("frame").cast("string"))
    framed.write.option("lineSep", BETWEEN).text(folder)


def read_archives(spark: SparkSession, folder: str, pattern: str = "part-*", payloads: bool = False) -> DataFrame:
    """A row a response or revisit; what breaks the format raises. ``payloads`` adds the payload (empty for revisits)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    names = [x.strip().split()[0] for x in RECORDS.split(",")]
    schema = RECORDS + (", payload binary" if payloads else "")
    kinds = [pa.int64() if " long" in x else pa.binary() if "binary" in x else pa.string() for x in schema.split(",")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*names, "payload"][: len(kinds)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, held, archive = [], 0, path.as_py()
                for at, raw in records_of(content.as_py()):
                    try:
                        record = parse_record(raw)
                    except WarcError as e:
                        raise WarcError(f"{archive} at {at}: {e}") from e
                    if record["record_type"] not in ("response", "revisit"):
                        continue
                    record |= {"archive": archive, "at": at}
                    rows.append(tuple(record[c] for c in [*names, "payload"][: len(kinds)]))
                    held += len(record["payload"]) if payloads else 200
                    if held > ARROW_BYTES:
                        yield packed(rows)
                        rows, held = [], 0
                yield packed(rows)
        trim()

    return files.mapInArrow(each, schema)


def resolved(records: DataFrame, work: Workspace) -> DataFrame:
    """Rows of ``read_archives(payloads=True)`` with the payloads of revisits from the responses that they name; null where
    no such response is there. A response that many revisits name is repeated and they are dealt out."""
    kept = work.keep(records, "records")
    named = F.coalesce("refers_to_record", "record_id")
    counts = kept.groupBy(named.alias("named")).agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, "named", "n", kept.count())
    whole = kept.where("record_type = 'response'").select(F.col("record_id").alias("named"), F.col("payload").alias("whole"))
    found = spread_join(kept.withColumn("named", named), whole, "named", hot, F.col("record_id"))
    lost = kept.withColumn("named", named).join(whole.select("named"), "named", "left_anti").withColumn("whole", F.lit(None).cast("binary"))
    return found.unionByName(lost).withColumn("payload", F.col("whole")).drop("whole", "named")


def archive_pages(pages: DataFrame, work: Workspace, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Write ``pages`` as archives and return their records as read back."""
    folder = folder or work.sub("archives")
    sampled = pages.where(F.octet_length(_payload("html")) > 0).limit(SAMPLED).select(F.substring(_payload("html"), 1, SAMPLE_BYTES).alias("p"))
    write_archives(decide(pages, work, least), [bytes(r["p"]) for r in sampled.collect()], folder)
    return read_archives(work.spark, folder)
