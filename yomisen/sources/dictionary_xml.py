"""Dictionary XML (entries with kanji forms, readings and senses) as DataFrames."""

from __future__ import annotations

import gzip
import io
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Priority markers that make a form common.
PRIORITY = ("news1", "ichi1", "spec1", "spec2", "gai1")
ENTRY_SCHEMA = (
    "ent_seq STRING, k_ele ARRAY<STRUCT<keb: STRING, ke_pri: ARRAY<STRING>>>, r_ele ARRAY<STRUCT<reb: STRING, re_pri: ARRAY<STRING>>>, "
    "sense ARRAY<STRUCT<pos: ARRAY<STRING>, gloss: ARRAY<STRING>, xref: ARRAY<STRING>, misc: ARRAY<STRING>, s_inf: ARRAY<STRING>>>"
)
#: A reference to an entity that XML itself doesn't define.
NAMED_ENTITY = r"&(?!amp;|lt;|gt;|quot;|apos;|#)([\w.-]+);"
#: Such a reference must be all of an element's text.
EMBEDDED_ENTITY = rf"(?:>\s*[^<>&\s][^<>]*{NAMED_ENTITY})|(?:{NAMED_ENTITY}[^<>]*[^<>\s][^<>]*<)"


class NotADictionary(ValueError):
    """The file is neither gzip nor dictionary XML."""


def sniff(head: bytes) -> str:
    """``gzip`` or ``xml`` by the first bytes; a byte order mark and white space may come first."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    rest = head.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n\x0c")
    if rest.startswith((b"<?xml", b"<!DOCTYPE JMdict", b"<JMdict")):
        return "xml"
    raise NotADictionary("neither gzip nor dictionary XML")


def is_dictionary_xml(content: Column) -> Column:
    """The same test on a column of file heads as text."""
    return F.ltrim(F.regexp_replace(content, "^\\x{FEFF}", "")).rlike(r"^\s*(?:<\?xml|<!DOCTYPE JMdict|<JMdict)")


#: Names under which a dictionary may lie in a folder, in order.
FILE_NAMES = ("JMdict_e.gz", "JMdict_e.xml", "JMdict_e", "JMdict.gz", "JMdict.xml")
#: Largest archive that is taken, and seconds that a download may take.
MOST_BYTES, MOST_SECONDS = 32 << 20, 120


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def head_of(spark: SparkSession, path: str, size: int = 512) -> bytes:
    """The first bytes of a file in any store."""
    row = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, size).alias("head")).first()
    return bytes(row["head"]) if row else b""


def resolve(spark: SparkSession, folder: str, names: tuple[str, ...] = FILE_NAMES, download: Callable[[], str] | None = None) -> str:
    """The first of the known file names that lies in a folder of any store; else what ``download`` gives, if that is allowed."""
    files, path = _files(spark, folder)
    for name in names:
        if files.exists(path(f"{folder}/{name}")):
            return f"{folder}/{name}"
    if download is not None:
        return download()
    raise FileNotFoundError(f"no dictionary in {folder}; looked for {', '.join(names)}")


def fetch(
    spark: SparkSession, opener: Callable[[], BinaryIO], target: str, tries: int = 3, most_bytes: int = MOST_BYTES, most_seconds: float = MOST_SECONDS, pause: float = 1.0
) -> str:
    """Copies a gzip archive from ``opener()`` to a store, reads it to its end, and only then publishes it by a rename.

    An archive that is too large, or isn't a dictionary, is an error at once; a
    broken or slow transfer is tried again, after a pause that doubles.
    """
    files, path = _files(spark, target)
    part = path(f"{target}.partial-{uuid.uuid4().hex}")
    for attempt in range(tries):
        try:
            data = _transfer(opener, most_bytes, most_seconds)
            break
        except (OSError, EOFError, zlib.error):
            if attempt == tries - 1:
                raise
            time.sleep(pause * 2**attempt)
    out = files.create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if files.exists(path(target)):
        files.delete(path(target), False)
    if not files.rename(part, path(target)):
        raise OSError(f"{target} can't be published")
    return target


def _transfer(opener: Callable[[], BinaryIO], most_bytes: int, most_seconds: float) -> bytes:
    """The whole archive, held against its own checksum and the test of its head."""
    began, blocks, size = time.monotonic(), [], 0
    with opener() as source:
        while block := source.read(1 << 16):
            size += len(block)
            if size > most_bytes:
                raise NotADictionary(f"the archive has over {most_bytes} bytes")
            if time.monotonic() - began > most_seconds:
                raise TimeoutError(f"no archive in {most_seconds} seconds")
            blocks.append(block)
    data = b"".join(blocks)
    if sniff(data[:512]) == "gzip":
        with gzip.open(io.BytesIO(data)) as file:
            if sniff(file.read(512)) != "xml":
                raise NotADictionary("the archive holds no dictionary XML")
            while file.read(1 << 20):
                pass
    return data


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, ent_seq, k_ele, r_ele, sense)`` of each entry of a dictionary file, split at entry ends.

    Named entities keep their names.  One that stands within other text is an
    error, and so are an entry that isn't well-formed and a file that is neither
    gzip nor dictionary XML by its first bytes, whatever its name; a gzip file
    without the extension is unpacked by its content.  seq keeps the order of
    entries in a file.
    """
    if sniff(head_of(spark, path)) == "gzip" and not path.endswith(".gz"):
        content = F.decode(F.col("content"), "utf-8")

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("content").to_pylist():
                    parts = gzip.decompress(data).split(b"</entry>")
                    for at in range(0, len(parts), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(parts[at : at + 10_000], pa.binary())], names=["content"])

        rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpacked, "content binary")
        return entries_of_text(rows.select(content.alias("value")))
    return entries_of_text(spark.read.option("lineSep", "</entry>").text(path))


def entries_of_text(lines: DataFrame) -> DataFrame:
    """The same from rows ``value`` that end before ``</entry>``."""
    begun = lines.where(F.col("value").contains("<entry>")).select(
        F.monotonically_increasing_id().alias("seq"),
        F.concat(F.regexp_extract("value", r"(?s)(<entry>.*)$", 1), F.lit("</entry>")).alias("xml"),
    )
    unknown = F.regexp_extract("xml", EMBEDDED_ENTITY, 0)
    checked = F.when(F.col("xml").rlike(EMBEDDED_ENTITY), F.raise_error(F.concat(F.lit("unknown entity in text: "), unknown)).cast("string"))
    bare = F.regexp_replace(F.coalesce(checked, F.col("xml")), NAMED_ENTITY, "$1")
    parsed = begun.select("seq", F.from_xml(bare, ENTRY_SCHEMA, {"mode": "FAILFAST", "ignoreSurroundingSpaces": "true"}).alias("e"))
    return parsed.select("seq", "e.*")


def count_skipped(raw: DataFrame) -> Column:
    """An aggregate: entries whose number isn't one."""
    return F.count_if(F.expr("try_cast(trim(ent_seq) AS BIGINT)").isNull())


def raw_entries(parsed: DataFrame) -> DataFrame:
    """``(seq, id, kanji, readings, senses)``; entries without a number are left out (count them with :func:`count_skipped`)."""
    number = F.expr("try_cast(trim(ent_seq) AS BIGINT)")

    def priority(codes: Column) -> Column:
        return F.exists(F.coalesce(codes, F.array().cast("array<string>")), lambda p: F.trim(p).isin(*PRIORITY))

    def forms(column: str, text: str, codes: str) -> Column:
        made = F.transform(F.col(column), lambda x: F.struct(F.trim(x[text]).alias("text"), priority(x[codes]).alias("has_priority")))
        return F.coalesce(made, F.array().cast("array<struct<text:string,has_priority:boolean>>"))

    def texts(x: Column) -> Column:
        return F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda t: F.trim(t))

    senses = F.transform(
        F.coalesce(F.col("sense"), F.array().cast("array<struct<pos:array<string>,gloss:array<string>,xref:array<string>,misc:array<string>,s_inf:array<string>>>")),
        lambda s: F.struct(
            texts(s["pos"]).alias("pos"), texts(s["gloss"]).alias("glosses"), texts(s["xref"]).alias("xrefs"), texts(s["misc"]).alias("misc"), texts(s["s_inf"]).alias("info")
        ),
    )
    return parsed.where(number.isNotNull()).select(
        "seq", number.alias("id"), forms("k_ele", "keb", "ke_pri").alias("kanji"), forms("r_ele", "reb", "re_pri").alias("readings"), senses.alias("senses")
    )
