"""Files in strands and back: headers with digests, data behind an outer and an inner code, one pool of reads a file.

A file is written as two kinds of strands, told apart by a barcode in front of
every index: its header (version, size, MD5, name, format and the parameters that
reading needs) and its data.  Reading finds the header first and lets it decide
how the data is read; a file is sound if its digest says so.  Every step is a
join, a grouping or a map over strands, for any number of files at once.
"""

from __future__ import annotations

import json
import struct
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import convert as C
from ..sources import dna as D
from . import codes as K
from . import outer as O
from . import packets as P
from .aggregate import majority_vote
from .pipeline import FORMATS, Pipeline, hedges_line, rs_base4

# Barcodes of headers and data, the version of the header's layout.
HEADER_BARCODE, DATA_BARCODE = 0xEE, 0xCC
VERSION = (0, 5)
#: Bytes before a strand's data: barcode, packet (two), sub-packet, slot.
INDEX = 5


@dataclass(frozen=True)
class Header:
    """What a file's strands say about it."""

    size: int
    md5: str
    filename: str = ""
    format_id: int = 0x0704
    barcode: int = DATA_BARCODE
    params: dict = field(default_factory=dict)
    version: tuple[int, int] = VERSION

    def to_bytes(self) -> bytes:
        """Version, size, digest, format and barcode, then name and parameters with their lengths."""
        name, params = self.filename.encode(), json.dumps(self.params, sort_keys=True, separators=(",", ":")).encode()
        return struct.pack("<BHQ16sHBHH", *self.version, self.size, bytes.fromhex(self.md5), self.format_id, self.barcode, len(name), len(params)) + name + params

    @classmethod
    def from_bytes(cls, data: bytes) -> Header:
        major, minor, size, md5, format_id, barcode, a, b = struct.unpack_from("<BHQ16sHBHH", data)
        if (major, minor) > VERSION:
            raise ValueError(f"a header of version {major}.{minor} is newer than {VERSION[0]}.{VERSION[1]}")
        at = struct.calcsize("<BHQ16sHBHH")
        if format_id not in FORMATS or at + a + b > len(data):
            raise ValueError("not a header")
        return cls(size, md5.hex(), data[at : at + a].decode(), format_id, barcode, json.loads(data[at + a : at + a + b] or b"{}"), (major, minor))


@dataclass(frozen=True)
class Design:
    """How files become strands: layout of packets, parity, and the inner code."""

    layout: O.Layout = O.Layout(packet_bytes=600, strand_bytes=15, data=10, parity=4)
    #: Headers have a layout of their own, the same for all designs of a format, so that they can be read first.
    header_layout: O.Layout = O.Layout(packet_bytes=120, strand_bytes=15, data=4, parity=4)
    format_id: int = 0x0704
    primer5: str = "TAAAGGAAAAAGCCTTCGAT"
    primer3: str = "CAAAATATAAAACGTTACCG"
    inner_ecc: int = 4

    def line(self) -> Pipeline:
        if FORMATS[self.format_id] == "RS+Base4":
            return rs_base4(self.primer5, self.primer3, inner_ecc=self.inner_ecc, index_bytes=INDEX)
        return hedges_line(self.primer5, self.primer3, index_bytes=INDEX, strand_bytes=self.layout.strand_bytes)

    def params(self) -> dict:
        return {"layout": asdict(self.layout), "inner_ecc": self.inner_ecc}

    @staticmethod
    def of(header: Header, base: Design) -> Design:
        return replace(base, format_id=header.format_id, layout=O.Layout(**header.params["layout"]), inner_ecc=header.params["inner_ecc"])


def _coded(files: DataFrame, layout: O.Layout, barcode: int) -> DataFrame:
    """(file_id, id, cw): index and data of every strand of (file_id, content), parity included."""
    key = ["file_id", "packet_id"]
    placed = O.strandize(P.packetize(files, layout.packet_bytes), layout, key)
    grid = O.add_parity(placed, layout, key) if layout.parity else placed
    h = F.hex("data")
    cw = F.transform(C.indexes(layout.strand_bytes), lambda i: F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
    packet = F.col("packet_id").cast("int")
    index = F.array(F.lit(barcode), F.floor(packet / 256).cast("int"), packet % 256, F.col("sub").cast("int"), F.col("slot").cast("int"))
    return grid.select("file_id", F.concat_ws("/", F.lit(barcode), "packet_id", "sub", "slot").alias("id"), F.concat(index, cw).alias("cw"))


def headers(files: DataFrame, design: Design) -> DataFrame:
    """(file_id, content): the header of each of (file_id, content) and, if there is one, filename."""
    name = F.col("filename") if "filename" in files.columns else F.lit("")
    told = files.select("file_id", F.octet_length("content").alias("size"), F.md5("content").alias("md5"), name.alias("filename"))
    fmt, params = design.format_id, design.params()

    def fn(size: list, md5: list, filename: list) -> list:
        return [Header(s or 0, m, f or "", fmt, DATA_BARCODE, params).to_bytes() for s, m, f in zip(size, md5, filename)]

    return K.with_column(told, "content", T.BinaryType(), ("size", "md5", "filename"), fn).select("file_id", "content")


def write(files: DataFrame, design: Design | None = None) -> DataFrame:
    """(file_id, id, dna) of (file_id, content[, filename]): the strands of headers and data; an empty file has a header only."""
    design = design or Design()
    data = _coded(files.select("file_id", "content"), design.layout, DATA_BARCODE)
    head = _coded(headers(files, design), design.header_layout, HEADER_BARCODE)
    return design.line().encode(data.unionByName(head))


def _votes(reads: DataFrame, line: Pipeline) -> DataFrame:
    """(file_id, barcode, packet_id, sub, slot, data): one strand of each place, by majority over its reads."""
    decoded = line.decode(reads.select("file_id", "dna")).where(~F.exists("cw", lambda x: x.isNull()) & (F.size("cw") > INDEX))
    at = lambda i: F.element_at("cw", i + 1)
    place = F.struct("file_id", at(0).alias("barcode"), (at(1) * 256 + at(2)).alias("packet_id"), at(3).alias("sub"), at(4).alias("slot")).alias("place")
    voted = majority_vote(decoded.select(place, F.slice("cw", INDEX + 1, 1 << 20).alias("cw")), "place", "cw")
    data = F.unhex(F.concat_ws("", F.transform("cw", lambda b: F.lpad(F.hex(b.cast("bigint")), 2, "0"))))
    return voted.select("place.*", data.alias("data"))


def _restored(strands: DataFrame, sizes: DataFrame, layout: O.Layout) -> DataFrame:
    """(file_id, content) from voted strands, for files of known n_bytes."""
    key = ["file_id", "packet_id"]
    whole = sizes.select("file_id", F.explode(C.indexes(P.packet_count(F.col("n_bytes"), layout.packet_bytes))).alias("packet_id"))
    fixed = O.restore(whole, strands.where(O.is_valid(F.col("sub"), F.col("slot"), layout)), layout, key)
    return P.reassemble(sizes, O.join_strands(fixed, layout, key), layout.packet_bytes, fill_missing=True).select("file_id", "content")


def read_headers(votes: DataFrame, design: Design) -> DataFrame:
    """(file_id, size, md5, filename, format_id, version, params) of the headers that can be read."""
    layout = design.header_layout
    found = votes.where(F.col("barcode") == HEADER_BARCODE)
    # a header's own length is in it, so all its packets are read and what follows it is ignored
    sizes = found.groupBy("file_id").agg(((F.max("packet_id") + 1) * layout.packet_bytes).cast("int").alias("n_bytes"))

    def fn(rows: list) -> list:
        out = []
        for data in rows:
            try:
                h = Header.from_bytes(bytes(data))
                out.append({"size": h.size, "md5": h.md5, "filename": h.filename, "format_id": h.format_id, "version": "{}.{}".format(*h.version), "params": json.dumps(h.params, sort_keys=True)})
            except (ValueError, struct.error, TypeError):
                out.append(None)
        return out

    kind = T._parse_datatype_string("size bigint, md5 string, filename string, format_id int, version string, params string")
    read = K.with_column(_restored(found, sizes, layout), "header", kind, "content", fn)
    return read.where(F.col("header").isNotNull()).select("file_id", "header.*")


def read(reads: DataFrame, design: Design | None = None) -> DataFrame:
    """(file_id, content, filename, md5, sound) of (file_id, dna), reads of both directions in any order and number.

    Files whose header cannot be read are not returned; those whose header asks for
    another layout than ``design`` has neither content nor soundness.
    """
    design = design or Design()
    votes = _votes(reads, design.line())
    told = read_headers(votes, design)
    known = told.withColumn("fits", F.col("params") == json.dumps(design.params(), sort_keys=True))
    sizes = known.where("fits").select("file_id", F.col("size").cast("int").alias("n_bytes"))
    content = _restored(votes.where(F.col("barcode") == DATA_BARCODE).drop("barcode"), sizes, design.layout)
    joined = known.join(content, "file_id", "left")
    data = F.when(F.col("fits"), F.when(F.col("size") == 0, F.lit(b"")).otherwise(F.col("content")))
    return joined.select("file_id", data.alias("content"), "filename", "md5", (F.md5(data) == F.col("md5")).alias("sound"))


def comments(strands: DataFrame, design: Design) -> Column:
    """What a strand file says about its format, for readers of the file."""
    return F.concat_ws(" ", F.lit("format"), F.lit(f"{design.format_id:#06x}"), F.lit(FORMATS[design.format_id]))


class Archive:
    """A strand file of one pool: ``write`` files into it, ``read`` them back.

    Lines have the file's id as their index, in front of the strand.
    """

    def __init__(self, spark: SparkSession, path: str, design: Design | None = None):
        self.spark, self.path, self.design = spark, path, design or Design()

    @classmethod
    def open(cls, spark: SparkSession, path: str, format_name: str = "RS+Base4", **options) -> Archive:
        known = {name: i for i, name in FORMATS.items()}
        if format_name not in known:
            raise ValueError(f"unknown format {format_name}; known: {', '.join(known)}")
        return cls(spark, path, Design(format_id=known[format_name], **options))

    def write(self, files: DataFrame) -> None:
        """``files``: file_id (an integer), content and, if wanted, filename."""
        strands = write(files, self.design).select(F.array("file_id").alias("index_ints"), "dna")
        D.write_strands(strands, self.path, {"format": f"{self.design.format_id:#x}", "version": "{}.{}".format(*VERSION)})

    def read(self) -> DataFrame:
        reads = D.read_strands(self.spark, self.path).select(F.element_at("index_ints", 1).alias("file_id"), "dna")
        return read(reads, self.design)
