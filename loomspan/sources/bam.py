"""Aligned reads in the binary alignment format, without a native library."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of operations and of bases by their code.
OPERATIONS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
#: Operations that move along the reference.
_ALONG = frozenset("MDN=X")
READS = pa.schema(
    [("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("left", pa.int64()), ("right", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("strand", pa.string()), ("template", pa.int64()), ("seq", pa.string())]
)


def _records(stream, path: str) -> Iterator[tuple]:
    def take(n: int) -> bytes:
        got = stream.read(n)
        if len(got) < n:
            raise ValueError(f"{path} ends within a record")
        return got

    if take(4) != b"BAM\1":
        raise ValueError(f"{path} is no binary alignment file")
    take(struct.unpack("<i", take(4))[0])
    chroms = []
    for _ in range(struct.unpack("<i", take(4))[0]):
        chroms.append(take(struct.unpack("<i", take(4))[0])[:-1].decode())
        take(4)
    while head := stream.read(4):
        body = take(struct.unpack("<i", head)[0])
        ref, pos, name_size, mapq, _, cigar_size, flag, seq_size, _, _, template = struct.unpack_from("<iiBBHHHiiii", body)
        at = 32 + name_size
        codes = struct.unpack_from(f"<{cigar_size}I", body, at)
        steps = [(c >> 4, OPERATIONS[c & 15]) for c in codes]
        at += 4 * cigar_size
        packed = body[at : at + (seq_size + 1) // 2]
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:seq_size]
        along = sum(n for n, op in steps if op in _ALONG)
        chrom = chroms[ref] if ref >= 0 else None
        yield body[32 : at - 4 * cigar_size - 1].decode(), flag, chrom, pos if chrom else None, pos + along if chrom else None, mapq, "".join(f"{n}{op}" for n, op in steps) or None, "-" if flag & 16 else "+", template, seq or None


def read_bam(spark: SparkSession, path: str | list[str], *, rows: int = 50_000) -> DataFrame:
    """``qname, flag, chrom, left, right, mapq, cigar, strand, template, seq``: reads over [left, right), counted from 0.

    Unplaced reads have no chromosome. A file is one task, streamed and never held whole: sets of many files are spread,
    one huge file isn't. Workers open the files by their path, in a folder that all share.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/*", "/").alias("path")).distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                held: list[tuple] = []
                with gzip.open(name, "rb") as stream:  # blocks of the format are gzip members
                    for record in _records(stream, name):
                        held.append(record)
                        if len(held) == rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), READS)], schema=READS)
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), READS)], schema=READS)

    return files.mapInArrow(run, "qname string, flag int, chrom string, left bigint, right bigint, mapq int, cigar string, strand string, template bigint, seq string")


def fragments(reads: DataFrame) -> DataFrame:
    """``chrom, left, right``: whole fragments of properly paired reads, from the mate that lies first."""
    proper = (F.col("flag").bitwiseAND(2) != 0) & (F.col("template") > 0) & F.col("chrom").isNotNull()
    return reads.where(proper).select("chrom", "left", (F.col("left") + F.col("template")).alias("right"))
