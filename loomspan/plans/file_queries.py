"""Queries that write files and read them back: every named format, and the readers and writers.

The files are made from the star-schema tables in the shared checkpoint folder, several per format, each with what the
layout wants around its data (header, comments, other lines), and read by the engine's own readers.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import arrays
from loomspan.operators import contacts, massspec, matrix, motifs, readqc, sets, tracks
from loomspan.plans.base import DNA, GENES, LONG, MATRIX, NAMES, ORACLE, PEAKS, QUERIES, READS, SWEEP, columns, dna, flat, genes, peaks, query, reads
from loomspan.plans.base import matrix as make_matrix
from loomspan.plans.general import table
from loomspan.session import ensure_checkpoint_dir
from loomspan.sources import motif_files, readers, store, writers
from loomspan.sources.formats import FORMATS, Format, find


def folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_lines(lines: DataFrame, path: str, before: list[str] = ()) -> str:
    """Write the column ``value`` as several files, each with the same lines before its data."""

    def framed(batches):
        if before:
            yield pa.RecordBatch.from_arrays([pa.array(before)], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])

    lines.select("value").repartition(3, "value").sortWithinPartitions("value").mapInArrow(framed, "value string").write.text(path)
    return path


# --- named formats ----------------------------------------------------------------------------------
# A row k of a file is a part: chromosome chr{size % 5}, whole number 10 k + column, strand by k % 2; other columns hold
# text (even) or whole numbers (odd).


def _roles(f: Format) -> dict[int, str]:
    """What each column of a format holds, from its key expressions."""
    roles: dict[int, str] = {}
    for text in f.keys.values():
        call = re.fullmatch(r"(?:loc|tss)\((.*)\)", text)
        if call:
            for place, part in enumerate(readers._split(call[1], ",")):
                for c in re.findall(r"(?<![+\d])(\d+)", part):
                    roles.setdefault(int(c), ("fa" if "fa(" in part else "chrom") if place == 0 else "strand" if place == 3 else "whole")
    for text in f.keys.values():
        for call, kind in (("text", "locus"), ("ints", "ints"), ("bar", "bars")):
            for c in re.findall(rf"\b{call}\((\d+)", text):
                roles[int(c)] = kind
        for c in re.findall(r"slice\((\d+)\)", text):
            roles |= {int(c): "number", int(c) + 1: "number"}
        if text.isdigit():
            roles.setdefault(int(text), "plain")
        for args in re.findall(r"join\(([^)]*)\)", text):
            roles |= {int(c): "text" for c in args.split(",")}
    return roles


def _cell(role: str, i: int) -> Column:
    k, chrom = F.col("p_partkey"), F.concat(F.lit("chr"), F.col("p_size") % 5)
    whole = (k * 10 + i).cast("string")
    return {
        "chrom": chrom, "fa": F.concat(chrom, F.lit(".fa")), "whole": whole, "strand": F.when(k % 2 == 0, "+").otherwise("-"), "locus": F.concat(chrom, F.lit(":"), whole, F.lit("-"), (k * 10 + i + 7).cast("string")),
        "ints": F.concat_ws(",", whole, (k + 1).cast("string"), F.lit("")), "bars": F.concat_ws("|", F.lit("a"), F.lit("b"), whole), "number": F.concat(whole, F.lit(".5")), "text": F.concat(F.lit(f"t{i} "), k),
        "plain": F.concat(F.lit(f"t{i} "), k) if i % 2 == 0 else (k + i).cast("string"),
    }[role]


def _sql_key(name: str, text: str, roles: dict[int, str]) -> list[str]:
    """SQL of what a key should come back as, flat."""
    chrom = "concat('chr', p_size % 5)"

    def number(x: str) -> str:
        x = x.strip()
        if "+" in x:
            a, b = readers._split(x, "+")
            return f"({number(a)} + {b if b.isdigit() else number(b)})"
        got = re.fullmatch(r"(int|min|max)\((.*)\)", x)
        if got and got[1] != "int":
            return f"{'least' if got[1] == 'min' else 'greatest'}({', '.join(number(p) for p in got[2].split(','))})"
        return f"(p_partkey * 10 + {got[2] if got else x})"

    flat_name = re.sub(r"\W", "_", name)
    place = lambda lo, hi: [f"{chrom} as {flat_name}_chrom", f"{lo} as {flat_name}_lo", f"{hi} as {flat_name}_hi"]
    got = re.fullmatch(r"(\w+)\((.*)\)", text)
    if got and got[1] in ("loc", "tss"):
        a = readers._split(got[2], ",")
        if got[1] == "loc":
            return place(number(a[1]), number(a[2]))
        known = roles[int(a[3])] == "strand"
        point = f"case when p_partkey % 2 = 0 then {number(a[1])} else {number(a[2])} end" if known else f"({number(a[1])} + {number(a[2])}) // 2"
        return place(point, point)
    i = int(re.search(r"\d+", text)[0]) if re.search(r"\d+", text) else 0
    whole = f"p_partkey * 10 + {i}"
    if got:
        value = {
            "ints": f"concat({whole}, ',', p_partkey + 1)", "slice": f"concat({whole}, '.5,', p_partkey * 10 + {i + 1}, '.5')", "bar": whole, "tag": "case when p_partkey % 2 = 0 then '+' else '-' end",
        }.get(got[1])
        if got[1] == "text":
            return place(whole, f"{whole} + 7")
        if got[1] == "join":
            value = " || ' ' || ".join(f"concat('t{c.strip()} ', p_partkey)" for c in got[2].split(","))
    else:
        value = {"chrom": chrom, "whole": whole, "strand": "case when p_partkey % 2 = 0 then '+' else '-' end", "text": f"concat('t{i} ', p_partkey)", "fa": f"concat({chrom}, '.fa')"}.get(roles[i])
        value = value or (f"concat('t{i} ', p_partkey)" if i % 2 == 0 else f"p_partkey + {i}")
    return [f"{value} as {flat_name}"]


def _flat(df: DataFrame, keys: list[str]) -> DataFrame:
    out = []
    for k in keys:
        kind, name, c = df.schema[k].dataType.typeName(), re.sub(r"\W", "_", k), F.col(f"`{k}`")
        if kind == "struct":
            out += [c["chrom"].alias(f"{name}_chrom"), c["left"].alias(f"{name}_lo"), c["right"].alias(f"{name}_hi")]
        else:
            out.append((F.array_join(c.cast("array<string>"), ",") if kind == "array" else c).alias(name))
    return df.select(*out)


def _add_format(name: str, f: Format) -> None:
    roles = _roles(f)
    if name == "gtf":
        roles[8] = "gtf"
    width = max(roles) + 1
    sep = "\t" if f.tsv else ","
    blank_rows = f.must_have is not None
    tagged = any(t.startswith("tag(") for t in f.keys.values())

    def run(spark, d):
        p = table(spark, d, "part")
        cells = [_cell(roles.get(i, "plain"), i) if roles.get(i) != "gtf" else F.concat(F.lit('gene_id "g'), F.col("p_partkey"), F.lit('"; brand "'), F.col("p_brand"), F.lit('";')) for i in range(width)]
        if blank_rows:
            cells[f.must_have] = F.when(F.col("p_partkey") % 7 == 0, "").otherwise(cells[f.must_have])
        if tagged:
            cells.append(F.concat(F.when(F.col("p_partkey") % 5 == 0, "NH:i:").otherwise("XS:A:"), _cell("strand", 0)))
        if not f.tsv:
            cells = [F.concat(F.lit('"'), c, F.lit('"')) if i % 3 == 2 else c for i, c in enumerate(cells)]
        before = [f"#chrom{sep}x"] if f.skip_till == "chr" else ["noise", f.skip_till] if f.skip_till else [sep.join(["head"] * width)] * (f.skip + 1)
        if f.comment:
            before.append(f"{f.comment} a comment")
        path = write_lines(p.select(F.concat_ws(sep, *cells).alias("value")), folder(spark, f"format-{name}"), before)
        got = readers.read_table(spark, path, name)
        if name == "gtf":
            got = got.withColumn("gene_id", F.col("attributes")["gene_id"]).withColumn("brand", F.col("attributes")["brand"])
        return _flat(got, [*f.keys, *(["gene_id", "brand"] if name == "gtf" else [])])

    outs = [c for k, t in f.keys.items() for c in _sql_key(k, t, roles)]
    if name == "gtf":
        outs += ["concat('g', p_partkey) as gene_id", "p_brand as brand"]
    where = " where p_partkey % 7 <> 0" if blank_rows else " where p_partkey % 5 <> 0" if tagged else ""
    QUERIES[f"format_{name}"] = run
    ORACLE[f"format_{name}"] = f"select {', '.join(outs)} from part{where}"


for _name, _format in FORMATS.items():
    if not _format.special and not _format.sniff:
        _add_format(_name, _format)

for _name, _sep in (("default", ","), ("sniffer", ","), ("sniffer_tsv", "\t")):

    def _sniff(spark, d, name=_name, sep=_sep):
        p = table(spark, d, "part").select(F.concat_ws(sep, F.col("p_partkey"), "p_brand", F.concat(F.lit('"'), F.col("p_size"), F.lit('"')) if sep == "," else F.col("p_size"), F.col("p_retailprice")).alias("value"))
        path = write_lines(p, folder(spark, f"format-{name}"), [sep.join(["key", "brand", "size", "price"])])
        return readers.read_table(spark, path, name).select("key", "brand", "size", "price")

    QUERIES[f"format_{_name}"] = _sniff
    ORACLE[f"format_{_name}"] = "select p_partkey as key, p_brand as brand, p_size as size, p_retailprice as price from part"


# --- readers and writers ----------------------------------------------------------------------------

_SEQ = "translate(md5(cast(p_partkey as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    word = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    return table(spark, d, "part").select("p_partkey", "p_brand", word.alias("seq"))


@query(f"select concat(p_brand, '_', p_partkey) as name, {_SEQ} as seq from part")
def format_fasta(spark, d):
    """Written by the FASTA writer, read back as a list."""
    path = folder(spark, "fasta")
    writers.write_fasta(_sequences(spark, d), path, ["p_brand", "p_partkey"])
    return readers.read_table(spark, path, "fasta")


@query(f"select concat('>s', p_partkey, ' a > b') as name, concat({_SEQ}, {_SEQ}) as seq from part".replace("'>s'", "'s'"))
def fasta_lines(spark, d):
    """Records over several lines, with a ``>`` inside the header."""
    s = _sequences(spark, d)
    text = s.select(F.concat(F.lit(">s"), F.col("p_partkey"), F.lit(" a > b\r\n"), F.col("seq"), F.lit("\r\n"), F.col("seq")).alias("value"))
    return readers.read_fasta(spark, write_lines(text, folder(spark, "fasta-lines")))


@query("select concat('p', p_partkey) as peptide, 'ACC.1' as dom_acc, concat('d', p_size) as dom_name, p_retailprice as score, concat('g', p_size) as gene from part")
def format_hmmer_tbl(spark, d):
    cells = F.concat_ws("  ", F.concat(F.lit("p"), F.col("p_partkey")), F.lit("-"), F.concat(F.lit("d"), F.col("p_size")), F.lit("ACC.1"), F.col("p_retailprice"), F.lit("x y"), F.concat(F.lit("gene:g"), F.col("p_size")), F.lit("end"))
    return readers.read_table(spark, write_lines(table(spark, d, "part").select(cells.alias("value")), folder(spark, "hmmer"), ["# target name", "#---"]), "hmmer_tbl")


@query("select concat('p', p_partkey) as peptide, 'D5' as dom_acc, concat('d', p_size) as dom_name, p_partkey as first, p_partkey + p_size as last, p_retailprice as e, 100 as tlen, 50 as qlen, 'last' as gene from part".replace("'D5'", "'acc'"))
def format_hmmer_domtbl(spark, d):
    c = [F.lit("-")] * 23
    for i, v in {0: F.concat(F.lit("p"), F.col("p_partkey")), 2: F.lit("100"), 3: F.concat(F.lit("d"), F.col("p_size")), 4: F.lit("acc"), 5: F.lit("50"), 6: F.col("p_retailprice"), 17: F.col("p_partkey"), 18: F.col("p_partkey") + F.col("p_size"), 22: F.lit("last")}.items():
        c[i] = v.cast("string")
    got = readers.read_table(spark, write_lines(table(spark, d, "part").select(F.concat_ws(" ", *c).alias("value")), folder(spark, "domtbl"), ["# head"]), "hmmer_domtbl")
    return got.select("peptide", "dom_acc", "dom_name", F.col("dom_loc.start").cast("bigint").alias("first"), F.col("dom_loc.end").cast("bigint").alias("last"), "e", "tlen", "qlen", "gene")


for _sep, _kind in ((",", "csv"), ("\t", "tsv")):

    @query(f"with {PEAKS} select chrom, lo, hi, score, list, rid as key from peaks", name=f"save_{_kind}")
    def _save(spark, d, sep=_sep, kind=_kind):
        path = folder(spark, kind)
        writers.write_delimited(peaks(spark, d).withColumnRenamed("rid", "key"), path, sep=sep, key_order=["loc", "score"], gzip=kind == "tsv")
        return flat(readers.read_table(spark, path, "sniffer" if sep == "," else "sniffer_tsv").select("loc", "score", "list", "key"))


@query(f"with {GENES} select chrom, lo, hi, concat(name, '-', gid) as name, strand from genes")
def save_bed(spark, d):
    path = folder(spark, "bed")
    writers.write_bed(genes(spark, d), path, name="name", strand="strand", unique="gid")
    return flat(readers.read_table(spark, path, "bed", infer=False)).select("chrom", "lo", "hi", "name", "strand")


@query(f"with {GENES} select 'gene' as feature, chrom, lo, hi, strand, name, gid from genes")
def save_gtf(spark, d):
    path = folder(spark, "gtf")
    writers.write_gtf(genes(spark, d).drop("tss_loc"), path, strand="strand", feature="gene")
    got = readers.read_table(spark, path, "gtf", infer=False)
    a = F.col("attributes")
    return flat(got.select("feature", "loc", "strand", a["name"].alias("name"), a["gid"].cast("bigint").alias("gid")))


@query(f"with {PEAKS} select rid, chrom, lo, hi, score, list from peaks")
def save_and_load(spark, d):
    path = folder(spark, "saved")
    writers.save(peaks(spark, d), path)
    return flat(readers.load(spark, path))


@query("select n_nationkey as k, n_name as name from nation")
def load_rows(spark, d):
    """From a list of dicts; a small list, as a caller of the driver would hand over."""
    return readers.from_rows(spark, [{"k": r.n_nationkey, "name": r.n_name} for r in table(spark, d, "nation").collect()])  # 25 rows


@query(f"with {MATRIX} select rid, " + ", ".join(f"round({n}, 6) as {n}" for n in NAMES) + " from m")
def load_pandas(spark, d):
    wide = matrix.to_columns(make_matrix(spark, d), NAMES).toPandas()  # one row per supplier: a caller's own pandas frame
    return columns(matrix.from_pandas(spark, wide, NAMES))


@query(f"with {MATRIX} select rid, " + ", ".join(f"{n} as {n}, {n} / 4 as err_{n}" for n in NAMES) + " from m")
def save_matrix(spark, d):
    """Values with their errors interleaved, read back with both."""
    path = folder(spark, "matrix")
    m = make_matrix(spark, d).withColumn("err", F.transform("conditions", lambda v: v / 4))
    writers.write_matrix(m, NAMES, path, err="err")
    back, names = readers.read_expression(spark, path, {"rid": 0}, 1, errors="interleaved")
    return back.select(F.col("rid").cast("bigint").alias("rid"), *[F.col("conditions")[i].alias(n) for i, n in enumerate(names)], *[F.col("err")[i].alias(f"err_{n}") for i, n in enumerate(names)])


@query(f"with {MATRIX} select rid, " + ", ".join(f"{n} as {n}" for n in NAMES) + " from m")
def load_expression(spark, d):
    path = folder(spark, "expression")
    writers.write_matrix(make_matrix(spark, d), NAMES, path, sep=",")
    back, names = readers.read_expression(spark, path, {"rid": 0}, 1, tsv=False)
    return back.select(F.col("rid").cast("bigint").alias("rid"), *[F.col("conditions")[i].alias(n) for i, n in enumerate(names)])


def _reads_file(spark: SparkSession, d: str, mate: int | None = None) -> str:
    s = _sequences(spark, d)
    qual = F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: ((F.col("p_partkey") + i) % 40).cast("int"))
    ids = F.concat(F.lit("@a:b:c:d:e:f"), F.col("p_partkey"), F.lit(f":{mate}" if mate else ":1"))
    rows = s.select("p_partkey", ids.alias("id"), "seq", qual.alias("qual")).orderBy("p_partkey")
    path = folder(spark, "fastq")
    writers.write_fastq(rows, path, single=True)
    return path


@query(f"select concat('@a:b:c:d:e:f', p_partkey, ':1') as id, {_SEQ} as seq, (p_partkey + 1) % 40 as first, (p_partkey + 32) % 40 as last from part")
def load_fastq(spark, d):
    got = readers.read_fastq(spark, _reads_file(spark, d))
    return got.select("id", "seq", F.col("qual")[0].cast("bigint").alias("first"), F.col("qual")[31].cast("bigint").alias("last"))


@query("select concat('@a:b:c:d:e:f', p_partkey, ':1') as one, concat('@a:b:c:d:e:f', p_partkey, ':2') as two from part")
def load_fastq_pairs(spark, d):
    return readers.pair_fastq(readers.read_fastq(spark, _reads_file(spark, d, 1)), readers.read_fastq(spark, _reads_file(spark, d, 2))).select(F.col("first.id").alias("one"), F.col("second.id").alias("two"))


@query(f"with {GENES} select chrom, count(*) as num_features from genes group by chrom")
def store_chromosomes(spark, d):
    return store.chromosomes(_store(spark, d))


@query(f"with {GENES} select chrom, lo, hi, name, strand from genes where chrom = 'chr2' and hi >= 200000 and lo <= 700000")
def store_region(spark, d):
    got = store.features_at(_store(spark, d), "chr2", 200_000, 700_000)
    return got.select("chrom", F.col("transcript_left").alias("lo"), F.col("transcript_right").alias("hi"), "name", "strand")


@query(f"with {GENES} select chrom, lo, hi, strand from genes where name = 'Customer#000000007'")
def store_find(spark, d):
    return store.find(_store(spark, d), "Customer#000000007").select("chrom", F.col("transcript_left").alias("lo"), F.col("transcript_right").alias("hi"), "strand")


def _store(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "features")
    g = genes(spark, d).withColumn("cds_loc", F.col("loc")).withColumn("exon_starts", F.array("loc.left")).withColumn("exon_ends", F.array("loc.right")).withColumn("feature_type", F.lit("gene"))
    for part in (0, 1):  # two appends
        store.add_features(g.where(F.col("gid") % 2 == part), path)
    return store.open_store(spark, path)


_WIG = "wig as (select concat('chr', p_size % 5) as chrom, p_partkey as pos, p_retailprice as score from part)"


@query(f"with {_WIG} select chrom, pos, 1 as span, score from wig")
def load_wig(spark, d):
    """variableStep blocks, one per part: a declaration line before each value."""
    p = table(spark, d, "part")
    text = F.concat(F.lit("variableStep chrom=chr"), F.col("p_size") % 5, F.lit("\n"), F.col("p_partkey"), F.lit(" "), F.col("p_retailprice"))
    return readers.read_wig(spark, write_lines(p.select(text.alias("value")), folder(spark, "wig"), ["track type=wiggle_0"]))


@query("select concat('chr', p_size % 5) as chrom, p_partkey * 10 + i * 2 as pos, 2 as span, cast(p_size + i as double) as score from part, (select unnest(range(3)) as i) where p_size % 5 <> 3")
def load_wig_steps(spark, d):
    """fixedStep blocks of three values; a chromosome with ``_`` in its name is skipped."""
    p = table(spark, d, "part")
    chrom = F.when(F.col("p_size") % 5 == 3, "chr3_alt").otherwise(F.concat(F.lit("chr"), F.col("p_size") % 5))
    text = F.concat(F.lit("fixedStep chrom="), chrom, F.lit(" start="), F.col("p_partkey") * 10, F.lit(" step=2 span=2\n"), F.concat_ws("\n", *[(F.col("p_size") + i).cast("string") for i in range(3)]))
    return readers.read_wig(spark, write_lines(p.select(text.alias("value")), folder(spark, "wig-steps")), standard_only=True)


@query(f"with {READS}, n as (select count(*) as reads from reads) select chrom, sum(hi - lo) as bases, max(reads) as total_reads from reads, n group by chrom")
def track_store(spark, d):
    """A stored coverage track with its library size, read back: bases by chromosome and the number of reads."""
    path = folder(spark, "track")
    r = reads(spark, d)
    tracks.save_track(tracks.coverage(r), path, total_reads=r.count())
    track, info = tracks.open_track(spark, path)
    return track.groupBy("chrom").agg(F.sum((F.col("end") - F.col("start")) * F.col("value")).cast("bigint").alias("bases")).withColumn("total_reads", F.lit(info["total_reads"]))


@query(
    "with b as (select p_partkey as id, concat('chr', p_partkey % 3) as chrom, p_partkey * 1000 as l from part), n as (select *, row_number() over (partition by chrom order by l) - 1 as k from b) "
    "select x.chrom, least(x.k, y.k) as i, greatest(x.k, y.k) as j, cast(p_size as double) as score from part join n x on x.id = p_partkey join n y on y.id = p_partkey + p_size where x.chrom = y.chrom"
)
def load_hicpro(spark, d):
    p = table(spark, d, "part")
    pixels = write_lines(p.select(F.concat_ws("\t", "p_partkey", F.col("p_partkey") + F.col("p_size"), "p_size").alias("value")), folder(spark, "pixels"))
    bins = write_lines(p.select(F.concat_ws("\t", F.concat(F.lit("chr"), F.col("p_partkey") % 3), F.col("p_partkey") * 1000, F.col("p_partkey") * 1000 + 999, "p_partkey").alias("value")), folder(spark, "bins"))
    return contacts.load_triplets(*contacts.read_hicpro(spark, pixels, bins))


@query("select concat('chr', p_size % 3) as chrom, p_partkey as i, p_partkey + p_size as j, p_retailprice as score from part where p_partkey % 4 <> 0")
def load_cooler(spark, d):
    k, chrom = F.col("p_partkey"), F.concat(F.lit("chr"), F.col("p_size") % 3)
    other = k + F.col("p_size")
    cells = [chrom, k * 1000, k * 1000 + 1000, chrom, other * 1000, other * 1000 + 1000, F.col("p_size"), F.when(k % 4 == 0, "").otherwise(F.col("p_retailprice").cast("string"))]
    return contacts.load_cooler_dump(contacts.read_cooler(spark, write_lines(table(spark, d, "part").select(F.concat_ws("\t", *cells).alias("value")), folder(spark, "cooler"))), 1000)


@query(
    "with x as (select unnest([concat('A', p_partkey), concat('B', p_partkey)]) as name, unnest([concat('P', p_partkey), concat('Q', p_partkey)]) as pid, p_size, p_retailprice from part) "
    "select name, pid, 's1' as sample, p_retailprice as intensity, cast(p_size as double) as peptides from x union all select name, pid, 's2', p_retailprice * 2, cast(p_size + 1 as double) from x"
)
def load_maxquant(spark, d):
    """A search-engine table: intensity columns found by their names, ambiguous names split, intensities in millions."""
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    names = ["Protein IDs", "Gene names", "Intensity s1", "Intensity s2", "Razor + unique peptides s1", "Razor + unique peptides s2", "Score"]
    cells = [F.concat(F.lit("P"), k, F.lit(";Q"), k), F.concat(F.lit("A"), k, F.lit(";B"), k), price * 1e6, price * 2e6, F.col("p_size"), F.col("p_size") + 1, F.lit("1")]
    path = write_lines(table(spark, d, "part").select(F.concat_ws("\t", *[c.cast("string") for c in cells]).alias("value")), folder(spark, "maxquant"), ["\t".join(names)])
    got = massspec.read_maxquant(spark, path)
    return got.select("name", "pid", "sample", F.round("intensity", 6).alias("intensity"), "peptides")


@query("select replace(concat(p_brand, '~', p_size), '~', ':') as name, p_retailprice as qvalue, p_partkey as count from part")
def load_go_terms(spark, d):
    cells = F.concat_ws("\t", F.concat_ws("~", "p_brand", "p_size"), F.col("p_partkey"), F.col("p_retailprice"))
    path = write_lines(table(spark, d, "part").select(cells.alias("value")), folder(spark, "go"), ["term\tcount\tq"])
    return readers.read_go(spark, path, Format(keys={"name": "0", "count": "1", "qvalue": "2"}, tsv=True)).select("name", "qvalue", "count")


@query(f"with {LONG} select rid, cond, value from long")
def save_long_matrix(spark, d):
    path = folder(spark, "long")
    writers.write_delimited(matrix.to_long(make_matrix(spark, d), NAMES, ["rid"]).select("rid", "cond", "value"), path, sep="\t")
    return readers.read_table(spark, path, Format(keys={"id": "0", "cond": "1", "value": "2"}, tsv=True)).select(F.col("id").alias("rid"), "cond", "value")


@query("select concat('chr', p_size % 3) as chrom, max(p_partkey + p_size) + 1 as bins, count(*) as contacts, 1000 as bin_size from part where p_partkey % 4 <> 0 group by 1")
def contact_store(spark, d):
    """A stored contact matrix: its chromosomes and bin size."""
    path = folder(spark, "contacts")
    contacts.save_contacts(load_cooler(spark, d), path, 1000)
    pixels, size = contacts.open_contacts(spark, path)
    return contacts.keys(pixels).withColumn("bin_size", F.lit(size))


@query("with l as (select 'nations' as list_name, 0 as list_ix, n_name as name, n_regionkey as k from nation union all select 'regions', 1, r_name, null from region) select * from l")
def stack_lists(spark, d):
    a = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("k"))
    return sets.stack({"nations": a, "regions": table(spark, d, "region").select(F.col("r_name").alias("name"))})


@query("select concat('A', p_partkey) as name, concat('P', p_partkey) as pid, p_retailprice as intensity_s1, cast(p_size as double) as peptides_s1, p_retailprice * 2 as intensity_s2, cast(p_size + 1 as double) as peptides_s2 from part")
def save_massspec(spark, d):
    """A mass-spec table written with columns per sample, read back."""
    path = folder(spark, "massspec")
    long = load_maxquant(spark, d).where(F.col("name").startswith("A"))
    writers.write_delimited(massspec.wide(long, ["s1", "s2"]), path, sep="\t")
    got = readers.read_table(spark, path, "sniffer_tsv")
    return got.select("name", "pid", *[F.round(F.col(f"{c}_{s}").cast("double"), 6).alias(f"{c}_{s}") for s in ("s1", "s2") for c in ("intensity", "peptides")])


@query("with n as (select text, count(*) as n from documents where text is not null group by text) select count(case when n = 1 then 1 end) as unique, count(case when n > 1 then 1 end) as repeated from n".replace("as unique", 'as "unique"'))
def read_uniqueness(spark, d):
    return readqc.uniqueness(table(spark, d, "documents").where("text is not null").select(F.col("text").alias("seq"))).select("unique", "repeated")


# --- what a list, a motif or a matrix is made of -----------------------------------------------------


@query("select p_partkey, p_brand, p_size from part")
def list_iterate(spark, d):
    """All rows and keys of a stored list: iterating, copying and exporting are reading."""
    path = folder(spark, "list")
    writers.save(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), path)
    return readers.load(spark, path)


@query("select count(*) as rows, count(*) > 0 as some from part")
def list_length(spark, d):
    return table(spark, d, "part").agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) > 0).alias("some"))


@query("select 'n_regionkey' as key, 0 as place, false as shared union all select 'name', 1, true")
def list_keys(spark, d):
    """Keys of a list and which of them another list has too."""
    a = table(spark, d, "nation").select("n_regionkey", F.col("n_name").alias("name"))
    both = set(sets.shared_keys(a, table(spark, d, "region").select(F.col("r_name").alias("name"))))
    return spark.createDataFrame([(k, i, k in both) for i, k in enumerate(a.columns)], "key string, place int, shared boolean")


@query(r"select p_partkey, a || 'C' || b as word from part, (values ('A'), ('G')) x(a), (values ('A'), ('C'), ('G'), ('T')) y(b)")
def motif_words(spark, d):
    """Concrete words of a degenerate motif, for every part."""
    words = motifs.expand_word("RCN")
    return table(spark, d, "part").select("p_partkey", F.explode(F.array(*[F.lit(w) for w in words])).alias("word"))


@query("with b as (select unnest(['A', 'C', 'G', 'T']) as b) select x.b || y.b || z.b as word, case when (x.b <> 'A')::int + (y.b <> 'C')::int + (z.b <> 'G')::int = 1 then true else false end as one_off from b x, b y, b z")
def motif_library(spark, d):
    """All words of three letters, and those that differ from one word in one base."""
    off = set(motifs.permute_one("ACG"))
    return spark.createDataFrame([(w, w in off) for w in motifs.library(3)], "word string, one_off boolean")


@query(f"with {DNA} select rid, length(seq) - length(regexp_replace(seq, '[ACGT]CG|A[ACGT]G|AC[ACGT]', '', 'g')) > 0 as near from dna")
def motif_mismatches(spark, d):
    """Sequences with a motif word, one place of it free."""
    return dna(spark, d).select("rid", F.col("seq").rlike("|".join(motifs.mismatch_regexes("ACG"))).alias("near"))


@query("select p_partkey, p_partkey % 10 + 1.0 as a, 2.0 as c, 1.0 as g, 3.0 as t from part")
def motif_file(spark, d):
    """Motif records of two places as text, read back."""
    k = F.col("p_partkey")
    text = F.concat(F.lit(">ACGT\tm"), k, F.lit("\t"), F.col("p_size"), F.lit("\n"), k % 10 + 1, F.lit("\t2\t1\t3\n0.1\t0.2\t0.3\t0.4"))
    got = motif_files.read_homer_motifs(spark, write_lines(table(spark, d, "part").select(text.alias("value")), folder(spark, "motifs")))
    row = F.col("matrix")[0]
    return got.select(F.substring("name", 2, 20).cast("bigint").alias("p_partkey"), row[0].alias("a"), row[1].alias("c"), row[2].alias("g"), row[3].alias("t"))


@query("select concat('m', p_partkey) as name, 0.25 as a, 0.75 as g, cast(p_size as double) as score from part")
def motif_save(spark, d):
    """Motifs written with rows that add up to 1, read back."""
    one = F.array(F.lit(1.0), F.lit(0.0), F.lit(3.0), F.lit(0.0))
    m = table(spark, d, "part").select(F.concat(F.lit("m"), "p_partkey").alias("name"), F.lit("AG").alias("word"), F.col("p_size").cast("double").alias("score"), F.array(one, one).alias("matrix"))
    path = folder(spark, "saved-motifs")
    writers.motif_lines(m).write.text(path)
    return motif_files.read_homer_motifs(spark, path).select("name", F.col("matrix")[1][0].alias("a"), F.col("matrix")[1][2].alias("g"), "score")


@query("select concat('id', p_partkey) as id, concat('n', p_size) as name, cast(p_partkey as double) as a, cast(p_size as double) as t from part")
def motif_jaspar(spark, d):
    k = F.col("p_partkey")
    text = F.concat(F.lit(">id"), k, F.lit(" n"), F.col("p_size"), F.lit("\n"), k, F.lit(" 1\n2 2\n3 3\n"), F.col("p_size"), F.lit(" 4"))
    got = motif_files.read_jaspar(spark, write_lines(table(spark, d, "part").select(text.alias("value")), folder(spark, "jaspar")))
    return got.select("id", "name", F.col("matrix")[0][0].alias("a"), F.col("matrix")[0][3].alias("t"))


@query("select p_partkey, p_size + 0.5 as low, p_size / 3.0 as high from part")
def array_rescale(spark, d):
    v = F.array(F.col("p_size") * 1.0, F.col("p_size") + 1.0, F.col("p_size") / 3.0)
    out = arrays.rescale(F.concat(F.array(v[0], v[1]), F.array(v[2], v[2])), 2)
    return table(spark, d, "part").select("p_partkey", out[0].alias("low"), out[1].alias("high"))


@query(f"with {MATRIX} select rid, RO, RF, NO, NF, AO, AF, round(AF / 2, 6) as extra from m where AF > 100")
def matrix_rebuilt(spark, d):
    """Rows cut by a condition, errors dropped, conditions sorted backwards, one inserted."""
    m = matrix.drop_errors(make_matrix(spark, d).withColumn("err", F.col("conditions")))
    kept = matrix.cut(m, lambda f: f["conditions"][0] > 100)
    names = matrix.sorted_conditions(NAMES, reverse=True)
    turned = matrix.slice_conditions(kept, NAMES, names)
    more = matrix.insert_condition(turned, "rid", kept.select("rid", (F.col("conditions")[0] / 2).alias("v")), "v")
    return columns(more, [*names, "extra"])


@query("select l_orderkey, l_linenumber, case when l_discount = 0 then 0.1 when l_discount > 0.05 then 1.0 else 0.0 end as code from lineitem")
def call_codes(spark, d):
    called = F.when(F.col("l_discount") != 0, F.col("l_discount") > 0.05)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", massspec.call_code(called).alias("code"))


@query("select concat('@a:b:c:d:e:f', p_partkey // 2, ':1') as one, concat('@a:b:c:d:e:f', p_partkey // 2, ':2') as two from part where p_partkey > 1 and p_partkey % 2 = 0 and p_partkey < (select max(p_partkey) from part)")
def split_fastq_pairs(spark, d):
    """Interleaved reads split into pairs: two records of one name, one behind another."""
    p = table(spark, d, "part").where("p_partkey > 1")
    ids = F.concat(F.lit("@a:b:c:d:e:f"), F.floor(F.col("p_partkey") / 2), F.lit(":"), F.col("p_partkey") % 2 + 1)
    path = folder(spark, "interleaved")
    writers.write_fastq(p.select("p_partkey", ids.alias("id"), F.lit("ACGT").alias("seq"), F.array(*[F.lit(30)] * 4).alias("qual")).orderBy("p_partkey"), path, single=True)
    return readers.split_pairs_fastq(readers.read_fastq(spark, path)).select(F.col("first.id").alias("one"), F.col("second.id").alias("two"))


@query("select i, array_to_string(list_transform(range(6), lambda j: cast(least(i, j) * 10 + greatest(i, j) as varchar)), ',') as row from (select unnest(range(6)) as i)")
def contacts_dense(spark, d):
    """Dense rows of one chromosome as text, read back."""
    rows = spark.createDataFrame([("a", i, j, float(i * 10 + j)) for i in range(6) for j in range(i, 6)], "chrom string, i long, j long, score double")
    dense = contacts.dense_rows(rows, "a", 6)
    path = folder(spark, "dense")
    writers.write_delimited(dense.select("i", *[F.col("values")[k].cast("bigint").alias(f"b{k}") for k in range(6)]), path, sep="\t")
    back = readers.read_table(spark, path, "sniffer_tsv")
    return back.select("i", F.concat_ws(",", *[F.col(f"b{k}") for k in range(6)]).alias("row"))


@query(f"with {READS}, {SWEEP}, {PEAKS}, w as (select rid, ((lo + hi) >> 1) - 200 as w0, chrom from peaks), c as (select rid, value, greatest(s, w0) - w0 as a, least(e, w0 + 400) - w0 as b from w join track t on t.chrom = w.chrom and t.e > w0 and t.s < w0 + 400), k as (select *, unnest(range(a // 100, (b - 1) // 100 + 1)) as bin from c), s as (select rid, bin, cast(sum(value * (least(b, (bin + 1) * 100) - greatest(a, bin * 100))) as double) as value from k where bin < 4 group by all) select 'one' as track, * from s union all select 'two', rid, bin, value * 2 from s")
def tracks_heat(spark, d):
    """Binned signal of two tracks around all peaks."""
    t = tracks.coverage(reads(spark, d))
    both = t.withColumn("track", F.lit("one")).unionByName(t.withColumn("value", F.col("value") * 2).withColumn("track", F.lit("two")))
    return tracks.list_heat(both, "track", peaks(spark, d), distance=200, bins=4).withColumn("value", F.col("value").cast("double"))


@query("select f, field from (select unnest(['bed', 'full_bed']) as f), (select unnest(['loc', 'name', 'score', 'strand']) as field)")
def format_fields(spark, d):
    """The catalogue: formats by name and the keys of each."""
    return spark.createDataFrame([(n, k) for n in ("bed", "full_bed") if n in find("bed") for k in list(FORMATS[n].keys)[:4]], "f string, field string")
