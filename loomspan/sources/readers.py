"""Readers of delimited, sequence and track files.

Text is read in splits; ``numbered_lines`` gives every line its place in its file by counting the lines of the
splits first, without sorting or moving any line. Skipping, record grouping and stateful formats need that;
``read_table(..., numbered=False)`` reads formats that skip nothing in one narrow pass.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.loci import loc, tss
from loomspan.session import checkpointed
from loomspan.sources.formats import FORMATS, Format

#: First cells that mark a header row.
HEADERS = ["chipseq_loc", "loc", "chr", "#", "Gene Name", "GenBank", "RefSeq", "Systematic", "mm8.refGene.chrom", "mm8", "chromosome", "mm9.refGene.chrom", "mm9", "=" * 69, "=" * 70, "=" * 71]


#: So many splits' line counts are broadcast (about 100 bytes each), more are joined.
MOST_SPLITS = 500_000


def _split_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, line, _i``: lines in the order of each split; gz files are read as they are, CR-only line ends too."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.explode(F.split("value", "\r(?=.)")).alias("line"))
    return text.select("file", "block", F.regexp_replace("line", "[\r\n]+$", "").alias("line"), F.monotonically_increasing_id().alias("_i"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, ordinal, line``: lines with their number from 0 within each file.

    One pass counts the lines of every split, one reads them: both plan the same splits in the same partitions, where a
    split's lines are counted up from its first. An empty file gives no row.
    """
    lines = _split_lines(spark, path)
    splits = lines.groupBy("file", "block").agg(F.min("_i").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpointed(splits.select("file", "block", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    starts = F.broadcast(starts) if starts.count() <= MOST_SPLITS else starts
    return lines.join(starts, ["file", "block"]).select("file", (F.col("_i") - F.col("_from") + F.col("_start")).alias("ordinal"), "line")


def _split_csv(line: Column) -> Column:
    """Cells of a comma-separated line; quotes protect commas."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), 1)
    return F.transform(cells, lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


_CALL = re.compile(r"^(\w+)\((.*)\)$")


def _split(text: str, mark: str) -> list[str]:
    """Parts between marks that aren't inside parentheses."""
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == mark and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()] if now.strip() else out


def compile_key(text: str, cells: Column) -> Column:
    """Column of a format expression over the cells of a row; missing cells are null."""
    text = text.strip()
    if text.isdigit():
        return F.get(cells, int(text))
    terms = _split(text, "+")
    if len(terms) > 1:  # in a sum a bare number is itself, not a column
        return functools.reduce(operator.add, [F.lit(int(t)) if t.isdigit() else compile_key(t, cells).try_cast("bigint") for t in terms])
    call = _CALL.match(text)
    if not call:
        raise ValueError(f"cannot read the format expression {text!r}")
    name, args = call[1], _split(call[2], ",")
    number = lambda a: compile_key(a, cells).try_cast("bigint")
    chrom = lambda a: F.concat(F.lit("chr"), F.regexp_replace(compile_key(a, cells), "(?i)^chr", ""))
    if name == "loc":
        return F.when(number(args[1]).isNotNull(), loc(chrom(args[0]), number(args[1]), number(args[2])))
    if name == "tss":
        return tss(loc(chrom(args[0]), number(args[1]), number(args[2])), compile_key(args[3], cells))
    if name == "text":
        c = compile_key(args[0], cells)
        return loc(F.concat(F.lit("chr"), F.regexp_replace(F.substring_index(c, ":", 1), "(?i)^chr", "")), F.regexp_extract(c, r":(\d+)-", 1).try_cast("bigint"), F.regexp_extract(c, r"-(\d+)\s*$", 1).try_cast("bigint"))
    if name == "int":
        return number(args[0])
    if name in ("min", "max"):
        return (F.least if name == "min" else F.greatest)(*[number(a) for a in args])
    if name == "ints":
        return F.transform(F.filter(F.split(compile_key(args[0], cells), ","), lambda x: x != ""), lambda x: x.try_cast("bigint"))
    if name == "slice":
        rest = F.slice(cells, int(args[0]) + 1, F.greatest(F.size(cells) - int(args[0]), F.lit(0)))
        return F.transform(rest, lambda x: F.coalesce(F.nanvl(x.try_cast("double"), F.lit(0.0)), F.lit(0.0)))
    if name == "join":
        return F.concat_ws(" ", *[compile_key(a, cells) for a in args])
    if name == "fa":
        return F.regexp_replace(compile_key(args[0], cells), r"\.fa$", "")
    if name == "bar":
        return F.get(F.split(compile_key(args[0], cells), "\\|"), int(args[1]))
    if name == "tag":
        hit = F.get(F.filter(cells, lambda c: F.instr(c, f"{args[0]}:") > 0), 0)
        return F.regexp_replace(hit, "[A-Z]*:*", "")
    raise ValueError(f"unknown function {name!r} in a format")


def data_lines(spark: SparkSession, path: str | list[str], fmt: Format, *, numbered: bool = True) -> DataFrame:
    """``file, ordinal, line, cells``: the lines a format takes for data.

    Without ``numbered`` the ordinal only grows within a split; a format that skips lines by number needs it.
    """
    if numbered or fmt.skip_till or fmt.end_with or fmt.skip >= 0:
        lines = numbered_lines(spark, path)
    else:
        lines = _split_lines(spark, path).select("file", F.col("_i").alias("ordinal"), "line")
    if fmt.skip_till:
        first = lines.where(F.col("line").contains(fmt.skip_till)).groupBy("file").agg(F.min("ordinal").alias("_from"))
        lines = lines.join(F.broadcast(first), "file").where(F.col("ordinal") > F.col("_from")).drop("_from")  # one row per file
    elif fmt.skip >= 0:
        lines = lines.where(F.col("ordinal") > fmt.skip)
    if fmt.end_with:
        last = lines.where(F.col("line").contains(fmt.end_with)).groupBy("file").agg(F.min("ordinal").alias("_to"))
        lines = lines.join(F.broadcast(last), "file", "left").where(F.col("_to").isNull() | (F.col("ordinal") < F.col("_to"))).drop("_to")
    lines = lines.where(F.trim("line") != "")
    if fmt.comment:
        lines = lines.where(~F.col("line").startswith(fmt.comment))
    if fmt.keep_if:
        lines = lines.where(F.col("line").contains(fmt.keep_if))
    cells = F.split("line", "\t") if fmt.tsv else _split_csv(F.col("line"))
    lines = lines.withColumn("cells", F.transform(cells, lambda c: F.trim(c)))
    if fmt.must_have is not None:
        lines = lines.where(F.coalesce(F.get("cells", fmt.must_have) != "", F.lit(False)))
    return lines.where(~F.coalesce(F.get("cells", 0).isin(*HEADERS), F.lit(False)))


def read_table(spark: SparkSession, path: str | list[str], fmt: str | Format, *, infer: bool = True, numbered: bool = True) -> DataFrame:
    """List of a named or own format, with ``rid``, the row's place. Short rows give null keys.

    Without ``numbered``, ``rid`` is unique but counts from no file's beginning, and a format that skips
    nothing is read in one narrow pass without counting lines first.

    ``infer`` narrows each text column to BIGINT, DOUBLE or a locus if all its values allow it: one column
    has one type.
    """
    f = FORMATS[fmt] if isinstance(fmt, str) else fmt
    if f.special:
        return {"fasta": read_fasta, "hmmer_tbl": read_hmmer_tbl, "hmmer_domtbl": read_hmmer_domtbl}[f.special](spark, path)
    if f.sniff:
        names = sniff_header(spark, path, f)
        f = f.update(keys={n: str(i) for i, n in enumerate(names)})
    rows = data_lines(spark, path, f, numbered=numbered)
    made = [compile_key(e, F.col("cells")).alias(k) for k, e in f.keys.items()]
    if f.gtf is not None:
        pairs = F.regexp_extract_all(F.get("cells", f.gtf), F.lit(r'(\w+) "?([^";]*)"?'), 0)
        made.append(F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(\w+) ", 1), F.regexp_extract(p, r'^\w+ "?([^";]*)"?$', 1)))).alias("attributes"))
    out = rows.select(F.col("ordinal").alias("rid"), *made)
    return infer_types(out) if infer else out


def sniff_header(spark: SparkSession, path: str | list[str], fmt: Format) -> list[str]:
    """Keys from the first line of a file, which is looked for in the first splits only."""
    line = _split_lines(spark, path).where("block = 0").limit(1)
    cells = F.split("line", "\t") if fmt.tsv else _split_csv(F.col("line"))
    got = line.select(F.transform(cells, lambda c: F.trim(c))).first()
    return list(got[0]) if got else []


LOCUS_TEXT = r"^[^:]+:\d+-\d+$"


def infer_types(df: DataFrame) -> DataFrame:
    """Narrow text columns to BIGINT, DOUBLE or a locus, from one aggregate over all rows; blank values don't count and become null in numbers."""
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    if not texts:
        return df
    tests = []
    for c in texts:
        v = F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
        tests += [F.count(v), F.count(v.try_cast("bigint")), F.count(v.try_cast("double")), F.count(F.when(v.rlike(LOCUS_TEXT), 1))]
    counts = df.agg(*[t.alias(f"_{i}") for i, t in enumerate(tests)]).first()
    for k, c in enumerate(texts):
        some, whole, real, place = counts[4 * k : 4 * k + 4]
        col = F.col(f"`{c}`")
        if some and whole == some:
            df = df.withColumn(c, col.try_cast("bigint"))
        elif some and real == some:
            df = df.withColumn(c, col.try_cast("double"))
        elif some and place == some:
            df = df.withColumn(c, compile_key("text(0)", F.array(col)))
    return df


def read_expression(spark: SparkSession, path: str, keys: dict[str, int], first: int, last: int | None = None, *, tsv: bool = True, errors: str | None = None, nan_value: float = 0.0) -> tuple[DataFrame, list[str]]:
    """Matrix file: key columns, and the columns from ``first`` (to before ``last``) as ``conditions``; names come from the header.

    ``errors``: ``interleaved`` (each value followed by its error) or ``behind`` (all errors behind the values) give ``err`` as well, and
    names without ``mean_`` and ``err_``. What is no number counts as ``nan_value``.
    """
    if errors not in (None, "interleaved", "behind"):
        raise ValueError("errors must be interleaved or behind")
    f = Format(keys={k: str(i) for k, i in keys.items()}, tsv=tsv)
    names = sniff_header(spark, path, f)[first:last]
    rows = data_lines(spark, path, f)
    width = len(names)
    fill = F.lit(float(nan_value))
    values = F.transform(F.slice("cells", first + 1, width), lambda x: F.coalesce(F.nanvl(x.try_cast("double"), fill), fill))
    padded = F.slice(F.concat(values, F.array_repeat(fill, width)), 1, width)
    made = {"conditions": padded}
    if errors:
        places = (range(0, width, 2), range(1, width, 2)) if errors == "interleaved" else (range(width // 2), range(width // 2, width))
        made = {c: F.transform(F.array(*[F.lit(i) for i in at]), lambda i: F.get(padded, i)) for c, at in zip(("conditions", "err"), places)}
        names = [re.sub("^mean_", "", names[i]) for i in places[0]]
    ids = [] if "rid" in keys else [F.col("ordinal").alias("rid")]
    return rows.select(*ids, *[compile_key(str(i), F.col("cells")).alias(k) for k, i in keys.items()], *[v.alias(c) for c, v in made.items()]), names


def read_go(spark: SparkSession, path: str | list[str], fmt: str | Format) -> DataFrame:
    """List of enriched terms with ``qvalue`` or ``pvalue``; a ``~`` in a name becomes ``:``."""
    got = read_table(spark, path, fmt)
    if not {"qvalue", "pvalue"} & set(got.columns):
        raise ValueError("a list of terms needs a qvalue or a pvalue")
    return got.withColumn("name", F.translate("name", "~", ":"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``name, seq``: multi-line records joined, case kept."""
    text = spark.read.text(path, lineSep="\n>").where(F.trim("value") != "")
    text = text.select(F.regexp_replace("value", "^>", "").alias("value"))  # a `>` inside a header begins no record
    head = F.substring_index(F.regexp_replace("value", "\r\n?", "\n"), "\n", 1)
    return text.select(F.trim(head).alias("name"), F.regexp_replace(F.regexp_replace("value", "^[^\r\n]*", ""), "\\s", "").alias("seq"))


def read_fastq(spark: SparkSession, path: str | list[str], *, offset: int = 33) -> DataFrame:
    """``rec, id, seq, strand, qual``: records of four lines by line number (a quality line may begin with ``@``); incomplete ones at the end go."""
    lines = numbered_lines(spark, path)
    slot = lambda k: F.max(F.when(F.pmod("ordinal", F.lit(4)) == k, F.col("line")))
    recs = lines.groupBy("file", F.floor(F.col("ordinal") / 4).alias("rec")).agg(slot(0).alias("id"), slot(1).alias("seq"), slot(2).alias("strand"), slot(3).alias("q"))
    qual = F.transform(F.split("q", "(?!$)"), lambda c: F.ascii(c) - offset)
    return recs.where("q is not null").select("rec", "id", "seq", "strand", qual.alias("qual"))


def split_pairs_fastq(reads: DataFrame) -> DataFrame:
    """``pair, first, second``: interleaved reads whose ids agree in their first six fields; others are left out."""
    key = lambda c: F.concat_ws(":", F.slice(F.split(c, ":"), 1, 6))
    halves = reads.withColumn("pair", F.floor(F.col("rec") / 2)).groupBy("pair").agg(
        F.max(F.when(F.pmod("rec", F.lit(2)) == 0, F.struct("id", "seq", "qual"))).alias("first"), F.max(F.when(F.pmod("rec", F.lit(2)) == 1, F.struct("id", "seq", "qual"))).alias("second")
    )
    return halves.where(key(F.col("first.id")) == key(F.col("second.id")))


def pair_fastq(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of two files joined on their number."""
    a = first.select("rec", F.struct("id", "seq", "qual").alias("first"))
    return a.join(second.select("rec", F.struct("id", "seq", "qual").alias("second")), "rec")


def read_hmmer_tbl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    cells = F.split(F.trim("line"), "\\s+")
    rows = numbered_lines(spark, path).where(~F.col("line").contains("#") & (F.trim("line") != "")).withColumn("c", cells)
    return rows.select(
        F.get("c", 0).alias("peptide"), F.get("c", 3).alias("dom_acc"), F.get("c", 2).alias("dom_name"), F.get("c", 4).try_cast("double").alias("score"), F.nullif(F.regexp_extract("line", r"gene:(\S+)", 1), F.lit("")).alias("gene")
    )


def read_hmmer_domtbl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    cells = F.split(F.trim("line"), "\\s+")
    rows = numbered_lines(spark, path).where(~F.col("line").contains("#") & (F.trim("line") != "")).withColumn("c", cells)
    g = lambda i: F.get("c", i)
    return rows.select(
        g(0).alias("peptide"), g(4).alias("dom_acc"), g(3).alias("dom_name"), F.struct(g(17).cast("int").alias("start"), g(18).cast("int").alias("end")).alias("dom_loc"),
        g(6).try_cast("double").alias("e"), g(2).cast("int").alias("tlen"), g(5).cast("int").alias("qlen"), g(22).alias("gene"), g(22).alias("name"),
    )


def carried(df: DataFrame, value: Column, name: str, file: str = "file", order: str = "ordinal") -> DataFrame:
    """Add ``name``: the last non-null ``value`` up to each line of its file.

    Two levels, so that a huge file isn't one task: inside blocks of 65,536 lines, and across the blocks' last
    values.
    """
    blocked = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / 65_536))
    inside = Window.partitionBy(file, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = blocked.groupBy(file, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_last"))
    before = ends.withColumn("_carry", F.last("_last", ignorenulls=True).over(Window.partitionBy(file).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    joined = blocked.withColumn("_in", F.last("_v", ignorenulls=True).over(inside)).join(before, [file, "_b"])
    return joined.withColumn(name, F.coalesce("_in", "_carry")).drop("_v", "_b", "_in", "_carry")


def read_wig(spark: SparkSession, path: str | list[str], *, standard_only: bool = False) -> DataFrame:
    """``chrom, pos, span, score`` of variableStep and fixedStep lines; ``standard_only`` skips chromosomes with ``_``."""
    lines = numbered_lines(spark, path).where(~F.col("line").rlike("^(track|browser|#)") & (F.trim("line") != ""))
    part = lambda k, d: F.coalesce(F.nullif(F.regexp_extract("line", rf"\b{k}=(\S+)", 1), F.lit("")), F.lit(d))
    step = F.col("line").rlike("^(variableStep|fixedStep)")
    head = F.when(step, F.struct(F.col("line").startswith("fixed").alias("fixed"), part("chrom", None).alias("chrom"), part("start", "0").cast("bigint").alias("start"), part("step", "1").cast("bigint").alias("step"), part("span", "1").cast("bigint").alias("span"), F.col("ordinal").alias("at")))
    rows = carried(lines, head, "h").where(~step & F.col("h").isNotNull())
    number = F.col("ordinal") - F.col("h.at") - 1
    cells = F.split(F.trim("line"), "\\s+")
    pos = F.when(F.col("h.fixed"), F.col("h.start") + number * F.col("h.step")).otherwise(F.get(cells, 0).try_cast("bigint"))
    score = F.when(F.col("h.fixed"), F.get(cells, 0)).otherwise(F.get(cells, 1)).try_cast("double")
    out = rows.select(F.col("h.chrom").alias("chrom"), pos.alias("pos"), F.col("h.span").alias("span"), score.alias("score"))
    return out.where(~F.col("chrom").contains("_")) if standard_only else out


def read_homer_motifs(spark: SparkSession, path: str) -> DataFrame:
    """``name, word, score, matrix`` of ``>word  name  score`` records with one row of weights per place."""
    text = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    head = F.split(F.get(lines, 0), "\t")
    rows = F.transform(F.slice(lines, 2, 10_000), lambda x: F.transform(F.split(F.trim(x), "\\s+"), lambda y: y.try_cast("double")))
    return text.select(F.get(head, 1).alias("name"), F.get(head, 0).alias("word"), F.get(head, 2).try_cast("double").alias("score"), rows.alias("matrix"))


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A list from dicts; missing keys are null; keys keep their order of first appearance."""
    keys = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], keys) if rows else spark.createDataFrame([], "rid bigint")
