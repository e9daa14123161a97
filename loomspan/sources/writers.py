"""Writers: every one makes the lines as a column and writes text in parallel; ``single`` asks for one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.loci import to_text
from loomspan.operators.matrix import V


def _text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if kind.typeName() == "struct" and {"chrom", "left", "right"} <= set(kind.names):
        return to_text(F.col(name))
    if kind.typeName() in ("array", "map", "struct"):
        return F.to_json(name)
    return F.col(name).cast("string")


def _write(lines: DataFrame, path: str, single: bool, gzip: bool) -> None:
    out = lines.coalesce(1) if single else lines
    out.write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def write_delimited(df: DataFrame, path: str, *, sep: str = ",", key_order: list[str] = (), header: bool = True, single: bool = False, gzip: bool = False) -> None:
    """CSV or TSV: ``key_order`` first, then the other keys; missing values are empty, loci are text."""
    keys = [*key_order, *[c for c in df.columns if c not in key_order]]
    flat = df.select(*[_text(df, k).alias(k) for k in keys])
    out = flat.coalesce(1) if single else flat
    out.write.mode("overwrite").option("header", header).option("sep", sep).option("emptyValue", "").option("compression", "gzip" if gzip else "none").csv(path)


def write_matrix(df: DataFrame, names: list[str], path: str, *, sep: str = "\t", err: str | None = None, interleave: bool = True, **options) -> None:
    """Matrix with its keys first; errors beside each value (``mean_X, err_X``) or behind all (``err_X``)."""
    keys = [c for c in df.columns if c not in (V, err)]
    values = [F.col(V)[i] for i in range(len(names))]
    if err and interleave:
        cols = [c for i, n in enumerate(names) for c in (values[i].alias(f"mean_{n}"), F.col(err)[i].alias(f"err_{n}"))]
    else:
        cols = [v.alias(n) for v, n in zip(values, names)] + ([F.col(err)[i].alias(f"err_{n}") for i, n in enumerate(names)] if err else [])
    write_delimited(df.select(*keys, *cols), path, sep=sep, **options)


def fasta_lines(df: DataFrame, names: list[str], seq: str = "seq") -> DataFrame:
    head = F.concat_ws("_", *[_text(df, n) for n in names]) if names else F.concat(F.lit("null_"), F.monotonically_increasing_id().cast("string"))
    return df.select(F.concat(F.lit(">"), head, F.lit("\n"), F.col(seq)).alias("value"))


def write_fasta(df: DataFrame, path: str, names: list[str], *, seq: str = "seq", single: bool = False, gzip: bool = False) -> None:
    _write(fasta_lines(df, names, seq), path, single, gzip)


def bed_lines(df: DataFrame, *, name: str | None = None, score: str | None = None, strand: str | None = None, extra: list[str] = (), loc_only: bool = False, unique: str | None = None, loc_key: str = "loc") -> DataFrame:
    """chrom, left, right, name or 0, score or 0, strand or +, extra keys; ``unique`` appends a row id to the name."""
    cells = [F.col(f"{loc_key}.chrom"), F.col(f"{loc_key}.left").cast("string"), F.col(f"{loc_key}.right").cast("string")]
    if not loc_only:
        label = F.coalesce(F.col(name).cast("string"), F.lit("0")) if name else F.lit("0")
        if unique:
            label = F.concat(label, F.lit("-"), F.col(unique).cast("string"))
        cells += [label, F.coalesce(F.col(score).cast("string"), F.lit("0")) if score else F.lit("0"), F.coalesce(F.col(strand), F.lit("+")) if strand else F.lit("+")]
        cells += [F.coalesce(_text(df, k), F.lit("")) for k in extra]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def write_bed(df: DataFrame, path: str, *, single: bool = False, gzip: bool = False, **options) -> None:
    _write(bed_lines(df, **options), path, single, gzip)


def gtf_lines(df: DataFrame, *, source: str = "source", feature: str = "exon", score: str | None = None, strand: str | None = None, loc_key: str = "loc") -> DataFrame:
    """Nine columns; the other keys become attributes ``key "value"; ``."""
    used = {loc_key, score, strand}
    pairs = [F.concat(F.lit(f'{k} "'), F.coalesce(_text(df, k), F.lit("")), F.lit('"; ')) for k in df.columns if k not in used]
    cells = [
        F.col(f"{loc_key}.chrom"), F.lit(source), F.lit(feature), F.col(f"{loc_key}.left").cast("string"), F.col(f"{loc_key}.right").cast("string"),
        F.coalesce(F.col(score).cast("string"), F.lit(".")) if score else F.lit("."), F.coalesce(F.col(strand), F.lit(".")) if strand else F.lit("."), F.lit("."), F.trim(F.concat(*pairs)) if pairs else F.lit(""),
    ]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def write_gtf(df: DataFrame, path: str, *, single: bool = False, gzip: bool = False, **options) -> None:
    _write(gtf_lines(df, **options), path, single, gzip)


def fastq_lines(reads: DataFrame, *, offset: int = 33) -> DataFrame:
    qual = F.array_join(F.transform("qual", lambda q: F.char(q + offset)), "")
    return reads.select(F.concat_ws("\n", "id", "seq", F.lit("+"), qual).alias("value"))


def write_fastq(reads: DataFrame, path: str, *, single: bool = False, gzip: bool = False) -> None:
    _write(fastq_lines(reads), path, single, gzip)


def write_track(track: DataFrame, path: str) -> None:
    """Runs as Parquet, one folder per chromosome."""
    track.repartition("chrom", F.shiftright("start", 24)).sortWithinPartitions("chrom", "start").write.mode("overwrite").partitionBy("chrom").parquet(path)


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def motif_lines(motifs: DataFrame) -> DataFrame:
    """``name, word, score, matrix`` as text records with one line of weights per place, rows normalised to sum 1."""
    row = lambda r: F.array_join(F.transform(r, lambda x: F.format_string("%.3f", x / F.aggregate(r, F.lit(0.0), lambda a, b: a + b))), "\t")
    head = F.concat_ws("\t", F.concat(F.lit(">"), F.col("word")), "name", F.col("score").cast("string"))
    return motifs.select(F.concat_ws("\n", head, F.array_join(F.transform("matrix", row), "\n")).alias("value"))
