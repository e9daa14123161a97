"""Mass-spec tables (long form: one row per protein and sample) and qPCR sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.matrix import fold

#: Name prefixes of contaminating proteins by species.
CONTAMINANTS = {
    "Hs": ["RPL", "RPS", "TUB", "GAPDH", "ACT", "MRPS", "sm-", "MYH", "FLN", "MYO", "APOA1", "MYL", "IGHG", "IGLV", "IGHV", "IGKV", "COL", "KRT", "EIF", "ATP"],
    "Mm": ["Rpl", "Rps", "Tub", "Gapdh", "Act", "Myh", "Ighg", "Iglv", "Col", "Golga", "Kif", "Myl", "Krt", "Eif", "Vim", "Atp", "Igkv", "Ighv"],
}


def _wide(spark: SparkSession, path: str | list[str], mark: str) -> tuple[DataFrame, list[str]]:
    """Rows of tab-separated files as ``cells``, and the header that holds ``mark``; files of one call have one header."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").contains(mark)).limit(1).collect()
    if not head:
        raise ValueError(f"no header with {mark!r}")
    return lines.where(~F.col("value").contains(mark) & (F.trim("value") != "")).select(F.split("value", "\t").alias("cells")), [x.strip() for x in head[0][0].strip().split("\t")]


def read_maxquant(spark: SparkSession, path: str | list[str], *, lfq: bool = False, split_names: bool = True) -> DataFrame:
    """``name, pid, sample, intensity, peptides`` of protein group tables; see ``melt``.

    Samples are found by their ``Razor + unique peptides`` columns; ``lfq`` takes the normalised intensities. Groups without a
    gene name go. Pids are the majority ids where there are any, else the group's.
    """
    rows, head = _wide(spark, path, "Protein IDs")
    kind = "LFQ intensity" if lfq else "Intensity"
    samples = [h.replace("Razor + unique peptides ", "") for h in head if h.startswith("Razor + unique peptides ")]
    wanted = ["Gene names", "Majority protein IDs" if "Majority protein IDs" in head else "Protein IDs", *[f"{k} {s}" for s in samples for k in (kind, "Razor + unique peptides")]]
    wide = rows.select(*[F.get("cells", head.index(c)).alias(c) for c in wanted if c in head])
    samples = [s for s in samples if f"{kind} {s}" in head]
    return melt(wide, samples, name="Gene names", pid=wanted[1], intensity=kind + " {}", split_names=split_names)


def read_company(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``read_maxquant``, of tables headed ``Protein accession`` with the name in the third column; short rows and blank cells count as 0."""
    rows, head = _wide(spark, path, "Protein accession")
    samples = [h.replace("Razor + unique peptides ", "") for h in head if h.startswith("Razor + unique peptides ") and h.replace("Razor + unique peptides ", "Intensity ") in head]
    cell = lambda i: F.coalesce(F.nullif(F.get("cells", i), F.lit("")), F.lit("0"))
    wide = rows.select(F.get("cells", 0).alias("pid"), F.get("cells", 2).alias("name"), *[cell(head.index(c)).alias(c) for s in samples for c in (f"Intensity {s}", f"Razor + unique peptides {s}")])
    return melt(wide, samples, split_names=False)


def read_company_samples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``read_company``, one file per sample, named by its file: accession, name, peptides and intensity in columns 0, 2, 6 and 9."""
    lines = spark.read.text(path).where(~F.col("value").contains("Accession") & (F.trim("value") != ""))
    sample = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.(txt|tsv)(\.gz)?$", "")
    cells = lines.select(sample.alias("sample"), F.split("value", "\t").alias("c"))
    number = lambda i: F.coalesce(F.get("c", i).try_cast("double"), F.lit(0.0))
    rows = cells.select(F.get("c", 2).alias("name"), F.get("c", 0).alias("pid"), "sample", (number(9) / 1e6).alias("i"), number(6).alias("p")).where("name <> ''")
    return rows.groupBy("name", "sample").agg(F.min("pid").alias("pid"), F.avg("i").alias("intensity"), F.avg(F.floor("p")).alias("peptides")).select("name", "pid", "sample", "intensity", "peptides")


def melt(wide: DataFrame, samples: list[str], *, name: str = "name", pid: str = "pid", intensity: str = "Intensity {}", peptides: str = "Razor + unique peptides {}", split_names: bool = True) -> DataFrame:
    """``name, pid, sample, intensity, peptides``: wide search-engine columns to rows, intensity in millions.

    Ambiguous groups (``a;b``) give one row per name and its pid; duplicates per sample are averaged.
    """
    rows = F.array(*[F.struct(F.lit(s).alias("sample"), F.col(intensity.format(s)).try_cast("double").alias("i"), F.col(peptides.format(s)).try_cast("double").alias("p")) for s in samples])
    names = F.split(F.col(name), ";") if split_names else F.array(name)
    pids = F.split(F.col(pid), ";") if split_names else F.array(pid)
    out = wide.select(F.explode(F.arrays_zip(names.alias("n"), pids.alias("p"))).alias("z"), rows.alias("r"))
    first, second = out.schema["z"].dataType.names
    flat = out.select(F.col(f"z.{first}").alias("name"), F.col(f"z.{second}").alias("pid"), F.inline("r")).where("name is not null and name <> ''")
    return flat.groupBy("name", "pid", "sample").agg((F.avg("i") / 1e6).alias("intensity"), F.avg("p").alias("peptides"))


def keep_specific(df: DataFrame, *, least_peptides: float, least_intensity: float, species: str = "Hs", remove_fusions: bool = True, name: str = "name") -> DataFrame:
    """Rows of proteins with enough peptides and intensity in some sample, no fusions (``-`` in the name), no contaminants."""
    plain = F.lit(True)
    if remove_fusions:
        plain = plain & ~F.col(name).contains("-")
    for p in CONTAMINANTS[species]:
        plain = plain & ~F.col(name).startswith(p)
    good = df.where(plain).groupBy(name).agg(F.max("peptides").alias("_p"), F.max("intensity").alias("_i")).where((F.col("_p") >= least_peptides) & (F.col("_i") >= least_intensity))
    return df.join(good.select(F.col(name).alias("_n")), F.col(name) == F.col("_n"), "left_semi")


def call(df: DataFrame, scheme: dict[str, list[str]], *, threshold: float = 1.0, pad: float = 0.1, cull: bool = True, name: str = "name") -> DataFrame:
    """``name, sample, intensity, fold_change, called``: samples against their control; fold change as log2, called from the threshold.

    The scheme names controls and their samples. Controls keep a fold change of 0 and no call. With ``cull``
    proteins without any call go.
    """
    of = {s: c for c, some in scheme.items() for s in some}
    pairs = F.create_map(*[x for s, c in of.items() for x in (F.lit(s), F.lit(c))])
    controls = df.where(F.col("sample").isin(*scheme)).select(F.col(name).alias("_n"), F.col("sample").alias("_c"), F.col("intensity").alias("_base"))
    tested = df.where(F.col("sample").isin(*of)).withColumn("_ctrl", F.try_element_at(pairs, "sample"))
    joined = tested.join(controls, (F.col(name) == F.col("_n")) & (F.col("_ctrl") == F.col("_c")), "left")
    change = fold(F.coalesce("_base", F.lit(0.0)) + pad, F.coalesce("intensity", F.lit(0.0)) + pad)
    out = joined.select(name, "sample", "intensity", change.alias("fold_change")).withColumn("called", F.col("fold_change") >= threshold)
    rest = df.where(F.col("sample").isin(*scheme)).select(name, "sample", "intensity", F.lit(0.0).alias("fold_change"), F.lit(None).cast("boolean").alias("called"))
    whole = out.unionByName(rest)
    if not cull:
        return whole
    called = out.where("called").select(F.col(name).alias("_n")).distinct()
    return whole.join(called, F.col(name) == F.col("_n"), "left_semi")


def merge_replicates(df: DataFrame, groups: dict[str, list[str]], *, name: str = "name") -> DataFrame:
    """Replicates to one sample: largest intensity, peptides and fold change, any call."""
    of = F.create_map(*[x for g, some in groups.items() for s in some for x in (F.lit(s), F.lit(g))])
    merged = df.withColumn("sample", F.coalesce(F.try_element_at(of, "sample"), F.col("sample")))
    kept = {"intensity": F.max, "peptides": F.max, "fold_change": F.max, "called": F.bool_or}
    return merged.groupBy(name, "sample").agg(*[f(c).alias(c) for c, f in kept.items() if c in df.columns])


def wide(df: DataFrame, samples: list[str], *, name: str = "name", pid: str | None = "pid") -> DataFrame:
    """One row per protein: intensity, peptides, call and fold change of every sample, those that the table has; absent ones are null."""
    kept = [c for c in ("intensity", "peptides", "called", "fold_change") if c in df.columns]
    at = lambda c, s: F.max(F.when(F.col("sample") == s, F.col(c))).alias(f"{c}_{s}")
    first = [F.min(pid).alias(pid)] if pid and pid in df.columns else []
    return df.groupBy(name).agg(*first, *[at(c, s) for s in samples for c in kept])


def call_code(called: Column) -> Column:
    """Calls as numbers: unknown 0.1, true 1, false 0."""
    return F.when(called.isNull(), 0.1).when(called, 1.0).otherwise(0.0)


def called_venn(df: DataFrame, a: str, b: str, *, name: str = "name") -> DataFrame:
    """``left_only, overlap, right_only``: proteins called in two samples."""
    flags = df.where(F.col("called")).groupBy(name).agg(F.bool_or(F.col("sample") == a).alias("x"), F.bool_or(F.col("sample") == b).alias("y"))
    return flags.agg(F.count_if(F.col("x") & ~F.col("y")).alias("left_only"), F.count_if(F.col("x") & F.col("y")).alias("overlap"), F.count_if(F.col("y") & ~F.col("x")).alias("right_only"))


def bait_edges(df: DataFrame, baits: dict[str, str], *, name: str = "name") -> DataFrame:
    """``bait, prey``: edges of the called proteins of each sample's bait."""
    of = F.create_map(*[x for s, b in baits.items() for x in (F.lit(s), F.lit(b))])
    return df.where(F.col("called")).select(F.try_element_at(of, "sample").alias("bait"), F.col(name).alias("prey")).where("bait is not null").distinct()


def qpcr_table(rows: DataFrame, *, missing: float = 35.0) -> DataFrame:
    """``sample, primer, mean, std, n`` of cycle rows ``sample, primer, ct, ok``; failed ones count as ``missing``."""
    ct = F.when(F.col("ok") & F.col("ct").isNotNull(), F.col("ct")).otherwise(missing)
    return rows.groupBy("sample", "primer").agg(F.avg(ct).alias("mean"), F.stddev_pop(ct).alias("std"), F.count(F.lit(1)).alias("n"))


def qpcr_normalise(rows: DataFrame, controls: list[str], *, missing: float = 35.0, fudge: float = 20.0) -> DataFrame:
    """``sample, primer, value``: mean over control primers of fudge + control - ct.

    Replicates that spread by more than 2 are missing; samples with a missing control and primers missing
    everywhere go.
    """
    t = qpcr_table(rows, missing=missing).withColumn("ct", F.when(F.col("std") > 2, missing).otherwise(F.col("mean")))
    ctrl = t.where(F.col("primer").isin(*controls)).groupBy("sample").agg(F.max("ct").alias("worst"), F.avg("ct").alias("ctrl")).where(F.col("worst") < missing)
    seen = t.groupBy("primer").agg(F.min("ct").alias("best")).where(F.col("best") < missing)
    kept = t.join(ctrl, "sample").join(seen, "primer", "left_semi")
    return kept.select("sample", "primer", (fudge + F.col("ctrl") - F.col("ct")).alias("value"))


def biomark_cycles(lines: DataFrame, *, prefix: str = "", omit: list[str] = ()) -> DataFrame:
    """``sample, primer, ct, ok`` of the data rows (first cell like ``S01-A01``) of a qPCR sheet given as ``cells`` arrays.

    Cells: chamber, sample, type, dilution, primer, kind, value, quality, call (Pass or Fail).
    """
    g = lambda i: F.trim(F.get("cells", i))
    rows = lines.where(F.get("cells", 0).rlike(r"^S\d+-A\d+$"))
    out = rows.select(F.concat(F.lit(prefix), g(1)).alias("sample"), g(4).alias("primer"), g(6).try_cast("double").alias("ct"), (F.lower(g(8)) != "fail").alias("ok"))
    return out.where(~F.col("sample").isin(*omit)) if omit else out


def to_arrays(df: DataFrame, samples: list[str], *, name: str = "name") -> DataFrame:
    """``name`` with one array per measure, in the order of the samples; absent entries are null."""
    kinds = [c for c in ("intensity", "peptides", "called", "fold_change") if c in df.columns]
    pick = lambda c, s: F.max(F.when(F.col("sample") == s, F.col(c)))
    return df.groupBy(name).agg(*[F.array(*[pick(c, s) for s in samples]).alias(c) for c in kinds])
