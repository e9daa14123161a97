"""Contact matrices as sparse rows ``chrom, i, j, score`` with i <= j over bins of one size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.loci import midpoint


def from_pairs(pairs: DataFrame, bin_size: int) -> DataFrame:
    """Bin pairs of positions (``chrom, left, right``) on one chromosome and sum them."""
    a, b = F.floor(F.col("left") / bin_size), F.floor(F.col("right") / bin_size)
    return pairs.groupBy("chrom", F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).agg(F.count(F.lit(1)).cast("double").alias("score"))


def load_triplets(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """``bin1, bin2, score`` with a table ``bin_id, chrom, left, right``: bins numbered by place on their chromosome, pairs across chromosomes dropped."""
    number = F.row_number().over(Window.partitionBy("chrom").orderBy("left")) - 1
    placed = bins.withColumn("n", number).select("bin_id", "chrom", "n")
    x = placed.select(F.col("bin_id").alias("bin1"), F.col("chrom").alias("c1"), F.col("n").alias("a"))
    y = placed.select(F.col("bin_id").alias("bin2"), F.col("chrom").alias("c2"), F.col("n").alias("b"))
    both = pixels.join(x, "bin1").join(y, "bin2").where("c1 = c2")
    return both.select(F.col("c1").alias("chrom"), F.least("a", "b").cast("bigint").alias("i"), F.greatest("a", "b").cast("bigint").alias("j"), F.col("score").cast("double").alias("score"))


def load_cooler_dump(rows: DataFrame, bin_size: int) -> DataFrame:
    """Rows ``chrom1, start1, end1, chrom2, start2, end2, count, balanced``; a blank balanced value is skipped."""
    good = rows.where((F.col("chrom1") == F.col("chrom2")) & F.col("balanced").try_cast("double").isNotNull())
    a, b = F.floor(F.col("start1").cast("bigint") / bin_size), F.floor(F.col("start2").cast("bigint") / bin_size)
    return good.select(F.col("chrom1").alias("chrom"), F.least(a, b).alias("i"), F.greatest(a, b).alias("j"), F.col("balanced").cast("double").alias("score"))


def read_hicpro(spark: SparkSession, matrix: str, bed: str) -> tuple[DataFrame, DataFrame]:
    """Pixels (``bin1, bin2, score``) and bins (``bin_id, chrom, left, right``) of a matrix file and its bed of bins, for ``load_triplets``."""
    pixels = spark.read.schema("bin1 bigint, bin2 bigint, score double").option("sep", "\t").csv(matrix)
    bins = spark.read.schema("chrom string, left bigint, right bigint, bin_id bigint").option("sep", "\t").csv(bed)
    return pixels, bins


def read_cooler(spark: SparkSession, path: str) -> DataFrame:
    """The eight columns of a dump of pixels, gz or not, for ``load_cooler_dump``."""
    names = ["chrom1", "start1", "end1", "chrom2", "start2", "end2", "count", "balanced"]
    return spark.read.schema(", ".join(f"{n} string" for n in names)).option("sep", "\t").csv(path).where("chrom1 <> 'chrom1'")


def save_contacts(contacts: DataFrame, path: str, bin_size: int) -> None:
    """Store a matrix, a folder per chromosome, with its bin size."""
    from loomspan.sources.store import write_info

    contacts.repartition("chrom", F.shiftright("i", 10)).sortWithinPartitions("chrom", "i", "j").write.mode("overwrite").partitionBy("chrom").parquet(f"{path}/pixels")
    write_info(contacts.sparkSession, path, bin_size=bin_size)


def open_contacts(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """A stored matrix and its bin size."""
    from loomspan.sources.store import read_info

    return spark.read.parquet(f"{path}/pixels").select("chrom", "i", "j", "score"), int(read_info(spark, path)["bin_size"])


def keys(contacts: DataFrame) -> DataFrame:
    """``chrom, bins, contacts``: what a matrix holds."""
    return contacts.groupBy("chrom").agg((F.max("j") + 1).alias("bins"), F.count(F.lit(1)).alias("contacts"))


def domains(tads: DataFrame, contacts: DataFrame, bin_size: int) -> DataFrame:
    """``chrom, left, right, inside, across``: contacts within each domain (``chrom, left, right``) and from it to elsewhere on the chromosome."""
    lo, hi = F.floor(F.col("left") / bin_size), F.floor(F.col("right") / bin_size)
    bins = tads.distinct().withColumn("lo", lo).withColumn("hi", hi).withColumn("bin", F.explode(F.sequence(lo, hi)))
    ends = contacts.select("chrom", "i", "j", "score", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("bin"))
    # a contact inside is met from both of its ends; the first one counts
    hits = bins.join(ends, ["chrom", "bin"]).withColumn("within", F.col("i").between(F.col("lo"), F.col("hi")) & F.col("j").between(F.col("lo"), F.col("hi")))
    once = hits.where(~F.col("within") | (F.col("bin") == F.col("i")))
    return once.groupBy("chrom", "left", "right").agg(F.sum(F.when(F.col("within"), F.col("score")).otherwise(0.0)).alias("inside"), F.sum(F.when(F.col("within"), 0.0).otherwise(F.col("score"))).alias("across"))


def region(contacts: DataFrame, chrom: str, left: int, right: int, bin_size: int) -> DataFrame:
    lo, hi = left // bin_size, right // bin_size
    return contacts.where((F.col("chrom") == chrom) & F.col("i").between(lo, hi) & F.col("j").between(lo, hi))


def observed_expected(contacts: DataFrame) -> DataFrame:
    """Add ``expected`` (mean of the non-zero scores at the same distance on the chromosome) and ``oe``."""
    d = (F.col("j") - F.col("i")).alias("d")
    means = contacts.where("score > 0").groupBy("chrom", d).agg(F.avg("score").alias("expected"))
    return contacts.withColumn("d", F.col("j") - F.col("i")).join(means, ["chrom", "d"]).withColumn("oe", F.col("score") / F.col("expected")).drop("d")


def compartments(contacts: DataFrame, chrom: str, bins: int) -> list[float]:
    """First eigenvector of the correlation of the observed/expected matrix of one chromosome.

    A dense matrix of ``bins`` squared on the driver (8 bytes an entry): meant for coarse bins, whose number follows
    the genome and not the reads.
    """
    import numpy as np

    m = np.zeros((bins, bins))
    for r in observed_expected(contacts.where(F.col("chrom") == chrom)).select("i", "j", "oe").toLocalIterator():
        m[r.i, r.j] = m[r.j, r.i] = r.oe
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.nan_to_num(np.corrcoef(m))
    values, vectors = np.linalg.eigh(c)
    first = vectors[:, values.argmax()]
    return (first * np.sign(first[np.abs(first).argmax()] or 1)).tolist()


def loop_strength(contacts: DataFrame, loops: DataFrame, bin_size: int, *, key: str = "rid", min_bins: int = 4, log2: bool = False) -> DataFrame:
    """``key, strength`` of loops with ``loc1`` and ``loc2`` on one chromosome, at least ``min_bins`` apart; no contact is 0."""
    a, b = F.floor(midpoint(F.col("loc1")) / bin_size), F.floor(midpoint(F.col("loc2")) / bin_size)
    where = loops.where((F.col("loc1.chrom") == F.col("loc2.chrom")) & (F.abs(a - b) >= min_bins)).select(key, F.col("loc1.chrom").alias("chrom"), F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))
    out = where.join(contacts, ["chrom", "i", "j"], "left").select(key, F.coalesce("score", F.lit(0.0)).alias("strength"))
    return out.withColumn("strength", F.log2(F.col("strength") + 0.01)) if log2 else out


def contact_probability(contacts: DataFrame, low: int, high: int, *, skip: tuple[str, ...] = ("chrY",), anchors: DataFrame | None = None) -> DataFrame:
    """``d, total``: contacts by distance in bins, low <= d < high, from every bin or from both sides of the anchor bins (``chrom, bin``)."""
    d = F.col("j") - F.col("i")
    rows = contacts.where(~F.col("chrom").isin(*skip) & (d >= low) & (d < high)).withColumn("d", d)
    if anchors is not None:
        once = anchors.select("chrom", "bin").distinct()
        ends = rows.select("chrom", "d", "score", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("bin"))
        rows = ends.join(once, ["chrom", "bin"], "left_semi")
    return rows.groupBy("d").agg(F.sum("score").alias("total"))


def anchor_pile(contacts: DataFrame, anchors: DataFrame, reach: int) -> DataFrame:
    """``di, dj, mean``: average submatrix within ``reach`` bins around anchors (``chrom, bin``), both triangles."""
    full = contacts.unionByName(contacts.where("i < j").select("chrom", F.col("j").alias("i"), F.col("i").alias("j"), "score"))
    near = anchors.select("chrom", "bin", F.explode(F.sequence(F.col("bin") - reach, F.col("bin") + reach)).alias("i"))
    hits = full.join(near, ["chrom", "i"]).where(F.abs(F.col("j") - F.col("bin")) <= reach)
    sums = hits.groupBy((F.col("i") - F.col("bin")).alias("di"), (F.col("j") - F.col("bin")).alias("dj")).agg(F.sum("score").alias("s"))
    return sums.select("di", "dj", (F.col("s") / anchors.agg(F.count(F.lit(1))).scalar()).alias("mean"))


def merge_matrices(matrices: list[DataFrame]) -> DataFrame:
    """Mean of matrices of one resolution; a missing contact is 0."""
    stacked = matrices[0]
    for m in matrices[1:]:
        stacked = stacked.unionByName(m)
    return stacked.groupBy("chrom", "i", "j").agg((F.sum("score") / len(matrices)).alias("score"))


def correlate(x: DataFrame, y: DataFrame) -> DataFrame:
    """``chrom, r`` of two matrices over the contacts either has; a missing contact is 0."""
    a = x.select("chrom", "i", "j", F.col("score").alias("a"))
    b = y.select("chrom", "i", "j", F.col("score").alias("b"))
    both = a.join(b, ["chrom", "i", "j"], "full_outer").na.fill(0.0, ["a", "b"])
    return both.groupBy("chrom").agg(F.corr("a", "b").alias("r"))


def dense_rows(contacts: DataFrame, chrom: str, bins: int) -> DataFrame:
    """``i, values``: symmetric dense rows of one chromosome, for export."""
    one = contacts.where(F.col("chrom") == chrom)
    full = one.select("i", "j", "score").unionByName(one.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "score"))
    entries = full.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "score"))).alias("m"))
    row = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint")), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)))
    return entries.select("i", row.alias("values"))


def pca_of(contacts: DataFrame, chrom: str, bins: int, k: int) -> DataFrame:
    """``i, scores`` of the principal components of log2(score + 0.1) of one chromosome's rows."""
    return components_of(contacts, chrom, bins, k)[0]


def components_of(contacts: DataFrame, chrom: str, bins: int, k: int) -> tuple[DataFrame, list[float]]:
    """``i, scores`` as in ``pca_of``, and the percent of the variance that each component holds."""
    from loomspan.operators.learn import pca

    rows = dense_rows(contacts, chrom, bins).select("i", F.transform("values", lambda x: F.log2(x + 0.1)).alias("conditions"))
    scores, _, explained = pca(rows, k)
    return scores.select("i", "scores"), [100.0 * float(e) for e in explained]


def embed_bins(contacts: DataFrame, chrom: str, bins: int, *, method: str = "tsne", **options) -> DataFrame:
    """Bins of one chromosome placed in the plane by ``learn.embed``; the number of bins follows the genome."""
    from loomspan.operators.learn import embed

    rows = dense_rows(contacts, chrom, bins).select("i", F.transform("values", lambda x: F.log2(x + 0.1)).alias("conditions"))
    return embed(rows, "i", method, **options)
