"""Sequences, degenerate motifs and position weight matrices."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.loci import MINUS
from loomspan.session import chunks, column

#: Letters of the degenerate alphabet and the bases they stand for.
DEGENERATE = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
_PLAIN, _TURNED = "ACGTNacgtn", "TGCANtgcan"
_FULL, _FULL_TURNED = "ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"


def rc(seq: Column, *, degenerate: bool = False) -> Column:
    """Reverse complement; other letters stay as they are."""
    return F.reverse(F.translate(seq, _FULL if degenerate else _PLAIN, _FULL_TURNED if degenerate else _TURNED))


def rc_word(word: str) -> str:
    return word.translate(str.maketrans(_FULL, _FULL_TURNED))[::-1]


def is_palindromic(seq: Column) -> Column:
    return rc(seq) == seq


def gc_content(seq: Column) -> Column:
    """Share of G and C, 0 for an empty sequence."""
    return F.coalesce(F.try_divide(F.regexp_count(F.upper(seq), F.lit("[GC]")), F.length(seq)), F.lit(0.0))


def to_regex(word: str) -> str:
    return "".join(b if len(b := DEGENERATE[c]) == 1 else f"[{b}]" for c in word.upper())


def mismatch_regexes(word: str) -> list[str]:
    """Patterns with any base in one place each."""
    return [to_regex(word[:i]) + "[ACGT]" + to_regex(word[i + 1 :]) for i in range(len(word))]


def expand_word(word: str) -> list[str]:
    """All concrete words of a degenerate one."""
    return ["".join(x) for x in itertools.product(*[DEGENERATE[c] for c in word.upper()])]


def library(length: int) -> list[str]:
    return ["".join(x) for x in itertools.product("ACGT", repeat=length)]


def permute_one(word: str) -> list[str]:
    """All words that differ in exactly one base."""
    return [word[:i] + b + word[i + 1 :] for i in range(len(word)) for b in "ACGT" if b != word[i]]


def both_strands(word: str, strands: bool = True) -> str:
    back = rc_word(word.upper())
    return to_regex(word) if not strands or back == word.upper() else f"{to_regex(word)}|{to_regex(back)}"


def motif_count(seq: Column, word: str, *, strands: bool = True) -> Column:
    """Non-overlapping matches, forward and, for words that aren't palindromes, backward."""
    up = F.upper(seq)
    n = F.regexp_count(up, F.lit(to_regex(word)))
    back = rc_word(word.upper())
    return n + F.regexp_count(up, F.lit(to_regex(back))) if strands and back != word.upper() else n


def motif_flags(df: DataFrame, word: str, name: str, *, seq: str = "seq", strands: bool = True, found_only: bool = False) -> DataFrame:
    """Add ``name`` (Found or None) and ``name_seqs`` (the matches)."""
    up = F.upper(F.col(seq))
    hits = F.regexp_extract_all(up, F.lit(f"({to_regex(word)})"), 1)
    back = rc_word(word.upper())
    if strands and back != word.upper():
        hits = F.concat(hits, F.regexp_extract_all(up, F.lit(f"({to_regex(back)})"), 1))
    out = df.withColumn(f"{name}_seqs", hits).withColumn(name, F.when(F.size(f"{name}_seqs") > 0, "Found").otherwise("None"))
    return out.where(F.col(name) == "Found") if found_only else out


def motif_summary(df: DataFrame, word: str, *, seq: str = "seq", strands: bool = True) -> DataFrame:
    """``num_motifs, with_motif, percent`` over all sequences."""
    n = motif_count(F.col(seq), word, strands=strands)
    s = df.agg(F.sum(n).alias("num_motifs"), F.sum((n > 0).cast("bigint")).alias("with_motif"), F.count(F.lit(1)).alias("_n"))
    return s.select("num_motifs", "with_motif", F.try_divide(F.col("with_motif") * 100.0, F.col("_n")).alias("percent"))


def _codes(text: str) -> np.ndarray:
    """Code points of a text, one per letter."""
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _allowed(word: str) -> np.ndarray:
    """For each place of a degenerate word, which of the first 128 code points fit; what is beyond fits none."""
    out = np.zeros((len(word), 129), bool)
    for i, letter in enumerate(word.upper()):
        out[i, [ord(b) for b in DEGENERATE[letter]]] = True
    return out


def motif_positions(df: DataFrame, word: str, *, key: str, seq: str = "seq", strands: bool = True) -> DataFrame:
    """``key, pos, strand, match``: every place, overlaps included, counted from 0.

    Sequences are matched as vectors, in time proportional to their length. Null and short sequences give none.
    """
    size, back = len(word), rc_word(word.upper())
    sides = [("+", _allowed(word))] + ([("-", _allowed(back))] if strands and back != word.upper() else [])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(iter(batches), 2_000):
            rows, pos, strand, match = [], [], [], []
            for i, text in enumerate(column(table, "s").to_pylist()):
                code = np.minimum(_codes(text), 128)
                n = len(code) - size + 1
                if n <= 0:
                    continue
                for sign, fits in sides:
                    good = np.ones(n, bool)
                    for k in range(size):
                        good &= fits[k, code[k : k + n]]
                    at = np.flatnonzero(good)
                    rows.append(np.full(len(at), i))
                    pos.append(at)
                    strand += [sign] * len(at)
                    match += [text[p : p + size] for p in at.tolist()]
            place = np.concatenate(rows) if rows else np.zeros(0, int)
            at = np.concatenate(pos) if pos else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([column(table, "k").take(pa.array(place)), pa.array(at.astype(np.int32)), pa.array(strand, pa.string()), pa.array(match, pa.string())], names=[key, "pos", "strand", "match"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.length(seq) >= size).select(F.col(key).alias("k"), F.upper(seq).alias("s"))
    return rows.mapInArrow(scan, f"`{key}` {kind}, pos int, strand string, match string")


def position_profile(df: DataFrame, word: str, *, key: str, seq: str = "seq", strands: bool = True) -> DataFrame:
    """``pos, count`` of matches by place."""
    return motif_positions(df, word, key=key, seq=seq, strands=strands).groupBy("pos").agg(F.count(F.lit(1)).alias("count"))


def kmer_counts(df: DataFrame, k: int, *, seq: str = "seq") -> DataFrame:
    """``kmer, count`` over all sequences, case kept. Words are counted per batch of sequences on the workers, then added up."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(iter(batches), 2_000):
            texts = [t for t in column(table, "s").to_pylist() if len(t) >= k]
            if not texts:
                continue
            letters, code = np.unique(np.concatenate([_codes(t) for t in texts]), return_inverse=True)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            first = np.repeat(np.cumsum(size) - size, size - k + 1)
            start = first + np.arange(len(first)) - np.repeat(np.cumsum(size - k + 1) - (size - k + 1), size - k + 1)
            base = len(letters)
            if base**k < 1 << 62:
                packed = np.zeros(len(start), np.int64)
                for i in range(k):
                    packed = packed * base + code[start + i]
                words, n = np.unique(packed, return_counts=True)
                digits = np.stack([words // base ** (k - 1 - i) % base for i in range(k)], axis=1)
                names = ["".join(map(chr, row)) for row in letters[digits].tolist()]
            else:
                whole = "".join(texts)
                words, n = np.unique(np.array([whole[p : p + k] for p in start.tolist()]), return_counts=True)
                names = words.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n.astype(np.int64))], names=["kmer", "n"])

    some = df.where(F.length(seq) >= k).select(F.col(seq).alias("s"))
    return some.mapInArrow(count, "kmer string, n bigint").groupBy("kmer").agg(F.sum("n").alias("count"))


def base_frequencies(df: DataFrame, *, seq: str = "seq") -> DataFrame:
    """``pos, base, count, share, bits``: aligned sequences by place; bits is the information content of the place."""
    letters = df.select(F.posexplode(F.split(F.upper(seq), "(?!$)")).alias("pos", "base"))
    counts = letters.where(F.col("base").isin("A", "C", "G", "T")).groupBy("pos", "base").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("pos").agg(F.sum("count").alias("_n"))
    shares = counts.join(totals, "pos").withColumn("share", F.col("count") / F.col("_n"))
    bits = shares.groupBy("pos").agg((2 + F.sum(F.col("share") * F.log2("share"))).alias("bits"))
    return shares.join(bits, "pos").select("pos", "base", "count", "share", "bits")


def count_matrix(df: DataFrame, *, seq: str = "seq") -> list[list[float]]:
    """Base counts (A C G T) by place of aligned sequences, for ``counts_to_weights``; a row per place of the motif."""
    found = {(r.pos, r.base): float(r["count"]) for r in base_frequencies(df, seq=seq).select("pos", "base", "count").collect()}
    return [[found.get((p, b), 0.0) for b in "ACGT"] for p in range(max((p for p, _ in found), default=-1) + 1)]


def counts_to_weights(counts: list[list[float]]) -> list[list[float]]:
    """log2 of (f + sqrt(N) / 4) / (N + sqrt(N)) / 0.25 for a matrix of base counts (rows are places; A C G T)."""
    out = []
    for row in counts:
        n = sum(row)
        root = math.sqrt(n)
        out.append([math.log2((f + root * 0.25) / (n + root) / 0.25) for f in row])
    return out


def score_limits(weights: list[list[float]]) -> tuple[float, float]:
    return sum(map(min, weights)), sum(map(max, weights))


_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def window_scores(seq: str, weights: np.ndarray, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Normalised scores by start place, forward and backward; windows with another letter than ACGT score 0.

    ``last=False`` leaves out the last window.
    """
    size = len(weights)
    low, high = weights.min(axis=1).sum(), weights.max(axis=1).sum()
    code = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = len(code) - size + (1 if last else 0)
    if n <= 0:
        return np.zeros(0), np.zeros(0)
    wide = np.lib.stride_tricks.sliding_window_view(code, size)[:n]
    good = (wide < 4).all(axis=1)
    safe = np.where(wide < 4, wide, 0)
    place = np.arange(size)
    forward = weights[place, safe].sum(axis=1)
    backward = weights[::-1, ::-1][place, safe].sum(axis=1)
    norm = lambda s: np.where(good, (s - low) / (high - low), 0.0)
    return norm(forward), norm(backward)


def pwm_hits(df: DataFrame, weights: list[list[float]], *, key: str, seq: str = "seq", threshold: float = 0.75, last: bool = True) -> DataFrame:
    """``key, pos, strand, score``: windows over the threshold on either strand; null and short sequences give none."""
    matrix = np.array(weights, float)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(iter(batches), 10_000):
            ids, pos, strand, score = [], [], [], []
            for i, text in enumerate(column(table, "s").to_pylist()):
                for sign, s in zip("+-", window_scores(text, matrix, last)):
                    at = np.flatnonzero(s > threshold)
                    ids.append(np.full(len(at), i))
                    pos.append(at)
                    strand += [sign] * len(at)
                    score.append(s[at])
            place = np.concatenate(ids) if ids else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([column(table, "k").take(pa.array(place)), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(strand, pa.string()), pa.array(np.concatenate(score))], names=[key, "pos", "strand", "score"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(seq).isNotNull()).select(F.col(key).alias("k"), F.col(seq).alias("s")).mapInArrow(scan, f"`{key}` {kind}, pos int, strand string, score double")


def best_score(df: DataFrame, weights: list[list[float]], *, key: str, seq: str = "seq") -> DataFrame:
    """``key, score``: best window of each sequence on either strand, reduced where it is scored; ``key`` is unique, sequences without a window go."""
    matrix = np.array(weights, float)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(iter(batches), 10_000):
            best = [max(map(np.max, both)) if len(both[0]) else None for both in (window_scores(t, matrix) for t in column(table, "s").to_pylist())]
            yield pa.RecordBatch.from_arrays([column(table, "k"), pa.array(best, pa.float64())], names=[key, "score"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(seq).isNotNull()).select(F.col(key).alias("k"), F.col(seq).alias("s")).mapInArrow(scan, f"`{key}` {kind}, score double").where("score is not null")


def error_rate(df: DataFrame, weights: list[list[float]], *, seq: str = "seq", first: float = 0.75, step: float = 0.007, steps: int = 30) -> DataFrame:
    """``threshold, hits``: how many windows on either strand reach each of ``steps`` thresholds, from one scan.

    Windows are counted by the highest threshold they reach on the workers; null sequences and windows with another letter than ACGT don't count.
    """
    matrix = np.array(weights, float)
    limits = first + step * np.arange(steps)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(iter(batches), 10_000):
            total = np.zeros(steps + 1, np.int64)
            for text in column(table, "s").to_pylist():
                for s in window_scores(text, matrix):
                    total += np.bincount(np.searchsorted(limits, s[s >= first], side="right"), minlength=steps + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(steps, dtype=np.int32)), pa.array(total[1:])], names=["k", "n"])

    reached = df.where(F.col(seq).isNotNull()).select(F.col(seq).alias("s")).mapInArrow(scan, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    every = df.sparkSession.range(steps).select(F.col("id").cast("int").alias("k"))
    upwards = Window.partitionBy().orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)  # ``steps`` rows
    counts = every.join(reached, "k", "left").select("k", F.sum(F.coalesce("n", F.lit(0))).over(upwards).alias("hits"))
    return counts.select((first + step * F.col("k")).alias("threshold"), "hits")


def periodicity(df: DataFrame, word: str, *, seq: str = "seq", windows: list[int] = (10, 50, 100, 500, 1000, 2000)) -> DataFrame:
    """``window, pos, hits, mean``: how often a motif begins at each place of the sequences and of their reverse complements, with moving averages.

    ``mean`` is over ``window`` places from ``pos`` on, places without a hit count as 0, and there is one only where all of them
    lie within the longest sequence. Matches don't overlap. Null and empty sequences give none.
    """
    usable = df.where(F.length(seq) > 0).select(F.upper(seq).alias("s"))
    both = usable.select(F.explode(F.array("s", rc(F.col("s")))).alias("s"))
    mark = to_regex(word).upper()
    before = F.transform(F.split("s", mark, -1), lambda x: F.length(x))
    found = F.transform(F.regexp_extract_all("s", F.lit(f"({mark})"), 1), lambda x: F.length(x))
    starts = F.transform(F.sequence(F.lit(0), F.size("f") - 1), lambda i: F.aggregate(F.slice("b", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice("f", F.lit(1), i), F.lit(0), lambda a, x: a + x))
    hits = both.select(before.alias("b"), found.alias("f")).where("size(f) > 0").select(F.explode(starts).alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("hits"))
    longest = usable.agg(F.max(F.length("s")).alias("size"))
    places = longest.where("size is not null").select("size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("pos"))
    filled = places.join(hits, "pos", "left").select("size", "pos", F.coalesce("hits", F.lit(0)).alias("hits"))
    total = filled.withColumn("upto", F.sum("hits").over(Window.partitionBy().orderBy("pos")))  # a row per place of a sequence
    wide = total.select("*", F.explode(F.array(*[F.lit(w) for w in windows])).alias("window"))
    ends = wide.select("window", (F.col("pos") - F.col("window") + 1).alias("pos"), F.col("upto").alias("end"))
    return wide.join(ends, ["window", "pos"]).select("window", "pos", "hits", ((F.col("end") - F.col("upto") + F.col("hits")) / F.col("window")).alias("mean"))


def sequence_chunks(chroms: DataFrame, size: int = 65_536) -> DataFrame:
    """``chrom, ix, seq``: sequences (``chrom, seq``) cut into pieces of ``size``, in time proportional to their length; null sequences go, an empty one is one empty piece."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chrom, seq in zip(batch.column("chrom").to_pylist(), batch.column("seq").to_pylist()):
                starts = range(0, max(len(seq), 1), size)
                for first in range(0, len(starts), 256):
                    some = starts[first : first + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(some), pa.string()), pa.array(range(first, first + len(some)), pa.int64()), pa.array([seq[p : p + size] for p in some], pa.string())], names=["chrom", "ix", "seq"])

    return chroms.where(F.col("seq").isNotNull()).select("chrom", "seq").mapInArrow(cut, "chrom string, ix bigint, seq string")


def get_sequences(loci: DataFrame, pieces: DataFrame, *, size: int = 65_536, loc_key: str = "loc", key: str = "rid", strand: str | None = None) -> DataFrame:
    """Loci with ``seq``: bases left..right, counted from 1, both ends included; reverse complement on the minus strand. Loci off the sequence go."""
    l = F.col(loc_key)
    wanted = loci.withColumn("ix", F.explode(F.sequence(F.floor((l["left"] - 1) / size), F.floor((l["right"] - 1) / size))))
    hits = wanted.join(pieces.withColumnRenamed("seq", "_piece"), (F.col(f"{loc_key}.chrom") == pieces["chrom"]) & (wanted["ix"] == pieces["ix"]))
    start = F.greatest(F.col(f"{loc_key}.left") - wanted["ix"] * size, F.lit(1)).cast("int")
    stop = F.least(F.col(f"{loc_key}.right") - wanted["ix"] * size, F.lit(size)).cast("int")
    part = F.substring("_piece", start, stop - start + 1)
    seqs = hits.select(F.col(key).alias("_k"), wanted["ix"].alias("ix"), part.alias("p")).groupBy("_k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "p"))), lambda s: s["p"]), "").alias("seq"))
    out = loci.join(seqs, loci[key] == F.col("_k")).drop("_k")
    if strand:
        out = out.withColumn("seq", F.when(F.col(strand).isin(*MINUS), rc(F.col("seq"))).otherwise(F.col("seq")))
    return out


def motif_set_hits(df: DataFrame, motifs: dict[str, list[list[float]]], *, key: str, seq: str = "seq", z: float = 4.0) -> DataFrame:
    """``motif, key, pos, strand, score, z``: windows of several motifs whose score is over mean + z * deviation of all the motif's windows in the sequence."""
    matrices = {name: np.array(weights, float) for name, weights in motifs.items()}

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Mean and deviation are made with the scores, so only hits leave the worker."""
        for table in chunks(iter(batches), 10_000):
            texts = column(table, "s").to_pylist()
            for name, matrix in matrices.items():
                rows, pos, minus, score, over = [], [], [], [], []
                for i, text in enumerate(texts):
                    s = np.array(window_scores(text, matrix))
                    spread = s.std() if s.size else 0.0
                    if spread > 0:
                        far = (s - s.mean()) / spread
                        strand, at = np.nonzero(far > z)
                        rows.append(np.full(len(at), i))
                        pos.append(at)
                        minus.append(strand)
                        score.append(s[strand, at])
                        over.append(far[strand, at])
                place = np.concatenate(rows) if rows else np.zeros(0, int)
                of = lambda x, kind=float: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
                signs = pa.array(["+", "-"]).take(of(minus, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(place), pa.string()), column(table, "k").take(pa.array(place)), of(pos, np.int32), signs, of(score), of(over)], names=["motif", key, "pos", "strand", "score", "z"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(seq).isNotNull()).select(F.col(key).alias("k"), F.col(seq).alias("s"))
    return rows.mapInArrow(scan, f"motif string, `{key}` {kind}, pos int, strand string, score double, z double")


def scramble(word: str, number: int, seed: int) -> list[str]:
    """Shuffled versions of a word, as regular expressions; the same ones for the same seed."""
    import random

    rng = random.Random(seed)
    return [to_regex("".join(rng.sample(word, len(word)))) for _ in range(number)]
