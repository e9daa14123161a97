"""The general data problems against plain Python."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.functions.loci import normal_chrom, with_locus
from loomspan.operators.packed import split_packed, unpack_fields
from loomspan.operators.periods import covered_and_gaps
from loomspan.sources.rejects import STRANDS, parse_lines, rejected, valid


def brute_periods(rows):
    out = []
    for e in {r[0] for r in rows if r[0] is not None}:
        spans = sorted((l, r) for x, l, r in rows if x == e and l is not None and r is not None and l <= r)
        merged = []
        for l, r in spans:
            if merged and l <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], r)
            else:
                merged.append([l, r])
        out += [(e, "covered", l, r) for l, r in merged]
        out += [(e, "gap", a[1] + 1, b[0] - 1) for a, b in zip(merged, merged[1:])]
    return sorted(out)


@pytest.mark.parametrize("bits", [2, 5, 20])
def test_periods_match_brute_force(spark, bits):
    rng = random.Random(bits)
    rows = [("hot", l := rng.randrange(-500, 4000), l + rng.choice([0, 1, 3, 30, 400])) for _ in range(300)]
    rows += [(e, l := rng.randrange(1000), l + rng.randrange(5)) for e in "abc" for _ in range(40)]
    rows += [("a", None, 5), ("a", 7, None), (None, 1, 2), ("a", 9, 3), ("only", 5, 5), ("only", 5, 5)]
    df = spark.createDataFrame(rows, "e string, l long, r long").withColumn("kind", F.lit("clash"))
    got = covered_and_gaps(df, ["e"], "l", "r", block_bits=bits).collect()
    assert sorted(tuple(x) for x in got) == brute_periods(rows)
    assert covered_and_gaps(df.limit(0), ["e"], "l", "r").count() == 0


def test_locus_texts(spark):
    cases = {
        "chr7:10-20": ("chr7", 10, 20), " CHRx: 1,000 - 2,000 ": ("chrX", 1000, 2000), "9:5-5": ("chr9", 5, 5),
        "chr1:9-3": None, "chr1:+5-6": None, "HLA-A:1-2": ("chrHLA-A", 1, 2), "chr1:1-2-3": None, "a:b:1-2": None, "chr1:-5-6": None, "chr1:5.0-6": None, "chr:1-2": None, "": None, "unmapped": None, "chr1:5": None, "chr1:5-": None, "5-6": None,
        "chr1:5..6": None, "chr1:5-6x": None, "chr1:" + "9" * 30 + "-" + "9" * 31: None,
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    got = {r.t: (r.chrom, r.left, r.right) if r.chrom else None for r in with_locus(df, "t").collect()}
    assert got == {**cases, None: None}
    clash = with_locus(df.withColumn("chrom", F.lit("c")).withColumn("left", F.lit(1)), "t")
    assert clash.columns == ["t", "chrom", "left", "right"] and clash.where("chrom = 'chr7'").first().left == 10
    chroms = spark.createDataFrame([("Chr4 ",), ("x",), ("chr",), (None,), (" ",)], "c string")
    assert [r[0] for r in chroms.select(normal_chrom(F.col("c"))).collect()] == ["chr4", "chrX", None, None, None]


def brute_reason(fmt, line):
    line = line.strip("\r\n")
    if fmt == "csv":
        fields, i, n = [], 0, len(line)
        while True:
            j = i
            while j < n and line[j] in " \t":
                j += 1
            if j < n and line[j] == '"':
                k, text = j + 1, ""
                while True:
                    if k >= n:
                        return "quoting"
                    if line[k] == '"':
                        if k + 1 < n and line[k + 1] == '"':
                            text, k = text + '"', k + 2
                            continue
                        break
                    text, k = text + line[k], k + 1
                k += 1
                while k < n and line[k] in " \t":
                    k += 1
                if k < n and line[k] != ",":
                    return "quoting"
                fields.append(text)
            else:
                k = line.find(",", i)
                k = n if k < 0 else k
                if '"' in line[i:k]:
                    return "quoting"
                fields.append(line[i:k])
            if k >= n:
                break
            i = k + 1
    else:
        fields = line.split("\t")
    fields = [f.strip() for f in fields]
    if len(fields) != (4 if fmt == "csv" else 6):
        return "column_count"
    if fmt == "csv":
        m = re.fullmatch(r"(\w+?)\s*:\s*(\d[\d,]*)\s*-\s*(\d[\d,]*)", fields[0], re.A)
        place = m and (m[1], m[2].replace(",", ""), m[3].replace(",", ""))
    else:
        place = fields[:3] if all(re.fullmatch(r"[0-9]+", x) for x in fields[1:3]) else None
    if not place or not re.fullmatch(r"\w+", re.sub("^chr", "", place[0].lower()), re.A) or int(place[1]) > int(place[2]):
        return "loc"
    score, strand = fields[-2:]
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", score) or not 0 <= float(score) <= 1000:
        return "score"
    return None if strand in STRANDS else "strand"


def is_record(fmt, line):
    s = (line or "").strip()
    return bool(s) and not s.startswith(("#", "track ", "browser ")) and not (fmt == "csv" and s.lower().replace('"', "") == "loc,name,score,strand")


EXTRA = [
    ("csv", 'chr1:1-2,a,1,"+'), ("csv", 'chr1:1-2,a"b",1,+'), ("csv", '"chr1:1-2"x,a,1,+'), ("csv", '"chr1:1-2" , "a" ,1,+'),
    ("csv", "chr1:1-2,a,1,+,"), ("csv", ",,,"), ("csv", "chr1:1 0-20,a,1,+"), ("csv", "chr1:1,000-2,000,a,1,+"), ("csv", '"chr1 : 1,000 - 2,000",a,1,+'),
    ("csv", "1:5-4,a,1,+"), ("csv", "1:5-6,a,1e2,+"), ("csv", "1:5-6,a,1e9,+"), ("csv", "1:5-6,a,nan,+"), ("csv", "1:5-6,a,0x10,+"), ("csv", '"Loc","Name","Score","Strand"'),
    ("bed", "chr1\t1\t2\tn\t5\t+"), ("bed", "chr1\t1,000\t2,000\tn\t5\t+"), ("bed", "chr\t1\t2\tn\t5\t+"), ("bed", "chr1\t1\t2\t\"n\t 5 \t+\r"), ("bed", "chr1\t1\t2"),
    ("bed", "# x"), ("bed", ""), ("bed", None), ("bed", "track name=x"), ("bed", "a b\t1\t2\tn\t5\t+"), ("bed", "chr1\t1\t2\tn\t5\t+\t"), ("csv", "x" * 300_000), ("tsv", "a"),
]


def test_failing_lines_match_brute_force(spark, data):
    rows = [(r.rec_id, r.fmt, r.line) for r in spark.read.parquet(f"{data}/format_lines.parquet").collect()]
    rows += [(10**6 + i, f, x) for i, (f, x) in enumerate(EXTRA)]
    df = spark.createDataFrame(rows, "rec_id long, fmt string, line string").withColumn("reason", F.lit(1))
    parsed = parse_lines(df).cache()
    records = [r for r in rows if r[1] in ("bed", "csv") and is_record(r[1], r[2])]
    want = {i: brute_reason(f, x) for i, f, x in records}
    got = {r.rec_id: r.reason for r in parsed.collect()}
    assert {i: (got.get(i, "none"), want.get(i, "none")) for i in {*got, *want} if got.get(i, 0) != want.get(i, 0)} == {}
    assert rejected(parsed).count() + valid(parsed).count() == len(records)
    assert valid(parsed).where("chrom is null or left > right or score is null").count() == 0
    assert parse_lines(df.limit(0)).count() == 0


def brute_split(text, blanks_split):
    """Values of a field, one character at a time."""
    text = text or ""
    bracketed = text.strip().startswith("[")
    parts, now, quote = [], "", ""
    for i, c in enumerate(text):
        if quote:
            now += c
            quote = "" if c == quote else quote
        elif c == '"' or (c == "'" and bracketed):
            quote, now = c, now + c
        elif c in ",;|" or (blanks_split and c.isspace()) or (c == "/" and text[i - 1 : i].isspace() and text[i + 1 : i + 2].isspace()):
            parts, now = [*parts, now], ""
        else:
            now += c
    out = []
    for p in [*parts, now]:
        p = p.strip()
        while p and p[0] in "[ ":
            p = p[1:]
        while p and p[-1] in "] ":
            p = p[:-1]
        marked = len(p) >= 2 and p[0] == p[-1] and (p[0] == '"' or (p[0] == "'" and bracketed))
        if marked:
            p = p[1:-1].strip().replace('""', '"')
        if p or marked:
            out.append(p)
    return out


PACKED_CASES = [
    None, "", " ", ";", "a", "a;b", "a; b ;", "['1', '2']", "[1, 2]", '"x, y";z', '"a ""q"" b"|c', "A b / C", "a/b;c", "é;ü, x", "1,,2", "x", "a,a,a",
    '"2;8-lig"', "5' end;3' end", "'a;b", '["a, b", c]', '"open;b', "x" * 100_000 + ";y",
]


@pytest.mark.parametrize("blanks_split", [True, False])
def test_packed_fields_match_brute_force(spark, data, blanks_split):
    texts = list(PACKED_CASES)
    g, m = spark.read.parquet(f"{data}/genome_sql.parquet"), spark.read.parquet(f"{data}/massspec.parquet")
    texts += [x for r in g.select("exonstarts", "exonends").collect() for x in r] + [r[0] for r in m.select("name").collect()]
    got = split_packed(pa.array(texts, pa.string()), blanks_split).to_pylist()
    assert [(t, a, b) for t, a, b in zip(texts, got, (brute_split(t, blanks_split) for t in texts)) if a != b] == []


def test_unpacked_rows(spark):
    df = spark.createDataFrame([(1, "a;b;a"), (2, "c"), (3, None), (4, '"x;y"')], "id long, name string").withColumn("item", F.lit(0))
    rows = unpack_fields(df, "id", {"name": False}).collect()
    assert sorted(tuple(r) for r in rows) == [("name", 1, 1, "a"), ("name", 1, 2, "b"), ("name", 1, 3, "a")]
    assert unpack_fields(df.limit(0), "id", {"name": False}).count() == 0
