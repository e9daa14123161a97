"""Catalogue of delimited formats.

A format maps keys to columns (counted from 0) by small expressions: ``3``, ``loc(0, 1, 2)``, ``loc(2, 3, 3)``,
``loc(0, int(1)+int(4), int(1)+int(4))``, ``tss(2, 4, 5, 3)``, ``ints(9)``, ``slice(4)``, ``join(1, 6)``. They are parsed, never evaluated.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Format:
    """One delimited layout: keys, separator and which rows are data."""

    keys: dict[str, str] = field(default_factory=dict)
    tsv: bool = False
    skip: int = 0  # lines to drop before the data; 0 drops the header, -1 nothing
    skip_till: str | None = None  # drop all lines up to and with the first that has this text
    end_with: str | None = None
    comment: str | None = None
    keep_if: str | None = None  # only lines with this text
    must_have: int | None = None  # rows with a blank in this column go
    sniff: bool = False
    gtf: int | None = None  # column of ``key "value";`` pairs
    special: str | None = None
    description: str = ""

    def update(self, **changes) -> Format:
        return replace(self, **changes)


def _f(keys: str = "", **options) -> Format:
    """Keys as text: ``name=3; loc=loc(0, 1, 2)``."""
    pairs = (p.split("=", 1) for p in keys.split(";") if p.strip())
    return Format({k.strip(): v.strip() for k, v in pairs}, **options)


def _run(names: str, start: int = 0) -> str:
    """Consecutive columns for a list of names."""
    return "; ".join(f"{n}={i}" for i, n in enumerate(names.split(), start))


_BED = "loc=loc(0, 1, 2)"
_SNP = "bin=0; name=4; score=5; strand=6; refNCBI=7; refUCSC=8; observed=9; molType=10; cclass=11; valid=12; avHet=13; avHetSE=14; func=15; locType=16; weight=17; loc=loc(1, 2, 3)"
_REFGENE = "loc=loc(2, 4, 5); strand=3; name=12; refseq=1; tss_loc=tss(2, 4, 5, 3); cds_loc=loc(2, 6, 7); exons_count=8"

#: Column layouts of the named formats.
FORMATS: dict[str, Format] = {
    "default": _f(sniff=True),
    "sniffer": _f(sniff=True),
    "sniffer_tsv": _f(sniff=True, tsv=True),
    "bed": _f(f"{_BED}; name=3; score=4; strand=5", tsv=True, skip=-1),
    "minimal_bed": _f(_BED, tsv=True, skip=-1),
    "full_bed": _f(f"{_BED}; {_run('name score strand thickStart thickEnd itemRgb blockCount blockSizes blockStarts', 3)}", tsv=True, skip=-1, comment="#"),
    "bed_no_strand": _f(_BED, tsv=True, skip=-1),
    "psl": _f(_run("matches misMatches repMatches nCount qNumInsert qBaseInsert tNumInsert tBaseInsert strand qName qSize qStart qEnd tName tSize tStart tEnd blockCount blockSizes qStarts tStarts"), tsv=True, skip=-1),
    "fasta": _f(special="fasta"),
    "gtf": _f("feature_type=1; feature=2; loc=loc(0, 3, 4); strand=6", tsv=True, skip=-1, comment="#", gtf=8),
    "snp": _f(_SNP, tsv=True),
    "pgsnp": _f(f"{_BED}; {_run('name alleleCount alleleFreq alleleScores', 3)}", tsv=True, skip=-1),
    "encode_rna_expn": _f(f"{_BED}; {_run('name score strand level signif score2', 3)}", tsv=True, skip=-1),
    "encode_broadpeak": _f(f"{_BED}; {_run('name score strand signalValue pValue qValue', 3)}", tsv=True, skip=-1),
    "fimo_out": _f("pattern-name=0; name=1; score=4; p-value=5; q-value=6; sequence=7; loc=loc(1, min(2, 3), max(2, 3))", tsv=True),
    "fimo_narrowPeak": _f(f"motif=3; strand=5; q-value=8; p-value=7; {_BED}", tsv=True),
    "homer_known_motifs": _f("name=0; motf_seq=1; q=4; p=2; -log10P=3", tsv=True),
    "macs_output": _f(f"{_BED}; tag_height=5; fold_change=7", tsv=True, skip_till="chr"),
    "macs_summit": _f("loc=loc(0, int(1)+int(4), int(1)+int(4)); fold_change=7; tag_count=5; fdr=8", tsv=True, skip_till="chr"),
    "ccat_output": _f("loc=loc(0, 1, 1); tag_height=4; fold=6", tsv=True, skip=-1),
    "ccat_output_csv": _f("loc=loc(0, 1, 1); tag_height=4; fold=6; fold_change=bar(3, 2)", skip=-1),
    "sissrs_output": _f(f"{_BED}; tag_height=3; fold=4; p-value=5", tsv=True, skip=57),
    "homer_peaks": _f("loc=loc(1, 2, 3); tagcount=5", tsv=True, comment="#"),
    "dfilter_bed": _f(f"{_BED}; p_value=5; tag_count=6", tsv=True, skip=1),
    "sam_tophat": _f("name=0; loc=loc(2, 3, 3); mapq=3; seq=9", tsv=True, skip=-1),
    "sam_tophat_xs": _f("name=0; loc=loc(2, 3, 3); mapq=4; seq=9; strand=tag(XS)", tsv=True, skip=-1, keep_if="XS:"),
    "sam": _f("qname=0; flag=1; cigar=5; loc=loc(2, 3, 3); mapq=3; seq=9", tsv=True, skip=-1, comment="@"),
    "exporttxt_loc_only": _f("loc=loc(fa(10), 12, int(12)+25); strand=13", tsv=True),
    "exporttxt_all": _f("loc=loc(fa(10), 12, int(12)+25); strand=13; seq=6; quality_score=7", tsv=True),
    "bowtie": _f("loc=loc(2, 3, 3); strand=1; seq=4; quality_scores=5", tsv=True),
    "bowtie_loc_only": _f("loc=loc(2, 3, 3); strand=1", tsv=True),
    "ann_list": _f("loc=text(4); strand=6; name=9; refseq=11; entrez=12; tag_height=1"),
    "peak_loc": _f("loc=text(4); name=9; refseq=11; entrez=12; tag_height=1"),
    "genespring_out": _f("refseq=4; entrez=8; fold_change=1; array_systematic_name=0", tsv=True),
    "array_simplified": _f("refseq=10; array_systematic_name=0; entrez=8"),
    "illumina_anotations": _f("array_systematic_name=0; refseq=3; entrez=7"),
    "snp_txt": _f(_SNP, tsv=True),
    "ncbi_gwas": _f("loc=loc(11, 12, int(12)+1); snp_name=20; associated_gene=13", tsv=True, must_have=11),
    "array_tsv": _f("refseq=0; entrez=1; symbol=2; conditions=slice(4); array_systematic_name=1", tsv=True),
    "array_csv": _f("refseq=0; entrez=1; symbol=2; conditions=slice(4); array_systematic_name=1"),
    "mm8_refgene": _f("loc=loc(0, 2, 3); strand=1; name=4; description=5; refseq=6; tss_loc=tss(0, 2, 3, 1)", tsv=True),
    "mm9_refgene": _f(_REFGENE, tsv=True),
    "mm10_refgene": _f(_REFGENE, tsv=True),
    "ensembl": _f("loc=loc(2, 4, 5); tss_loc=tss(2, 4, 5, 3); ensmbl=1; name=12; exon_count=8", tsv=True),
    "hg19_refgene": _f("loc=loc(2, int(4), int(5)); strand=3; name=12; refseq=1; cds_loc=loc(2, 6, 7); exons_count=8; exonStarts=ints(9); exonEnds=ints(10)", tsv=True),
    "hg18_refseq": _f("loc=loc(0, 1, 2); strand=5; refseq=3; tss_loc=tss(0, 2, 3, 1)", tsv=True),
    "homer_annotated": _f(f"{_BED}; {_run('peak_id motif_score strand motif_seq summit_dist summit_height nearest_gene TSS_dist annotation', 3)}", tsv=True, skip=-1),
    "MACS_combined": _f(f"{_BED}; {_run('peak_id summit_height p-value_score number_tags fold_enrichment FDR', 3)}", tsv=True, skip=-1),
    "rsem_gene": _f("ensg=0; tpm=8; tpm_lo=10; tpm_hi=11; transcripts=1", tsv=True),
    "blast_tabular": _f(_run("queryId subjectId percIdentity alnLength mismatchCount gapOpenCount queryStart queryEnd subjectStart subjectEnd eVal bitScore"), tsv=True, skip=-1),
    "hmmer_tbl": _f(special="hmmer_tbl"),
    "hmmer_domtbl": _f(special="hmmer_domtbl"),
    "go_GREAT_shown": _f("name=0; qvalue=3", tsv=True, comment="#"),
    "go_DAVID": _f("ontology=0; count=2; name=1; qvalue=11; pvalue=4", tsv=True),
    "go_GOseq": _f("ontology=7; count=4; name=join(1, 6); qvalue=2; pvalue=2", tsv=True),
    "go_cistrome_download": _f("name=0; qvalue=4", tsv=True, skip_till="# Term"),
}


def find(text: str) -> list[str]:
    """Names of formats whose name or keys contain the text."""
    return [n for n, f in FORMATS.items() if text.lower() in n.lower() or any(text == k for k in f.keys)]
