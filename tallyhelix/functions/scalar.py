"""Scalar expressions: alignments, densities, genotypes, chromosome keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the analysis.
MIN_MAPQ = 20
REJECT_FLAGS = 1804
SEX_CHROMS = {"X": 1, "Z": 1, "W": 2, "Y": 2}
INTERGENIC = "intergenic_"
TRUNCATED_SD_2 = 0.8796256610342398  # sd of a standard normal cut at two sd
HALF_NORMAL_95 = 1.959963984540054
LOGNORMAL_SD = 0.5
DUP_HOMO_RATIO = 1.9


def let(value: Column, body) -> Column:
    """body(value) with the value bound once, so that the plan does not repeat its expression."""
    return F.transform(F.array(value), body)[0]


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x.cast("int"))


def cigar_ref_length(cigar: Column) -> Column:
    """Bases of the reference that an alignment spans: M, D, N, = and X."""
    return _total(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1)))


def first_unclipped(cigar: Column) -> Column:
    """The first base of the read that is not clipped."""
    head = F.regexp_extract(cigar, r"^((?:\d+[HS])*)", 1)
    return F.lit(1) + _total(F.regexp_extract_all(head, F.lit(r"(\d+)[HS]"), F.lit(1)))


def has_bits(flag: Column, mask: int, value: int | None = None) -> Column:
    return flag.bitwiseAND(F.lit(mask)) == F.lit(mask if value is None else value)


def first_read_forward(flag: Column) -> Column:
    """Whether the first read of the pair lies on the forward strand."""
    return has_bits(flag, 80, 64) | has_bits(flag, 144, 144)


def bare_chrom(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def sex_chrom(chrom: Column) -> Column:
    """1 for X and Z, 2 for W and Y, 0 for the rest, with or without ``chr``."""
    bare = bare_chrom(chrom)
    return F.when(bare.isin("X", "Z"), 1).when(bare.isin("W", "Y"), 2).otherwise(0)


def window_type(exon_id: Column, chrom: Column) -> Column:
    """0 autosome exon, 1 exon of a sex chromosome, 2 intergenic."""
    return F.when(exon_id.startswith(INTERGENIC), 2).when(sex_chrom(chrom) > 0, 1).otherwise(0)


def normal_pdf(x: Column, mu: Column, sd: Column) -> Column:
    z = (x - mu) / sd
    return F.exp(-0.5 * z * z) / (sd * F.sqrt(2 * F.pi()))


def half_normal_pdf(x: Column, sd: Column) -> Column:
    return F.lit(2.0) / (sd * F.sqrt(2 * F.pi())) * F.exp(-(x * x) / (2 * sd * sd))


def lognormal_pdf(x: Column, mu: Column, sd: Column, haploid: Column) -> Column:
    """Shifted by mu + 2 sd; zero up to there. Location ln(mu), or ln(2 mu) on haploids."""
    loc = mu + 2 * sd
    log_mu = F.log(mu) + F.when(haploid, F.log(F.lit(2.0))).otherwise(0.0)
    y = x - loc
    z = (F.log(F.when(y > 0, y)) - log_mu) / LOGNORMAL_SD
    return F.when(y > 0, F.exp(-0.5 * z * z) / (y * LOGNORMAL_SD * F.sqrt(2 * F.pi()))).otherwise(0.0)


#: Terms of the series of the error function: enough for arguments up to 6.
ERF_TERMS = 140


def erf(z: Column) -> Column:
    """The error function of 0 to 6, by its series of positive terms: 2 / sqrt(pi) * exp(-z^2) * sum of 2^k z^(2k+1) / (2k+1)!!"""
    start = F.struct(z.alias("term"), z.alias("total"))

    def step(a: Column, k: Column) -> Column:
        return let(a["term"] * 2 * z * z / (2 * k + 1), lambda t: F.struct(t.alias("term"), (a["total"] + t).alias("total")))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(ERF_TERMS)), start, step, lambda a: a["total"])
    return 2 / F.sqrt(F.pi()) * F.exp(-z * z) * total


def truncated_sd(cut: Column) -> Column:
    """Spread of a standard normal cut at +-cut."""
    pdf = F.exp(-cut * cut / 2) / F.sqrt(2 * F.pi())
    return F.sqrt(1 - 2 * cut * pdf / erf(cut / F.sqrt(F.lit(2.0))))


def argmax(*values: Column) -> Column:
    """Index of the largest value, the first one on ties."""
    a = F.array(*values)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def sv_type(cn: Column) -> Column:
    return F.when(cn <= 1, "DEL").otherwise("DUP")


def genotype(cn: Column, ratio: Column) -> Column:
    return F.when(cn == 1, "0/1").when((cn == 3) & (ratio < DUP_HOMO_RATIO), "0/1").otherwise("1/1")


def vcf_pos(start: Column, padding: int) -> Column:
    """The base before the variant, with padding taken back; 0 if there is none."""
    return F.when(start - 1 <= 0, F.lit(0)).otherwise(start - 1 + padding)


def vcf_key(chrom: Column) -> Column:
    """Sort key of a chromosome in merged files."""
    bare = bare_chrom(chrom)
    digest = F.sha2(bare.cast("binary"), 256)
    # the whole digest modulo 1000, eight hex digits at a time
    parts = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)])
    other = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: (a * (16**8 % 1000) + x) % 1000) + 1100
    return F.when(bare.rlike(r"^\d+$"), bare.try_cast("long")).when(bare == "X", 1023).when(bare == "Y", 1024).when(bare.isin("M", "MT"), 1025).otherwise(other).cast("long")


def sample_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[bs]am$", "")
