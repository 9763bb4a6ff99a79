"""Scalar functions on alignment fields, as Spark columns. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The 20 amino acids in code order, the standard genetic code over ACGT x ACGT x ACGT, the letters that
#: stand for another one.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
GENETIC_CODE = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"
FOLDED_FROM, FOLDED_TO = "BZJUO", "NQLCK"

UINT32_MAX = 4294967295
FLOAT_PREFIX = r"^-?(?:(?i:nan|inf(?:inity)?)|(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)"


def select_once(df: DataFrame, keep: list[str], columns: list[Column]) -> DataFrame:
    """``keep`` and computed columns that no later filter or projection makes the optimizer compute again.

    A predicate on a projected column is pushed below the projection with the column's expression in it, which then
    runs twice. It isn't pushed below a generator whose output it reads; a generator of one row costs a copy.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def uint_prefix(c: Column) -> Column:
    """The leading digits as a number below 2**32; null without any, or beyond it."""
    n = F.nullif(F.regexp_extract(c, "^[0-9]+", 0), F.lit("")).try_cast("bigint")
    return F.when(n <= UINT32_MAX, n)


def float_prefix(c: Column, kind: str = "double") -> Column:
    """The leading decimal number (also nan and inf); null without one."""
    return F.nullif(F.regexp_extract(c, FLOAT_PREFIX, 0), F.lit("")).try_cast(kind)


def extract_hog(sseqid: Column) -> Column:
    """What follows the last bar; everything if there is none."""
    return F.substring_index(sseqid, "|", -1)


def extract_acc(qseqid: Column) -> Column:
    """What precedes the first underscore; everything if there is none."""
    return F.substring_index(qseqid, "_", 1)


def parse_cnum(qseqid: Column) -> Column:
    """The number at the start of the field after the first underscore.

    Where there is none, the first 32 bits of the id's MD5: the same in every run, and without a shuffle.
    """
    return F.coalesce(
        uint_prefix(F.nullif(F.regexp_extract(qseqid, "^[^_]*_([0-9]+)", 1), F.lit(""))),
        F.conv(F.substring(F.md5(qseqid), 1, 8), 16, 10).cast("bigint"),
    )


def unitig_id(acc_id: Column, cnum: Column) -> Column:
    return F.concat_ws("_", acc_id, cnum.cast("string"))


def qframe(qstrand: Column, qstart: Column, qend: Column, qlen: Column) -> Column:
    """Reading frame 1..3 of the query, negative on the minus strand."""
    minus = F.coalesce(F.substring(qstrand, 1, 1) == "-", F.lit(False))
    base = F.when(minus, F.greatest(qlen - qend, F.lit(0))).otherwise(F.greatest(qstart - 1, F.lit(0)))
    return (F.when(minus, -1).otherwise(1) * (base % 3 + 1)).cast("tinyint")


def revcomp(codon: Column) -> Column:
    """Reverse complement of ACGT text; any other letter becomes N."""
    return F.regexp_replace(F.translate(F.reverse(codon), "ACGT", "TGCA"), "[^ACGT]", "N")


def pack_codon(codon: Column) -> Column:
    """0..63 with A, C, G, T as 0..3, first base most significant; null for anything else."""
    base = [F.instr(F.lit("ACGT"), F.substring(codon, i, 1)) - 1 for i in (1, 2, 3)]
    return F.when(codon.rlike("^[ACGT]{3}$"), base[0] * 16 + base[1] * 4 + base[2]).cast("tinyint")


def unpack_codon(idx: Column) -> Column:
    letter = lambda n: F.substring(F.lit("ACGT"), n + 1, 1)
    i = idx.cast("int")
    return F.when(i.between(0, 63), F.concat(letter((i / 16).cast("int") % 4), letter((i / 4).cast("int") % 4), letter(i % 4)))


def codon_idx_to_aa(idx: Column) -> Column:
    """Amino acid of a packed codon; null for stops."""
    return F.nullif(F.substring(F.lit(GENETIC_CODE), idx.cast("int") + 1, 1), F.lit("*"))


def codon_to_aa(codon: Column) -> Column:
    return codon_idx_to_aa(pack_codon(codon))


def encode_aa(letter: Column) -> Column:
    """The letter of one of the 20 amino acids, ambiguity letters folded; null for gaps and unknown ones."""
    folded = F.translate(F.substring(letter, 1, 1), FOLDED_FROM, FOLDED_TO)
    return F.when(folded.rlike(f"^[{AMINO_ACIDS}]$"), folded)


def pident_u8(pident: Column) -> Column:
    """Half-up whole per cent, 100 at most."""
    return F.floor(F.least(F.lit(100).cast("float"), pident + F.lit(0.5).cast("float"))).cast("int")


def encode_pident(pident: Column) -> Column:
    return F.round(pident.cast("double") * 10).cast("int")


def decode_pident(code: Column) -> Column:
    return code / 10.0


def encode_evalue(evalue: Column) -> Column:
    """Hundredths of log10 in -32767..0; -32767 for zero and below."""
    q = F.round(F.log10(evalue) * 100)
    return F.when(evalue <= 0, -32767).otherwise(F.greatest(F.lit(-32767), F.least(F.lit(0), q))).cast("int")


def decode_evalue(code: Column) -> Column:
    return F.when(code <= -32767, 0.0).otherwise(F.pow(F.lit(10.0), code / 100.0))


#: Where the hash begins, and the two parts of its prime, 2 ** 40 + 435.
FNV_BASIS, FNV_SHIFT, FNV_LOW = 1469598103934665603, 8, 435


def fnv_bucket(c: Column, buckets: int) -> Column:
    """The 64-bit FNV-1a hash of the text's UTF-8 bytes, unsigned, modulo ``buckets``.

    The state is two 32-bit halves: products of 64 bits would overflow a long.
    """
    mask = (1 << 32) - 1
    code = F.hex(F.encode(c, "utf-8"))
    byte = lambda i: F.conv(F.substr(code, (2 * i - 1).cast("int"), F.lit(2)), 16, 10).cast("bigint")
    start = F.struct(F.lit(FNV_BASIS >> 32).cast("bigint").alias("hi"), F.lit(FNV_BASIS & mask).cast("bigint").alias("lo"))

    def step(h: Column, i: Column) -> Column:
        lo = h["lo"].bitwiseXOR(byte(i))
        carry = F.shiftright(lo * FNV_LOW, 32)
        hi = h["hi"] * FNV_LOW + carry + F.shiftleft(lo, FNV_SHIFT)
        return F.struct(hi.bitwiseAND(F.lit(mask)).alias("hi"), (lo * FNV_LOW).bitwiseAND(F.lit(mask)).alias("lo"))

    last = lambda h: ((h["hi"] % buckets * ((1 << 32) % buckets) + h["lo"] % buckets) % buckets).cast("int")
    return F.when(c == "", F.lit(FNV_BASIS % buckets)).otherwise(F.aggregate(F.sequence(F.lit(1), F.octet_length(c)), start, step, last))
