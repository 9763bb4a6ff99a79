"""CIGAR strings to match segments, and segments to validated codon observations, as array expressions.

An alignment row keeps its observations in one array, so their number is known without grouping, and a codon is cut
out of the contig once.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import FOLDED_FROM, FOLDED_TO, GENETIC_CODE, select_once

# parsing ends at the first operation without a length, with length zero, or at the end of the text
_RUN = r"^((?:0*[1-9][0-9]*[^0-9])*)"
# clipping, matches, and perhaps a gap and matches
_COMMON = r"^(?:0*[1-9][0-9]*[^0-9MID])?0*([1-9][0-9]{0,8})M(?:0*([1-9][0-9]{0,8})([ID])0*([1-9][0-9]{0,8})M)?$"


def match_segments(cigar: Column, span: Column) -> Column:
    """array<struct<h, q, n>>: match runs by subject offset, query offset and length, cut at ``span``.

    I moves on in the query, D in the subject, other operations nowhere. Only match positions can hold an
    observation, so nothing is made for gaps.
    """
    run = F.regexp_extract(cigar, _RUN, 1)
    tokens = F.arrays_zip(
        F.regexp_extract_all(run, F.lit("([0-9]+)[^0-9]"), F.lit(1)).alias("n"), F.regexp_extract_all(run, F.lit("[0-9]+([^0-9])"), F.lit(1)).alias("op")
    )
    long = lambda x: x.cast("bigint")
    empty = F.expr("cast(array() as array<struct<h:bigint,q:bigint,n:bigint>>)")
    start = F.struct(long(F.lit(0)).alias("h"), long(F.lit(0)).alias("q"), empty.alias("segs"))

    def step(acc: Column, x: Column) -> Column:
        n, op, h, q = long(x["n"]), x["op"], acc["h"], acc["q"]
        seg = F.struct(h.alias("h"), q.alias("q"), F.least(n, span - h).alias("n"))
        return F.struct(
            F.when(op.isin("M", "D"), h + n).otherwise(h).alias("h"),
            F.when(op.isin("M", "I"), q + n).otherwise(q).alias("q"),
            F.when((op == "M") & (h < span), F.concat(acc["segs"], F.array(seg))).otherwise(acc["segs"]).alias("segs"),
        )

    return F.aggregate(tokens, start, step, lambda acc: acc["segs"])


def with_segments(df: DataFrame, keep: list[str], cigar: Column, span: Column) -> DataFrame:
    """``keep`` and ``segs``, ``match_segments`` of each row. One run of matches, or two with an insertion or a deletion between them, need no
    parsing: nearly all texts. Numbers are read once, and no later filter makes the optimizer work anything out again."""
    part = lambda i: F.nullif(F.regexp_extract(cigar, _COMMON, i), F.lit(""))
    plain = cigar.rlike(r"^[1-9][0-9]{0,8}M$")
    first = F.when(plain, F.substring(cigar, F.lit(1), F.length(cigar) - 1)).otherwise(part(1))
    gapped = lambda i: F.when(~plain, part(i))
    rows = select_once(df, keep, [cigar.alias("_c"), span.alias("_w"), first.try_cast("bigint").alias("_a"), gapped(2).try_cast("bigint").alias("_b"), gapped(3).alias("_op"), gapped(4).try_cast("bigint").alias("_z")])
    a, b, z, w, zero = F.col("_a"), F.col("_b"), F.col("_z"), F.col("_w"), F.lit(0).cast("bigint")
    h, q = (a + F.when(F.col("_op") == op, b).otherwise(zero) for op in "DI")
    one = F.struct(zero.alias("h"), zero.alias("q"), F.least(a, w).alias("n"))
    two = F.struct(h.alias("h"), q.alias("q"), F.least(z, w - h).alias("n"))
    common = F.when(z.isNull() | (h >= w), F.array(one)).otherwise(F.array(one, two))
    segs = F.when((w > 0) & a.isNotNull(), common).otherwise(match_segments(F.col("_c"), w))
    return select_once(rows.select(*keep, segs.alias("_found")), keep, [F.col("_found").alias("segs")])


def codon_at(nt: Column, qstart: Column, minus: Column, q: Column) -> Column:
    """The codon of query residue ``q`` (from 0) in the contig; null where it doesn't lie within."""
    plus = F.when((qstart >= 1) & (qstart + q * 3 + 1 < F.length(nt)), F.substr(nt, (qstart + q * 3).cast("int"), F.lit(3)))
    cut = F.substr(nt, (qstart - q * 3 - 2).cast("int"), F.lit(3))
    back = F.when((q * 3 + 3 <= qstart) & (qstart - 1 - q * 3 < F.length(nt)), F.translate(F.reverse(cut), "ACGT", "TGCA"))
    return F.when(minus, back).otherwise(plus)


def _by_digits() -> tuple[Column, Column]:
    """The residues of all codons, and their numbers 0..63, as arrays by the codon's bases as decimal digits 0..3; empty at stops and other numbers."""
    letters, numbers = [""] * 334, [-1] * 334
    for i, (digits, aa) in enumerate(zip(itertools.product(range(4), repeat=3), GENETIC_CODE, strict=True)):
        at = digits[0] * 100 + digits[1] * 10 + digits[2]
        letters[at], numbers[at] = "" if aa == "*" else aa, i
    return F.array(*map(F.lit, letters)), F.array(*map(F.lit, numbers))


_LETTERS, _NUMBERS = "ACGTN", "01239"


def query_digits(nt: Column, qseq: Column, qstart: Column, minus: Column) -> Column:
    """The bases of the query residues' codons as digits: ACGT are 0123, all else 9. Only the aligned stretch is cut out, once, and turned once
    on the minus strand; bases that don't lie within the contig are missing at the end or 9 at the beginning."""
    size = F.length(qseq) * 3
    only = lambda c: F.when(c.rlike("[^ACGTN]"), F.regexp_replace(c, "[^ACGT]", "N")).otherwise(c)
    plus = F.when(qstart >= 1, F.translate(only(F.substr(nt, qstart.cast("int"), size)), _LETTERS, _NUMBERS))
    begin = F.greatest(F.lit(1), qstart - size + 1)
    turned = F.translate(F.reverse(only(F.substr(nt, begin.cast("int"), (qstart - begin + 1).cast("int")))), _LETTERS, "32109")
    beyond = F.least(size, F.greatest(F.lit(0), qstart - F.length(nt))).cast("int")
    back = F.when(qstart >= 1, F.when(beyond > 0, F.concat(F.repeat(F.lit("9"), beyond), turned)).otherwise(turned))
    return F.when(minus, back).otherwise(plus)


def query_letters(qseq: Column) -> Column:
    """The query's residues, ambiguity letters folded."""
    return F.when(qseq.rlike(f"[{FOLDED_FROM}]"), F.translate(qseq, FOLDED_FROM, FOLDED_TO)).otherwise(qseq)


def places(seg: Column, digits: Column, letters: Column, max_offset: int | None) -> Column:
    """array<int>: the places 0, 1, .. within a match segment that have a whole codon, a residue, and an offset below ``max_offset``; null for none."""
    most = F.least(F.floor(F.length(digits) / 3), F.length(letters).cast("bigint")) - seg["q"]
    n = F.least(seg["n"], most) if max_offset is None else F.least(seg["n"], most, max_offset - seg["h"])
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1))


def code_at(digits: Column, q: Column) -> Column:
    """The digits of the codon of query residue ``q`` (from 0) as a number."""
    return F.substr(digits, (q * 3 + 1).cast("int"), F.lit(3)).try_cast("int")


def encodes(code: Column, letters: Column, q: Column) -> Column:
    """Whether a codon by its digits is ACGT and encodes query residue ``q``. A lookup by number, since searching a string costs its length."""
    return F.coalesce(F.get(_by_digits()[0], code) == F.substr(letters, (q + 1).cast("int"), F.lit(1)), F.lit(False))


def codon_number(code: Column) -> Column:
    """0..63 of a codon by its digits."""
    return F.get(_by_digits()[1], code)


def observations(segs: Column, digits: Column, letters: Column, max_offset: int | None) -> Column:
    """array<bigint> of the positions whose codon is ACGT and encodes the aligned residue: 64 times the offset, plus the codon's number.

    ``digits``, ``letters``: columns of ``query_digits`` and ``query_letters``. Stops, ambiguous bases, residues without a code, mismatches and
    offsets of ``max_offset`` and more drop out.
    """

    def one(s: Column) -> Column:
        def place(k: Column) -> Column:
            code = code_at(digits, s["q"] + k)
            return F.when(encodes(code, letters, s["q"] + k), (s["h"] + k) * 64 + codon_number(code))

        return F.filter(F.transform(F.coalesce(places(s, digits, letters, max_offset), F.expr("cast(array() as array<int>)")), place), lambda p: p.isNotNull())

    return F.when(F.size(segs) == 1, one(segs[0])).otherwise(F.flatten(F.transform(segs, one)))


def any_observation(segs: Column, digits: Column, letters: Column, max_offset: int | None) -> Column:
    """Whether ``observations`` would hold any: stops at the first one."""
    good = lambda s: lambda k: encodes(code_at(digits, s["q"] + k), letters, s["q"] + k)
    return F.exists(segs, lambda s: F.coalesce(F.exists(places(s, digits, letters, max_offset), good(s)), F.lit(False)))
