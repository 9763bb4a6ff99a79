"""Alignment lines to alignments with validated codon observations. One pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import cigar, scalars
from ..sources.alignments import FIELDS, split_fields

MAX_OFFSET = 1024

_KINDS = {"pident": "float", "evalue": "double"} | dict.fromkeys(("qstart", "qend", "qlen", "sstart", "send"), "uint")


def parse(lines: DataFrame) -> DataFrame:
    """Typed columns, ``n_fields``; a number that can't be read is null, and so is a field that isn't there."""

    def one(i: int, name: str) -> Column:
        c = F.get(F.col("parts"), F.lit(i))
        kind = _KINDS.get(name)
        return (scalars.uint_prefix(c) if kind == "uint" else scalars.float_prefix(c, kind) if kind else c).alias(name)

    return scalars.select_once(split_fields(lines), ["shard_id"], [F.size("parts").alias("n_fields"), *(one(i, n) for i, n in enumerate(FIELDS))])


def reject_reason(min_pident: float = 0.0, max_evalue: float = 1.0) -> Column:
    """Why a parsed row is skipped, in order of evaluation; ``no_nucleotides`` for rows dropped without being counted;
    null for rows that go on. A pident of exactly 100 (as a float) is skipped. NaN passes both limits."""
    pident, evalue = F.col("pident"), F.col("evalue")
    coords = F.col("sstart").isNull() | F.col("send").isNull() | F.col("qstart").isNull() | F.col("qend").isNull() | F.col("qlen").isNull()
    return (
        F.when(F.col("n_fields") < 13, "fields")
        .when(pident.isNull() | evalue.isNull(), "number")
        .when(pident < F.lit(min_pident).cast("float"), "pident")
        .when((evalue > max_evalue) & ~F.isnan(evalue), "evalue")
        .when(pident == F.lit(100).cast("float"), "perfect")
        .when(coords, "coordinates")
        .when(F.col("sstart") > F.col("send"), "span")
        .when(F.coalesce(F.col("full_qseq"), F.lit("")) == "", "no_nucleotides")
    )


_WORKED = ("digits", "letters", "segs")


def _coded(parsed: DataFrame, columns: list[Column], min_pident: float, max_evalue: float) -> DataFrame:
    """``columns`` of the rows that go on, with ``digits`` and ``letters`` of their residues and ``segs``, their match segments, worked out once."""
    minus = F.coalesce(F.substring("qstrand", 1, 1) == "-", F.lit(False))
    # steps of their own: generated code beyond 8,000 bytes a method isn't compiled
    rows = scalars.select_once(parsed.where(reject_reason(min_pident, max_evalue).isNull()), parsed.columns, [minus.alias("_minus")])
    given = {"_nt": F.col("full_qseq"), "_qseq": F.col("qseq_translated"), "_start": F.col("qstart"), "_minus": F.col("_minus"), "_cigar": F.col("cigar"), "_span": F.col("send") - F.col("sstart") + 1}
    rows = rows.select(*columns, *(c.alias(n) for n, c in given.items()))
    names = rows.columns[: -len(given)]
    digits = cigar.query_digits(F.col("_nt"), F.col("_qseq"), F.col("_start"), F.col("_minus"))
    rows = scalars.select_once(rows, [*names, "_cigar", "_span"], [digits.alias("digits"), cigar.query_letters(F.col("_qseq")).alias("letters")])
    return cigar.with_segments(rows, [*names, "digits", "letters"], F.col("_cigar"), F.col("_span"))


def _acc(acc: str) -> Column:
    return (scalars.extract_acc(F.col("qseqid")) if acc == "auto" else F.lit(acc)).alias("acc_id")


def align(
    parsed: DataFrame, acc: str = "auto", min_pident: float = 0.0, max_evalue: float = 1.0, max_offset: int | None = MAX_OFFSET, keep_empty: bool = False,
    counters: Observation | None = None,
) -> DataFrame:
    """The ``hsp`` table with its observations in an array.

    ``acc``: an accession for all rows, or "auto" for that of each query id. Rows without observations go, unless
    ``keep_empty``. Columns: shard_id, hog_id, acc_id, contig, cnum, sstart, send, qframe, pident, pident_u8,
    evalue, n_obs, obs (64 times the offset, plus the codon's number).
    """
    columns = [
        "shard_id",
        scalars.extract_hog(F.col("sseqid")).alias("hog_id"),
        _acc(acc),
        F.col("qseqid").alias("contig"),
        scalars.parse_cnum(F.col("qseqid")).alias("cnum"),
        "sstart",
        "send",
        scalars.qframe(F.col("qstrand"), F.col("qstart"), F.col("qend"), F.col("qlen")).alias("qframe"),
        "pident",
        scalars.pident_u8(F.col("pident")).alias("pident_u8"),
        "evalue",
    ]
    rows = _coded(parsed, columns, min_pident, max_evalue)
    names = [c for c in rows.columns if c not in _WORKED]
    obs = cigar.observations(F.col("segs"), F.col("digits"), F.col("letters"), max_offset)
    rows = rows.select(*names, F.coalesce(obs, F.expr("cast(array() as array<bigint>)")).alias("found"))
    out = scalars.select_once(rows, names, [F.size("found").alias("n_obs"), F.col("found").alias("obs")])
    if counters is not None:
        out = out.observe(counters, *_kept_counts())
    return out if keep_empty else out.where("n_obs > 0")


def observed_spans(parsed: DataFrame, acc: str = "auto", min_pident: float = 0.0, max_evalue: float = 1.0, max_offset: int | None = MAX_OFFSET) -> DataFrame:
    """(shard_id, hog_id, acc_id, sstart, send, pident_u8) of the rows that ``align`` keeps. Each is looked at up to its first observation."""
    columns = ["shard_id", scalars.extract_hog(F.col("sseqid")).alias("hog_id"), _acc(acc), "sstart", "send", scalars.pident_u8(F.col("pident")).alias("pident_u8")]
    rows = _coded(parsed, columns, min_pident, max_evalue)
    return rows.where(cigar.any_observation(F.col("segs"), F.col("digits"), F.col("letters"), max_offset)).drop(*_WORKED)


def observable(parsed: DataFrame, acc: str = "auto", min_pident: float = 0.0, max_evalue: float = 1.0) -> DataFrame:
    """The rows that go on, with what their observations are read from by ``unfold``."""
    every = {
        "shard_id": F.col("shard_id"), "hog_id": scalars.extract_hog(F.col("sseqid")), "acc_id": _acc(acc), "cnum": scalars.parse_cnum(F.col("qseqid")), "sstart": F.col("sstart"),
        "send": F.col("send"), "pident_u8": scalars.pident_u8(F.col("pident")),
    }
    return _coded(parsed, [c.alias(n) for n, c in every.items()], min_pident, max_evalue)


def observe(parsed: DataFrame, max_offset: int | None = MAX_OFFSET, marks: tuple[str, ...] = (), **options) -> DataFrame:
    """``flatten`` of ``align``, a row per observation, without arrays of them; ``marks``: further columns of the alignment to carry."""
    return unfold(observable(parsed, **options), max_offset, marks)


def observed(rows: DataFrame, max_offset: int | None = MAX_OFFSET) -> DataFrame:
    """The rows of ``observable`` that have an observation."""
    return rows.where(cigar.any_observation(F.col("segs"), F.col("digits"), F.col("letters"), max_offset))


def unfold(rows: DataFrame, max_offset: int | None, marks: tuple[str, ...] = ()) -> DataFrame:
    """The observations of rows of ``observable``."""
    digits, letters = F.col("digits"), F.col("letters")
    names = [c for c in rows.columns if c != "segs"]
    # outer, since Spark puts a filter that works the array out below an inner one
    segs = rows.select(*names, F.explode_outer("segs").alias("s"))
    each = segs.select(*names, "s", F.explode_outer(cigar.places(F.col("s"), digits, letters, max_offset)).alias("k"))
    q = F.col("s.q") + F.col("k")
    good = each.where(cigar.encodes(cigar.code_at(digits, q), letters, q))
    return good.select(
        "shard_id", "hog_id", (F.col("sstart") + F.col("s.h") + F.col("k")).cast("int").alias("hog_pos"), "acc_id", "cnum",
        cigar.codon_number(cigar.code_at(digits, q)).cast("tinyint").alias("codon_idx"), *marks,
    )


class Counters:
    """What an ingest of lines counts on its way, readable once an action has run: lines, skipped rows, rows without
    nucleotides, records, observations, observations dropped."""

    def __init__(self) -> None:
        self.rows, self.kept = Observation(), Observation()

    @property
    def get(self) -> dict[str, int]:
        return {**self.rows.get, **self.kept.get}


def ingest(lines: DataFrame, counters: Counters | None = None, **options) -> DataFrame:
    """``align`` of ``parse``; ``counters`` gets its numbers in the same pass."""
    parsed = parse(lines)
    if counters is None:
        return align(parsed, **options)
    limits = {k: v for k, v in options.items() if k in ("min_pident", "max_evalue")}
    return align(parsed.observe(counters.rows, *_row_counts(reject_reason(**limits))), counters=counters.kept, **options)


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("bigint")), F.lit(0))


def _row_counts(reason: Column) -> list[Column]:
    silent = F.coalesce(reason == "no_nucleotides", F.lit(False))
    return [F.count(F.lit(1)).alias("lines"), _sum(reason.isNotNull() & ~silent).alias("skipped"), _sum(silent).alias("no_nucleotides")]


def _kept_counts() -> list[Column]:
    n = F.col("n_obs")
    return [_sum(n > 0).alias("records"), _sum(n).alias("observations"), _sum(F.col("send") - F.col("sstart") + 1 - n).alias("observations_dropped")]


def counts(lines: DataFrame, **options) -> DataFrame:
    """One row: lines, rows skipped, rows without nucleotides, records written, observations kept and dropped."""
    limits = {k: v for k, v in options.items() if k in ("min_pident", "max_evalue")}
    parsed = parse(lines)
    kept = align(parsed, keep_empty=True, **options).agg(*_kept_counts())
    return kept.join(parsed.agg(*_row_counts(reject_reason(**limits))))  # one row each


def flatten(hsp: DataFrame, marks: tuple[str, ...] = ()) -> DataFrame:
    """The ``obs`` table: a row per observation, duplicates kept; ``marks``: further columns of the alignment to carry."""
    return hsp.select("shard_id", "hog_id", "acc_id", "cnum", "sstart", *marks, F.explode("obs").alias("o")).select(
        "shard_id", "hog_id", (F.col("sstart") + F.shiftright("o", 6)).cast("int").alias("hog_pos"), "acc_id", "cnum", F.col("o").bitwiseAND(F.lit(63)).cast("tinyint").alias("codon_idx"), *marks
    )
