"""Registered queries of the engine and the SQL of each, side by side. All run over whole tables of the driver view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as sql
from .driver_view import alignment_lines
from .functions import cigar, scalars
from .operators import aggregates, ingest
from .plans import index as idx
from .plans import queries as q
from .sources.folders import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOG = "N0.HOG0000007"


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# ---------------------------------------------------------------- tables of the view
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_lines(spark, sf_dir).select("shard_id", "value")


def _overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_lines(spark, sf_dir).select(F.col("overlap_id").alias("shard_id"), "value")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse(_lines(spark, sf_dir))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).where(ingest.reject_reason().isNull())


def _hsp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest(_lines(spark, sf_dir))


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.observe(_parsed(spark, sf_dir))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.observed_spans(_parsed(spark, sf_dir))


def _index(spark: SparkSession, sf_dir: str, rollup: bool = False) -> idx.Index:
    return idx.build(_lines(spark, sf_dir), rollup)


def _int(*names: str) -> list:
    return [F.col(n).cast("int").alias(n) for n in names]


def _long(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _minus():
    return F.coalesce(F.substring("qstrand", 1, 1) == "-", F.lit(False))


def _span():
    return F.col("send") - F.col("sstart") + 1


# ---------------------------------------------------------------- sources, parsing, filters
@query(sql.lines("select shard_id, cast(len(string_split(value, chr(9))) as integer) as n_fields, count(*) as n from raw where value <> '' and value not like '#%' group by all"))
def field_split(spark, sf_dir):
    from .sources.alignments import split_fields

    return split_fields(_lines(spark, sf_dir)).groupBy("shard_id", F.size("parts").alias("n_fields")).agg(F.count("*").alias("n"))


@query(sql.lines("select shard_id, count(*) as kept from raw where value <> '' and value not like '#%' group by all"))
def comment_filter(spark, sf_dir):
    from .sources.alignments import split_fields

    return split_fields(_lines(spark, sf_dir)).groupBy("shard_id").agg(F.count("*").alias("kept"))


@query(sql.parsed("select qseqid, qstart, qend, qlen, sstart, send, cast(pident as double) as pident, evalue from parsed"))
def numeric_parse(spark, sf_dir):
    return _parsed(spark, sf_dir).select("qseqid", "qstart", "qend", "qlen", "sstart", "send", F.col("pident").cast("double").alias("pident"), "evalue")


@query(sql.parsed("select coalesce(reason, 'kept') as reason, count(*) as n from judged group by all"))
def hsp_filters(spark, sf_dir):
    return _parsed(spark, sf_dir).groupBy(F.coalesce(ingest.reject_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(sql.parsed("select shard_id, count(*) as n from judged where reason = 'perfect' group by all"))
def perfect_match_drop(spark, sf_dir):
    return _parsed(spark, sf_dir).where(ingest.reject_reason() == "perfect").groupBy("shard_id").agg(F.count("*").alias("n"))


@query(sql.parsed("select shard_id, count(*) as n from judged where pident >= 70 and evalue <= 0.001 and pident <> 100 group by all"))
def ingest_thresholds(spark, sf_dir):
    reason = ingest.reject_reason(70, 0.001)
    passed = reason.isNull() | reason.isin("coordinates", "span", "no_nucleotides")
    return _parsed(spark, sf_dir).where(passed).groupBy("shard_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- scalar functions
@query(sql.parsed("select distinct sseqid, hog_id from valid"))
def extract_hog(spark, sf_dir):
    return _valid(spark, sf_dir).select("sseqid", scalars.extract_hog(F.col("sseqid")).alias("hog_id")).distinct()


@query(sql.parsed("select distinct qseqid, acc_id from valid"))
def extract_acc(spark, sf_dir):
    return _valid(spark, sf_dir).select("qseqid", scalars.extract_acc(F.col("qseqid")).alias("acc_id")).distinct()


@query(sql.parsed("select distinct qseqid, cnum from valid"))
def parse_cnum(spark, sf_dir):
    return _valid(spark, sf_dir).select("qseqid", scalars.parse_cnum(F.col("qseqid")).alias("cnum")).distinct()


@query(sql.parsed("select distinct qseqid, acc_id || '_' || cast(cnum as varchar) as unitig_id from valid"))
def unitig_id(spark, sf_dir):
    c = F.col("qseqid")
    return _valid(spark, sf_dir).select("qseqid", scalars.unitig_id(scalars.extract_acc(c), scalars.parse_cnum(c)).alias("unitig_id")).distinct()


@query(sql.parsed(f"select qseqid, cast({sql.FRAME} as integer) as qframe from valid"))
def qframe(spark, sf_dir):
    c = [F.col(x) for x in ("qstrand", "qstart", "qend", "qlen")]
    return _valid(spark, sf_dir).select("qseqid", scalars.qframe(*c).cast("int").alias("qframe"))


@query(sql.parsed("select qseqid, substr(nt, 8, 3) as codon, regexp_replace(translate(reverse(substr(nt, 8, 3)), 'ACGT', 'TGCA'), '[^ACGT]', 'N', 'g') as rc from valid"))
def revcomp(spark, sf_dir):
    codon = F.substring("full_qseq", 8, 3)
    return _valid(spark, sf_dir).select("qseqid", codon.alias("codon"), scalars.revcomp(codon).alias("rc"))


_ALL = "codons as (select a.b || c.b || d.b as codon from (values ('A'), ('C'), ('G'), ('T')) a(b), (values ('A'), ('C'), ('G'), ('T')) c(b), (values ('A'), ('C'), ('G'), ('T')) d(b))"


def _codons(spark: SparkSession) -> DataFrame:
    """The codon dimension: 64 rows by their number."""
    return spark.range(64).select(scalars.unpack_codon(F.col("id")).alias("codon"))


@query(f"with {_ALL} select codon, cast({sql.IDX} as integer) as codon_idx, codon as unpacked from codons")
def codon_pack_unpack(spark, sf_dir):
    packed = scalars.pack_codon(F.col("codon"))
    return _codons(spark).select("codon", packed.cast("int").alias("codon_idx"), scalars.unpack_codon(packed).alias("unpacked"))


@query(f"with {_ALL} select codon, nullif(substr('{sql.GENETIC_CODE}', cast({sql.IDX} + 1 as int), 1), '*') as aa from codons")
def codon_to_aa(spark, sf_dir):
    return _codons(spark).select("codon", scalars.codon_to_aa(F.col("codon")).alias("aa"))


@query(
    sql.parsed(
        f"select letter, case when instr('{sql.AMINO_ACIDS}', f) > 0 then f end as aa, n from (select letter, translate(letter, 'BZJUO', 'NQLCK') as f, count(*) as n from (select unnest(string_split(qseq, '')) as letter from valid) where letter <> '' group by all)"
    )
)
def encode_aa(spark, sf_dir):
    letters = _valid(spark, sf_dir).select(F.explode(F.split("qseq_translated", "")).alias("letter")).where("letter <> ''")
    return letters.groupBy("letter").agg(F.count("*").alias("n")).select("letter", scalars.encode_aa(F.col("letter")).alias("aa"), "n")


@query(sql.parsed(f"select qseqid, {sql.PIDENT} as pident_u8 from valid"))
def pident_u8(spark, sf_dir):
    return _valid(spark, sf_dir).select("qseqid", scalars.pident_u8(F.col("pident")).alias("pident_u8"))


@query(sql.parsed("select qseqid, cast(round(cast(pident as double) * 10) as integer) as code, cast(round(cast(pident as double) * 10) as integer) / 10.0 as back from valid"))
def pident_codec(spark, sf_dir):
    code = scalars.encode_pident(F.col("pident"))
    return _valid(spark, sf_dir).select("qseqid", code.alias("code"), scalars.decode_pident(code).alias("back"))


@query(sql.parsed("select qseqid, cast(case when evalue <= 0 then -32767 else greatest(-32767, least(0, round(log10(evalue) * 100))) end as integer) as code from valid"))
def evalue_codec(spark, sf_dir):
    return _valid(spark, sf_dir).select("qseqid", scalars.encode_evalue(F.col("evalue")).alias("code"))


# ---------------------------------------------------------------- CIGAR and codons
@query(sql.observed("select cigar, span, cast(h as bigint) as h, cast(q as bigint) as q, cast(least(n, span - h) as bigint) as n from (select distinct cigar, span, h, q, n from segs join valid using (rid) where op = 'M' and h < span)"))
def cigar_segments(spark, sf_dir):
    rows = _valid(spark, sf_dir).select("cigar", _span().alias("span")).distinct()
    return rows.select("cigar", "span", F.explode(cigar.match_segments(F.col("cigar"), F.col("span"))).alias("s")).select("cigar", "span", "s.h", "s.q", "s.n")


@query(sql.observed("select distinct cigar, span, off, q from places join (select rid, cigar, span from valid) using (rid) where off < span"))
def cigar_expand(spark, sf_dir):
    rows = _valid(spark, sf_dir).select("cigar", _span().alias("span")).distinct()
    segs = rows.select("cigar", "span", F.explode(cigar.match_segments(F.col("cigar"), F.col("span"))).alias("s"))
    return segs.select("cigar", "span", "s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("s.n") - 1)).alias("k")).select(
        "cigar", "span", (F.col("s.h") + F.col("k")).alias("off"), (F.col("s.q") + F.col("k")).alias("q")
    ).distinct()


def _cut(spark, sf_dir, strand: bool | None = None) -> DataFrame:
    """Codons at match positions, of one strand or of both in one pass."""
    rows = _valid(spark, sf_dir) if strand is None else _valid(spark, sf_dir).where(_minus() == strand)
    names = ["shard_id", "qseqid", "qseq_translated", "full_qseq", "qstart", "minus"]
    minus = _minus() if strand is None else F.lit(strand)
    rows = cigar.with_segments(rows.select(*names[:-1], minus.alias("minus"), "cigar", _span().alias("span")), names, F.col("cigar"), F.col("span"))
    segs = rows.select(*names, F.explode_outer("segs").alias("s")).where("s is not null")
    each = segs.select(*names, "s", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), F.col("s.n") - 1)).alias("k"))
    codon = cigar.codon_at(F.col("full_qseq"), F.col("qstart"), F.col("minus") if strand is None else F.lit(strand), F.col("s.q") + F.col("k"))
    return each.select("shard_id", "qseqid", "qseq_translated", (F.col("s.q") + F.col("k")).alias("q"), (F.col("s.h") + F.col("k")).alias("off"), codon.alias("codon"))


@query(sql.observed("select qseqid, off, codon from cut join (select rid, qseqid from valid) using (rid) where not minus"))
def codon_plus(spark, sf_dir):
    return _cut(spark, sf_dir, False).select("qseqid", "off", "codon")


@query(sql.observed("select qseqid, off, codon from cut join (select rid, qseqid from valid) using (rid) where minus"))
def codon_minus(spark, sf_dir):
    return _cut(spark, sf_dir, True).select("qseqid", "off", "codon")


@query(sql.observed("select codon, count(*) as n from cut where codon is not null and not regexp_full_match(codon, '[ACGT]{3}') group by all"))
def acgt_reject(spark, sf_dir):
    return _cut(spark, sf_dir).where(F.col("codon").isNotNull() & scalars.pack_codon(F.col("codon")).isNull()).groupBy("codon").agg(F.count("*").alias("n"))


@query(sql.observed(f"select shard_id, count(*) as rejected from acgt where substr('{sql.GENETIC_CODE}', cast(codon_idx + 1 as int), 1) <> aa group by all"))
def round_trip_reject(spark, sf_dir):
    rows = _cut(spark, sf_dir)
    packed = scalars.pack_codon(F.col("codon"))
    aa = F.translate(F.substr("qseq_translated", (F.col("q") + 1).cast("int"), F.lit(1)), scalars.FOLDED_FROM, scalars.FOLDED_TO)
    wrong = F.substr(F.lit(scalars.GENETIC_CODE), packed.cast("int") + 1, F.lit(1)) != aa
    return rows.where(packed.isNotNull() & wrong).groupBy("shard_id").agg(F.count("*").alias("rejected"))


@query(sql.observed("select shard_id, cast(sum(span) - sum(coalesce(n_obs, 0)) as bigint) as dropped from valid left join (select rid, count(*) as n_obs from obs group by rid) using (rid) group by all"))
def observations_dropped(spark, sf_dir):
    return ingest.align(_parsed(spark, sf_dir), keep_empty=True).groupBy("shard_id").agg(F.sum(_span() - F.col("n_obs")).alias("dropped"))


@query(sql.parsed("select distinct cast(case when evalue <= 0 then -32767 else greatest(-32767, least(0, round(log10(evalue) * 100))) end as integer) as code, cast(case when evalue <= 0 then null else greatest(-32767, least(0, round(log10(evalue) * 100))) end as integer) as back from valid"))
def evalue_decode(spark, sf_dir):
    code = scalars.encode_evalue(F.col("evalue"))
    value = scalars.decode_evalue(code)
    return _valid(spark, sf_dir).select(code.alias("code"), F.when(value > 0, F.round(F.log10(value) * 100)).cast("int").alias("back")).distinct()


@query(sql.observed("select shard_id, count(*) as n from obs where off < 8 group by all"))
def offset_cap(spark, sf_dir):
    return ingest.ingest(_lines(spark, sf_dir), max_offset=8).groupBy("shard_id").agg(F.sum("n_obs").alias("n"))


@query(sql.observed("select shard_id, hog_id, cast(hog_pos as integer) as hog_pos, acc_id, cnum, cast(codon_idx as integer) as codon_idx from obs"))
def obs_flatten(spark, sf_dir):
    return _obs(spark, sf_dir).select("shard_id", "hog_id", "hog_pos", "acc_id", "cnum", *_int("codon_idx"))


@query(sql.observed(f"select shard_id, hog_id, acc_id, qseqid as contig, cnum, sstart, send, cast({sql.FRAME} as integer) as qframe, pident_u8, evalue, cast(n_obs as integer) as n_obs from hsp"))
def hsp_records(spark, sf_dir):
    return _hsp(spark, sf_dir).select("shard_id", "hog_id", "acc_id", "contig", "cnum", "sstart", "send", *_int("qframe"), "pident_u8", "evalue", "n_obs")


@query(sql.observed("select (select count(*) from hsp) as records, (select count(*) from judged where reason <> 'no_nucleotides') as skipped, (select count(*) from judged where reason = 'no_nucleotides') as no_nucleotides, (select count(*) from obs) as observations, (select cast(sum(span) as bigint) from valid) - (select count(*) from obs) as observations_dropped"))
def ingest_counters(spark, sf_dir):
    return ingest.counts(_lines(spark, sf_dir)).select("records", "skipped", "no_nucleotides", "observations", "observations_dropped")


# ---------------------------------------------------------------- aggregations
@query(sql.observed("select hog_id, count(*) as n_records, min(sstart) as min_sstart, max(send) as max_send from hsp group by all"))
def group_by_hog(spark, sf_dir):
    return _spans(spark, sf_dir).groupBy("hog_id").agg(F.count("*").alias("n_records"), F.min("sstart").alias("min_sstart"), F.max("send").alias("max_send"))


@query(sql.observed("select hog_id, cast(hog_pos as integer) as hog_pos, count(*) as n_obs from obs group by all"))
def group_by_position(spark, sf_dir):
    return _obs(spark, sf_dir).groupBy("hog_id", "hog_pos").agg(F.count("*").alias("n_obs"))


@query(sql.observed("select shard_id, hog_id, acc_id, min_pident from pairs"))
def min_pident(spark, sf_dir):
    return aggregates.min_pident(_spans(spark, sf_dir))


@query(sql.observed("select hog_id, cast(max(send) + 1 as integer) as hog_length from hsp group by all"))
def hog_length(spark, sf_dir):
    return _spans(spark, sf_dir).groupBy("hog_id").agg((F.max("send") + 1).cast("int").alias("hog_length"))


@query(sql.observed("select shard_id, hog_id, acc_id, cast(count(distinct x) as integer) as covered_aa from (select shard_id, hog_id, acc_id, unnest(range(sstart, send + 1)) as x from hsp) group by all"))
def coverage(spark, sf_dir):
    return aggregates.coverage(_spans(spark, sf_dir))


@query(sql.observed("select hog_id, count(distinct acc_id) as n_accessions from hsp group by all"))
def n_accessions(spark, sf_dir):
    return _spans(spark, sf_dir).groupBy("hog_id").agg(F.count_distinct("acc_id").alias("n_accessions"))


@query(sql.observed("select hog_id, count(distinct hog_pos) as n_positions from obs group by all"))
def n_positions(spark, sf_dir):
    return _obs(spark, sf_dir).groupBy("hog_id").agg(F.count_distinct("hog_pos").alias("n_positions"))


_BEST = "best as (select *, row_number() over (partition by shard_id, hog_id, hog_pos order by n desc, codon_idx) as r, sum(n) over (partition by shard_id, hog_id, hog_pos) as total from (select shard_id, hog_id, hog_pos, codon_idx, codon, count(*) as n from obs group by all))"


@query(sql.observed("").rstrip() + f", {_BEST} select shard_id, hog_id, cast(hog_pos as integer) as hog_pos, codon as consensus_codon from best where r = 1")
def consensus(spark, sf_dir):
    return aggregates.consensus(_obs(spark, sf_dir)).select("shard_id", "hog_id", "hog_pos", "consensus_codon")


@query(sql.observed("").rstrip() + f", {_BEST} select shard_id, hog_id, cast(hog_pos as integer) as hog_pos, cast(total as bigint) as n_obs, cast(total - n as bigint) as n_var from best where r = 1")
def n_var(spark, sf_dir):
    return aggregates.consensus(_obs(spark, sf_dir)).select("shard_id", "hog_id", "hog_pos", "n_obs", "n_var")


@query(sql.observed("select hog_id, count(*) as n_unitigs from (select distinct hog_id, acc_id, cnum from obs) group by all"))
def unitig_dict(spark, sf_dir):
    return _hsp(spark, sf_dir).select("hog_id", "acc_id", "cnum").distinct().groupBy("hog_id").agg(F.count("*").alias("n_unitigs"))


@query(sql.observed("select shard_id, hog_id, acc_id, cnum, cast(dense_rank() over (partition by shard_id, hog_id order by acc_id, cnum) - 1 as integer) as uid from (select distinct shard_id, hog_id, acc_id, cnum from obs)"))
def unitig_dense_id(spark, sf_dir):
    return aggregates.unitigs(_obs(spark, sf_dir))


@query(sql.parsed("select acc_id, row_number() over (order by acc_id) - 1 as acc_idx from (select distinct string_split(qseqid, '_')[1] as acc_id from parsed)"))
def acc_rank(spark, sf_dir):
    return aggregates.acc_rank(idx.accessions(_lines(spark, sf_dir)))


@query(sql.observed("select hog_id, cast(hog_pos as integer) as hog_pos, acc_id, cnum, cast(codon_idx as integer) as codon_idx, cast(row_number() over (partition by shard_id, hog_id, hog_pos order by acc_id, cnum, codon_idx) - 1 as integer) as ordinal from obs"))
def obs_ordinal(spark, sf_dir):
    return aggregates.obs_ordinals(_obs(spark, sf_dir)).select("hog_id", "hog_pos", "acc_id", "cnum", *_int("codon_idx"), "ordinal")


@query(sql.observed("select shard_id, hog_id, cast(hog_pos as integer) as hog_pos, cast(hog_pos - lag(hog_pos, 1, 0) over (partition by shard_id, hog_id order by hog_pos) as integer) as delta from (select distinct shard_id, hog_id, hog_pos from obs)"))
def pos_delta(spark, sf_dir):
    return aggregates.position_deltas(_obs(spark, sf_dir))


# ---------------------------------------------------------------- queries
def _freq(where: str, least: int = 0, shard: str = "shard_id", keys: str = "hog_id, ") -> str:
    pairs = "pairs" if shard == "shard_id" else "other_pairs"
    return sql.observed(
        f"select {keys}cast(hog_pos as integer) as hog_pos, codon, obs_aa, count(distinct {shard} || '/' || acc_id) as n_accessions from obs "
        f"semi join (select * from {pairs} where min_pident >= {least}) using ({shard}, hog_id, acc_id) where {where} group by all"
    )


@query(_freq(f"hog_id = '{HOG}'", keys=""))
def freq_hog(spark, sf_dir):
    return q.freq(_index(spark, sf_dir), HOG)


@query(_freq(f"hog_id = '{HOG}'", 62, keys=""))
def freq_min_pident(spark, sf_dir):
    return q.freq(_index(spark, sf_dir), HOG, 62)


@query(_freq("true"))
def dump_all(spark, sf_dir):
    return q.dump(_index(spark, sf_dir))


@query(_freq("true", 65))
def dump_min_pident(spark, sf_dir):
    return q.dump(_index(spark, sf_dir), 65)


@query(_freq("true", 62))
def freq_rollup(spark, sf_dir):
    return q.dump(_index(spark, sf_dir, rollup=True), 62)


def _saav(where: str, shard: str = "shard_id") -> str:
    pairs = "pairs" if shard == "shard_id" else "other_pairs"
    return sql.observed(
        f"select acc_id, acc_id || '_' || cast(cnum as varchar) as unitig_id, cast(hog_pos as integer) as hog_pos, obs_aa, codon, min_pident as pident from obs join (select {shard}, hog_id, acc_id, min_pident from {pairs}) using ({shard}, hog_id, acc_id) where hog_id = '{HOG}' and {where}"
    )


@query(_saav("hog_pos = 120"))
def saav(spark, sf_dir):
    return q.saav(_index(spark, sf_dir), HOG, 120)


@query(_saav("hog_pos = 120 and obs_aa = 'L'"))
def saav_aa(spark, sf_dir):
    return q.saav(_index(spark, sf_dir), HOG, 120, "L")


@query(_saav("hog_pos = 120 and min_pident >= 62"))
def saav_min_pident(spark, sf_dir):
    return q.saav(_index(spark, sf_dir), HOG, 120, min_pident=62)


@query(sql.observed("select (select count(distinct hog_id) from hsp) as n_hogs, (select count(distinct string_split(qseqid, '_')[1]) from parsed) as n_accessions, (select count(*) from pairs) as total_hog_accession_pairs"))
def stat_totals(spark, sf_dir):
    return q.stat(_index(spark, sf_dir))


@query(sql.observed("select hog_id, count(*) as n_accessions, cast(sum(n_obs) as bigint) as n_obs from pairs group by all"))
def stat_per_hog(spark, sf_dir):
    return q.stat_hogs(_index(spark, sf_dir))


@query(sql.observed("select acc_id, count(distinct hog_id) as n_hogs, count(*) as n_blocks from pairs group by all"))
def stat_accession(spark, sf_dir):
    return q.stat_accession(_index(spark, sf_dir))


@query(sql.observed("select acc_id, hog_id, count(*) as n_blocks from pairs group by all"))
def stat_accession_hogs(spark, sf_dir):
    return q.stat_accession_hogs(_index(spark, sf_dir))


# ---------------------------------------------------------------- shards
def _split(spark, sf_dir, lines: DataFrame, shards: list[str]) -> idx.Index:
    out = None
    for s in shards:
        one = idx.build(lines.where(F.col("shard_id") == s))
        out = one if out is None else out.union(one)
    return out


@query(sql.parsed("select distinct string_split(qseqid, '_')[1] as acc_id from parsed"))
def registry_union(spark, sf_dir):
    lines = _overlapping(spark, sf_dir)
    both = [idx.accessions(lines.where(F.col("shard_id") == s)).select("acc_id") for s in ("half0", "half1")]
    return both[0].union(both[1]).distinct()


@query(_freq(f"hog_id = '{HOG}'", shard="overlap_id", keys=""))
def cross_shard_freq(spark, sf_dir):
    return q.freq(_split(spark, sf_dir, _overlapping(spark, sf_dir), ["half0", "half1"]), HOG)


@query(_saav("hog_pos = 120", "overlap_id"))
def cross_shard_saav(spark, sf_dir):
    return q.saav(_split(spark, sf_dir, _overlapping(spark, sf_dir), ["half0", "half1"]), HOG, 120)


@query(sql.observed("select hog_id, count(*) as n_obs, count(distinct acc_id) as n_accessions from obs group by all"))
def merge_shards(spark, sf_dir):
    both = _split(spark, sf_dir, _lines(spark, sf_dir), [f"shard{i}" for i in range(4)])
    return both.obs.groupBy("hog_id").agg(F.count("*").alias("n_obs"), F.count_distinct("acc_id").alias("n_accessions"))


@query(sql.observed("select hog_id, count(*) as n_obs from obs where hog_id between 'N0.HOG0000005' and 'N0.HOG0000009' group by all"))
def hog_range_inclusive(spark, sf_dir):
    return q.hog_range(_obs(spark, sf_dir), "N0.HOG0000005", "N0.HOG0000009").groupBy("hog_id").agg(F.count("*").alias("n_obs"))


@query(sql.observed("select hog_id, count(*) as n_obs from obs where hog_id >= 'N0.HOG0000005' and hog_id < 'N0.HOG0000009' group by all"))
def hog_range_exclusive(spark, sf_dir):
    return q.hog_range(_obs(spark, sf_dir), "N0.HOG0000005", "N0.HOG0000009", False).groupBy("hog_id").agg(F.count("*").alias("n_obs"))


@query(sql.observed("select shard_id, hog_id, cast(max(send) + 1 as integer) as hog_length, cast(count(distinct acc_id) as integer) as n_accessions, cast((select count(distinct hog_pos) from obs o where o.shard_id = h.shard_id and o.hog_id = h.hog_id) as integer) as n_positions, cast(sum(n_obs) as bigint) as n_obs from hsp h group by shard_id, hog_id"))
def hog_catalog(spark, sf_dir):
    return _index(spark, sf_dir).hog


# ---------------------------------------------------------------- written tables
def _write(spark, lines: DataFrame) -> tuple[str, idx.Index]:
    path = work_folder(spark)
    return path, idx.write(lines, path)


def _write_shards(spark, lines: DataFrame, shards: list[str]) -> str:
    """An index per shard in a folder of their own."""
    path = work_folder(spark)
    for s in shards:
        idx.write(lines.where(F.col("shard_id") == s), f"{path}/{s}")
    return path


@query(_freq("true", 65))
def written_dump(spark, sf_dir):
    return q.dump(_write(spark, _lines(spark, sf_dir))[1], 65)


@query(_saav("hog_pos = 120"))
def written_saav(spark, sf_dir):
    return q.saav(_write(spark, _lines(spark, sf_dir))[1], HOG, 120)


@query(sql.observed("select shard_id, cast(count(distinct hog_id) as bigint) as n_hogs, n_accessions from hsp join (select shard_id, count(distinct string_split(qseqid, '_')[1]) as n_accessions from parsed group by all) using (shard_id) group by all"))
def manifest(spark, sf_dir):
    path = _write_shards(spark, _lines(spark, sf_dir), [f"shard{i}" for i in range(4)])
    rows = idx.write_manifest(spark, [path], f"{path}/all.manifest")
    return rows.select(F.substring_index("path", "/", -1).alias("shard_id"), "n_hogs", "n_accessions")


@query(_freq("true", shard="overlap_id"))
def manifest_dump(spark, sf_dir):
    path = _write_shards(spark, _overlapping(spark, sf_dir), ["half0", "half1"])
    idx.write_manifest(spark, [path], f"{path}/all.manifest")
    return q.dump(idx.read_manifest(spark, f"{path}/all.manifest"))


_SUMMED = "select hog_id, acc_id, min(min_pident) as min_pident, cast(sum(n_obs) as bigint) as n_obs, cast(sum(covered_aa) as integer) as covered_aa from (select overlap_id, hog_id, acc_id, min(pident_u8) as min_pident, sum(n_obs) as n_obs from hsp group by all) join (select overlap_id, hog_id, acc_id, count(distinct x) as covered_aa from (select overlap_id, hog_id, acc_id, unnest(range(sstart, send + 1)) as x from hsp) group by all) using (overlap_id, hog_id, acc_id) group by all"


@query(sql.observed(_SUMMED))
def merged_pairs(spark, sf_dir):
    path = _write_shards(spark, _overlapping(spark, sf_dir), ["half0", "half1"])
    one = idx.merge(spark, [path], f"{path}-one", as_shard="all")
    return one.hog_acc.select("hog_id", "acc_id", "min_pident", "n_obs", "covered_aa")


_FNV = "list_reduce(list_prepend(cast({basis} as hugeint), [cast(ord(x) as hugeint) for x in string_split(hog_id, '')]), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616)"


@query(sql.observed(f"select hog_id, cast({_FNV.format(basis=scalars.FNV_BASIS)} % 7 as integer) as hog_bucket, count(*) as n_obs from obs group by all"))
def hog_buckets(spark, sf_dir):
    path, ix = _write(spark, _lines(spark, sf_dir))
    return idx.write_buckets(ix, f"{path}/buckets", 7).groupBy("hog_id", "hog_bucket").agg(F.count("*").alias("n_obs"))


@query(sql.observed("select acc_id, count(*) as n_records, cast(sum(n_obs) as bigint) as n_obs from hsp group by all"))
def per_accession(spark, sf_dir):
    rows = idx.write_by_accession(_lines(spark, sf_dir), work_folder(spark))
    return rows.groupBy("acc_id").agg(F.count("*").alias("n_records"), F.sum("n_obs").alias("n_obs"))
