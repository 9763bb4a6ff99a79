"""SQL that states what each registered query returns, written from the definitions and run by DuckDB."""

from __future__ import annotations

from .driver_view import GENETIC_CODE, duckdb_lines
from .functions.scalars import AMINO_ACIDS, FLOAT_PREFIX


def _uint(c: str) -> str:
    n = f"try_cast(nullif(regexp_extract({c}, '^[0-9]+'), '') as bigint)"
    return f"case when {n} <= 4294967295 then {n} end"


def _float(c: str, kind: str) -> str:
    return f"try_cast(nullif(regexp_extract({c}, '{FLOAT_PREFIX}'), '') as {kind})"


CNUM = f"coalesce({_uint("regexp_extract(qseqid, '^[^_]*_([0-9]+)', 1)")}, cast('0x' || substr(md5(qseqid), 1, 8) as bigint))"
IDX = "(" + " + ".join(f"{16 >> (2 * i)} * (instr('ACGT', substr(codon, {i + 1}, 1)) - 1)" for i in range(3)) + ")"
FRAME = "(case when minus then -1 else 1 end) * ((case when minus then greatest(qlen - qend, 0) else greatest(qstart - 1, 0) end) % 3 + 1)"
PIDENT = "cast(floor(least(cast(100 as float), pident + cast(0.5 as float))) as integer)"

_RAW = f"""raw as materialized (select row_number() over () as rid, shard_id, overlap_id, line as value from ({duckdb_lines()}))"""

_PARSED = f"""kept as materialized (select *, string_split(value, chr(9)) as p from raw where value <> '' and value not like '#%'),
parsed as materialized (select rid, shard_id, overlap_id, len(p) as n_fields, p[1] as qseqid, {_uint("p[2]")} as qstart, {_uint("p[3]")} as qend, {_uint("p[4]")} as qlen,
  p[5] as qstrand, p[5] like '-%' as minus, p[6] as sseqid, {_uint("p[7]")} as sstart, {_uint("p[8]")} as send, {_float("p[10]", "float")} as pident, {_float("p[11]", "double")} as evalue,
  p[12] as cigar, p[13] as qseq, p[14] as nt from kept),
judged as materialized (select *, case when n_fields < 13 then 'fields' when pident is null or evalue is null then 'number' when pident < 0 then 'pident' when evalue > 1.0 then 'evalue'
  when pident = cast(100 as float) then 'perfect' when sstart is null or send is null or qstart is null or qend is null or qlen is null then 'coordinates' when sstart > send then 'span'
  when coalesce(nt, '') = '' then 'no_nucleotides' end as reason from parsed),
valid as materialized (select *, send - sstart + 1 as span, list_last(string_split(sseqid, '|')) as hog_id, string_split(qseqid, '_')[1] as acc_id, {CNUM} as cnum from judged where reason is null)"""

_OBS = f"""tokens as (select rid, regexp_extract_all(regexp_extract(cigar, '^((?:0*[1-9][0-9]*[^0-9])*)', 1), '[0-9]+[^0-9]') as t from valid),
ops as (select rid, unnest(range(1, len(t) + 1)) as i, unnest(t) as tok from tokens),
runs as (select rid, i, right(tok, 1) as op, cast(left(tok, length(tok) - 1) as bigint) as n from ops),
segs as (select rid, op, n, coalesce(sum(case when op in ('M', 'D') then n else 0 end) over w, 0) as h, coalesce(sum(case when op in ('M', 'I') then n else 0 end) over w, 0) as q
  from runs window w as (partition by rid order by i rows between unbounded preceding and 1 preceding)),
places as (select rid, cast(h + k as bigint) as off, cast(q + k as bigint) as q from (select rid, h, q, unnest(range(0, n)) as k from segs where op = 'M')),
cut as materialized (select v.rid, v.shard_id, v.overlap_id, v.hog_id, v.acc_id, v.cnum, v.sstart, off, minus, case when minus then
    case when 3 * q + 3 <= qstart and qstart - 1 - 3 * q < length(nt) then translate(reverse(substr(nt, qstart - 3 * q - 2, 3)), 'ACGT', 'TGCA') end
    else case when qstart >= 1 and qstart + 3 * q + 1 < length(nt) then substr(nt, qstart + 3 * q, 3) end end as codon,
  translate(substr(qseq, q + 1, 1), 'BZJUO', 'NQLCK') as aa from places join valid v using (rid) where off < v.span),
acgt as (select *, {IDX} as codon_idx from cut where regexp_full_match(codon, '[ACGT][ACGT][ACGT]')),
obs as materialized (select *, sstart + off as hog_pos, substr('{GENETIC_CODE}', cast(codon_idx + 1 as int), 1) as obs_aa from acgt
  where substr('{GENETIC_CODE}', cast(codon_idx + 1 as int), 1) = aa and length(aa) = 1 and instr('{AMINO_ACIDS}', aa) > 0 and off < 1024),
hsp as materialized (select v.*, n_obs, {PIDENT} as pident_u8 from valid v join (select rid, count(*) as n_obs from obs group by rid) using (rid)),
pairs as materialized (select shard_id, hog_id, acc_id, min(pident_u8) as min_pident, cast(sum(n_obs) as bigint) as n_obs from hsp group by all),
other_pairs as (select overlap_id, hog_id, acc_id, min(pident_u8) as min_pident from hsp group by all)"""


def lines(select: str) -> str:
    return f"with {_RAW} {select}"


def parsed(select: str) -> str:
    return f"with {_RAW}, {_PARSED} {select}"


def observed(select: str) -> str:
    return f"with {_RAW}, {_PARSED}, {_OBS} {select}"
