"""Alignment lines made from ``lineitem``: there is no alignment table among the driver's, so one is derived.

The expressions are plain SQL that Spark and DuckDB read alike, but for the list of residues (``LISTS``). They plant
what the engine must handle: both strands, insertions, deletions, unknown operations, cut spans, N bases, mismatches,
ambiguity letters, unreadable numbers, exact matches, missing nucleotides, comments and blank lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import GENETIC_CODE, select_once
from .sources.alignments import spread

#: Steps of (name, expression); each step sees the names of those before it.
STEPS = [
    {
        "okey": "l_orderkey", "lno": "cast(l_linenumber as bigint)", "pk": "l_partkey", "sk": "l_suppkey", "minus": "l_linestatus = 'O'",
        "naa": "4 + l_partkey % 17", "sstart": "(l_orderkey * 7 + l_linenumber * 13) % 300",
        "shard_id": "concat('shard', cast(l_suppkey % 4 as varchar(20)))",
        "nt0": "translate(concat(md5(concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)))), md5(concat(cast(l_orderkey as varchar(20)), '+', cast(l_linenumber as varchar(20))))), '0123456789abcdef', 'ACGTACGTACGTACGT')",
    },
    {
        "nt": "case when lno = 6 then concat(substr(nt0, 1, 9), 'N', substr(nt0, 11)) else nt0 end",
        "qstart": "case when minus then 64 - okey % 3 else 1 + okey % 3 end",
        "span": "case lno when 2 then naa - 1 when 3 then naa + 1 when 4 then naa - 2 else naa end",
        "cigar": "case lno when 2 then concat('2M1I', cast(naa - 3 as varchar(20)), 'M') when 3 then concat('2M1D', cast(naa - 2 as varchar(20)), 'M') when 5 then concat('3S', cast(naa as varchar(20)), 'M') else concat(cast(naa as varchar(20)), 'M') end",
        "acc": "concat('SRR', lpad(cast(sk as varchar(20)), 7, '0'))",
    },
    {"qend": "case when minus then qstart - 3 * naa + 1 else qstart + 3 * naa - 1 end", "qseq": "{residues}"},
    {
        "line": (
            "case when okey % 101 = 0 then '# comment' when okey % 103 = 0 then '' else concat("
            "acc, case when okey % 53 = 0 then '_x' else '_' end, cast(okey * 10 + lno as varchar(20)), '_ka:f:1', '{tab}',"
            "cast(qstart as varchar(20)), '{tab}', cast(qend as varchar(20)), '{tab}', '64', '{tab}', case when minus then '-' else '+' end, '{tab}',"
            "'bpgv2|N0.HOG', lpad(cast(pk % 50 as varchar(20)), 7, '0'), '{tab}', cast(sstart as varchar(20)), '{tab}', cast(sstart + span - 1 as varchar(20)), '{tab}', '400', '{tab}',"
            "case when okey % 97 = 0 then 'not_a_float' when lno % 2 = 0 then concat(cast(60 + okey % 41 as varchar(20)), '.5') else cast(60 + okey % 41 as varchar(20)) end, '{tab}',"
            "case okey % 13 when 0 then '1.5' when 1 then '1e-20' else '0.001' end, '{tab}', cigar, '{tab}', qseq,"
            "case when okey % 89 = 0 then '' else concat('{tab}', nt) end) end"
        )
    },
]

_CODON = "case when minus then translate(reverse(substr(nt, cast(qstart - 3 * q - 2 as int), 3)), 'ACGT', 'TGCA') else substr(nt, cast(qstart + 3 * q as int), 3) end"
_INDEX = " + ".join(f"{16 >> (2 * i)} * (instr('ACGT', substr(c, {i + 1}, 1)) - 1)" for i in range(3))
_RESIDUE = (
    "case when instr(c, 'N') > 0 or length(c) < 3 then 'X' when (okey + q) % 7 = 0 then 'W'"
    f" when (okey + q) % 5 = 0 and substr('{GENETIC_CODE}', cast({_INDEX} + 1 as int), 1) = 'N' then 'B'"
    f" else substr('{GENETIC_CODE}', cast({_INDEX} + 1 as int), 1) end"
)
_PER_Q = _RESIDUE.replace("substr(c,", f"substr({_CODON},").replace("instr(c,", f"instr({_CODON},").replace("length(c)", f"length({_CODON})")

#: DuckDB's residues. Spark has the same ones without a function of its own for each, which it would interpret: the aligned stretch is
#: turned into digits once, 15 of them are a number, and a codon and what is planted at its residue look a letter up.
LISTS = {"duckdb": f"array_to_string(list_transform(range(0, naa), lambda q: {_PER_Q}), '')"}

MOST = 20  # residues of a row
_CHUNK = 5  # codons of a number


def _letters() -> str:
    """1,000 letters by a codon's digits (ACGTN as 0..3 and 9), for each plant: none, a residue W, a residue B in place of N."""
    plain = ["X"] * 1000
    for i, aa in enumerate(GENETIC_CODE):
        plain[i // 16 * 100 + i // 4 % 4 * 10 + i % 4] = aa
    return ",".join(plain + ["X" if x == "X" else "W" for x in plain] + ["B" if x == "N" else x for x in plain])


def _spark_steps() -> list[dict[str, str]]:
    """From ``nt``, ``qstart``, ``naa`` and ``minus`` to ``qseq``. Rows have 4 to 20 residues and their stretch lies within the contig."""
    stretch = f"substr(nt, cast(case when minus then qstart - {3 * MOST - 1} else qstart end as int), {3 * MOST})"
    size = 3 * _CHUNK
    numbers = {f"n{j}": f"cast(substr(digits, {size * j + 1}, {size}) as bigint)" for j in range(MOST // _CHUNK)}

    def letter(q: int) -> str:
        codon = f"n{q // _CHUNK} div {1000 ** (_CHUNK - 1 - q % _CHUNK)} % 1000"
        plant = f"case when (okey + {q}) % 7 = 0 then 1000 when (okey + {q}) % 5 = 0 then 2000 else 0 end"
        one = f"get(letters, cast({codon} + {plant} as int))"
        return one if q < 4 else f"case when naa > {q} then {one} else '' end"

    return [
        {"digits": f"case when minus then translate(reverse({stretch}), 'ACGTN', '32109') else translate({stretch}, 'ACGTN', '01239') end"},
        numbers,
        *({f"part{j}": f"concat({', '.join(letter(q) for q in range(_CHUNK * j, _CHUNK * j + _CHUNK))})"} for j in range(MOST // _CHUNK)),
        {"qseq": f"concat({', '.join(f'part{j}' for j in range(MOST // _CHUNK))})"},
    ]


def _expressions(engine: str) -> list[dict[str, str]]:
    tab = "\t"
    fix = lambda e: e.replace("{residues}", LISTS["duckdb"]).replace("{tab}", tab)
    if engine == "duckdb":
        return [{k: fix(e) for k, e in step.items()} for step in STEPS]
    kinds = lambda e: fix(e).replace("varchar(20)", "string").replace("get(letters,", f"get(split('{_letters()}', ','),")
    steps = [{k: v for k, v in step.items() if k != "qseq"} for step in STEPS]
    return [{k: kinds(e) for k, e in step.items()} for step in [*steps[:3], *_spark_steps(), steps[3]]]


def alignment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard_id, value, overlap_id): lines; ``overlap_id`` is another split, in which shards share accessions."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    df = spread(df, len(df.inputFiles()), "l_orderkey", "l_linenumber")  # a file may be a single row group
    for step in _expressions("spark"):
        # generated code of a step of its own stays small enough to be compiled
        df = select_once(df, df.columns, [F.expr(e).alias(k) for k, e in step.items()])
    overlap = F.concat(F.lit("half"), (F.col("okey") % 2).cast("string")).alias("overlap_id")
    return df.select("shard_id", F.col("line").alias("value"), overlap)


def duckdb_lines() -> str:
    """The same table as DuckDB SQL, with a number per row."""
    inner = "select * from lineitem"
    for step in _expressions("duckdb"):
        inner = f"select *, {', '.join(f'{e} as {k}' for k, e in step.items())} from ({inner})"
    return f"select okey * 10 + lno as rid, shard_id, concat('half', cast(okey % 2 as varchar)) as overlap_id, line from ({inner})"
