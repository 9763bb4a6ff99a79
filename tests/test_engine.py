"""The engine against a row-at-a-time interpreter of the definitions, and the fixtures of the survey."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from codonspark.functions import cigar, scalars
from codonspark.operators import aggregates, ingest
from codonspark.plans import index, queries
from codonspark.sources.alignments import read_lines

ROW = ["SRR0000001_1_ka:f:17_L:+:550:+", "4", "12", "15", "+", "bpgv2|N0.HOG0000001", "0", "2", "10", "85.0", "1e-20", "3M", "MKG", "AAGATGAAAGGT"]
CODE = scalars.GENETIC_CODE


def row(**changes):
    names = "qseqid qstart qend qlen qstrand sseqid sstart send slen pident evalue cigar qseq nt".split()
    values = dict(zip(names, ROW)) | {k: str(v) for k, v in changes.items()}
    return "\t".join(values[n] for n in names)


def lines(spark, rows, shard="s"):
    return spark.createDataFrame([(shard, r) for r in rows], "shard_id string, value string")


def dump(spark, rows, **options):
    return sorted(tuple(r) for r in queries.dump(index.build(lines(spark, rows), **options)).collect())


def interpret(values):
    """(offset, codon) of one row, read off the definition of the CIGAR loop and of the codon rules."""
    qstart, sstart, send, text, qseq, nt, minus = values
    span, aas, q, i = send - sstart + 1, [], 0, 0
    while i < len(text) and len(aas) < span:
        j = i
        while j < len(text) and text[j].isdigit():
            j += 1
        n = int(text[i:j] or 0)
        if j >= len(text) or not n:
            break
        op, i = text[j], j + 1
        for _ in range(n if op in "MD" else 0):
            if len(aas) < span:
                aas.append((qseq[q : q + 1], q) if op == "M" else None)
            q += op == "M"
        q += n if op == "I" else 0
    out = []
    for off, x in enumerate(aas):
        if x is None or off >= 1024:
            continue
        aa, q = x
        aa = dict(zip("BZJUO", "NQLCK")).get(aa, aa)
        start = qstart - 1 - 3 * q - 2 if minus else qstart - 1 + 3 * q
        if qstart < 1 or start < 0 or start + 2 >= len(nt):
            continue
        codon = nt[start : start + 3]
        if minus:
            codon = "".join(dict(zip("ACGT", "TGCA")).get(b, "N") for b in reversed(codon))
        if set(codon) <= set("ACGT") and aa and aa in scalars.AMINO_ACIDS and CODE[sum("ACGT".index(b) << s for b, s in zip(codon, (4, 2, 0)))] == aa:
            out.append((off, codon))
    return out


def test_single_row(spark):
    assert dump(spark, ["\t".join(ROW)]) == [("N0.HOG0000001", p, c, a, 1) for p, c, a in ((0, "ATG", "M"), (1, "AAA", "K"), (2, "GGT", "G"))]
    got = queries.saav(index.build(lines(spark, ["\t".join(ROW)])), "N0.HOG0000001", 1).collect()
    assert [tuple(r) for r in got] == [("SRR0000001", "SRR0000001_1", 1, "K", "AAA", 85)]


@pytest.mark.parametrize(
    "bad, skipped, silent",
    [
        (row(pident="not_a_float"), 1, 0), (row(pident="100.0"), 1, 0), (row(pident="99.999999"), 1, 0), (row(nt=""), 0, 1),
        ("\t".join(ROW[:13]), 0, 1), ("\t".join(ROW[:12]), 1, 0), (row(evalue="2"), 1, 0), (row(sstart=3), 1, 0), (row(qend="-1"), 1, 0), (row(qstart=4294967296), 1, 0),
        (row(pident=" 85"), 1, 0), (row(pident="+85"), 1, 0),
    ],
)
def test_skips(spark, bad, skipped, silent):
    got = ingest.counts(lines(spark, [bad, "\t".join(ROW), "", "# note"])).first()
    assert (got["records"], got["skipped"], got["no_nucleotides"]) == (1, skipped, silent)


def test_lenient_numbers(spark):
    good = [row(pident=x) for x in ("85x", "nan", "inf", ".5", "1e")] + [row(qstart="4.5"), row(evalue="nan"), row() + "\textra"]
    # the 14th field takes the rest of the line: only codons of its text count
    assert ingest.counts(lines(spark, good)).first()["records"] == len(good)


def test_random_rows_against_the_interpreter(spark):
    rnd = random.Random(5)
    rows, expected = [], {}
    for n in range(400):
        nt = "".join(rnd.choices("ACGTacN", weights=[9, 9, 9, 9, 1, 1, 1], k=rnd.randint(0, 70)))
        minus = rnd.random() < 0.5
        text = "".join(f"{rnd.choice(['', '0', '00'])if rnd.random() < .1 else ''}{rnd.randint(0, 9) if rnd.random() < .1 else rnd.randint(1, 9)}{rnd.choice('MMMIDS=')}" for _ in range(rnd.randint(0, 5))) + rnd.choice(["", "", "3", "M"])
        qstart = rnd.randint(0, len(nt) + 2)
        residues = []
        for q in range(24):
            s = qstart - 3 * q - 3 if minus else qstart - 1 + 3 * q
            c = nt[s : s + 3] if s >= 0 else ""
            c = "".join(dict(zip("ACGT", "TGCA")).get(b, b) for b in reversed(c)) if minus else c
            good = len(c) == 3 and set(c) <= set("ACGT")
            residues.append(CODE[sum("ACGT".index(b) << k for b, k in zip(c, (4, 2, 0)))] if good and rnd.random() < 0.85 else rnd.choice("ACDXBZJUO*-m"))
        qseq = "".join(residues)[: rnd.randint(0, 24)]
        sstart = rnd.randint(0, 9)
        send = sstart + rnd.randint(0, 20)
        rows.append(row(qseqid=f"A{n}_{n}_x", qstart=qstart, qstrand="-" if minus else "+", sstart=sstart, send=send, cigar=text, qseq=qseq, nt=nt))
        if nt:
            expected[f"A{n}"] = [(sstart + o, c) for o, c in interpret((qstart, sstart, send, text, qseq, nt, minus))]
    got = {}
    obs = ingest.flatten(ingest.ingest(lines(spark, rows)))
    for r in obs.select("acc_id", "hog_pos", scalars.unpack_codon(F.col("codon_idx")).alias("codon")).collect():
        got.setdefault(r["acc_id"], []).append((r["hog_pos"], r["codon"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items() if v}
    assert sum(map(len, expected.values())) > 300


def test_offset_limit(spark):
    nt, qseq = "ATG" * 1100, "M" * 1100
    one = [row(qstart=1, sstart=0, send=1099, cigar="1100M", qseq=qseq, nt=nt)]
    assert len(dump(spark, one)) == 1024 and len(dump(spark, one, max_offset=None)) == 1100


def test_all_codons(spark):
    got = spark.range(64).select("id", scalars.unpack_codon(F.col("id")).alias("c")).select("id", "c", scalars.pack_codon(F.col("c")).alias("p"), scalars.codon_to_aa(F.col("c")).alias("aa"), scalars.revcomp(F.col("c")).alias("r")).collect()
    for r in got:
        assert r["p"] == r["id"] and (r["aa"] or "*") == CODE[r["id"]]
        assert r["r"] == "".join(dict(zip("ACGT", "TGCA"))[b] for b in reversed(r["c"]))


def test_coverage_unions_intervals(spark):
    spans = [(0, 4), (3, 9), (10, 12), (20, 30), (22, 25), (20, 30)]
    hsp = spark.createDataFrame([("s", "h", "a", a, b) for a, b in spans], "shard_id string, hog_id string, acc_id string, sstart long, send long")
    assert aggregates.coverage(hsp).first()["covered_aa"] == 24


def test_group_minimum_and_consensus_tie(spark):
    rows = [row(pident="90"), row(pident="70", sstart=1, send=3), row(qseqid="B_2_x", pident="95")]
    ix = index.build(lines(spark, rows))
    assert {r["acc_id"] for r in queries.saav(ix, "N0.HOG0000001", 1, min_pident=80).collect()} == {"B"}
    tie = spark.createDataFrame([("s", "h", 1, "a", 1, c) for c in (9, 4)], "shard_id string, hog_id string, hog_pos int, acc_id string, cnum long, codon_idx int")
    got = aggregates.consensus(tie).first()
    assert (got["consensus_codon"], got["n_obs"], got["n_var"]) == ("ACA", 2, 1)


def test_written_index_shards_and_rollup(spark, tmp_path):
    rnd = random.Random(2)
    rows = [row(qseqid=f"ACC{i % 5}_{i}_x", sseqid=f"p|H{i % 7}", pident=f"{60 + i % 30}", sstart=i % 4, send=i % 4 + 2) for i in range(80)]
    rnd.shuffle(rows)
    one = index.write(lines(spark, rows, "all"), str(tmp_path / "one"), partitions=3)
    for least in (0, 70):
        flat = sorted(map(tuple, queries.dump(one, least, from_rollup=False).collect()))
        assert flat == sorted(map(tuple, queries.dump(one, least).collect())) and flat
    parts = []
    for k in range(2):  # shards by accession
        own = [r for r in rows if int(r[3]) % 2 == k]
        index.write(lines(spark, own, f"s{k}"), str(tmp_path / f"s{k}"), partitions=2)
        parts.append(str(tmp_path / f"s{k}"))
    whole = sorted(map(tuple, queries.dump(one).collect()))
    assert sorted(map(tuple, queries.dump(index.read(spark, parts)).collect())) == whole
    merged = index.merge(spark, parts, str(tmp_path / "m"))
    assert sorted(map(tuple, queries.dump(merged).collect())) == whole
    catalog = index.write_manifest(spark, parts, str(tmp_path / "x.manifest"))
    assert sorted(r["n_hogs"] for r in catalog.collect()) == [7, 7]
    assert queries.stat(index.read_manifest(spark, str(tmp_path / "x.manifest"))).first()["n_accessions"] == 5
    some = index.merge(spark, parts, str(tmp_path / "r"), "H1", "H3", inclusive_end=False)
    assert {r["hog_id"] for r in some.hog.collect()} == {"H1", "H2"}
    assert index.storage_stats(str(tmp_path / "m" / "obs"))[0]["compressed"] > 0
    assert queries.freq(one, "nothing").collect() == [] and queries.freq(one, "nothing").columns[0] == "hog_pos"
    plan = queries.freq(one, "H1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(hog_id,H1)" in plan


def test_sources(spark, tmp_path):
    import zstandard

    text = "\r\n".join([row(), row(qseqid="B_1_x")]) + "\r\n"
    (tmp_path / "a.tsv").write_bytes(text.encode())
    with gzip.open(tmp_path / "b.tsv.gz", "wb") as f:
        f.write(text.encode())
    frame = zstandard.ZstdCompressor().compress
    (tmp_path / "c.tsv.zst").write_bytes(frame(text[:50].encode()) + frame(text[50:].encode()))
    for name in ("a.tsv", "b.tsv.gz", "c.tsv.zst"):
        got = read_lines(spark, str(tmp_path / name), "s")
        assert [r["n_accessions"] for r in queries.dump(index.build(got)).collect()] == [2, 2, 2]
    both = read_lines(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "c.tsv.zst")])
    assert both.select("shard_id").distinct().count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from codonspark.streaming import ingest as streaming

    src = tmp_path / "in"
    src.mkdir()
    rows = [row(qseqid=f"A{i}_{i}_x", sseqid=f"p|H{i % 2}") for i in range(6)]
    for k in range(2):
        (src / f"{k}.tsv").write_text("\n".join(rows[k::2]) + "\n")
    q = streaming.start(streaming.read_stream(spark, str(src), "s", 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = queries.dump(streaming.read(spark, str(tmp_path / "out")))
    assert sorted(map(tuple, got.collect())) == dump(spark, rows)


def test_result_does_not_depend_on_partitions(spark):
    rows = [row(qseqid=f"SRR000000{i % 5 + 1}_c{i}_x", pident=f"{85 + i / 10}") for i in range(20)]
    a = sorted(map(tuple, queries.dump(index.build(lines(spark, rows).repartition(7))).collect()))
    assert a == dump(spark, rows) and [r[-1] for r in a] == [5, 5, 5]


def test_empty_input(spark):
    ix = index.build(lines(spark, []), rollup=True)
    assert queries.dump(ix).count() == 0 and queries.stat(ix).first()["n_hogs"] == 0


def test_command_line(spark, tmp_path, capsys):
    from codonspark import cli

    (tmp_path / "a.tsv").write_text(row() + "\n")
    assert cli.main(["build", str(tmp_path / "ix"), str(tmp_path / "a.tsv"), "--shard", "s"]) == 0
    assert cli.main(["freq", str(tmp_path / "ix"), "N0.HOG0000001"]) == 0
    assert capsys.readouterr().out.splitlines()[1:] == ["0\tATG\tM\t1", "1\tAAA\tK\t1", "2\tGGT\tG\t1"]
    assert cli.main(["freq", str(tmp_path / "ix"), "x", "--min-pident", "300"]) == 1


def test_match_segments_are_cut(spark):
    df = spark.createDataFrame([("2M1D9M", 5), ("3S2M", 9), ("0M3M", 3), ("3", 3), ("", 3), (None, 3)], "c string, n long")
    got = [[tuple(s) for s in r[0]] if r[0] is not None else None for r in df.select(cigar.match_segments(F.col("c"), F.col("n"))).collect()]
    assert got[:5] == [[(0, 0, 2), (3, 2, 2)], [(0, 0, 2)], [], [], []]


def test_zstd_frames_are_dealt_out(spark, tmp_path):
    """Lines that run across frames, skippable frames, several frames a range and several ranges a frame."""
    import gzip

    import zstandard

    rnd = random.Random(3)
    text = "\n".join("".join(rnd.choices("ACGT\t|", k=rnd.randint(0, 300))) for _ in range(3000)) + "\n"
    data, out, at = text.encode(), b"", 0
    while at < len(data):
        size = rnd.choice([1, 50, 4000, 60000])
        c = zstandard.ZstdCompressor(write_checksum=rnd.random() < 0.5, write_content_size=rnd.random() < 0.5)
        out += c.compress(data[at : at + size])
        if rnd.random() < 0.2:
            out += (0x184D2A50).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"(\xb5/\xfdx"
        at += size
    (tmp_path / "a.zst").write_bytes(out)
    (tmp_path / "b").write_bytes(gzip.compress(data[:1000]) + gzip.compress(data[1000:]))
    want = sorted(text.split("\n")[:-1])
    from codonspark.sources.compressed import CompressedLines

    spark.dataSource.register(CompressedLines)
    for size in (500, 10_000, 1 << 30):
        df = spark.read.format("codonspark_lines").option("paths", str(tmp_path / "a.zst")).option("range", size).load()
        assert sorted(r["value"] for r in df.collect()) == want
    got = read_lines(spark, [str(tmp_path / "a.zst"), str(tmp_path / "b")]).groupBy("shard_id").count().collect()
    assert sorted(r["count"] for r in got) == [3000, 3000]


def test_counters_of_an_ingest(spark):
    from codonspark.operators import ingest

    rows = [row(), row(pident="x"), row(pident="100.0"), "# c", "", row(qseq="WKG"), row(qseq="WWW")]
    counters = ingest.Counters()
    assert ingest.ingest(lines(spark, rows), counters).count() == 2
    want = ingest.counts(lines(spark, rows)).first().asDict()
    assert counters.get == want and want["records"] == 2 and want["skipped"] == 2 and want["observations"] == 5 and want["observations_dropped"] == 4


def test_command_line_over_shards(spark, tmp_path, capsys, monkeypatch):
    """Folders of shards, standard input, buckets, a folder per accession, codecs, statistics."""
    import io
    import types

    from codonspark import cli

    two = row(qseqid="SRR0000002_7_x", sseqid="x|N0.HOG0000002")
    for name, text in (("s1", row() + "\n"), ("s2", f"{row()}\n{two}\n{row(pident='x')}\n")):
        monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(text.encode() if name == "s1" else gzip.compress(text.encode()))))
        assert cli.main(["build", str(tmp_path / "shards" / name), "-", "--shard", name]) == 0
    assert "2 records" in capsys.readouterr().err
    assert cli.main(["manifest", str(tmp_path / "m.manifest"), str(tmp_path / "shards")]) == 0
    assert [x.split("\t")[1:] for x in capsys.readouterr().out.splitlines()[1:]] == [["1", "1"], ["2", "2"]]
    assert cli.main(["freq", str(tmp_path / "m.manifest"), "N0.HOG0000001"]) == 0
    assert capsys.readouterr().out.splitlines()[1] == "0\tATG\tM\t2"
    assert cli.main(["merge", str(tmp_path / "one"), str(tmp_path / "shards"), "--as-shard", "all", "--buckets", "3"]) == 0
    assert cli.main(["freq", str(tmp_path / "one"), "N0.HOG0000001"]) == 0
    assert capsys.readouterr().out.splitlines()[1] == "0\tATG\tM\t1"
    rows = spark.read.parquet(str(tmp_path / "one" / "hog_acc")).where("acc_id = 'SRR0000001'").collect()
    assert [(r["covered_aa"], r["n_obs"]) for r in rows] == [(6, 6)]
    assert spark.read.parquet(str(tmp_path / "one" / "buckets")).count() == 9
    assert cli.main(["stat", str(tmp_path / "m.manifest")]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith("file_size_mb\t") and out[2] == "2\t2\t3" and out[3] == "hog_id\tn_accessions\tn_obs\tdata_length_kb"
    assert cli.main(["stat", str(tmp_path / "m.manifest"), "--accession", "SRR0000001"]) == 0
    assert capsys.readouterr().out.splitlines() == ["acc_id\tSRR0000001", "n_hogs\tn_blocks", "1\t2", "hog_id\tn_blocks", "N0.HOG0000001\t2"]
    (tmp_path / "a.tsv").write_text(f"{row()}\n{two}\n")
    assert cli.main(["convert", str(tmp_path / "by"), str(tmp_path / "a.tsv")]) == 0
    assert sorted(p.name for p in (tmp_path / "by").glob("acc_id=*")) == ["acc_id=SRR0000001", "acc_id=SRR0000002"]
    assert cli.main(["codecs", str(tmp_path / "one"), str(tmp_path / "trials")]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 13
    assert cli.main(["manifest", str(tmp_path / "n.manifest"), str(tmp_path / "nowhere")]) == 1


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_the_view_are_made_without_interpreted_functions(spark):
    from codonspark.driver_view import alignment_lines

    assert "lambda" not in plan_of(alignment_lines(spark, "/root/testdata/sf0.001"))


def test_spaces_and_signs_in_contigs_are_no_bases(spark):
    """A codon `` AC`` or ``+AC`` isn't AAC."""
    bad = [row(nt=f"AAG{c}ACAAAGGT", qseq="NKG") for c in " +-9"] + [row(nt="AAGAC AAAGGT", qseq="NKG")]
    assert {(p, c) for _, p, c, *_ in dump(spark, bad)} == {(1, "AAA"), (2, "GGT")}


def test_common_cigars_are_cut_as_all_are(spark):
    texts = ["3M", "03M", "2M1I4M", "2M1D4M", "4S2M", "1H2M3D2M", "2M9D1M", "0M3M", "2M0I3M", "2M1X3M", "M", "", "12", "2M1I4M7S", "1000000000M"]
    df = spark.createDataFrame([(i, t, n) for i, t in enumerate(texts) for n in (0, 1, 3, 9)], "i int, c string, n long")
    got = cigar.with_segments(df.withColumn("whole", cigar.match_segments(F.col("c"), F.col("n"))), ["c", "n", "whole"], F.col("c"), F.col("n")).collect()
    for r in got:
        assert [tuple(s) for s in r["segs"]] == [tuple(s) for s in r["whole"]], (r["c"], r["n"])
    assert len(got) == 4 * len(texts)


def test_generated_code_of_observations_is_compiled(spark):
    """The JVM leaves methods of 8,000 bytes and more to its interpreter."""
    import re

    from codonspark import registry

    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for f in (registry._lines, registry._valid, registry._obs):
            text = spark._jvm.PythonSQLUtils.explainString(f(spark, "/root/testdata/sf0.001")._jdf.queryExecution(), "codegen")
            sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:\s*(\d+)", text)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
