import json

import pytest
from pyspark.sql import functions as F

from helixlake.sources import genbank as gb
from helixlake.sources import native, parsers as P, register

FASTQ = "@r1 runid=a start_time=2024-01-01T00:00:00Z\nATGC\n+\n!!!!\n@r2\nGG\n+\n@@\n"
SAM = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:100\n@PG\tID:x\tCL:run a:b:c\n@CO\ta comment\n" + "\t".join(["q1", "2064", "chr1", "7", "60", "4M", "*", "0", "0", "ATGC", "!!!!", "NM:i:0", "SA:Z:chr1,5,+,4M:x"]) + "\n" + "\t".join(["q2", "0", "chr1", "9", "60", "4M", "*", "0", "0", "ATGC", "!!!!"]) + "\n"
PILEUP = "chr1\t1\tA\t4\t.,^].$a\tIIII\nchr1\t2\tC\t3\t+2AG-1t*\tIII\n"
SLOW5 = (
    "#slow5_version\t0.2.0\n#num_read_groups\t2\n@asic_id\t1\t2\n@exp\tx\t.\n#char*\tuint32_t\tdouble\tdouble\tdouble\tdouble\tuint64_t\tint16_t*\tuint64_t\tint32_t\tuint8_t\tdouble\tenum{unknown,partial}\tchar*\n"
    "#read_id\tread_group\tdigitisation\toffset\trange\tsampling_rate\tlen_raw_signal\traw_signal\tstart_time\tread_number\tstart_mux\tmedian_before\tend_reason\tchannel_number\n"
    "a1\t0\t8192\t6\t1467.61\t4000\t3\t430,-2,463\t12\t1\t2\t214.9\t1\t115\na2\t1\t8192\t6\t1467.61\t4000\t1\t1\t.\t.\t.\t.\t0\t.\n"
)
GENBANK = """junk before
LOCUS       TESTP                     24 bp    DNA     circular SYN 22-OCT-2019
DEFINITION  a short plasmid with a definition which is long enough to be wrapped
            over two lines.
ACCESSION   X1
VERSION     X1.1
KEYWORDS    .
SOURCE      synthetic DNA construct
  ORGANISM  synthetic DNA construct
            other sequences; artificial sequences; plasmids.
REFERENCE   1  (bases 1 to 24)
  AUTHORS   A,B and C,D.
  TITLE     Direct
            Submission
COMMENT     something else
FEATURES             Location/Qualifiers
     source          1..24
                     /organism="synthetic DNA construct"
                     /note="x=y/z"
     CDS             join(complement(1..4),
                     7..9)
                     /gene="abc"
                     /pseudo
     misc_feature    complement(join(2..3,<5..>6))
     variation       5
BASE COUNT    6 a   6 c   6 g   6 t
ORIGIN
        1 atgcatgcat gcatgcatgc atgc
//
"""
REBASE = "REBASE version 1\n\nREBASE codes for commercial sources of enzymes\n\n\t\tB\t\tThermo\n\t\tN\t\tNew England\n\n<1>AarI\n<2>PaqCI,X\n<3>CACCTGC(4/8)\n<4>5(5)\n<5>Arthro\n<6>F. Lab\n<7>BN\n<8>Ref one\nmore\n\n<1>BsaI\n<2>\n<3>GGTCTC(1/5)\n<4>\n<5>\n<6>\n<7>N\n<8>R\n"


def lines(text):
    return text.splitlines(keepends=True)


def test_fasta():
    text = ">a b\nATG\n\nCC\n;comment\n>b\nG\n"
    rows = list(P.fasta(lines(text)))
    assert rows == [{"identifier": "a b", "sequence": "ATGCC"}, {"identifier": "b", "sequence": "G"}]
    for bad in ("ATG\n", ">a\n>b\nA\n", ""):
        with pytest.raises(P.FormatError):
            list(P.fasta(lines(bad)))
    assert P.fasta_text({"identifier": "x", "sequence": "A" * 80}) == ">x\n" + "A" * 80 + "\n\n\n"
    assert P.fasta_text({"identifier": "x", "sequence": "A" * 85}) == ">x\n" + "A" * 80 + "\nAAAAA\n\n"


@pytest.mark.parametrize("bad", ["@a\nATX\n+\n!!!\n", "@a\nATG\n!\n!!!\n", "@a\nATG\n+\n!!\n", "a\nATG\n+\n!!!\n", "@a\n\n+\n!!!\n", "@a x\nATG\n+\n!!!\n", "@a\nATG\n"])
def test_fastq_errors(bad):
    with pytest.raises(P.FormatError):
        list(P.fastq(lines(bad)))


def test_texts_come_back():
    assert "".join(map(P.fastq_text, P.fastq(lines(FASTQ)))) == FASTQ
    body = "".join(map(P.sam_text, P.sam(lines(SAM))))
    assert P.sam_header_text(P.sam_header(lines(SAM))) + body == SAM
    assert "".join(map(P.pileup_text, P.pileup(lines(PILEUP)))) == PILEUP
    groups, _, _ = P.slow5_header(iter(lines(SLOW5)))
    text = P.slow5_header_text(groups) + "".join(P.slow5_text(r, groups[0]["end_reason_map"]) for r in P.slow5(lines(SLOW5)))
    assert text == SLOW5


def test_pileup_results():
    assert P.read_results(".,^].$a+2AG-1t*") == [".", ",", "^].$", "a", "+2AG", "-1t", "*"]
    for bad in ("Z", "+5AG"):
        with pytest.raises(P.FormatError):
            P.read_results(bad)
    for bad in ("chr\t1\tA\n", "chr\tx\tA\t1\t.\tI\n", "chr\t1\tA\tx\t.\tI\n"):
        with pytest.raises(P.FormatError):
            list(P.pileup(lines(bad)))


def test_slow5_values():
    a, b = P.slow5(lines(SLOW5))
    assert a["raw_signal"] == [430, -2, 463] and a["end_reason"] == "partial" and b["start_time"] is None
    assert list(P.slow5(lines(SLOW5), zeros=True))[1]["start_time"] == 0
    with pytest.raises(P.FormatError):
        list(P.slow5(lines(SLOW5.replace("430,", "99999,"))))


def test_genbank():
    (r,) = gb.genbank(lines(GENBANK))
    m = r["meta"]
    assert m["locus"] == {"name": "TESTP", "sequence_length": "24", "sequence_coding": "bp", "molecule_type": "DNA", "genbank_division": "SYN", "modification_date": "22-OCT-2019", "circular": True}
    assert m["definition"].endswith("wrapped over two lines.") and m["taxonomy"] == ["other sequences", "artificial sequences", "plasmids"]
    assert m["references"][0]["title"] == "Direct Submission" and m["other"] == {"COMMENT": "something else"}
    f = r["features"]
    assert [x["type"] for x in f] == ["source", "CDS", "misc_feature", "variation"]
    assert f[0]["attributes"]["note"] == ["x=y/z"] and f[1]["attributes"] == {"gene": ["abc"], "pseudo": [""]}
    s = r["sequence"]
    assert s == "atgcatgcatgcatgcatgcatgc" and m["base_count"][0] == {"base": "a", "count": 6}
    assert gb.location_sequence(s, f[1]["location"]) == "gcat" + "gca"
    assert gb.location_sequence(s, f[2]["location"]) == "tatgca"[:0] + "tgca"[:0] + "".join({"a": "t", "t": "a", "g": "c", "c": "g"}[c] for c in reversed("tg" + "at"))
    assert gb.location_sequence(s, f[3]["location"]) == "a"
    again = list(gb.genbank(lines(gb.genbank_text(r))))
    assert again[0]["sequence"] == s and [gb.location_sequence(s, x["location"]) for x in again[0]["features"]] == [gb.location_sequence(s, x["location"]) for x in f]
    assert gb.location_text(gb.parse_location("complement(join(1..4,7..9))")) == "complement(join(1..4,7..9))"
    for bad in ("join(1..2", "x..y"):
        with pytest.raises(P.FormatError):
            gb.parse_location(bad)


def test_rebase():
    a, b = P.rebase(lines(REBASE))
    assert a["commercial_availability"] == ["Thermo", "New England"] and a["references"] == "Ref one\nmore" and b["name"] == "BsaI"
    assert len(list(P.rebase(lines(REBASE), parity=True))) == 1


@pytest.mark.parametrize(("name", "text", "n"), [("fasta", "".join(f">r{i}\n{'ATGC' * 30}\n{'GG' * (i % 7 + 1)}\n" for i in range(200)), 200), ("fastq", FASTQ * 100, 200), ("sam", SAM + SAM.split("\n", 4)[4] * 50, 102), ("pileup", PILEUP * 60, 120), ("genbank", GENBANK * 30, 30), ("slow5", SLOW5, 2)])
def test_ranges_and_round_trip(spark, tmp_path, name, text, n):
    register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / f"x.{name}").write_text(text)
    whole = spark.read.format(name).load(str(tmp_path / "in"))
    cut = spark.read.format(name).option("splitBytes", 777 if name != "slow5" else 10**9).load(str(tmp_path / "in"))
    key = lambda df: sorted(map(str, df.collect()))
    assert whole.count() == n and key(whole) == key(cut)
    write = cut.write.format(name).mode("append")
    if name == "slow5":
        groups, _, _ = P.slow5_header(iter(lines(text)))
        write = write.option("header", json.dumps(groups))
    write.save(str(tmp_path / "out"))
    back = spark.read.format(name).load(str(tmp_path / "out"))
    if name != "genbank":
        assert key(back) == key(whole)
    else:
        assert back.count() == n


def test_modes_and_headers(spark, tmp_path):
    register(spark)
    (tmp_path / "a.fastq").write_text(FASTQ + "@bad\nATX\n+\n!!!\n")
    rows = spark.read.format("fastq").option("mode", "PERMISSIVE").load(str(tmp_path / "a.fastq")).collect()
    assert [r.identifier for r in rows] == ["r1", "r2", None] and rows[2]["_corrupt_record"].startswith("@bad")
    with pytest.raises(Exception, match="ATGCN"):
        spark.read.format("fastq").load(str(tmp_path / "a.fastq")).collect()
    (tmp_path / "a.sam").write_text(SAM)
    h = spark.read.format("sam").option("table", "header").load(str(tmp_path / "a.sam")).first()
    assert h.pg[0]["CL"] == "run a:b:c" and h.co == ["a comment"]
    native_rows = native.read_sam(spark, str(tmp_path / "a.sam")).collect()
    assert native_rows == spark.read.format("sam").load(str(tmp_path / "a.sam")).collect()
    ok = spark.read.format("sam").load(str(tmp_path / "a.sam")).select(native.sam_error(spec=True).alias("e"), native.sam_error().alias("narrow")).collect()
    assert [r.e for r in ok] == [None, None] and ok[0].narrow.startswith("Invalid RNAME")
    head = spark.read.format("sam").option("table", "header").load(str(tmp_path / "a.sam"))
    assert head.select(native.sam_header_error().alias("e")).first().e is None
    assert head.withColumn("hd", F.create_map(F.lit("SO"), F.lit("odd"))).select(native.sam_header_error().alias("e")).first().e == "Invalid value for @HD SO"


def test_xml_and_csv(spark, tmp_path):
    (tmp_path / "u.xml").write_text('<?xml version="1.0" encoding="ISO-8859-1"?>\n<UniRef90 xmlns="x">\n<entry id="UniRef90_A" updated="2020-01-01"><name>Cluster: z</name><property type="member count" value="1"/><representativeMember><dbReference type="UniProtKB ID" id="A"><property type="length" value="3"/></dbReference><sequence length="3" checksum="F">MKT</sequence></representativeMember><member><dbReference type="t" id="B"/></member></entry>\n</UniRef90>\n')
    r = native.read_uniref(spark, str(tmp_path / "u.xml")).first()
    assert r.id == "UniRef90_A" and r.rep_member.sequence.value == "MKT" and r.members[0].db_ref.id == "B" and r.properties[0].value == "1"
    assert native.uniref_version(spark, str(tmp_path / "u.xml")) == "90"
    (tmp_path / "p.xml").write_text('<uniprot><entry dataset="Swiss-Prot" created="2009-05-05" modified="2020-08-12" version="9"><accession>P0C9F0</accession><name>X</name><protein><recommendedName><fullName evidence="1 2">Protein</fullName></recommendedName></protein><sequence length="3" mass="10" checksum="C" modified="2009-05-05" version="1">MRT</sequence></entry></uniprot>')
    e = native.read_uniprot(spark, str(tmp_path / "p.xml"))
    row = e.select("accession", "sequence", "_created", native.evidence_keys(F.col("protein.recommendedName.fullName._evidence")).alias("ev")).first()
    assert row.accession == ["P0C9F0"] and row.sequence["_VALUE"] == "MRT" and row.ev == [1, 2] and str(row["_created"]) == "2009-05-05"
    (tmp_path / "b.csv").write_text("A1,ATG,GGC\nA2,ATT\nA3,ATG,CCC\n")
    assert [r["name"] for r in native.read_dual_barcodes(spark, str(tmp_path / "b.csv")).collect()] == ["A1", "A3"]


def test_stream_reads_late_files(spark, tmp_path):
    """A file that arrives with an older time than those before it is read, and none twice."""
    import os

    register(spark)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run() -> list[str]:
        q = spark.readStream.format("fasta").load(str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.identifier for r in spark.read.parquet(out).collect())

    (folder / "b.fasta").write_text(">b\nATG\n")
    assert run() == ["b"]
    (folder / "a.fasta").write_text(">a\nATG\n")
    os.utime(folder / "a.fasta", (1, 1))
    assert run() == ["a", "b"]
    assert run() == ["a", "b"]


def test_files_and_ranges_without_records(spark, tmp_path):
    """A task without rows writes an empty file; a record may be longer than a range."""
    register(spark)
    rows = spark.createDataFrame([("a", "ACGT"), ("b", "T" * 3000)], "identifier string, sequence string")
    rows.repartition(5).write.format("fasta").mode("append").save(str(tmp_path / "some"))
    assert spark.read.format("fasta").option("splitBytes", "700").load(str(tmp_path / "some")).count() == 2
    rows.where("false").write.format("fasta").mode("append").save(str(tmp_path / "none"))
    assert spark.read.format("fasta").load(str(tmp_path / "none")).count() == 0


def _batch(name, rows):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from helixlake.sources.datasources import FORMATS

    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(StructType.fromDDL(FORMATS[name].ddl)))


def test_texts_and_blocks_of_batches(spark):
    """Batches are written and read at once, and as record by record."""
    from helixlake.sources import vectors
    from helixlake.sources.datasources import FORMATS

    sam = [dict(qname=f"r{k}", flag=k, rname="c", pos=k, mapq=k, cigar="4M", rnext="*", pnext=0, tlen=-k, seq="ATGC", qual="!!!!", optionals=[{"tag": "NM", "type": "i", "data": f"{j}:{j}"} for j in range(k % 3)] or ([] if k % 2 else None)) for k in range(9)]
    fastq = [dict(identifier=f"r{k}", optionals={x: f"{k}=" for x in ("st", "ch", "z")[: k % 4]}, sequence="ACGTN"[: 1 + k % 5], quality="@I+#!"[: 1 + k % 5]) for k in range(9)]
    for name, rows in (("sam", sam), ("fastq", fastq)):
        text = "".join(FORMATS[name].text(r, None) for r in rows)
        for part, start in ((rows, 0), (rows[3:7], 3)):
            batch = _batch(name, rows).slice(start, len(part))
            assert bytes(vectors.written(getattr(vectors, f"{name}_text")(batch))).decode() == "".join(FORMATS[name].text(r, None) for r in part)
        read = {k: v.to_pylist() for k, v in getattr(vectors, name)(text.encode(), 1000).items()}
        slow = list(FORMATS[name].parse(iter(text.splitlines(keepends=True)), {"parity": False}))
        assert [{k: dict(v[i]) if k == "optionals" and name == "fastq" else v[i] for k, v in read.items()} for i in range(len(rows))] == slow
    assert vectors.sam_text(_batch("sam", [sam[1] | {"qname": None}])) is None
    assert vectors.sam(b"r\t+5\n", 1000) is None and vectors.fastq(b"@r\nAX\n+\nII\n", 1000) is None
    assert vectors.fastq(b"@r a=1 a=2\nA\n+\nI\n", 1000) is None and vectors.fastq("@ré\nA\n+\nI\n".encode(), 1000) is None


def test_a_broken_record_at_the_end_of_a_range_is_an_error(spark, tmp_path):
    from helixlake.sources import register

    register(spark)
    good = "".join(f"@r{k}\nACGT\n+\nIIII\n" for k in range(4))
    (tmp_path / "x.fastq").write_text(good + "@bad\nACGT\n+\nI\n" + good)
    size = len(good)
    with pytest.raises(Exception, match="differ in length"):
        spark.read.format("fastq").option("splitBytes", str(size)).load(str(tmp_path / "x.fastq")).collect()
