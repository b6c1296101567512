"""Queries that write files of the formats from the driver's tables and read them back, with their SQL twins.

Files go to the folder that driver and executors share (session.scratch). Every query writes and reads whole tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records
from ..session import scratch, table
from ..sources import native, register
from ..streaming import stages
from .catalogue import _RAND, _SEQS, _SYMBOLS, _md5, _pileups, query, rand_dna, rc, seqs


def through(df: DataFrame, form: str, **options: str) -> DataFrame:
    """df as files of a format, read again."""
    return df.sparkSession.read.format(form).load(saved(df, form, **options))


def saved(df: DataFrame, form: str, **options: str) -> str:
    register(df.sparkSession)
    path = scratch(df.sparkSession)
    df.write.format(form).mode("append").options(**options).save(path)
    return path


def one_file(texts: DataFrame, head: str = "", foot: str = "") -> str:
    """One text file of all rows of column `t`, in order; for small tables."""
    path = scratch(texts.sparkSession)
    texts.agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list("t")), "\n"), F.lit(foot)).alias("value")).write.text(path)
    return path


def _key(c: str) -> F.Column:
    return F.col(c).cast("string")


@query(f"WITH {_SEQS} SELECT 'doc ' || doc_id AS identifier, length(dna)::INT AS n, md5(dna) AS s FROM seqs WHERE dna <> ''")
def fasta_files(spark: SparkSession, sf: str) -> DataFrame:
    """A record needs letters, so texts without any give none."""
    rows = seqs(spark, sf).where("dna != ''").select(F.concat(F.lit("doc "), _key("doc_id")).alias("identifier"), F.col("dna").alias("sequence"))
    return through(rows, "fasta").select("identifier", F.length("sequence").alias("n"), _md5(F.col("sequence")).alias("s"))


_READS = f"WITH {_RAND} SELECT 'r' || o_orderkey AS identifier, (o_orderkey % 512)::VARCHAR AS ch, o_orderstatus AS status, dna AS sequence, repeat('I', 32) AS quality FROM rand JOIN orders USING (o_orderkey)"


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    d = rand_dna(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    optionals = F.create_map(F.lit("ch"), (F.col("o_orderkey") % 512).cast("string"), F.lit("status"), F.col("o_orderstatus"))
    return d.select(F.concat(F.lit("r"), _key("o_orderkey")).alias("identifier"), optionals.alias("optionals"), F.col("dna").alias("sequence"), F.expr("repeat('I', 32)").alias("quality"))


def _flat_reads(reads: DataFrame) -> DataFrame:
    return reads.select("identifier", F.col("optionals.ch").alias("ch"), F.col("optionals.status").alias("status"), "sequence", "quality")


@query(_READS)
def fastq_files(spark, sf):
    return _flat_reads(through(_reads(spark, sf), "fastq"))


@query(f"SELECT * FROM ({_READS}) WHERE sequence LIKE '%GAT%'")
def fastq_stream(spark, sf):
    """The files as a stream, through a stage, until all that is there has been read."""
    path, out, state = saved(_reads(spark, sf), "fastq"), scratch(spark), scratch(spark)
    reads = stages.filtered(spark.readStream.format("fastq").load(path), F.col("sequence").contains("GAT"))
    reads.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return _flat_reads(spark.read.schema(reads.schema).parquet(out))


@query("SELECT 'r' || o_orderkey AS identifier, o_orderkey % 5 = 0 AS broken FROM orders")
def fastq_permissive(spark, sf):
    """Records whose quality is too short come back as texts."""
    quality = F.when(F.col("o_orderkey") % 5 == 0, "III").otherwise("I" * 32)
    path = scratch(spark)
    rand_dna(spark, sf).select(F.concat(F.lit("@r"), _key("o_orderkey"), F.lit("\n"), F.col("dna"), F.lit("\n+\n"), quality).alias("value")).write.text(path)
    register(spark)
    rows = spark.read.format("fastq").option("mode", "PERMISSIVE").load(path)
    return rows.select(F.coalesce("identifier", F.regexp_extract("_corrupt_record", "^@(\\S+)", 1)).alias("identifier"), F.col("_corrupt_record").isNotNull().alias("broken"))


_ALIGNED = "SELECT 'r' || l_orderkey || '.' || l_linenumber AS qname, (l_orderkey % 4096)::INT AS flag, 'chr' || l_suppkey AS rname, l_partkey::INT AS pos, (l_linenumber * 7)::SMALLINT AS mapq, '4M' AS cigar, 'ATGC' AS seq, 'NM:i:' || l_linenumber || ' RG:Z:' || l_returnflag AS tags FROM lineitem"


def _alignments(spark, sf):
    tag = lambda name, kind, value: F.struct(F.lit(name).alias("tag"), F.lit(kind).alias("type"), value.alias("data"))
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("r"), _key("l_orderkey"), F.lit("."), _key("l_linenumber")).alias("qname"), (F.col("l_orderkey") % 4096).cast("int").alias("flag"), F.concat(F.lit("chr"), _key("l_suppkey")).alias("rname"),
        F.col("l_partkey").cast("int").alias("pos"), (F.col("l_linenumber") * 7).cast("smallint").alias("mapq"), F.lit("4M").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"),
        F.lit("ATGC").alias("seq"), F.lit("!!!!").alias("qual"), F.array(tag("NM", "i", _key("l_linenumber")), tag("RG", "Z", F.col("l_returnflag"))).alias("optionals"),
    )


def _flat_alignments(rows: DataFrame) -> DataFrame:
    return rows.select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", F.array_join(F.transform("optionals", lambda o: F.concat_ws(":", o.tag, o.type, o.data)), " ").alias("tags"))


@query(_ALIGNED)
def sam_files(spark, sf):
    return _flat_alignments(through(_alignments(spark, sf), "sam"))


@query(_ALIGNED)
def sam_files_native(spark, sf):
    """The same files by the built-in text reader."""
    return _flat_alignments(native.read_sam(spark, saved(_alignments(spark, sf), "sam")))


@query("SELECT 'chr' || n_nationkey AS sn, (1000 + n_nationkey)::VARCHAR AS ln, '1.6' AS vn FROM nation")
def sam_headers(spark, sf):
    """A header is one record of a file; its reference sequences are the nations."""
    keys = sorted(r.n_nationkey for r in table(spark, sf, "nation").select("n_nationkey").toLocalIterator())
    header = {"hd": {"VN": "1.6"}, "sq": [{"SN": f"chr{k}", "LN": str(1000 + k)} for k in keys], "rg": [], "pg": [], "co": ["a comment"]}
    path = saved(_alignments(spark, sf), "sam", header=json.dumps(header))
    heads = spark.read.format("sam").option("table", "header").load(path)
    return heads.select(F.explode("sq").alias("s"), F.col("hd.VN").alias("vn")).select(F.col("s.SN").alias("sn"), F.col("s.LN").alias("ln"), "vn").distinct()


@query(f"SELECT l_orderkey, 'C' AS reference_base, count(*) AS read_count, string_agg({_SYMBOLS}, '|' ORDER BY l_linenumber, {_SYMBOLS}) AS results FROM lineitem GROUP BY l_orderkey")
def pileup_files(spark, sf):
    rows = _pileups(spark, sf).select(_key("l_orderkey").alias("sequence"), F.lit(1).cast("long").alias("position"), F.lit("C").alias("reference_base"), F.size("read_results").cast("long").alias("read_count"), "read_results", F.lit("I").alias("quality"))
    return through(rows, "pileup").select(F.col("sequence").cast("long").alias("l_orderkey"), "reference_base", "read_count", F.array_join("read_results", "|").alias("results"))


@query("""SELECT l_orderkey, count(*) AS n, string_agg((l_partkey % 2000 - 1000)::VARCHAR, ',' ORDER BY l_linenumber, l_partkey % 2000) AS signal, 'partial' AS end_reason, (l_orderkey % 100)::INT AS read_number FROM lineitem GROUP BY l_orderkey""")
def slow5_files(spark, sf):
    v = (F.col("l_partkey") % 2000 - 1000).cast("smallint")
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", v.alias("v")))), lambda x: x.v).alias("raw_signal"))
    real = {"digitisation": 8192.0, "offset": 6.0, "range": 1467.61, "sampling_rate": 4000.0, "median_before": 214.9}
    rows = s.select(
        F.concat(F.lit("o"), _key("l_orderkey")).alias("read_id"), F.lit(0).cast("long").alias("read_group"), *(F.lit(x).alias(k) for k, x in real.items()), F.size("raw_signal").cast("long").alias("len_raw_signal"), "raw_signal",
        F.lit("115").alias("channel_number"), (F.col("l_orderkey") % 100).cast("int").alias("read_number"), F.lit(1).cast("smallint").alias("start_mux"), F.col("l_orderkey").alias("start_time"), F.lit("partial").alias("end_reason"),
    )
    header = [{"read_group": 0, "slow5_version": "0.2.0", "attributes": {"asic_id": "1"}, "end_reason_map": {"unknown": 0, "partial": 1}}]
    back = through(rows, "slow5", header=json.dumps(header))
    return back.select(F.expr("cast(substr(read_id, 2) as bigint)").alias("l_orderkey"), F.col("len_raw_signal").alias("n"), F.array_join(F.transform("raw_signal", lambda x: x.cast("string")), ",").alias("signal"), "end_reason", "read_number")


@query(f"""WITH {_RAND}, p AS (SELECT o_orderkey, lower(dna) AS s FROM rand)
SELECT 'O' || o_orderkey AS name, 'order number ' || o_orderkey AS definition, 0 AS place, 'CDS' AS type, translate(reverse(substr(s, 3, 12)), 'acgt', 'tgca') AS sequence, 'g' || o_orderkey AS gene, true AS circular FROM p
UNION ALL SELECT 'O' || o_orderkey, 'order number ' || o_orderkey, 1, 'misc_feature', substr(s, 2, 4) || substr(s, 9, 4), 'h' || o_orderkey, true FROM p""")
def genbank_files(spark, sf):
    """Features by nested places, cut out of the sequence that was read."""
    node = lambda text: F.array(F.struct(F.lit(0).alias("node"), F.lit(-1).alias("parent"), F.lit(0).alias("start"), F.lit(0).alias("end"), *(F.lit(False).alias(c) for c in ("complement", "join", "five_prime_partial", "three_prime_partial")), F.lit(text).alias("gbk_location_string")))
    key = _key("o_orderkey")
    feature = lambda kind, place, letter: F.struct(F.lit(kind).alias("type"), F.lit("").alias("description"), F.create_map(F.lit("gene"), F.array(F.concat(F.lit(letter), key))).alias("attributes"), *(F.lit("").alias(c) for c in ("sequence_hash", "hash_function", "sequence")), node(place).alias("location"))
    locus = F.struct(F.concat(F.lit("O"), key).alias("name"), F.lit("32").alias("sequence_length"), F.lit("DNA").alias("molecule_type"), F.lit("SYN").alias("genbank_division"), F.lit("22-OCT-2019").alias("modification_date"), F.lit("bp").alias("sequence_coding"), F.lit(True).alias("circular"))
    text = lambda value, name: F.lit(value).alias(name)
    reference = "array<struct<authors:string,title:string,journal:string,pub_med:string,remark:string,range:string,consortium:string>>"
    meta = F.struct(
        text("", "date"), F.concat(F.lit("order number "), key).alias("definition"), key.alias("accession"), text("1", "version"), text(".", "keywords"), text("made up", "organism"), text("made up", "source"), F.array(F.lit("none")).alias("taxonomy"), text("", "origin"),
        locus.alias("locus"), F.array().cast(reference).alias("references"), F.array().cast("array<struct<base:string,count:bigint>>").alias("base_count"), F.create_map().cast("map<string,string>").alias("other"), text("", "name"), text("", "sequence_hash"), text("", "hash_function"),
    )
    rows = rand_dna(spark, sf, wide=True).select(meta.alias("meta"), F.array(feature("CDS", "complement(3..14)", "g"), feature("misc_feature", "join(2..5,9..12)", "h")).alias("features"), F.lower("dna").alias("sequence"))
    back = through(rows, "genbank").select("*", F.col("meta.locus.name").alias("name"), F.col("meta.definition").alias("definition"), F.col("meta.locus.circular").alias("circular"))
    return records.features(back, "name", "definition", "circular").select("name", "definition", "place", "type", "sequence", F.get(F.col("attributes.gene"), F.lit(0)).alias("gene"), "circular")


_ENZYME = "'Enz' || s_suppkey AS name, 'GGTCTC(' || (s_suppkey % 5) || '/5)' AS site"


@query(f"SELECT {_ENZYME}, 'Iso' || s_suppkey AS isoschizomers, 'Thermo|New England' AS suppliers FROM supplier")
def rebase_files(spark, sf):
    k = _key("s_suppkey")
    fields = F.concat(F.lit("<1>Enz"), k, F.lit("\n<2>Iso"), k, F.lit("\n<3>GGTCTC("), (F.col("s_suppkey") % 5).cast("string"), F.lit("/5)\n<4>\n<5>Arthro\n<6>F. Lab\n<7>BN\n<8>A reference\n"))
    path = one_file(table(spark, sf, "supplier").select(fields.alias("t")), "REBASE version 1\n\nREBASE codes for commercial sources of enzymes\n\n\t\tB\t\tThermo\n\t\tN\t\tNew England\n\n")
    register(spark)
    rows = spark.read.format("rebase").load(path)
    return rows.select("name", F.col("recognition_sequence").alias("site"), F.array_join("isoschizomers", "|").alias("isoschizomers"), F.array_join("commercial_availability", "|").alias("suppliers"))


@query("SELECT 'P' || s_suppkey AS accession, s_name AS protein, md5(s_suppkey::VARCHAR) AS sequence, 32 AS length, (s_suppkey % 7)::INT AS version FROM supplier")
def uniprot_files(spark, sf):
    k = _key("s_suppkey")
    entry = F.concat(
        F.lit('<entry dataset="Swiss-Prot" created="2009-05-05" modified="2020-08-12" version="'), (F.col("s_suppkey") % 7).cast("string"), F.lit('"><accession>P'), k, F.lit("</accession><name>X</name><protein><recommendedName><fullName>"), F.col("s_name"),
        F.lit('</fullName></recommendedName></protein><sequence length="32" mass="10" checksum="C" modified="2009-05-05" version="1">'), F.md5(k.cast("binary")), F.lit("</sequence></entry>"),
    )
    rows = native.read_uniprot(spark, one_file(table(spark, sf, "supplier").select(entry.alias("t")), "<uniprot>\n", "\n</uniprot>"))
    return rows.select(F.get("accession", F.lit(0)).alias("accession"), F.col("protein.recommendedName.fullName._VALUE").alias("protein"), F.col("sequence._VALUE").alias("sequence"), F.col("sequence._length").alias("length"), F.col("_version").alias("version"))


@query("SELECT 'UniRef90_' || s_suppkey AS id, 'Cluster: ' || s_name AS name, md5(s_suppkey::VARCHAR) AS sequence, 'm' || s_suppkey AS member, (s_suppkey % 9)::VARCHAR AS members FROM supplier")
def uniref_files(spark, sf):
    k = _key("s_suppkey")
    entry = F.concat(
        F.lit('<entry id="UniRef90_'), k, F.lit('" updated="2020-01-01"><name>Cluster: '), F.col("s_name"), F.lit('</name><property type="member count" value="'), (F.col("s_suppkey") % 9).cast("string"),
        F.lit('"/><representativeMember><dbReference type="UniProtKB ID" id="A"/><sequence length="32" checksum="F">'), F.md5(k.cast("binary")), F.lit('</sequence></representativeMember><member><dbReference type="t" id="m'), k, F.lit('"/></member></entry>'),
    )
    rows = native.read_uniref(spark, one_file(table(spark, sf, "supplier").select(entry.alias("t")), "<UniRef90>\n", "\n</UniRef90>"))
    first = lambda c: F.get(c, F.lit(0))
    return rows.select("id", "name", F.col("rep_member.sequence.value").alias("sequence"), first("members").db_ref.id.alias("member"), first("properties").value.alias("members"))


@query(f"WITH {_RAND} SELECT 'W' || o_orderkey AS name, substr(dna, 1, 16) AS forward, {rc('substr(dna, 17, 16)')} AS reverse FROM rand WHERE o_orderkey % 3 <> 0")
def barcode_files(spark, sf):
    """Lines with two fields are left out, as readers of these tables do."""
    d = rand_dna(spark, sf)
    back = F.translate(F.reverse(F.substring("dna", 17, 16)), "ACGT", "TGCA")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("W"), _key("o_orderkey"), F.lit(","), F.substring("dna", 1, 16))).otherwise(F.concat(F.lit("W"), _key("o_orderkey"), F.lit(","), F.substring("dna", 1, 16), F.lit(","), back))
    path = scratch(spark)
    d.select(line.alias("value")).write.text(path)
    return native.read_dual_barcodes(spark, path)
