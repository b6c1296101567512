"""Readers and sinks made of built-in functions: fast paths for line formats, XML, CSV and JSON, and texts of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

# ---- sources


def sam_lines(lines: DataFrame) -> DataFrame:
    """Alignments of a column `value` of SAM lines; splittable, stays in the JVM. Header lines and short lines are left out."""
    p = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("@")).select(p.alias("p")).where(F.size("p") >= 11)
    at = lambda i: F.get("p", F.lit(i))
    optional = F.transform(
        F.slice("p", F.lit(12), F.greatest(F.size("p") - 11, F.lit(0))),
        lambda o: F.struct(F.substring_index(o, ":", 1).alias("tag"), F.get(F.split(o, ":"), F.lit(1)).alias("type"), F.regexp_extract(o, r"^[^:]*:[^:]*:(.*)$", 1).alias("data")),
    )
    return rows.select(
        at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("rname"), at(3).cast("int").alias("pos"), at(4).cast("smallint").alias("mapq"), at(5).alias("cigar"),
        at(6).alias("rnext"), at(7).cast("int").alias("pnext"), at(8).cast("int").alias("tlen"), at(9).alias("seq"), at(10).alias("qual"), optional.alias("optionals"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return sam_lines(spark.read.text(path))


def read_results(text: Column | str) -> Column:
    """Read results of a pileup column: letters with their marks, insertions and deletions with their letters.

    Numbers say how many letters belong to an insertion; built-in patterns know them up to 30.
    """
    indel = "|".join(f"[+-]{n}[.,*ATGCNatgcn]{{{n}}}\\$?" for n in range(30, 0, -1))
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(rf"(?s)({indel}|\^.[.,*ATGCNatgcn]\$?|[.,*ATGCNatgcn]\$?)"), F.lit(1))


def pileup_lines(lines: DataFrame) -> DataFrame:
    p = F.split("value", "\t")
    at = lambda i: F.get(p, F.lit(i))
    return lines.where(F.size(p) == 6).select(at(0).alias("sequence"), at(1).cast("bigint").alias("position"), at(2).alias("reference_base"), at(3).cast("bigint").alias("read_count"), read_results(at(4)).alias("read_results"), at(5).alias("quality"))


def read_uniprot(spark: SparkSession, path: str) -> DataFrame:
    """UniProt entries. Evidence stays text; evidence_keys() gives numbers."""
    return spark.read.format("xml").option("rowTag", "entry").schema(schemas.UNIPROT).load(path)


def evidence_keys(c: Column | str) -> Column:
    """Evidence attributes are numbers between spaces."""
    return F.transform(F.filter(F.split(F.col(c) if isinstance(c, str) else c, " "), lambda x: x != ""), lambda x: x.cast("int"))


def read_uniref(spark: SparkSession, path: str) -> DataFrame:
    """UniRef entries: id, updated, name, properties, rep_member, members."""
    raw = spark.read.format("xml").option("rowTag", "entry").option("charset", "ISO-8859-1").schema(schemas.UNIREF).load(path)
    props = lambda c: F.transform(c, lambda p: F.struct(p["_type"].alias("type"), p["_value"].alias("value")))
    member = lambda m: F.struct(F.struct(m.dbReference["_type"].alias("type"), m.dbReference["_id"].alias("id"), props(m.dbReference.property).alias("properties")).alias("db_ref"), F.struct(m.sequence["_length"].alias("length"), m.sequence["_checksum"].alias("checksum"), m.sequence["_VALUE"].alias("value")).alias("sequence"))
    return raw.select(F.col("_id").alias("id"), F.col("_updated").alias("updated"), "name", props(F.col("property")).alias("properties"), member(F.col("representativeMember")).alias("rep_member"), F.transform("member", member).alias("members"))


def uniref_version(spark: SparkSession, path: str) -> str:
    """50, 90 or 100, from the name of the root element."""
    found = spark.read.text(path).select(F.regexp_extract("value", r"<UniRef(\d+)[\s>]", 1).alias("v")).where("v != ''").limit(1).collect()
    return found[0].v if found else ""


def get_uniprot(accession: str, base: str = "https://rest.uniprot.org/uniprotkb", timeout: float = 30.0) -> str:
    """XML text of one entry from the public service; raises unless the answer is 200."""
    from urllib.request import urlopen

    with urlopen(f"{base}/{accession}.xml", timeout=timeout) as answer:  # noqa: S310
        if answer.status != 200:
            raise OSError(f"Got status code: {answer.status}")
        return answer.read().decode("utf-8")


def read_dual_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """CSV of name, forward, reverse; rows with other than three fields are left out."""
    rows = spark.read.schema("name string, forward string, reverse string, more string").csv(path)
    return rows.where("more is null and reverse is not null").drop("more")


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def first_records(df: DataFrame, n: int) -> DataFrame:
    """The first n records of the files, for sources read with option ordinals."""
    return df.orderBy("source_file", "ordinal").limit(n)


# ---- sinks: a record as text


def fasta_text(identifier: Column | str, sequence: Column | str) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(F.lit(">"), c(identifier), F.lit("\n"), F.regexp_replace(c(sequence), "(.{80})", "$1\n"), F.lit("\n\n"))


def fastq_text(identifier: Column | str, optionals: Column | str, sequence: Column | str, quality: Column | str) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(c(optionals))), lambda e: F.concat(F.lit(" "), e.key, F.lit("="), e.value)), "")
    return F.concat(F.lit("@"), c(identifier), F.coalesce(pairs, F.lit("")), F.lit("\n"), c(sequence), F.lit("\n+\n"), c(quality), F.lit("\n"))


def sam_text() -> Column:
    """Of the columns of an alignment, without the line end."""
    return F.concat_ws("\t", "qname", F.col("flag").cast("string"), "rname", F.col("pos").cast("string"), F.col("mapq").cast("string"), "cigar", "rnext", F.col("pnext").cast("string"), F.col("tlen").cast("string"), "seq", "qual", F.transform("optionals", lambda o: F.concat_ws(":", o.tag, o.type, o.data)))


def pileup_text() -> Column:
    return F.concat_ws("\t", "sequence", F.col("position").cast("string"), "reference_base", F.col("read_count").cast("string"), F.array_join("read_results", ""), "quality")


def uniprot_json() -> Column:
    return F.to_json(F.struct("*"))


def uniref_xml(row: Column) -> Column:
    return F.to_xml(row, {"rowTag": "entry"})


def rebase_json(enzymes: DataFrame) -> DataFrame:
    """One column `json`: enzymes by name."""
    return enzymes.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", F.struct(*enzymes.columns))))).alias("json"))


# ---- validation of alignments and headers

_RULES = (
    ("qname", r"^[!-?A-~]{1,254}$", "Invalid QNAME: must match ^[!-?A-~]{1,254}$"),
    ("rname", r"^\*|[:rname^*=][:rname]*$", r"Invalid RNAME: must match ^\*|[:rname:^\*=][:rname:]*$"),
    ("pos", None, "Invalid POS: must be in range [0, 2147483647]"),
    ("cigar", r"^\*|([0-9]+[MIDNSHPX=])+$", r"Invalid CIGAR: must match ^\*|([0-9]+[MIDNSHPX=])+$"),
    ("rnext", r"^\*|=\|[:rname^*=][:rname]*$", r"Invalid RNEXT: must match ^\*|=\|[:rname:^\*=][:rname:]*$"),
    ("pnext", None, "Invalid PNEXT: must be in range [0, 2147483647]"),
    ("seq", r"^\*|[A-Za-z=.]+$", r"Invalid SEQ: must match ^\*|[A-Za-z=.]+$"),
    ("qual", r"^[!-~]+$", "Invalid QUAL: must match ^[!-~]+$"),
)


#: The patterns of the format's specification, for names that the rules above refuse.
_SPEC = {"rname": r"^(\*|[0-9A-Za-z!#$%&+./:;?@^_|~-][0-9A-Za-z!#$%&*+./:;=?@^_|~-]*)$", "cigar": r"^(\*|([0-9]+[MIDNSHPX=])+)$", "rnext": r"^(\*|=|[0-9A-Za-z!#$%&+./:;?@^_|~-][0-9A-Za-z!#$%&*+./:;=?@^_|~-]*)$", "seq": r"^(\*|[A-Za-z=.]+)$"}


def sam_error(spec: bool = False) -> Column:
    """The first rule that an alignment breaks, or null.

    The rules for names are character classes of the letters of the word rname, anchored at one side; with `spec` the
    specification's own patterns are taken.
    """
    rules = [(c, _SPEC.get(c, p) if spec else p, m) for c, p, m in _RULES]
    checks = [F.when((F.col(c) < 0) if pattern is None else ~F.coalesce(F.col(c).rlike(pattern), F.lit(False)), F.lit(message)) for c, pattern, message in rules]
    return F.coalesce(*checks)


_PLATFORMS = "CAPILLARY DNBSEQ ELEMENT HELICOS ILLUMINA IONTORRENT LS454 ONT PACBIO SOLID ULTIMA".split()


def sam_header_error() -> Column:
    """The first rule that a header row breaks, or null."""
    bad = lambda value, good: value.isNotNull() & ~good
    hd = lambda k: F.try_element_at("hd", F.lit(k))
    any_ = lambda column, tag, wrong: F.exists(column, lambda m: F.coalesce(bad(F.try_element_at(m, F.lit(tag)), ~wrong(F.try_element_at(m, F.lit(tag)))), F.lit(False)))
    twice = lambda column, tag: F.size(F.filter(column, lambda m: F.try_element_at(m, F.lit(tag)).isNotNull())) > F.size(F.array_distinct(F.filter(F.transform(column, lambda m: F.try_element_at(m, F.lit(tag))), lambda v: v.isNotNull())))
    rules = [
        (bad(hd("VN"), hd("VN").rlike(r"^[0-9]+\.[0-9]+$")), "Invalid format for @HD VN"),
        (bad(hd("SO"), hd("SO").isin("unknown", "unsorted", "queryname", "coordinate")), "Invalid value for @HD SO"),
        (bad(hd("GO"), hd("GO").isin("none", "query", "reference")), "Invalid value for @HD GO"),
        (bad(hd("SS"), hd("SS").rlike("(coordinate|queryname|unsorted)(:[A-Za-z0-9_-]+)+")), "Invalid format for @HD SS"),
        (twice("sq", "SN"), "Non-unique @SQ SN"),
        (any_("sq", "LN", lambda v: ~F.coalesce(v.try_cast("bigint").between(1, 2147483647), F.lit(False))), "Invalid value for @SQ LN"),
        (any_("sq", "TP", lambda v: ~v.isin("linear", "circular")), "Invalid value for @SQ TP"),
        (twice("rg", "ID"), "Non-unique @RG ID"),
        (any_("rg", "FO", lambda v: ~v.rlike(r"\*|[ACMGRSVTWYHKDBN]+")), "Invalid format for @RG FO"),
        (any_("rg", "PL", lambda v: ~v.isin(*_PLATFORMS)), "Invalid value for @RG PL"),
        (twice("pg", "ID"), "Non-unique @PG ID"),
    ]
    return F.coalesce(*[F.when(wrong, F.lit(message)) for wrong, message in rules])
