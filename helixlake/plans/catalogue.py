"""Queries over the driver's tables, with the SQL that gives the same rows in DuckDB.

There is no DNA in the tables, so sequences are derived by expressions that both engines compute alike: the letters
A, C, G, T of a text (seqs), and 32 letters from a hash of an order's key (rand_dna). Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import align, cloning, codec, design, seq
from ..operators import barcoding, codons, matching, pileups
from ..session import spread, table
from ..sources import native

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- derived views

_SEQS = "seqs AS (SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS dna FROM documents)"
_ITEMS = "items AS (SELECT item_id::VARCHAR AS identifier, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS dna FROM benchmark)"
_RAND = "rand AS (SELECT o_orderkey, translate(md5(o_orderkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS dna FROM orders)"
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def rc(x: str) -> str:
    return _RC.format(x)


def _letters(text: str) -> Column:
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]", ""))


def seqs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", _letters("text").alias("dna"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("identifier"), _letters("text").alias("sequence"))


def rand_dna(spark: SparkSession, sf: str, wide: bool = False) -> DataFrame:
    """`wide` for functions whose work is large beside their input."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    return (spread(orders, "o_orderkey") if wide else orders).select("o_orderkey", F.translate(F.md5(F.col("o_orderkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("dna"))


def _md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


# ---- scalar functions


@query(f"WITH {_SEQS} SELECT doc_id, md5({rc('dna')}) AS rc, md5(translate(dna, 'ACGT', 'TGCA')) AS c, md5(reverse(dna)) AS r FROM seqs")
def complements(spark, sf):
    return seqs(spark, sf).select("doc_id", _md5(seq.reverse_complement("dna")).alias("rc"), _md5(seq.complement("dna")).alias("c"), _md5(seq.reverse("dna")).alias("r"))


@query(f"WITH {_SEQS} SELECT doc_id, md5(reverse(translate(replace(dna, 'T', 'U'), 'ACGU', 'UGCA'))) AS rc, md5(translate(replace(dna, 'T', 'U'), 'ACGU', 'UGCA')) AS c FROM seqs")
def complements_rna(spark, sf):
    rna = F.replace("dna", F.lit("T"), F.lit("U"))
    return seqs(spark, sf).select("doc_id", _md5(seq.reverse_complement_rna(rna)).alias("rc"), _md5(seq.complement_rna(rna)).alias("c"))


@query(f"WITH {_SEQS} SELECT doc_id, md5(least(dna, {rc('dna')})) AS canonical FROM seqs")
def canonical(spark, sf):
    return seqs(spark, sf).select("doc_id", _md5(seq.canonical("dna")).alias("canonical"))


@query(f"WITH {_SEQS} SELECT doc_id, round(len(regexp_replace(dna, '[AT]', '', 'g')) / len(dna), 9) AS gc FROM seqs WHERE dna <> ''")
def gc_content(spark, sf):
    return seqs(spark, sf).where("dna != ''").select("doc_id", F.round(seq.gc_content("dna"), 9).alias("gc"))


@query(f"""WITH {_RAND}, h AS (SELECT o_orderkey, substr(dna, 1, 4) AS s FROM rand), t AS (SELECT o_orderkey, s, translate(s, 'T', 'U') AS u FROM h)
SELECT o_orderkey, s = {rc('s')} AS palindrome, regexp_full_match(u, '[ACGT]*') AS dna, regexp_full_match(u, '[ACGU]*') AS rna, regexp_full_match(translate(s, 'ACGT', '(.).'), '[().]+') AS brackets FROM t""")
def predicates(spark, sf):
    s = rand_dna(spark, sf).select("o_orderkey", F.substring("dna", 1, 4).alias("s")).withColumn("u", F.translate("s", "T", "U"))
    return s.select("o_orderkey", seq.is_palindromic("s").alias("palindrome"), seq.is_dna("u").alias("dna"), seq.is_rna("u").alias("rna"), seq.is_dot_bracket(F.translate("s", "ACGT", "(.).")).alias("brackets"))


@query("SELECT l_orderkey, l_linenumber, (l_orderkey % 4096) & 2304 = 0 AS is_primary FROM lineitem")
def primary_filter(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", seq.is_primary_alignment((F.col("l_orderkey") % 4096).cast("int")).alias("is_primary"))


# ---- k-mers


@query(f"""WITH {_SEQS}, k AS (SELECT doc_id, substr(dna, i, 8) AS w FROM (SELECT doc_id, dna, unnest(range(1, len(dna) - 6)) AS i FROM seqs))
SELECT least(w, {rc('w')}) AS kmer, count(*) AS n, count(DISTINCT doc_id) AS docs FROM k GROUP BY 1""")
def kmer_count(spark, sf):
    return seqs(spark, sf).select("doc_id", F.explode(seq.canonical_kmers("dna", 8)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


_INDEX = f"""ik AS (SELECT DISTINCT identifier, least(w, {rc('w')}) AS kmer FROM (SELECT identifier, substr(dna, i, 12) AS w FROM (SELECT identifier, dna, unnest(range(1, len(dna) - 10)) AS i FROM items))),
idx AS (SELECT kmer, min(identifier) AS identifier FROM ik GROUP BY kmer HAVING count(*) = 1)"""


@query(f"WITH {_ITEMS}, {_INDEX} SELECT kmer, identifier FROM idx")
def unique_kmer_index(spark, sf):
    return matching.unique_kmer_index(items(spark, sf), 12)


@query(f"""WITH {_SEQS}, {_ITEMS}, {_INDEX}, tot AS (SELECT identifier, count(*) AS total FROM idx GROUP BY identifier),
rk AS (SELECT doc_id, least(w, {rc('w')}) AS kmer FROM (SELECT doc_id, substr(dna, i, 12) AS w FROM (SELECT doc_id, dna, unnest(range(1, len(dna) - 10)) AS i FROM seqs))),
hits AS (SELECT doc_id, identifier, count(*) AS n FROM rk JOIN idx USING (kmer) GROUP BY ALL)
SELECT doc_id, identifier, round(n / total, 9) AS score FROM hits JOIN tot USING (identifier) WHERE n / total > 0.5""")
def megamash_match(spark, sf):
    reads = seqs(spark, sf).select("doc_id", F.col("dna").alias("sequence"))
    return matching.match_templates(reads, items(spark, sf), 12, 0.5, "doc_id").select("doc_id", "identifier", F.round("score", 9).alias("score"))


_KMERS = "ov AS (SELECT DISTINCT substr(dna, 1, 16) AS kmer FROM items WHERE len(dna) >= 16)"


def _junctions(spark, sf):
    return items(spark, sf).where(F.length("sequence") >= 16).select(F.substring("sequence", 1, 16).alias("kmer"))


@query(f"WITH {_SEQS}, {_ITEMS}, {_KMERS} SELECT doc_id, kmer FROM seqs, ov WHERE contains(dna, kmer) OR contains(dna, {rc('kmer')})")
def find_kmers_theta(spark, sf):
    return matching.find_kmers_theta(seqs(spark, sf).withColumnRenamed("dna", "sequence"), _junctions(spark, sf), "doc_id")


@query(ORACLE_SQL["find_kmers_theta"])
def find_kmers_equi(spark, sf):
    return matching.find_kmers(seqs(spark, sf).withColumnRenamed("dna", "sequence"), _junctions(spark, sf), 16, "doc_id")


_VALUE = "(ascii(substr(w, 1, 1)) * 16777216 + ascii(substr(w, 2, 1)) * 65536 + ascii(substr(w, 3, 1)) * 256 + ascii(substr(w, 4, 1)))::BIGINT"
_SKETCH = """sk AS (SELECT {id}, v, row_number() OVER (PARTITION BY {id} ORDER BY v) AS r FROM (SELECT {id}, {v} AS v FROM (SELECT {id}, substr(dna, i, 16) AS w FROM (SELECT {id}, dna, unnest(range(1, len(dna) - 15)) AS i FROM {t} WHERE len(dna) >= 16 + {s}))))"""


@query(f"WITH {_SEQS}, {_SKETCH.format(id='doc_id', v=_VALUE, t='seqs', s=20)} SELECT doc_id, string_agg(v::VARCHAR, ',' ORDER BY r) AS sketch FROM sk WHERE r <= 20 GROUP BY doc_id")
def mash_sketch(spark, sf):
    long_ = seqs(spark, sf).where(F.length("dna") >= 36)
    return long_.select("doc_id", F.array_join(F.transform(seq.sketch("dna", 16, 20), lambda v: v.cast("string")), ",").alias("sketch"))


@query(f"""WITH {_SEQS}, {_ITEMS}, {_SKETCH.format(id='doc_id', v=_VALUE, t='seqs', s=20)}, a AS (SELECT doc_id, v, count(*) AS n FROM sk WHERE r <= 20 GROUP BY ALL),
{_SKETCH.format(id='identifier', v=_VALUE, t='items', s=10).replace('sk AS', 'sk2 AS')}, b AS (SELECT identifier, v, count(*) AS n FROM sk2 WHERE r <= 10 GROUP BY ALL)
SELECT doc_id, identifier, round(1 - sum(least(a.n, b.n)) / 10, 9) AS distance FROM a JOIN b USING (v) GROUP BY ALL""")
def mash_distance(spark, sf):
    a = seqs(spark, sf).where(F.length("dna") >= 36).select(F.col("doc_id").alias("id"), seq.sketch("dna", 16, 20).alias("sketch"))
    b = items(spark, sf).where(F.length("sequence") >= 26).select(F.col("identifier").alias("id"), seq.sketch("sequence", 16, 10).alias("sketch"))
    return matching.sketch_similarity(a, b, 20, 10).select(F.col("a_id").alias("doc_id"), F.col("b_id").alias("identifier"), F.round(1 - F.col("similarity"), 9).alias("distance"))


# ---- codons


def _case(letters: dict[str, str], x: str) -> str:
    return "map_extract_value(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in letters.items()) + "}, " + x + ")"


def _translation(name: str, number: int) -> None:
    sql = f"""WITH {_SEQS}, c AS (SELECT doc_id, i, substr(dna, i, 3) AS t FROM (SELECT doc_id, dna, unnest(range(1, len(dna) - 1, 3)) AS i FROM seqs))
SELECT doc_id, md5(string_agg({_case(codons.translation_map(number), 't')}, '' ORDER BY i)) AS protein FROM c GROUP BY doc_id"""

    def run(spark, sf):
        return seqs(spark, sf).where(F.length("dna") >= 3).select("doc_id", _md5(seq.translate("dna", codons.translation_map(number))).alias("protein"))

    run.__name__ = name
    query(sql)(run)


_translation("translate_table_1", 1)
_translation("translate_table_11", 11)
_translation("translate_table_2", 2)

_COUNTS = "c AS (SELECT substr(dna, i, 3) AS triplet, count(*) AS n FROM (SELECT dna, unnest(range(1, len(dna) - 1, 3)) AS i FROM seqs {where}) GROUP BY 1)"
_TABLE = "tab(letter, triplet) AS (VALUES " + ", ".join(f"('{v}', '{k}')" for k, v in codons.translation_map(1).items()) + ")"


@query(f"WITH {_SEQS}, {_COUNTS.format(where='')} SELECT triplet, n FROM c")
def codon_frequency(spark, sf):
    return codons.codon_frequency(seqs(spark, sf), column="dna")


@query(f"WITH {_SEQS}, {_COUNTS.format(where='WHERE len(dna) % 3 = 0')}, {_TABLE} SELECT letter, triplet, coalesce(n, 0) AS weight FROM tab LEFT JOIN c USING (triplet)")
def codon_weights(spark, sf):
    return codons.weighted(codons.codon_tables(spark, 1), seqs(spark, sf), "dna").select("letter", "triplet", "weight")


@query(f"WITH {_SEQS} SELECT substr(dna, 1, 3) AS triplet, count(*) AS n FROM seqs WHERE len(dna) % 3 = 0 AND dna <> '' GROUP BY 1")
def start_codons(spark, sf):
    return codons.start_codons(seqs(spark, sf), "dna")


def _two_tables(spark, sf):
    first = codons.weighted(codons.codon_tables(spark, 1), seqs(spark, sf), "dna")
    second = codons.weighted(codons.codon_tables(spark, 1), items(spark, sf))
    return first, second


_BOTH = f"""WITH {_SEQS}, {_ITEMS}, {_COUNTS.format(where='WHERE len(dna) % 3 = 0')}, {_COUNTS.format(where='WHERE len(dna) % 3 = 0').replace('c AS', 'd AS').replace('FROM seqs', 'FROM items')}, {_TABLE},
x AS (SELECT letter, triplet, coalesce(n, 0) AS w FROM tab LEFT JOIN c USING (triplet)), y AS (SELECT letter, triplet, coalesce(n, 0) AS w FROM tab LEFT JOIN d USING (triplet))"""


@query(f"{_BOTH} SELECT x.letter, x.triplet, x.w + y.w AS weight FROM x JOIN y USING (triplet)")
def codon_table_add(spark, sf):
    return codons.added(*_two_tables(spark, sf)).select("letter", "triplet", "weight")


@query(f"""{_BOTH}, s AS (SELECT x.letter, x.triplet, coalesce(trunc(x.w::DOUBLE / nullif(sum(x.w) OVER (PARTITION BY x.letter), 0)::DOUBLE * 10000), 0)::BIGINT AS a, coalesce(trunc(y.w::DOUBLE / nullif(sum(y.w) OVER (PARTITION BY x.letter), 0)::DOUBLE * 10000), 0)::BIGINT AS b FROM x JOIN y USING (triplet))
SELECT letter, triplet, (CASE WHEN a < 1000 OR b < 1000 THEN 0 ELSE trunc((a + b) / 2) END)::BIGINT AS weight FROM s""")
def codon_table_compromise(spark, sf):
    return codons.compromise(*_two_tables(spark, sf), 0.1).select("letter", "triplet", "weight")


# ---- melting temperatures, primers, barcodes, variants

_PAIRS = "MAP {" + ", ".join(f"'{k}': {{'h': {h}::DOUBLE, 's': {s}::DOUBLE}}" for k, (h, s) in seq.NEAREST_NEIGHBOURS.items()) + "}"


@query(f"WITH {_SEQS} SELECT doc_id, (2 * len(regexp_replace(dna, '[CG]', '', 'g')) + 4 * len(regexp_replace(dna, '[AT]', '', 'g')) - 7)::DOUBLE AS tm FROM seqs")
def marmur_doty(spark, sf):
    return seqs(spark, sf).select("doc_id", seq.marmur_doty("dna").alias("tm"))


@query(f"""WITH {_RAND}, p AS (SELECT o_orderkey, dna, unnest(range(1, 32)) AS i FROM rand), e AS (SELECT o_orderkey, dna, map_extract_value({_PAIRS}, substr(dna, i, 2)) AS v FROM p),
s AS (SELECT o_orderkey, dna, sum(v.h) AS h, sum(v.s) AS s FROM e GROUP BY ALL),
q AS (SELECT o_orderkey, dna = {rc('dna')} AS own, h + 0.2 + CASE WHEN right(dna, 1) IN ('A', 'T') THEN 2.2 ELSE 0 END AS h, s - 5.7 + CASE WHEN dna = {rc('dna')} THEN -1.4 ELSE 0 END + CASE WHEN right(dna, 1) IN ('A', 'T') THEN 6.9 ELSE 0 END + 0.368 * 31 * ln(0.05) AS s FROM s)
SELECT o_orderkey, round(h * 1000 / (s + 1.9872 * ln(0.0000005 / CASE WHEN own THEN 1 ELSE 4 END)) - 273.15, 6) AS tm, round(h, 6) AS dh, round(s, 6) AS ds FROM q""")
def santa_lucia(spark, sf):
    t = rand_dna(spark, sf).select("o_orderkey", seq.santa_lucia("dna").alias("t"))
    return t.select("o_orderkey", F.round("t.tm", 6).alias("tm"), F.round("t.dh", 6).alias("dh"), F.round("t.ds", 6).alias("ds"))


@query()
def design_primers(spark, sf):
    return rand_dna(spark, sf, wide=True).select("o_orderkey", seq.design_primers("dna", 50.0, "GGTCTC", "GAGACC").alias("p")).select("o_orderkey", "p.forward", "p.reverse")


@query(f"SELECT i AS ordinal, substr('{design.de_bruijn(6)}', (i * 15 + 1)::BIGINT, 20) AS barcode FROM range(0, 273) t(i) WHERE i * 15 + 20 < 4101")
def barcodes(spark, sf):
    return design.barcode_table(spark, 20, 6)


_IUPAC_SQL = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(b) for b in v)}]" for k, v in seq.IUPAC.items()) + "}"


@query(f"""WITH s AS (SELECT o_orderkey, translate(substr(md5(o_orderkey::VARCHAR), 1, 3), '0123456789abcdef', 'ACGTRYMKSWHBVDNN') AS s FROM orders),
a AS (SELECT o_orderkey, s, map_extract_value({_IUPAC_SQL}, substr(s, 1, 1)) AS x, map_extract_value({_IUPAC_SQL}, substr(s, 2, 1)) AS y, map_extract_value({_IUPAC_SQL}, substr(s, 3, 1)) AS z FROM s),
b AS (SELECT o_orderkey, x, y, z, unnest(range(1, len(x) + 1)) AS i FROM a), c AS (SELECT *, unnest(range(1, len(y) + 1)) AS j FROM b), d AS (SELECT *, unnest(range(1, len(z) + 1)) AS k FROM c)
SELECT o_orderkey, count(*) AS n, string_agg(x[i] || y[j] || z[k], ',' ORDER BY i, j, k) AS variants FROM d GROUP BY o_orderkey""")
def iupac_variants(spark, sf):
    s = table(spark, sf, "orders").select("o_orderkey", F.translate(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 3), "0123456789abcdef", "ACGTRYMKSWHBVDNN").alias("s"))
    v = s.select("o_orderkey", seq.variants_iupac("s").alias("v"))
    return v.select("o_orderkey", F.size("v").cast("long").alias("n"), F.array_join("v", ",").alias("variants"))


# ---- seqhash

_ROT = "list_min(list_transform(range(1, 33), lambda i: substr({0} || {0}, i, 32)))"


@query(f"WITH {_RAND} SELECT o_orderkey, {_ROT.format('dna')} AS rotation FROM rand")
def least_rotation(spark, sf):
    return rand_dna(spark, sf).select("o_orderkey", seq.least_rotation("dna").alias("rotation"))


@query(ORACLE_SQL["least_rotation"])
def least_rotation_linear(spark, sf):
    return rand_dna(spark, sf).select("o_orderkey", codec.least_rotation_column("dna").alias("rotation"))


@query(f"""WITH {_RAND}, r AS (SELECT o_orderkey, dna, {rc('dna')} AS rc FROM rand)
SELECT o_orderkey, '20' || upper(substr(sha256(dna), 1, 30)) AS linear_single, '24' || upper(substr(sha256(least(dna, rc)), 1, 30)) AS linear_double,
'28' || upper(substr(sha256({_ROT.format('dna')}), 1, 30)) AS circular_single, '2C' || upper(substr(sha256(least({_ROT.format('dna')}, {_ROT.format('rc')})), 1, 30)) AS circular_double, '21' || upper(substr(sha256(dna), 1, 30)) AS rna FROM r""")
def seqhash(spark, sf):
    h = lambda **kw: F.hex(seq.seqhash_bytes("dna", **kw))
    return rand_dna(spark, sf).select(
        "o_orderkey", h().alias("linear_single"), h(double=True).alias("linear_double"), h(circular=True).alias("circular_single"), h(circular=True, double=True).alias("circular_double"),
        F.hex(seq.seqhash_bytes(F.replace("dna", F.lit("T"), F.lit("U")), kind="RNA")).alias("rna"),
    )


@query(f"WITH {_RAND}, r AS (SELECT o_orderkey, dna, {rc('dna')} AS rc FROM rand) SELECT o_orderkey, '23' || CASE WHEN dna > rc THEN '0503' ELSE '0305' END || upper(substr(sha256(least(dna, rc)), 1, 26)) AS h FROM r")
def seqhash_fragment(spark, sf):
    return rand_dna(spark, sf).select("o_orderkey", F.hex(seq.seqhash_fragment_bytes("dna", F.lit(3), F.lit(5))).alias("h"))


@query("SELECT o_orderkey, (f >> 4)::INT AS version, ['DNA', 'RNA', 'PROTEIN', 'FRAGMENT'][(f & 3) + 1] AS kind, f & 8 <> 0 AS circular, f & 4 <> 0 AS double_stranded FROM (SELECT o_orderkey, o_orderkey % 256 AS f FROM orders)")
def seqhash_flag(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", seq.decode_flag(F.col("o_orderkey") % 256).alias("f")).select("o_orderkey", "f.*")


@query(f"WITH {_RAND} SELECT o_orderkey, '20' || upper(substr(sha256(dna), 1, 30)) AS h FROM rand")
def seqhash_name_roundtrip(spark, sf):
    return rand_dna(spark, sf).select("o_orderkey", F.hex(codec.hash_from_name_column(codec.hash_name_column(seq.seqhash_bytes("dna")))).alias("h"))


# ---- alignment and codecs


@query(f"WITH {_RAND} SELECT o_orderkey, -levenshtein(substr(dna, 1, 16), substr(dna, 17)) AS score FROM rand")
def nw_score(spark, sf):
    edit = align.Scoring("ACGT", [[0 if i == j else -1 for j in range(4)] for i in range(4)], -1)
    run = align.needleman_wunsch_column(edit)
    return rand_dna(spark, sf).select("o_orderkey", run(F.substring("dna", 1, 16), F.substring("dna", 17, 16)).alias("r")).select("o_orderkey", F.col("r.score").cast("long").alias("score"))


@query()
def sw_align(spark, sf):
    run = align.smith_waterman_column()
    return rand_dna(spark, sf).select("o_orderkey", run(F.substring("dna", 1, 16), F.substring("dna", 17, 16)).alias("r")).select("o_orderkey", "r.*")


@query("SELECT l_orderkey, string_agg(((l_partkey * l_suppkey) % 65536 - 32768)::VARCHAR, ',' ORDER BY l_linenumber, (l_partkey * l_suppkey) % 65536) AS signal FROM lineitem GROUP BY l_orderkey")
def svb_roundtrip(spark, sf):
    v = (F.col("l_partkey") * F.col("l_suppkey") % 65536 - 32768).cast("smallint")
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", v.alias("v")))), lambda x: x.v).alias("s"))
    packed = s.select("l_orderkey", F.size("s").alias("n"), codec.svb_compress_column("s").alias("c"))
    return packed.select("l_orderkey", F.array_join(codec.svb_decompress_column("n", "c.mask", "c.data").cast("array<string>"), ",").alias("signal"))


# ---- cloning and design


@query(f"""WITH {_SEQS}, p AS (SELECT doc_id, dna, unnest(range(1, len(dna) - 4)) AS i FROM seqs),
s AS (SELECT doc_id, i + 6 AS position, true AS forward FROM p WHERE substr(dna, i, 6) = 'GGTCTC' UNION ALL SELECT doc_id, i - 2, false FROM p WHERE substr(dna, i, 6) = 'GAGACC')
SELECT doc_id, position, forward, coalesce(lead(position) OVER (PARTITION BY doc_id ORDER BY position, forward DESC), -1) AS next FROM s""")
def cut_sites(spark, sf):
    from pyspark.sql import Window as W

    places = cloning.site_places_column({"GGTCTC": (6, True), "GAGACC": (-2, False)})
    sites = seqs(spark, sf).select("doc_id", F.explode(places("dna")).alias("s")).select("doc_id", "s.position", "s.forward")
    return sites.withColumn("next", F.coalesce(F.lead("position").over(W.partitionBy("doc_id").orderBy("position", F.desc("forward"))), F.lit(-1)))


_ONE_EACH = "len(p) - len(replace(p, 'GGTCTC', '')) = 6 AND len(p) - len(replace(p, 'GAGACC', '')) = 6"


@query(f"""WITH {_RAND}, p AS (SELECT o_orderkey, dna, 'TTTTTTGGTCTCA' || dna || 'TGAGACCTTTTTT' AS p FROM rand)
SELECT o_orderkey, substr(dna, 5, 24) AS sequence, substr(dna, 1, 4) AS forward_overhang, substr(dna, 29, 4) AS reverse_overhang FROM p WHERE {_ONE_EACH}""")
def digest(spark, sf):
    """Sequences between two sites, cut out of their vectors; those with sites of their own are left out."""
    part = F.concat(F.lit("TTTTTTGGTCTCA"), "dna", F.lit("TGAGACCTTTTTT"))
    one = lambda site: F.length(part) - F.length(F.replace(part, F.lit(site), F.lit(""))) == 6
    cut = cloning.digest_column("BsaI")
    return rand_dna(spark, sf).where(one("GGTCTC") & one("GAGACC")).select("o_orderkey", F.explode(cut(part, F.lit(False))).alias("f")).select("o_orderkey", "f.*")


def _gate_parts(spark, sf):
    """Two parts for each order, cut from vectors, that close to a circle."""
    d = rand_dna(spark, sf)
    part = lambda left, body, right: F.concat(F.lit(f"TTGGTCTCA{left}"), F.replace(F.replace(body, F.lit("G"), F.lit("A")), F.lit("C"), F.lit("T")), F.lit(f"{right}TGAGACCTT"))
    one = d.select(F.col("o_orderkey").alias("reaction"), F.lit(0).alias("ordinal"), part("AATG", F.substring("dna", 1, 16), "GCTT").alias("sequence"))
    two = d.select(F.col("o_orderkey").alias("reaction"), F.lit(1).alias("ordinal"), part("GCTT", F.substring("dna", 17, 16), "AATG").alias("sequence"))
    return one.unionByName(two).withColumn("circular", F.lit(False))


@query(f"""WITH {_RAND}, b AS (SELECT o_orderkey, replace(replace(dna, 'G', 'A'), 'C', 'T') AS x FROM rand)
SELECT o_orderkey::VARCHAR AS reaction, 'AATG' || substr(x, 1, 16) || 'GCTT' || substr(x, 17, 16) AS product, '0,1' AS pattern FROM b""")
def golden_gate(spark, sf):
    return cloning.golden_gate_reactions(_gate_parts(spark, sf), "BsaI").select("reaction", "product", F.array_join(F.col("pattern").cast("array<string>"), ",").alias("pattern"))


@query(f"""WITH {_RAND}, b AS (SELECT o_orderkey, replace(replace(dna, 'G', 'A'), 'C', 'T') AS x FROM rand), p AS (SELECT o_orderkey, 'AATG' || substr(x, 1, 16) || 'GCTT' || substr(x, 17, 16) AS p FROM b),
k AS (SELECT o_orderkey, o, substr(p || p, o * 20 - 3, 12) AS w FROM p, (VALUES (1), (2)) t(o))
SELECT o_orderkey::VARCHAR AS reaction, (o - 1)::INT AS ordinal, least(w, {rc('w')}) AS kmer FROM k""")
def junction_kmers(spark, sf):
    cut = cloning.digest_column("BsaI")
    f = _gate_parts(spark, sf).select(F.col("reaction").cast("string").alias("reaction"), "ordinal", F.explode(cut("sequence", "circular")).alias("f")).select("reaction", "ordinal", "f.*")
    return matching.junction_kmers(f, 12)


@query()
def pcr(spark, sf):
    """Every order's sequence, long enough for primers, amplified between its ends."""
    template = F.concat("dna", F.reverse("dna"), "dna")
    ends = F.array(F.concat(F.lit("TTTTTT"), F.substring(template, 1, 24)), F.concat(F.lit("AAAAAA"), F.substring(seq.reverse_complement(template), 1, 24)))
    return rand_dna(spark, sf).select("o_orderkey", cloning.pcr_column(40.0, False)(F.array(template), ends).alias("r")).select("o_orderkey", F.array_join("r.products", ",").alias("products"), "r.error")


def _fidelity(spark) -> DataFrame:
    """A made-up table by rule: 1000 right ligations of every overhang, 0 to 6 wrong ones with the others."""
    words = spark.range(256).select(F.concat(*[F.substring(F.lit("ACGT"), (F.shiftright("id", 2 * k).bitwiseAND(3) + 1).cast("int"), F.lit(1)) for k in (3, 2, 1, 0)]).alias("w"), F.col("id").alias("i"))
    x, y = words.toDF("x", "i"), words.toDF("y", "j")
    return x.crossJoin(y).select("x", "y", F.when(F.col("i") == F.col("j"), 1000).otherwise((F.col("i") * 7 + F.col("j") * 3) % 7).cast("long").alias("n"))


_FID = """w AS (SELECT i, substr('ACGT', ((i >> 6) & 3) + 1, 1) || substr('ACGT', ((i >> 4) & 3) + 1, 1) || substr('ACGT', ((i >> 2) & 3) + 1, 1) || substr('ACGT', (i & 3) + 1, 1) AS s FROM range(256) t(i)),
fid AS (SELECT a.s AS x, b.s AS y, CASE WHEN a.i = b.i THEN 1000 ELSE (a.i * 7 + b.i * 3) % 7 END AS n FROM w a, w b)"""


@query(f"""WITH {_RAND}, {_FID}, s AS (SELECT o_orderkey, o, substr(dna, 4 * o + 1, 4) AS h FROM rand, range(4) t(o)), both_ AS (SELECT o_orderkey, h AS y FROM s UNION ALL SELECT o_orderkey, {rc('h')} FROM s),
tot AS (SELECT s.o_orderkey, o, h, sum(n) AS t FROM s JOIN both_ b USING (o_orderkey) JOIN fid ON fid.x = h AND fid.y = b.y GROUP BY ALL)
SELECT o_orderkey, round(product(CASE WHEN t = 1000 THEN 1 ELSE 1000 / t END), 9) AS efficiency FROM tot GROUP BY o_orderkey""")
def set_efficiency(spark, sf):
    sets = rand_dna(spark, sf).select(F.col("o_orderkey").alias("set_id"), F.posexplode(F.array(*[F.substring("dna", 4 * k + 1, 4) for k in range(4)])).alias("ordinal", "overhang"))
    return design.set_efficiency_native(sets, _fidelity(spark)).select(F.col("set_id").alias("o_orderkey"), F.round("efficiency", 9).alias("efficiency"))


@query()
def next_overhangs(spark, sf):
    """Overhangs that may follow four given ones, with their efficiencies."""
    fidelity = design.read_fidelity(_fidelity(spark))
    return spark.createDataFrame(design.next_overhangs(["AATG", "GCTT", "AGGA", "CGCT"], fidelity), "overhang string, efficiency double")


def _long_dna(spark, sf) -> DataFrame:
    """384 letters for each customer."""
    part = lambda k: F.translate(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit(f"-{k}")).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    return spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select("c_custkey", F.concat(*[part(k) for k in range(12)]).alias("dna"))


@query()
def fragment_sequences(spark, sf):
    run = design.fragment_column(60, 90, design.read_fidelity(_fidelity(spark)))
    return _long_dna(spark, sf).select("c_custkey", run("dna").alias("f")).select("c_custkey", F.array_join("f.fragments", ",").alias("fragments"), F.round("f.efficiency", 9).alias("efficiency"), "f.error")


@query()
def recursive_fragment(spark, sf):
    run = design.recursive_fragment_column(100, [3, 4], design.read_fidelity(_fidelity(spark)))
    return _long_dna(spark, sf).select("c_custkey", run("dna").alias("f")).select("c_custkey", F.explode_outer("f.nodes").alias("n"), "f.error").select("c_custkey", "n.node", "n.parent", "n.level", "n.sequence", "error")


_PROTEIN = _case({k: v for k, v in codons.translation_map(1).items()}, "t")


@query(f"""WITH {_RAND}, c AS (SELECT o_orderkey, i, substr(dna, i, 3) AS t FROM rand, range(1, 30, 3) r(i)) SELECT o_orderkey, string_agg({_PROTEIN}, '' ORDER BY i) AS protein FROM c GROUP BY o_orderkey""")
def codon_optimize(spark, sf):
    """Proteins to weighted codons and back."""
    known = codons.translation_map(1)
    table_ = design.as_codons(codons.weighted(codons.codon_tables(spark, 1), seqs(spark, sf), "dna"))
    p = rand_dna(spark, sf).select("o_orderkey", seq.translate("dna", known).alias("p"))
    return p.select("o_orderkey", design.optimize_column(table_)("p", "o_orderkey").alias("d")).select("o_orderkey", seq.translate("d.dna", known).alias("protein"))


@query(f"""WITH {_RAND}, c AS (SELECT o_orderkey, i, substr(dna || dna || dna, i, 3) AS t FROM rand, range(1, 95, 3) r(i)) SELECT o_orderkey, string_agg({_PROTEIN}, '' ORDER BY i) AS protein FROM c GROUP BY o_orderkey""")
def cds_fix(spark, sf):
    """Repeats of coding sequences taken out without a change of their protein (a sequence that can't be repaired stays)."""
    known = codons.translation_map(1)
    table_ = design.as_codons(codons.codon_tables(spark, 1))
    s = F.concat("dna", "dna", "dna")
    fixed = rand_dna(spark, sf, wide=True).select("o_orderkey", s.alias("s"), design.repair_column(table_, ["GGTCTC", "GAAGAC"])(s).alias("r"))
    return fixed.select("o_orderkey", seq.translate(F.coalesce("r.sequence", "s"), known).alias("protein"))


@query()
def dual_barcode(spark, sf):
    """Wells of all texts as reads, between two barcodes; four wells of words from a de Bruijn string."""
    words = [design.de_bruijn(6)[40 * i : 40 * i + 24] for i in range(4)]
    wells = spark.createDataFrame([(f"W{i}{j}", words[i], words[2 + j]) for i in range(2) for j in range(2)], "name string, forward string, reverse string")
    reads = seqs(spark, sf).select("doc_id", F.concat(F.lit(words[0] + "GTTTTCCCAGTCACGAC"), "dna", F.lit(cloning.revcomp(words[3] + "AGCGGATAACAATTTCACACAGG"))).alias("sequence"))
    return barcoding.demultiplexed(reads, wells, "GTTTTCCCAGTCACGAC", "AGCGGATAACAATTTCACACAGG").select("doc_id", "well")


# ---- sources and sinks: records as texts and back


@query("SELECT o_orderkey, 'read ' || o_orderkey AS identifier, md5(o_comment) AS s FROM (SELECT o_orderkey, repeat(md5(o_orderkey::VARCHAR), 1 + (o_orderkey % 7)::INT) AS o_comment FROM orders)")
def fasta_roundtrip(spark, sf):
    """Texts of records, parsed again by the wrapping rule."""
    o = table(spark, sf, "orders").select("o_orderkey", F.expr("repeat(md5(cast(cast(o_orderkey as string) as binary)), cast(1 + o_orderkey % 7 as int))").alias("s"))
    t = o.select("o_orderkey", native.fasta_text(F.concat(F.lit("read "), F.col("o_orderkey").cast("string")), F.col("s")).alias("t"))
    return t.select("o_orderkey", F.regexp_extract("t", "^>([^\n]*)\n", 1).alias("identifier"), _md5(F.replace(F.regexp_replace("t", "^>[^\n]*\n", ""), F.lit("\n"), F.lit(""))).alias("s"))


@query(f"WITH {_RAND} SELECT o_orderkey, '@r' || o_orderkey || ' ch=' || (o_orderkey % 512) || ' status=' || o_orderstatus || chr(10) || dna || chr(10) || '+' || chr(10) || repeat('I', 32) || chr(10) AS record FROM rand JOIN orders USING (o_orderkey)")
def fastq_text(spark, sf):
    d = rand_dna(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    optionals = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("ch"), (F.col("o_orderkey") % 512).cast("string"))
    return d.select("o_orderkey", native.fastq_text(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")), optionals, F.col("dna"), F.expr("repeat('I', 32)")).alias("record"))


@query("SELECT 'r' || l_orderkey || '.' || l_linenumber AS qname, (l_orderkey % 4096)::INT AS flag, 'chr' || l_suppkey AS rname, l_partkey::INT AS pos, (l_quantity::INT)::SMALLINT AS mapq, 'NM:i:' || l_linenumber AS nm FROM lineitem")
def sam_roundtrip(spark, sf):
    """Alignments as SAM lines, parsed by built-in functions."""
    line = table(spark, sf, "lineitem").select(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("qname"), (F.col("l_orderkey") % 4096).cast("int").alias("flag"),
        F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")).alias("rname"), F.col("l_partkey").cast("int").alias("pos"), F.col("l_quantity").cast("int").cast("smallint").alias("mapq"), F.lit("4M").alias("cigar"),
        F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.lit("ATGC").alias("seq"), F.lit("!!!!").alias("qual"),
        F.array(F.struct(F.lit("NM").alias("tag"), F.lit("i").alias("type"), F.col("l_linenumber").cast("string").alias("data"))).alias("optionals"),
    ).select(native.sam_text().alias("value"))
    o = F.get("optionals", F.lit(0))
    return native.sam_lines(line).select("qname", "flag", "rname", "pos", "mapq", F.concat_ws(":", o.tag, o.type, o.data).alias("nm"))


_SYMBOLS = "CASE WHEN l_returnflag = 'A' THEN '.' WHEN l_linestatus = 'O' THEN 'a' WHEN l_linenumber % 2 = 0 THEN '^]T' ELSE '+2AG' END"


def _pileups(spark, sf):
    s = F.expr(_SYMBOLS)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", s.alias("s")))), lambda x: x.s).alias("read_results"))


@query(f"SELECT l_orderkey, string_agg({_SYMBOLS}, '|' ORDER BY l_linenumber, {_SYMBOLS}) AS results FROM lineitem GROUP BY l_orderkey")
def pileup_roundtrip(spark, sf):
    line = _pileups(spark, sf).select(F.col("l_orderkey").cast("string").alias("sequence"), F.lit(1).alias("position"), F.lit("C").alias("reference_base"), F.size("read_results").alias("read_count"), "read_results", F.lit("I").alias("quality")).select(native.pileup_text().alias("value"))
    return native.pileup_lines(line).select(F.col("sequence").cast("long").alias("l_orderkey"), F.array_join("read_results", "|").alias("results"))


@query(f"""WITH s AS (SELECT l_orderkey, {_SYMBOLS} AS s FROM lineitem), c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (s = '.') AS ok, count(*) FILTER (s = 'a') AS a, count(*) FILTER (s = '^]T') AS t, count(*) FILTER (s = '+2AG') AS ins FROM s GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN a / n >= 0.5 THEN 'point' WHEN t / n >= 0.5 THEN 'point' WHEN ins / n >= 0.5 AND ins > 0 THEN 'insertion' WHEN (n - ok) / n >= 0.5 THEN 'noisy' ELSE 'no_mutation' END AS type,
CASE WHEN a / n >= 0.5 THEN 'A' WHEN t / n >= 0.5 THEN 'T' WHEN ins / n >= 0.5 AND ins > 0 THEN '+2AG' WHEN (n - ok) / n >= 0.5 THEN '?' ELSE '.' END AS "to",
CASE WHEN a / n < 0.5 AND t / n < 0.5 AND ins / n >= 0.5 THEN 2 ELSE 0 END::INT AS length, ok::INT AS total_correct, n::INT AS total_aligned,
(CASE WHEN a / n >= 0.5 THEN a WHEN t / n >= 0.5 THEN t WHEN ins / n >= 0.5 AND ins > 0 THEN ins ELSE n - ok END)::INT AS total_mutated FROM c""")
def call_mutations(spark, sf):
    m = _pileups(spark, sf).select("l_orderkey", pileups.call_mutation("read_results", F.lit("C"), 0.5).alias("m"))
    return m.select("l_orderkey", "m.type", "m.to", "m.length", "m.total_correct", "m.total_aligned", "m.total_mutated")


@query("SELECT source, count(*) AS n FROM (SELECT 'doc' AS source FROM documents UNION ALL SELECT 'item' FROM benchmark UNION ALL SELECT 'page' FROM pages) GROUP BY source")
def union_files(spark, sf):
    tag = lambda name, kind: table(spark, sf, name).select(F.lit(kind).alias("source"))
    return native.union(tag("documents", "doc"), tag("benchmark", "item"), tag("pages", "page")).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT table_id, letter, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT {k} AS table_id, unnest(string_split('{v[0]}', '')) AS letter" for k, v in codons.GENETIC_CODES.items()) + ") GROUP BY ALL")
def genetic_codes(spark, sf):
    return codons.codon_tables(spark).groupBy("table_id", "letter").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM range(5)")
def enzymes(spark, sf):
    return cloning.enzyme_table(spark).agg(F.count("*").alias("n"))
