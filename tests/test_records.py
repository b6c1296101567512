from pyspark.sql import functions as F

from helixlake.functions import records
from helixlake.operators import codons
from helixlake.sources import register
from test_sources import FASTQ, GENBANK, PILEUP


def test_texts_as_columns(spark):
    df = spark.createDataFrame([(FASTQ,), ("broken",), (None,)], "t string")
    rows = df.select(records.parse_column("fastq")("t").alias("r")).collect()
    assert [x.identifier for x in rows[0].r.records] == ["r1", "r2"] and rows[1].r.error and rows[2].r.records is None
    one = df.limit(1).select(F.explode(records.parse_column("fastq")("t").records).alias("r"))
    assert "".join(x.t for x in one.select(records.text_column("fastq")("r").alias("t")).collect()) == FASTQ
    p = spark.createDataFrame([(PILEUP,)], "t string").select(F.explode(records.parse_column("pileup")("t").records).alias("r"))
    assert "".join(x.t for x in p.select(records.text_column("pileup")("r").alias("t")).collect()) == PILEUP


def test_features(spark, tmp_path):
    register(spark)
    (tmp_path / "a.gb").write_text(GENBANK)
    df = spark.read.format("genbank").load(str(tmp_path / "a.gb")).withColumn("id", F.col("meta.locus.name"))
    f = {r.type: r for r in records.features(df, "id").collect()}
    assert f["source"].sequence == "atgc" * 6 and f["CDS"].sequence == "gcatgca" and f["variation"].sequence == "a" and f["CDS"].attributes["gene"] == ["abc"]
    assert records.coding_sequences(df, "id").count() == 0
    more = df.withColumn("features", F.transform("features", lambda x: x.withField("type", F.lit("CDS")))).select("id", "sequence", "features")
    w = codons.weighted(codons.codon_tables(spark, 1), records.coding_sequences(more, "id"))
    assert w.where("triplet = 'ATG'").first().weight == 2
    place = spark.createDataFrame([("complement(join(1..4,<7..9))",), ("x..",)], "t string").select(records.location_column()("t").alias("l"))
    assert [r.t for r in place.select(records.location_text_column()("l").alias("t")).collect()] == ["complement(join(1..4,<7..9))", None]
    m = spark.createDataFrame([(1, "a", "x"), (1, "a", "b"), (1, "c", "z")], "id int, key string, value string")
    assert records.multimap(m, "id").first()["values"] == {"a": ["b", "x"], "c": ["z"]}
