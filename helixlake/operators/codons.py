"""Codon tables as rows (table_id, letter, triplet, weight, is_start, is_stop) and what is counted and merged with them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import seq

# ---- fixed values: genetic codes by number, letters and starts in the order TTT, TTC, TTA, TTG, TCT, ...
GENETIC_CODES = {
    1: ("FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "---M------**--*----M---------------M----------------------------"),
    2: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG", "----------**--------------------MMMM----------**---M------------"),
    3: ("FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------**----------------------MM---------------M------------"),
    4: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "--MM------**-------M------------MMMM---------------M------------"),
    5: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG", "---M------**--------------------MMMM---------------M------------"),
    6: ("FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "--------------*--------------------M----------------------------"),
    9: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG", "----------**-----------------------M---------------M------------"),
    10: ("FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------**-----------------------M----------------------------"),
    11: ("FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "---M------**--*----M------------MMMM---------------M------------"),
    12: ("FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------**--*----M---------------M----------------------------"),
    13: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG", "---M------**----------------------MM---------------M------------"),
    14: ("FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG", "-----------*-----------------------M----------------------------"),
    16: ("FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------*---*--------------------M----------------------------"),
    21: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG", "----------**-----------------------M---------------M------------"),
    22: ("FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "------*---*---*--------------------M----------------------------"),
    23: ("FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "--*-------**--*-----------------M--M---------------M------------"),
    24: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG", "---M------**-------M---------------M---------------M------------"),
    25: ("FFLLSSSSYY**CCGWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "---M------**-----------------------M---------------M------------"),
    26: ("FFLLSSSSYY**CC*WLLLAPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------**--*----M---------------M----------------------------"),
    27: ("FFLLSSSSYYQQCCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "--------------*--------------------M----------------------------"),
    28: ("FFLLSSSSYYQQCCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------**--*--------------------M----------------------------"),
    29: ("FFLLSSSSYYYYCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "--------------*--------------------M----------------------------"),
    30: ("FFLLSSSSYYEECC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "--------------*--------------------M----------------------------"),
    31: ("FFLLSSSSYYEECCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------**-----------------------M----------------------------"),
    33: ("FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG", "---M-------*-------M---------------M---------------M------------"),
}
TRIPLETS = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
_DDL = "table_id int, letter string, triplet string, weight long, is_start boolean, is_stop boolean"


def translation_map(number: int = 1) -> dict[str, str]:
    return dict(zip(TRIPLETS, GENETIC_CODES[number][0], strict=True))


def table_rows(numbers: Iterable[int]) -> list[tuple]:
    return [(k, letter, t, 1, s == "M", s == "*") for k in numbers for t, letter, s in zip(TRIPLETS, *GENETIC_CODES[k], strict=True)]


def codon_tables(spark: SparkSession, *numbers: int) -> DataFrame:
    """Rows of the genetic codes, all of them without numbers; every weight is 1."""
    return spark.createDataFrame(table_rows(numbers or GENETIC_CODES), _DDL)


def read_codon_json(spark: SparkSession, path: str, table_id: int = 0) -> DataFrame:
    """A table in JSON: start_codons, stop_codons, amino_acids of letter and codons of triplet and weight."""
    schema = "start_codons array<string>, stop_codons array<string>, amino_acids array<struct<letter:string,codons:array<struct<triplet:string,weight:bigint>>>>"
    return _flat(spark.read.schema(schema).option("multiLine", "true").json(path), table_id)


def parse_codon_json(df: DataFrame, column: str, table_id: int = 0) -> DataFrame:
    schema = "struct<start_codons:array<string>,stop_codons:array<string>,amino_acids:array<struct<letter:string,codons:array<struct<triplet:string,weight:bigint>>>>>"
    return _flat(df.select(F.from_json(column, schema).alias("t")).select("t.*"), table_id)


def _flat(nested: DataFrame, table_id: int) -> DataFrame:
    rows = nested.select("start_codons", "stop_codons", F.explode("amino_acids").alias("a")).select("start_codons", "stop_codons", "a.letter", F.explode("a.codons").alias("c"))
    return rows.select(F.lit(table_id).alias("table_id"), "letter", "c.triplet", "c.weight", F.array_contains("start_codons", F.col("c.triplet")).alias("is_start"), F.array_contains("stop_codons", F.col("c.triplet")).alias("is_stop"))


def codon_json(table: DataFrame) -> DataFrame:
    """One column `json` for each table_id."""
    letters = table.groupBy("table_id", "letter").agg(F.sort_array(F.collect_list(F.struct("triplet", "weight"))).alias("codons"))
    marks = table.groupBy("table_id").agg(F.sort_array(F.collect_list(F.when(F.col("is_start"), F.col("triplet")))).alias("start_codons"), F.sort_array(F.collect_list(F.when(F.col("is_stop"), F.col("triplet")))).alias("stop_codons"))
    nested = letters.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("letter", "codons"))).alias("amino_acids"))
    return marks.join(nested, "table_id").select("table_id", F.to_json(F.struct("start_codons", "stop_codons", "amino_acids")).alias("json"))


def codon_frequency(sequences: DataFrame, *by: str, column: str = "sequence") -> DataFrame:
    """Counts of upper-case triplets in frame, over all sequences or for each value of `by`."""
    return sequences.select(*by, F.explode(seq.codons(column)).alias("triplet")).groupBy(*by, "triplet").agg(F.count("*").alias("n"))


def weighted(table: DataFrame, sequences: DataFrame, column: str = "sequence") -> DataFrame:
    """The table with weights from coding sequences; those with a broken frame are left out, absent triplets weigh 0."""
    counts = codon_frequency(sequences.where(F.length(column) % 3 == 0), column=column)
    return table.drop("weight").join(counts, "triplet", "left").select("table_id", "letter", "triplet", F.coalesce("n", F.lit(0)).cast("long").alias("weight"), "is_start", "is_stop")


def start_codons(sequences: DataFrame, column: str = "sequence") -> DataFrame:
    """triplet, n over coding sequences in frame; their sum is the number of genes."""
    whole = sequences.where((F.length(column) % 3 == 0) & (F.length(column) > 0))
    return whole.groupBy(F.substring(column, 1, 3).alias("triplet")).agg(F.count("*").alias("n"))


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    """Weights of both tables added; triplets that b lacks vanish."""
    other = b.select("triplet", F.col("weight").alias("other"))
    return a.join(other, "triplet").select("table_id", "letter", "triplet", (F.col("weight") + F.col("other")).alias("weight"), "is_start", "is_stop")


def compromise(a: DataFrame, b: DataFrame, cutoff: float) -> DataFrame:
    """Means of both shares (in ten-thousandths, cut to whole numbers); 0 where one of them is below the cutoff."""
    if cutoff < 0:
        raise ValueError("cut off too low, cannot be less than 0")
    if cutoff > 1:
        raise ValueError("cut off too high, cannot be greater than 1")
    share = lambda df: F.coalesce(F.try_divide(F.col("weight").cast("double"), F.sum("weight").over(W.partitionBy("letter")).cast("double")) * 10000, F.lit(0.0)).cast("long")
    x = a.select("table_id", "letter", "triplet", "is_start", "is_stop", share(a).alias("x"))
    y = b.select("letter", "triplet", share(b).alias("y"))
    least = int(10000 * cutoff)
    both = x.join(y, ["letter", "triplet"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    weight = F.when((F.col("x") < least) | (F.col("y") < least), 0).otherwise(((F.col("x") + F.col("y")) / 2).cast("long"))
    return both.select("table_id", "letter", "triplet", weight.cast("long").alias("weight"), "is_start", "is_stop")
