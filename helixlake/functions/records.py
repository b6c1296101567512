"""Records as columns: texts parsed into arrays of records and back, and the features of GenBank records."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..sources.datasources import FORMATS, _plain_deep
from ..sources.genbank import location_sequence, location_text, parse_location


def _struct(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()


def parse_column(name: str, parity: bool = False, zeros: bool = False):
    """f(text) -> struct of records (an array in the format's schema) and error; for texts that hold whole files."""
    form, options = FORMATS[name], {"parity": parity, "zeroValues": zeros}

    @F.pandas_udf(f"records array<{_struct(form.ddl)}>, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((None, None) if t is None else (list(form.parse(iter(t.splitlines(keepends=True)), options)), None))
            except ValueError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["records", "error"])

    return run


def text_column(name: str, end_reasons: dict[str, int] | None = None):
    """f(record struct) -> text of the record; SLOW5 needs the numbers of its end reasons."""
    form = FORMATS[name]

    @F.pandas_udf("string")
    def run(records: pd.DataFrame) -> pd.Series:
        return pd.Series([form.text({k: _plain(v) for k, v in r.items()}, end_reasons) for r in records.to_dict("records")])

    return run


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list) and v and isinstance(v[0], tuple) and len(v[0]) == 2:
        return dict(v)
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return _plain_deep(v)


def location_column():
    """f(text) -> location nodes in preorder; null for a broken one."""

    @F.pandas_udf(schemas.LOCATION)
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else parse_location(t)
            except ValueError:
                return None

        return texts.map(one)

    return run


def location_text_column():
    """f(location nodes) -> text."""

    @F.pandas_udf("string")
    def run(nodes: pd.Series) -> pd.Series:
        return nodes.map(lambda x: None if x is None else location_text([dict(n) for n in x]))

    return run


def feature_sequence_column():
    """f(sequence, location nodes) -> letters of the feature."""

    @F.arrow_udf("string")
    def run(sequence: pa.Array, nodes: pa.Array) -> pa.Array:
        flat, out, end = nodes.flatten(), [], 0
        names = ("node", "parent", "start", "end", "complement")
        places = [dict(zip(names, x, strict=True)) for x in zip(*(flat.field(n).to_pylist() for n in names), strict=True)]
        for s, count in zip(sequence.to_pylist(), pc.list_value_length(nodes).to_pylist(), strict=True):
            start, end = end, end + (count or 0)
            out.append(None if s is None or count is None else location_sequence(s, places[start:end]))
        return pa.array(out, pa.string())

    return run


def features(records: DataFrame, *keep: str) -> DataFrame:
    """A row for each feature of GenBank records: kept columns, place, type, attributes, location, sequence.

    A sequence that is stored with a feature stays; others are cut out of the record.
    """
    rows = records.select(*keep, F.col("sequence").alias("__parent"), F.posexplode("features").alias("place", "f"))
    cut = feature_sequence_column()("__parent", "f.location")
    return rows.select(*keep, "place", "f.type", "f.attributes", "f.location", F.coalesce(F.when(F.col("f.sequence") != "", F.col("f.sequence")), cut).alias("sequence"))


def coding_sequences(records: DataFrame, *keep: str) -> DataFrame:
    """CDS features whose length is a multiple of three."""
    return features(records, *keep).where((F.col("type") == "CDS") & (F.length("sequence") % 3 == 0))


def add_feature(column: str, feature: Column) -> Column:
    return F.array_append(column, feature)


def multimap(df: DataFrame, *by: str, key: str = "key", value: str = "value") -> DataFrame:
    """Columns `by` and a map of arrays: values of each key, sorted."""
    one = df.groupBy(*by, key).agg(F.sort_array(F.collect_list(value)).alias("v"))
    return one.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "v")))).alias("values"))
