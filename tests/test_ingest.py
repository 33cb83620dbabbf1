from pyspark.sql import functions as F

from accessloom.operators.ingest import narrowed_expansions
from tests.helpers import grants


def test_filters_keep_types_beyond_ten_thousand(spark):
    scheduled = spark.range(10_050).select(F.concat(F.lit("t"), F.col("id")).alias("external_id"))
    df = grants(spark, [("a:1:x", "user", "u", {}, (["b:1:y"], False, ["t10049", "t3", "gone"])), ("a:1:x", "user", "v", {}, (["b:1:y"], False, ["gone"]))])
    out = narrowed_expansions(df, scheduled)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = {r.principal_resource_id: (r.expansion and r.expansion.resource_type_ids, r.needs_expansion) for r in out.collect()}
    assert got == {"u": (["t10049", "t3"], True), "v": (None, False)}
