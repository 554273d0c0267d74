"""SQL functions give what the operators give."""

import pytest
from pyspark.sql import functions as F

from metaudit.operators import pattern_rules as P
from metaudit.operators.redact import redact_text
from metaudit.sources.sql_functions import register_sql

TEXTS = [None, "", "nothing", "GPS Location gps geotag", "a@b.co, x.y@z.org a@b.co", "call (123) 456-7890 or 123.456.7890", "1234 5678",
         "ssn 123-45-6789 123-45-678", "see http://www.site-one.org/x, https://a.b/c%20d. and example.com google.com",
         "10.0.0.1 8.8.8.8 192.168.1.1 172.16.0.1 172.32.0.1 127.0.0.1 2001:db8:0:0:0:0:0:1", "4111111111111111 5500005555555559 340000000000009",
         "it's a 'quoted' \\ text é@ü.de"]
SAME = {"gps_terms": P.gps_term_matches, "email": P.email_matches, "phone": P.phone_matches, "ssn": P.ssn_matches, "domains": P.domain_matches,
        "ip": P.ip_matches, "urls": P.url_matches,
        "credit_cards": lambda e: F.sort_array(F.transform(P.card_matches(e), P.mask_card))}


@pytest.mark.parametrize("name", sorted(SAME))
def test_detectors(spark, name):
    register_sql(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").union(docs)
    out = df.select("text", F.expr(f"detect_{name}(text)").alias("sql"), SAME[name](P.text_entries(df, ["text"])).alias("own"))
    rows = out.collect()
    assert all(r.sql == r.own for r in rows) and any(r.sql for r in rows)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_redaction(spark):
    register_sql(spark)
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    every = ["email", "phone", "ssn", "card", "ip"]
    out = df.select(F.expr("redact_text(text)").alias("a"), redact_text(F.col("text")).alias("b"),
                    F.expr(f"redact_text(text, array({', '.join(map(repr, every))}))").alias("c"), redact_text(F.col("text"), every).alias("d"))
    assert all(r.a == r.b and r.c == r.d for r in out.collect())


def test_sources_from_sql(spark, tmp_path):
    (tmp_path / ".hidden").write_text("x")
    register_sql(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW here USING folder OPTIONS (path '{tmp_path}')")
    assert [r.file_size for r in spark.sql("SELECT file_size FROM here").collect()] == [1]
