"""The batch request flow reproduces the registered per-operator queries."""

from pyspark.sql import functions as F

from locations import SF_SMALL
from querywarden.plans import catalog as C
from querywarden.plans import search as S
from querywarden.sources import policy as P
from querywarden.sources import tables as TB


def test_search_batch_matches_catalog(spark):
    q = TB.query_log(spark, SF_SMALL).withColumn("policy_id", F.expr(TB.USER_POLICY_SQL))
    rows = TB.result_rows(spark, SF_SMALL)
    item = F.struct(F.col("rnk").alias("o"), F.struct("title", "content", "url").alias("r"))
    bodies = rows.groupBy("set_id").agg(F.to_json(F.struct(F.transform(
        F.sort_array(F.collect_list(item)), lambda x: x["r"]).alias("results"))).alias("body"))
    out = S.search_batch(q, P.policies(spark), bodies, len(P.POLICY_PROFILES), max_segment_bytes=None)

    def as_set(df, cols):
        return {tuple(r[c] for c in cols) for r in df.select(*cols).collect()}

    cols = ["query_id", "status", "context", "query_used", "redactions", "decoys_sent"]
    assert as_set(out["responses"], cols) == as_set(C.search_responses(spark, SF_SMALL), cols)
    cols = ["user_id", "seq", "entry_hash", "line"]
    assert as_set(out["audit"], cols) == as_set(C.audit_chain(spark, SF_SMALL), cols)
    cols = ["query_id", "kind", "seq", "text", "offset_ms"]
    assert as_set(out["plan"], cols) == as_set(C.outbound_plan(spark, SF_SMALL), cols)
