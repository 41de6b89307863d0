import os
import tempfile
import uuid

from pyspark.sql import functions as F

from cohortlens.sources.tables import load
from cohortlens.streaming import score_stream

ROLES = {
    "attendance": "Overall_Avg_Attendance",
    "homework": "Overall_Avg_Homework",
    "participation": "Overall_Avg_Participation",
    "resources": "School_Resources_Score",
    "textbook": "Overall_Textbook_Access_Composite",
    "ratio": "Teacher_Student_Ratio",
}


def test_stream_scores_every_arriving_row(spark, sf_small):
    src = tempfile.mkdtemp(prefix="stream-src-")
    share = F.pmod(F.col("c_acctbal"), F.lit(100.0))
    prof = load(spark, sf_small, "customer").select(
        F.col("c_custkey").alias("Student_ID"),
        *[share.alias(ROLES[r]) for r in ("attendance", "homework", "participation")],
        *[(share / 100).alias(ROLES[r]) for r in ("resources", "textbook")],
        (20 + share / 2).alias(ROLES["ratio"]),
    )
    prof.write.mode("overwrite").parquet(os.path.join(src, "batch1"))
    name = f"scored_{uuid.uuid4().hex[:8]}"
    q = score_stream(spark, os.path.join(src, "batch1"), prof.schema, "Student_ID", ROLES, sink="memory", query_name=name)
    try:
        q.processAllAvailable()
        out = spark.table(name)
        assert out.count() == prof.count()
        assert out.where("predicted_score < 0 OR predicted_score > 100").count() == 0
        assert out.where("status IS NULL OR causes = '' OR recommendations = ''").count() == 0
    finally:
        q.stop()
