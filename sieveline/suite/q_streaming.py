"""Streaming sample with quotas, and the extension points."""

from pyspark.sql import functions as F

from sieveline.functions import raster as ra, registry
from sieveline.operators import calibration as c, images as im, thresholds as h
from sieveline.session import scratch_path
from sieveline.streaming.quota import Quotas, quota_sample
from sieveline.suite.q_images import H, W, planes
from sieveline.suite.q_thresholds import ACC, PREC, REC, SPEC, calibrated_sql, pick, weighted
from sieveline.suite.registry import SHARED, case


@case(
    "q_X01_streaming_quota_sample",
    """WITH x AS (SELECT id, source_label, y_true, row_number() OVER (PARTITION BY source_label ORDER BY id) AS n FROM predictions_wide),
       f AS (SELECT id, row_number() OVER (ORDER BY id) AS m FROM x WHERE y_true = 1 AND source_label IN (1, 2, 4) AND n <= 100)
       SELECT id FROM x WHERE y_true = 0 AND n <= 500
       UNION ALL SELECT id FROM f WHERE m <= 250""",
)
def _(t):
    folder = scratch_path(t.spark, "stream")
    rows = t.predictions_wide.select("id", F.when(F.col("y_true") == 0, "real").otherwise("ai_generated").alias("kind"), "source_label")
    top = rows.agg(F.max("id").alias("m")).first()["m"] + 1
    # three arrivals of two files each, one after the other
    for part in range(3):
        inside = (F.col("id") >= top * part // 3) & (F.col("id") < top * (part + 1) // 3)
        rows.where(inside).repartition(2, "id").write.mode("append").parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    quotas = Quotas(real=500, fake=250, per_source=100, wanted_sources=(1, 2, 4))
    return quota_sample(stream, f"{folder}/out", f"{folder}/state", quotas, "kind", "source_label", "id").select("id")


@case("q_Y01_feature_set_registry")
def _(t):
    if "contrast" not in im.FAMILIES:
        registry.register_family(
            "contrast", lambda df, w, h: df.withColumn("contrast", F.array_max("r") - F.array_min("r")).withColumn("r_std", ra.std(F.col("r")))
        )
    return im.feature_set(planes(t), "contrast", W, H)


SHARED["registry_scored"] = calibrated_sql("reg", "predictions", "predictions", "method", "y_true, score")


@case(
    "q_Y02_calibrator_registry",
    "SELECT method, calibrator, y_true, count(*) AS n, r9(avg(cal)) AS mean FROM registry_scored GROUP BY ALL",
)
def _(t):
    out = None
    for name in registry.names()["calibrator"]:
        done = c.calibrated(name, t.predictions, t.predictions, ["method"]).groupBy("method", "y_true").agg(
            F.count(F.lit(1)).alias("n"), F.avg("calibrated").alias("mean")
        )
        done = done.withColumn("calibrator", F.lit(name))
        out = done if out is None else out.unionByName(done)
    return out


GOALS = {
    "source_accuracy": ACC,
    "source_balanced_accuracy": f"({REC} + {SPEC}) / 2.0::DOUBLE",
    "source_f1": f"2.0::DOUBLE * {PREC} * {REC} / greatest({PREC} + {REC}, 1e-12::DOUBLE)",
    "source_utility": weighted(0.5, 0.5, 1, 1),
    "source_youden": f"{REC} + {SPEC} - 1.0::DOUBLE",
}
TIES = {"near_half": "abs(threshold - 0.5::DOUBLE)", "higher": "threshold DESC", "lower": "threshold"}


@case(
    "q_Y03_objective_registry",
    "\nUNION ALL\n".join(
        f"SELECT '{g}' AS goal, '{k}' AS tie_break, method, r9(threshold) AS threshold, r9(objective) AS objective FROM ({pick('cand_m', 'method', sql, tie)}) x{i}{n}"
        for i, (g, sql) in enumerate(GOALS.items())
        for n, (k, tie) in enumerate(TIES.items())
    ),
)
def _(t):
    from sieveline.session import cut_lineage

    counts = cut_lineage(h.candidate_counts(t.predictions, ["method"]))
    out = None
    for goal in GOALS:
        for tie in TIES:
            one = h.choose(counts, ["method"], h.objective_column(goal), tie).select(
                F.lit(goal).alias("goal"), F.lit(tie).alias("tie_break"), "method", "threshold", "objective"
            )
            out = one if out is None else out.unionByName(one)
    return out
