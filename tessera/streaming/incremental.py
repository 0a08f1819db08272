"""New data points scored as they arrive, and scores that follow the stream of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.matrix import GROUP
from tessera.operators.scoring import CELL_KEY, Oracle, finished
from tessera.sources.store import Store


def running_scores(cells: DataFrame, late: str | None = None) -> DataFrame:
    """Per hypothesis and model the count and sum of log lifts of a stream of cells; repeated cells count once.

    With ``late`` a watermark on ``scored_at`` bounds what is kept to tell repetitions by: a cell that comes again later than that counts
    again, and cells without a time are not told apart. Without it every key is kept.
    """
    once = cells.dropDuplicates(CELL_KEY) if late is None else cells.withWatermark("scored_at", late).dropDuplicatesWithinWatermark(CELL_KEY)
    return once.groupBy(*GROUP).agg(F.count("*").alias("n"), F.sum("log_lift").alias("sum_log_lift"))


def score_arrivals(points: DataFrame, store: Store, oracle: Oracle, checkpoint: str) -> StreamingQuery:
    """Start scoring a stream ``points(dp_id, text)`` against the store's hypotheses, into its cell cache.

    Each micro-batch judges the pairs that the cache lacks and merges them; as cells are keyed by content, a batch
    that is run again after a failure adds nothing.
    """

    def batch(rows: DataFrame, _: int) -> None:
        fresh = rows.where("dp_id is not null and text is not null").dropDuplicates(["dp_id"])
        hyps = store.read("hypotheses").select("hyp_id", F.col("text").alias("hyp"))
        told = fresh.select("dp_id", F.col("text").alias("dp"))
        priced = told.join(oracle.priors(told).where("status = 'ok'").select("dp_id", "prior"), "dp_id")
        # the grid of the arrivals is what is asked for: every new data point with every hypothesis
        pairs = priced.join(hyps, how="cross")
        known = store.read("lift_cache").where(F.col("model") == oracle.model).select("hyp_id", "dp_id")
        cells = finished(oracle.cells(pairs.join(known, ["hyp_id", "dp_id"], "left_anti")), oracle.model)
        store.merge("lift_cache", cells)

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
