"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import discard, new_folder, written


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node in ``edges``.

    ``edges`` has two columns of one type, in either direction, repeats allowed;
    an edge with a null end links nothing. Each round gives a node the smallest
    label next to it and then the label of that label, so labels travel twice as
    far each round: rounds grow with the logarithm of the longest path. Labels
    are written after each half round, so a lost executor costs half a round,
    and both sides of each join are plain exchanges that adaptive execution may
    split where a hub holds many edges. Nothing but a count reaches the driver.
    """
    spark = edges.sparkSession
    folder = new_folder(spark, "components")
    given = written(edges.toDF("src", "dst"), f"{folder}/given")
    pairs = given.where("src != dst")
    turned = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    links = written(pairs.unionByName(turned).distinct(), f"{folder}/links")

    odd = given.where("src IS NULL OR dst IS NULL OR src = dst")
    loops = odd.select(F.explode(F.array("src", "dst")).alias("node")).where("node IS NOT NULL")
    alone = loops.select("node", F.col("node").alias("label"))
    first = links.select(F.col("src").alias("node"), F.least("src", "dst").alias("label"))
    labels = written(
        first.unionByName(alone).groupBy("node").agg(F.min("label").alias("label")),
        f"{folder}/labels-0",
    )
    discard(spark, f"{folder}/given")
    round_ = 0
    while True:
        round_ += 1
        near = (
            links.join(labels, links["dst"] == labels["node"])
            .groupBy("src")
            .agg(F.min("label").alias("near"))
        )
        hooked = written(
            labels.join(near, labels["node"] == near["src"], "left").select(
                "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
            ),
            f"{folder}/hooked-{round_}",
        )
        target = hooked.select(F.col("node").alias("via"), F.col("label").alias("jumped"))
        jumped = written(
            hooked.join(target, hooked["label"] == target["via"]).select("node", "old", F.col("jumped").alias("label")),
            f"{folder}/labels-{round_}",
        )
        changed = jumped.where("label != old").limit(1).count()
        discard(spark, f"{folder}/labels-{round_ - 1}")
        discard(spark, f"{folder}/hooked-{round_}")
        labels = jumped.select("node", "label")
        if not changed:
            discard(spark, f"{folder}/links")
            return labels.select("node", F.col("label").alias("component"))
