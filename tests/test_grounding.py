"""Grounding in turns before equals grounding in their copies."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.functions import grounding

COLUMNS = ("n_claims", "n_supported", "n_unsupported", "n_citations", "uncited", "faithfulness", "hallucination_rate", "mean_relevance", "max_relevance")


def test_turns_and_copied_contexts_agree(spark):
    rng = np.random.default_rng(18)
    words = [*"abcdefgh", "the", "!", ".", ""]
    text = lambda: None if rng.random() < 0.05 else " ".join(rng.choice(words, int(rng.integers(0, 12)))) + rng.choice([".", "! x y", ""])
    rows = [(c, 3 * t + 1, str(rng.choice(["user", "assistant"])), text()) for c, n in ((0, 1), (1, 2), (2, 60), (3, 9), (4, 15)) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(3)
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    copied = turns.withColumns({"contexts": F.collect_list(F.coalesce("text", F.lit(""))).over(so_far), "question": F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))})
    cited = F.slice(F.array((F.col("turn") % 7).cast("int"), F.lit(0), F.lit(2), F.lit(99)), 1, (F.col("turn") % 5).cast("int"))
    answers = copied.filter("role = 'assistant'").withColumn("citations", F.when(F.col("turn") % 11 != 0, cited)).withColumn("answer", F.col("text"))
    for least in (0.15, 0.6, 0.0):
        want = {(r.conv_id, r.turn): [r[c] for c in COLUMNS] for r in grounding.grounding(answers, least).collect()}
        found = grounding.grounding_by_turn(turns, answers.drop("contexts", "text"), least)
        got = {(r.conv_id, r.turn): [r[c] for c in COLUMNS] for r in found.collect()}
        assert set(got) == set(want) and len(want) > 30
        for k, values in want.items():
            assert got[k][:5] == values[:5] and np.allclose(got[k][5:], values[5:], atol=1e-12), (k, got[k], values)
