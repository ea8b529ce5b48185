"""The gate report: small aggregated tables as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import config_label, percent, three_digits
from ..operators import evaluation


def table(df: DataFrame) -> str:
    rows = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in df.collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def gate_report(metrics: DataFrame, n_places: int, cycles: list[str]) -> str:
    """metrics: variant (findable, strict), config, concept, n_gt, k, hit, recall, mrr."""
    find, strict = (metrics.filter(F.col("variant") == v).drop("variant") for v in ("findable", "strict"))
    shown = lambda df: df.withColumns({"hit": percent(F.col("hit")), "recall": percent(F.col("recall")), "mrr": three_digits(F.col("mrr"))})
    label = config_label(F.col("config")).alias("config")
    sizes = find.groupBy("concept").agg(F.max("n_gt").alias("n_gt"))
    held = sizes.filter("n_gt > 0")
    base = evaluation.random_baseline(held, n_places)
    random10 = base.filter("k = 10").agg(F.coalesce(F.avg("hit"), F.lit(0.0))).first()[0]
    findable = find.join(held.select("concept"), "concept", "left_semi")
    up = evaluation.roll_up(findable, ["config"], missing_as_zero=True)
    best = evaluation.best_config(find.filter("k = 1").join(_order(find), "config"), ["concept"], "mrr", "ord").orderBy("concept")
    ten = metrics.filter("k = 10").groupBy("concept").pivot("variant", ["findable", "strict"]).agg(F.max("hit")).orderBy("concept")
    gate = evaluation.gate(find, random10)
    parts = [
        f"# Retrieval report\n\n{n_places} places, cycles {', '.join(cycles)}.",
        "## A. Means over findable concepts\n\n" + table(shown(up).select(label, "k", "hit", "recall", "mrr").orderBy("config", "k")),
        "## B. Random ranking\n\n" + table(shown(base).select("concept", "k", "hit", "recall", "mrr").orderBy("concept", "k")),
        "## C. Best configuration of each concept\n\n" + table(best.select("concept", label, three_digits(F.col("mrr")).alias("mrr"))),
        "## D. Findable and strict ground truth, best hit@10\n\n" + table(ten),
        "## E. Ground truth sizes\n\n" + table(sizes.join(strict.groupBy("concept").agg(F.max("n_gt").alias("n_gt_strict")), "concept", "left").orderBy("concept")),
        "## F. Checks\n\n" + table(gate),
    ]
    return "\n\n".join(parts) + "\n"


def _order(table_: DataFrame) -> DataFrame:
    """Configs in order of their names: the first wins ties."""
    from pyspark.sql import Window

    return table_.select("config").distinct().withColumn("ord", F.row_number().over(Window.orderBy("config")))
