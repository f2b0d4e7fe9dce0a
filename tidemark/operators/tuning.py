"""Search over candidates of several model families, with early dropping of the bad ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import models, report


@dataclass(frozen=True)
class Candidate:
    """A family, its parameters, and ``fit``, which takes a train table and the parameters and returns a model; ``features`` names its vector column."""

    family: str
    features: str
    fit: Callable
    parameters: dict = field(hash=False, default_factory=dict)

    @property
    def name(self) -> str:
        return ",".join([self.features, *[f"{k}={v:g}" for k, v in self.parameters.items()]])


def candidates(family: str, features: list[str], fit: Callable, **choices) -> list[Candidate]:
    """A candidate for each feature column and each combination of the parameters' choices."""
    return [Candidate(family, f, fit, dict(zip(choices, values, strict=True))) for f in features for values in product(*choices.values())]


def best_first() -> list:
    return [F.desc("macro_f1"), F.desc("pr_auc"), F.asc("brier_score"), F.asc("family"), F.asc("candidate")]


def successive_halving(
    train: DataFrame, validation: DataFrame, tried: list[Candidate], write: Callable[[DataFrame], DataFrame], factor: int = 3, rungs: int = 2, parallelism: int = 4,
) -> DataFrame:
    """One row for each candidate: family, candidate, rung, share, the validation threshold and metrics of its last fit, ``dropped`` and ``best``.

    In the first rung all candidates learn from a share of the train rows, in each further one the better ``1 / factor`` of each family from ``factor`` times as many;
    the last rung learns from all rows. The shares are nested, drawn by a hash of record_id. Fits of a rung run side by side; one
    plan judges them all on the whole validation table. The best of a family, and of all, is the last rung's by macro-F1, then average precision, Brier
    score and name. ``rungs=1`` is the full grid. ``write`` writes a table and reads it again; ``train`` and ``validation`` are written tables with record_id,
    target_resolved and the candidates' vector columns.
    """
    left, results = list(tried), []
    turn = F.pmod(F.xxhash64("record_id", F.lit(17)), F.lit(factor ** (rungs - 1)))
    for rung in range(rungs):
        share = factor**rung
        some = train.where(turn < share) if rung < rungs - 1 else train

        def fitted(c, some=some):
            model = c.fit(some.select("record_id", "target_resolved", F.col(c.features).alias("features")), **c.parameters)
            held = validation.select("record_id", "target_resolved", F.col(c.features).alias("features"))
            return models.scored_sets(model, {"validation": held}, family=c.family, candidate=c.name)

        scores = reduce(DataFrame.unionByName, models.side_by_side(fitted, left, parallelism))
        found = write(models.judged(scores, ["family", "candidate"]).drop("split").withColumns({
            "rung": F.lit(rung + 1), "share": F.lit(share / factor ** (rungs - 1)),
        }))
        if rung == rungs - 1:
            results.append(found.withColumn("dropped", F.lit(False)))
            break
        sizes = {f: sum(c.family == f for c in left) for f in {c.family for c in left}}
        keep = {r["family"]: r["names"][: max(1, -(-sizes[r["family"]] // factor))] for r in _in_order(found).collect()}  # the names of the candidates
        stays = reduce(lambda a, b: a | b, [(F.col("family") == f) & F.col("candidate").isin(*names) for f, names in keep.items()])
        results.append(found.where(~stays).withColumn("dropped", F.lit(True)))
        left = [c for c in left if c.name in keep[c.family]]
    table = write(report.union_padded(results))
    first = report.best_by(table.where("NOT dropped"), ["family"], best_first()).select("family", "candidate", F.lit(True).alias("best_of_family"))
    top = report.best_by(table.where("NOT dropped").withColumn("all_", F.lit(1)), ["all_"], best_first())
    chosen = first.join(top.select("family", "candidate", F.lit(True).alias("best")), ["family", "candidate"], "left")
    return table.join(F.broadcast(chosen), ["family", "candidate"], "left").fillna(False, ["best_of_family", "best"])  # a row for each family


def _in_order(found: DataFrame) -> DataFrame:
    """family, names: the candidates' names, the best first."""
    key = F.struct((-F.col("macro_f1")).alias("a"), (-F.col("pr_auc")).alias("b"), F.col("brier_score").alias("c"), F.col("candidate").alias("name"))
    return found.groupBy("family").agg(F.sort_array(F.collect_list(key)).alias("x")).select("family", F.col("x.name").alias("names"))
