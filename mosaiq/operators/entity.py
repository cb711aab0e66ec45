"""Entity resolution: alias dimensions, staged joins, fuzzy top two."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.texts import SCORES
from mosaiq.operators.ranks import first_per_key


def alias_index(dimension: DataFrame, ident: str, aliases: str, key, last_wins: bool = False) -> DataFrame:
    """(alias, id): exploded aliases by normalised key. Of entries that share a key the first wins, or the last.
    dimension: ident, aliases (array), ordinal."""
    rows = dimension.select(F.col(ident).alias("id"), "ordinal", F.posexplode(aliases).alias("pos", "raw")).withColumn("alias", key(F.col("raw"))).where("alias <> ''")
    order = [F.desc("ordinal"), F.desc("pos")] if last_wins else [F.asc("ordinal"), F.asc("pos")]
    return first_per_key(rows, ["alias"], order).select("alias", "id")


def staged(df: DataFrame, stages: list[tuple[str, object, DataFrame, float]]) -> DataFrame:
    """Left joins in order of trust; the first stage that knows a row's key gives id, mode and confidence.
    stages: (mode, key column, index of (alias, id), confidence)."""
    found, out = [], df
    for k, (mode, key, index, confidence) in enumerate(stages):
        side = index.select(F.col("alias").alias(f"_a{k}"), F.col("id").alias(f"_i{k}"))
        out = out.withColumn(f"_k{k}", key).join(side, F.col(f"_k{k}") == F.col(f"_a{k}"), "left")
        found.append((mode, confidence))
    ident = F.coalesce(*[f"_i{k}" for k in range(len(stages))])
    mode = F.coalesce(*[F.when(F.col(f"_i{k}").isNotNull(), F.lit(m)) for k, (m, _) in enumerate(found)])
    conf = F.coalesce(*[F.when(F.col(f"_i{k}").isNotNull(), F.lit(c)) for k, (_, c) in enumerate(found)], F.lit(0.0))
    return out.select(*df.columns, ident.alias("id"), mode.alias("mode"), conf.alias("confidence"))


#: Aliases of a dimension that every title is compared with, at most.
MOST_ALIASES = 20_000


def fuzzy_best(df: DataFrame, key: str, dimension: DataFrame, threshold: float, margin: float, score: str = "sequence") -> DataFrame:
    """key, id, score of the best alias if it reaches the threshold and beats the second by the margin. score: a rule of SCORES.

    Each distinct key is compared with all aliases, which tasks hold as a list after a check of their number, so neither the
    best nor the runner-up is missed. An alias is left out only if its length alone keeps it below the second best so far.
    dimension: alias, id. Null and empty keys and aliases have no answer; without a second alias the margin is the score.
    """
    entries = sorted({(r.alias, r.id) for r in dimension.where("alias <> ''").select("alias", "id").limit(MOST_ALIASES + 1).collect()})
    if len(entries) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    make, bound = SCORES[score]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compare = [(alias, ident, make(alias)) for alias, ident in entries]
        for pdf in batches:
            out = []
            for text in pdf[key]:
                top: list[tuple] = []
                for alias, ident, scored in sorted(compare, key=lambda x: -bound(len(text), len(x[0]))):
                    if len(top) == 2 and bound(len(text), len(alias)) < top[1][0]:
                        break
                    top = sorted([*top, (scored(text), alias, ident)], key=lambda x: (-x[0], x[1]))[:2]
                if top and top[0][0] >= threshold and top[0][0] - (top[1][0] if len(top) > 1 else 0.0) >= margin:
                    out.append((text, top[0][2], top[0][0]))
            yield pd.DataFrame(out, columns=[key, "id", "score"])

    kind = dimension.schema["id"].dataType.simpleString()
    return df.where(F.coalesce(key, F.lit("")) != "").select(key).distinct().mapInPandas(run, f"{key} string, id {kind}, score double")
