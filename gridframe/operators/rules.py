"""Drawn paths to rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How thin and how long a rule is, and how far apart its pieces may lie along and across.
THIN, LONG, ALIGNED, JOIN_ACROSS = 2.5, 12.0, 2.5, 80.0


def transform_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes (min_x, max_x, min_y, max_y) through an affine map (a, b, c, d, e, f); without a finite one, none."""
    corners = [(x, y) for x in ("min_x", "max_x") for y in ("min_y", "max_y")]
    xs = [F.col("a") * F.col(x) + F.col("c") * F.col(y) + F.col("e") for x, y in corners]
    ys = [F.col("b") * F.col(x) + F.col("d") * F.col(y) + F.col("f") for x, y in corners]
    names = [c for c in boxes.columns if c not in {"a", "b", "c", "d", "e", "f", "min_x", "max_x", "min_y", "max_y"}]
    out = boxes.select(*names, F.least(*xs).alias("min_x"), F.greatest(*xs).alias("max_x"), F.least(*ys).alias("min_y"), F.greatest(*ys).alias("max_y"))
    return out.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('Infinity')" for c in ("min_x", "max_x", "min_y", "max_y")))


def classify_paths(paths: DataFrame) -> DataFrame:
    """Flat wide boxes are horizontal rules, narrow tall ones vertical; others are no rules."""
    width, height = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    kind = F.when((height <= THIN) & (width >= LONG), F.lit("H")).when((width <= THIN) & (height >= LONG), F.lit("V"))
    h = kind == "H"
    return paths.withColumn("orient", kind).where("orient is not null").select(
        "doc_id", "page", "path_ix", "orient",
        F.when(h, (F.col("min_y") + F.col("max_y")) / 2).otherwise((F.col("min_x") + F.col("max_x")) / 2).alias("pos"),
        F.when(h, F.col("min_x")).otherwise(F.col("min_y")).alias("lo"), F.when(h, F.col("max_x")).otherwise(F.col("max_y")).alias("hi"),
    )


def merge_rules(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Collinear pieces become one rule: in order of (pos, lo) a piece goes on the last rule if it lies within 2.5
    of that rule's first piece and starts at most 80 beyond its end.
    """
    rows = pieces.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "hi"))).alias("ps"))
    kind = "array<struct<pos:double,lo:double,hi:double,pieces:int>>"

    def step(out: Column, p: Column) -> Column:
        last = F.element_at(out, -1)
        on = (F.abs(last["pos"] - p["pos"]) <= ALIGNED) & (p["lo"] <= last["hi"] + JOIN_ACROSS)
        new = F.struct(p["pos"].alias("pos"), p["lo"].alias("lo"), p["hi"].alias("hi"), F.lit(1).alias("pieces"))
        grown = F.struct(last["pos"].alias("pos"), F.least(last["lo"], p["lo"]).alias("lo"), F.greatest(last["hi"], p["hi"]).alias("hi"), (last["pieces"] + 1).alias("pieces"))
        return F.when(F.size(out) == 0, F.array(new)).when(on, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(out, F.array(new)))

    return rows.select(*keys, F.posexplode(F.aggregate("ps", F.array().cast(kind), step)).alias("rule_ix", "r")).select(*keys, "rule_ix", "r.*")
