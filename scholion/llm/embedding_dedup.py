"""Embedding near-duplicates by randomly rotated binary codes with correction factors.

A unit vector o is rotated at random and kept as the signs of its coordinates, x, together with the
factor f = <x, o> / sqrt(D). For a second rotated unit vector q, <x, q> / (sqrt(D) f) estimates
<o, q> without bias, and its error stays below e * sqrt((1 - f^2) / (f^2 (D - 1))) but for a
probability that falls as exp(-e^2 / 2). A pair whose upper bound is under the threshold is dropped;
all others are recomputed from the stored vectors in double precision, so no link rests on an
estimate.

Vectors with one label meet in pairs of blocks of bounded size. Blocks hold vectors with the same
nearest pivot, and a pair of blocks is skipped when for some pivot the ranges of angles are further
apart than the threshold's angle. Equal vectors are one class with a count before any pair is looked
at, and a block pair returns link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion.llm.components import components
from scholion.session import persist_shared

BLOCK_ROWS = 3000
PIVOTS = 32
SIGMAS = 6.0
SEED = 20


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction factor of each row of unit vectors."""
    turned = unit @ rotation(unit.shape[1])
    factor = np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])
    return np.packbits(turned >= 0, axis=1), factor


def decode(bits: np.ndarray, dim: int) -> np.ndarray:
    """The code's signs as +1 and -1."""
    return np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1


def may_reach(
    signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, threshold: float, sigmas: float = SIGMAS
) -> np.ndarray:
    """Pairs (row of codes, row of rotated vectors) whose upper bound reaches the threshold."""
    dim = signs.shape[1]
    estimate = (signs @ turned.T) / (math.sqrt(dim) * factor[:, None]).astype(np.float32)
    slack = sigmas * np.sqrt(np.maximum(1 - factor**2, 0) / (factor**2 * max(dim - 1, 1))) + 1e-5
    return estimate >= (threshold - slack)[:, None]


def _usable(vec: str, label: str):
    """True for the vectors that can link at all."""
    v = F.col(f"`{vec}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    nonzero = F.exists(v, lambda x: x != 0)
    ok = F.col(f"`{label}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & nonzero
    return F.coalesce(ok, F.lit(False))


def _units(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    # Scaling by the largest component first keeps very large and very small vectors finite.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add code, factor, the nearest pivot and the angles to all pivots."""
    added = T.StructType.fromDDL("code binary, factor double, cell int, angles array<float>")
    schema = T.StructType([*classes.schema.fields, *added.fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                unit = _units(part["vec"])
                bits, factor = encode(unit)
                angles = np.arccos(np.clip(unit @ pivots[dim].T, -1, 1))
                yield part.assign(
                    code=[b.tobytes() for b in bits],
                    factor=factor,
                    cell=angles.argmin(axis=1),
                    angles=list(angles.astype(np.float32)),
                )

    return classes.mapInPandas(run, schema)


def _pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """A few vectors of each length, chosen by the hash of their id, as unit vectors."""
    found = {}
    for dim in sorted(r["dim"] for r in classes.select("dim").distinct().collect()):
        seen = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("rep"), "rep").limit(PIVOTS)
        found[dim] = _units(seen.select("vec").toPandas()["vec"])
    return found


def _blocks(coded: DataFrame, block_rows: int) -> DataFrame:
    """For each cell the block it starts in and the number of blocks it is dealt over.

    Small cells share a block: the sizes of a label's cells, summed up in the cells' order, are cut
    at multiples of block_rows. A label has at most PIVOTS cells.
    """
    cells = coded.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("label", "dim").orderBy("cell"))
    large = F.col("n") > block_rows
    return cells.select(
        "label",
        "dim",
        "cell",
        F.when(large, F.concat(F.lit("c"), "cell"))
        .otherwise(F.concat(F.lit("s"), (upto / block_rows).cast("int")))
        .alias("first"),
        F.when(large, F.ceil(F.col("n") / block_rows)).otherwise(1).alias("parts"),
    )


def _near_blocks(dealt: DataFrame, reach: float) -> DataFrame:
    """Pairs of one label's blocks, block <= other, whose angles to every pivot come within reach."""
    ranges = persist_shared(
        dealt.select("label", "dim", "block", F.posexplode("angles").alias("p", "angle"))
        .groupBy("label", "dim", "block", "p")
        .agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"))
        .groupBy("label", "dim", "block")
        .agg(F.sort_array(F.collect_list(F.struct("p", "lo", "hi"))).alias("ranges")),
        "blocks",
    )
    others = ranges.select("label", "dim", F.col("block").alias("other"), F.col("ranges").alias("theirs"))
    apart = F.exists(
        F.zip_with(
            "ranges",
            "theirs",
            lambda x, y: (x["lo"] > y["hi"] + reach) | (y["lo"] > x["hi"] + reach),
        ),
        lambda far: far,
    )
    return (
        ranges.join(others, ["label", "dim"])
        .where((F.col("block") <= F.col("other")) & ~apart)
        .select("label", "dim", "block", "other")
    )


def _block_pair(threshold: float):
    """Link counts and a spanning forest of one pair of blocks (or of one block with itself)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "rep"], ignore_index=True)
        dim = int(frame["dim"].iat[0])
        unit = _units(frame["vec"])
        rep, copies = frame["rep"].to_numpy(), frame["copies"].to_numpy()
        bits = np.stack([np.frombuffer(c, dtype=np.uint8) for c in frame["code"]])
        signs, factor = decode(bits, dim), frame["factor"].to_numpy()
        turned = (unit @ rotation(dim)).astype(np.float32)
        second = frame["side"].to_numpy() == 1
        rows, cols = (np.flatnonzero(~second), np.flatnonzero(second))
        itself = not second.any()
        if itself:
            cols = rows
        links = np.zeros(len(frame), dtype=np.int64)
        root = np.arange(len(frame))
        for at in range(0, len(rows), 256):
            mine = rows[at : at + 256]
            near = may_reach(signs[mine], factor[mine], turned[cols], threshold)
            mine, theirs = mine[near.any(axis=1)], cols[near.any(axis=0)]
            if not len(mine):
                continue
            linked = unit[mine] @ unit[theirs].T >= threshold
            if itself:
                linked &= mine[:, None] != theirs[None, :]
            links[mine] += linked @ copies[theirs]
            if not itself:
                links[theirs] += linked.T @ copies[mine]
            for i, row in zip(mine, linked, strict=True):
                met = np.unique(np.append(root[theirs[row]], root[i]))
                if len(met) > 1:
                    root[np.isin(root, met)] = met[0]
        found = (links > 0) | (root != np.arange(len(frame)))
        out = pd.DataFrame({"rep": rep, "n_links": links, "hub": rep[root]})
        return out[found]

    return run


def link_embeddings(
    vectors: DataFrame,
    threshold: float = 0.93,
    ids: str = "vec_id",
    vec: str = "embedding",
    label: str = "label",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """ids, n_links, component_id and kept of every row.

    Rows link when their labels are equal and their cosine is at least threshold. A vector that is
    null, empty, zero or holds a null or non-finite component, a null label or id, or another length than
    its partner links with nothing and stays alone. Repeated ids keep their rows; equal vectors are
    linked with each other. An empty table gives an empty result; other columns are ignored.
    """
    usable = _usable(vec, label) & F.col(f"`{ids}`").isNotNull()
    fit = vectors.where(usable).select(
        F.col(f"`{ids}`").alias("id"),
        F.col(f"`{label}`").alias("label"),
        F.col(f"`{vec}`").alias("vec"),
        F.size(f"`{vec}`").alias("dim"),
    )
    classes = persist_shared(
        fit.groupBy("label", "dim", "vec").agg(
            F.min("id").alias("rep"), F.count("*").alias("copies")
        ),
        "vectors",
    )
    coded = persist_shared(_coded(classes, _pivots(classes)), "vectors")
    dealt = coded.join(_blocks(coded, block_rows), ["label", "dim", "cell"]).withColumn(
        "block",
        F.concat_ws("-", "first", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts"))),
    )
    pairs = persist_shared(_near_blocks(dealt, math.acos(threshold) + 1e-4), "blocks")
    sides = pairs.select("label", "dim", "block", "other", F.lit(0).alias("side"), F.col("block").alias("at"))
    sides = sides.unionByName(
        pairs.where("block != other").select(
            "label", "dim", "block", "other", F.lit(1).alias("side"), F.col("other").alias("at")
        )
    )
    rows = dealt.select("label", "dim", F.col("block").alias("at"), "rep", "copies", "vec", "code", "factor")
    found = persist_shared(
        rows.join(sides, ["label", "dim", "at"])
        .groupBy("label", "dim", "block", "other")
        .applyInPandas(_block_pair(threshold), "rep bigint, n_links bigint, hub bigint"),
        "links",
    )
    groups = components(found.select(F.col("rep").alias("u"), F.col("hub").alias("v")))
    per_class = (
        classes.join(found.groupBy("rep").agg(F.sum("n_links").alias("links")), "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "dim", "vec", "rep", "copies", "links", "component_id")
    )
    members = fit.join(per_class, ["label", "dim", "vec"]).select(
        "id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "rep").alias("component_id"),
    )
    alone = vectors.where(~usable).select(
        F.col(f"`{ids}`").alias("id"),
        F.lit(0).cast("bigint").alias("n_links"),
        F.col(f"`{ids}`").alias("component_id"),
    )
    return members.unionByName(alone).select(
        F.col("id").alias(ids),
        "n_links",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
