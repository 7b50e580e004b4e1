"""A Merkle manifest of a table, built by nested-struct rollup.

Leaves are ranked in their group, and the digits of the rank to the base of the fan-out are columns. They
are grouped away one after the other: each grouping collects a run of nodes into one struct with their
hash, so the structs of children nest in that of their parent, up to a block of a bounded number of
leaves. Blocks are the nodes of the next tier, which is rolled up alike, until one node is left; groups'
last nodes are ranked and rolled up once more, to the root. On the way back a block and what lies
above it meet by grouping, and transform and explode turn the nested structs into one proof a leaf:
no leaf is ever joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.llm.ranking import numbered, with_row
from scholion.session import persist_shared

FAN_OUT = 8
BITS = 3
DIGITS = 3
BLOCK_BITS = BITS * DIGITS

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(**changed: Column) -> Column:
    """sha256 of the fields of a row of documents; a changed field stands for the column."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _height() -> Column:
    """Levels of a tree of n leaves: the digits of n - 1, none for a single leaf."""
    return F.when(F.col("n") > 1, F.length(F.conv(F.col("n") - 1, 10, FAN_OUT))).otherwise(0)


def _hash_of(kids: Column, level: int) -> Column:
    joined = F.sha2(F.array_join(F.transform(kids, lambda k: k["hash"]), ""), 256)
    return F.when(F.col("height") > level, joined).otherwise(F.get(kids, F.lit(0))["hash"])


def roll_up(nodes: DataFrame, level: int) -> DataFrame:
    """group, height, block, hash, kids: DIGITS levels of nodes (group, height, rank, hash, inner).

    A task holds whole blocks of at most FAN_OUT ** DIGITS nodes; the digits are grouped away within it,
    so that rows are shuffled once. Above a tree's height the single node passes through.
    """
    digits = [f"d{k}" for k in range(DIGITS)]
    rows = nodes.select(
        "group",
        "height",
        F.shiftright("rank", BLOCK_BITS).alias("block"),
        *[F.shiftright("rank", BITS * k).bitwiseAND(FAN_OUT - 1).cast("int").alias(d) for k, d in enumerate(digits)],
        "hash",
        "inner",
    ).repartition("group", "block")
    content = ["hash", "inner"]
    for k, digit in enumerate(digits):
        kids = F.sort_array(F.collect_list(F.struct(F.col(digit).alias("at"), *content)))
        rows = (
            rows.groupBy("group", "height", "block", *digits[k + 1 :])
            .agg(kids.alias("kids"))
            .withColumn("hash", _hash_of(F.col("kids"), level + k))
        )
        content = ["hash", "kids"]
    return rows


def _beside(kids: Column, at: Column, level: int) -> Column:
    """What stands before and after a run's node, as an array of one (before, after), or of none."""
    hashes = F.transform(kids, lambda k: k["hash"])
    pair = F.struct(
        F.array_join(F.slice(hashes, F.lit(1), at), "").alias("before"),
        F.array_join(F.slice(hashes, at + 2, F.lit(FAN_OUT)), "").alias("after"),
    )
    return F.when(F.col("height") > level, F.array(pair)).otherwise(F.slice(F.array(pair), F.lit(1), F.lit(0)))


def hand_down(blocks: DataFrame, above: DataFrame, level: int) -> DataFrame:
    """group, inner, hash, path, top of each node under blocks, given those of the blocks themselves.

    above holds group, block, path and top. A block and its path meet by grouping.
    """
    empty = lambda name, frame: F.lit(None).cast(frame.schema[name].dataType).alias(name)
    met = (
        blocks.select("group", "block", "height", "kids", empty("path", above), empty("top", above))
        .unionByName(
            above.select("group", "block", empty("height", blocks), empty("kids", blocks), "path", "top")
        )
        .groupBy("group", "block")
        .agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("height", "kids", "path", "top")])
    )

    def under(kids: Column, k: int, path: Column) -> Column:
        def one(node: Column, at: Column) -> Column:
            here = F.concat(_beside(kids, at, level + k), path)
            if k:
                return under(node["kids"], k - 1, here)
            return F.struct(node["inner"].alias("inner"), node["hash"].alias("hash"), here.alias("path"))

        found = F.transform(kids, one)
        return F.flatten(found) if k else found

    proofs = F.explode(under(F.col("kids"), DIGITS - 1, F.col("path"))).alias("p")
    return met.select("group", "top", proofs).select("group", "p.inner", "p.hash", "p.path", "top")


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    tiers = [persist_shared(roll_up(nodes, 0), "merkle-blocks")]
    while (tiers[-1].agg(F.max("block")).first()[0] or 0) > 0:
        above = tiers[-1].select(
            "group", "height", F.col("block").alias("rank"), "hash", F.col("block").alias("inner")
        )
        tiers.append(persist_shared(roll_up(above, DIGITS * len(tiers)), "merkle-blocks"))
    return tiers


def _proofs(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    for k in reversed(range(len(tiers))):
        found = hand_down(tiers[k], above, DIGITS * k)
        above = found.withColumnRenamed("inner", "block") if k else found
    return above


NO_PATH = "array<struct<before:string,after:string>>"


def manifest(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, carried, group, subroot, root, path of each row of leaves (group, doc_id, leaf, carried).

    A group's leaves ascend by doc_id (null first, ties by leaf hash); while several nodes are left, each
    run of FAN_OUT neighbours becomes the hash of theirs, a last run of one included. What is left is the
    group's subroot; subroots, by group (null first, bytewise), are rolled up likewise to the root. path
    is one (before, after) for each level, from the leaf to the root: the digests of the run's other
    nodes, concatenated. carried is any bounded value that goes with a leaf. Repeated rows are leaves of
    their own. An empty table gives an empty result. A group, however large, is spread over blocks.
    """
    stored = with_row(leaves.select("group", "doc_id", "leaf", "carried"), "merkle-leaves")
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    ranked = numbered(stored, order, within=("group",), label="merkle-ranks")
    inner = F.struct("doc_id", "carried").alias("inner")
    trees = _tiers(ranked.select("group", _height().alias("height"), "rank", F.col("leaf").alias("hash"), inner))
    subroots = with_row(trees[-1].select("group", "hash"), "merkle-subroots")
    named = numbered(subroots, [F.col("group").asc_nulls_first()], label="merkle-subroots").select(
        F.lit(0).alias("group"),
        _height().alias("height"),
        "rank",
        "hash",
        F.struct("group", F.col("hash").alias("subroot")).alias("inner"),
    )
    trunk = _tiers(named)
    root = trunk[-1].select("group", "block", F.array().cast(NO_PATH).alias("path"), F.col("hash").alias("top"))
    tops = _proofs(trunk, root).select(
        F.col("inner.group").alias("group"),
        F.lit(0).cast("bigint").alias("block"),
        "path",
        F.struct("inner.subroot", F.col("top").alias("root")).alias("top"),
    )
    return _proofs(trees, tops).select(
        "inner.doc_id", F.col("hash").alias("leaf"), "inner.carried", "group", "top.subroot", "top.root", "path"
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda own, p: F.sha2(F.concat(p["before"], own, p["after"]), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of a path's siblings, from the leaf's run to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of documents.

    Every third row by the CRC-32 of its doc_id is tampered with: A-Z in its text become a-z. Its root is
    folded anew from the tampered leaf and the original siblings. A row without a doc_id, without a text
    or without such letters stays as it is. Documents are grouped by lang, null being a group.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(chosen & F.col("text").isNotNull(), leaf_hash(text=F.translate("text", UPPER, LOWER)))
    leaves = docs.select(F.col("lang").alias("group"), "doc_id", leaf_hash().alias("leaf"), tampered.alias("carried"))
    return (
        manifest(leaves)
        .withColumn("proof_sha256", proof_digest(F.col("path")))
        .withColumn("folded_root", folded(F.coalesce("carried", "leaf"), F.col("path")))
        .select(
            "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"),
        )
    )
