"""Merkle manifest of a dataset: nested structs rolled up by the digits of a rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

FAN = 8
DIGITS = 3            # digits that are rolled up inside a block
BLOCK = FAN ** DIGITS


def digest(value: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(value.cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value with its UTF-8 byte count before it, so that no two rows run together; null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return digest(F.concat(*map(framed, values)))


def _ranked(rows: DataFrame, part: str, *order: str) -> DataFrame:
    """Rows with their ``rank`` from 0 and the number ``n`` of rows within ``part``, nulls a part of
    their own. Ranges of (part, order) are sorted apart, however large a part is; only the counts of
    (range, part) are offset in one place. Rows equal in all are parted by their place in the input."""
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [part, *order, "_place"]
    ranged = rows.withColumn("_place", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(wanted, *keys).sortWithinPartitions(*keys).drop("_place")
    ranged = stored(ranged.select(
        "*", F.spark_partition_id().alias("_range"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_in")))
    runs = ranged.groupBy("_range", part).agg(F.count("*").alias("_n"), F.min("_in").alias("_first"))
    whole = Window.partitionBy(part)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "_range", F.col(part).alias("_part"), F.sum("_n").over(whole).alias("n"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    on = (F.col("r._range") == F.col("s._range")) & F.col(part).eqNullSafe(F.col("_part"))
    return ranged.alias("r").join(runs.alias("s"), on).withColumn("rank", F.col("_start") + F.col("_in")).drop(
        "_range", "_part", "_start", "_in")


def _height(n: Column) -> Column:
    """Levels above n nodes inside a block: none above one node, ``DIGITS`` at most."""
    height = F.lit(0)
    for k in range(DIGITS):
        height = height + F.when(n > FAN ** k, 1).otherwise(0)
    return height


def _blocks(nodes: DataFrame, part: str) -> DataFrame:
    """(part, block, n, hash, tree) from nodes (part, rank, n, hash, data).

    Within a block the digits of the rank are grouped away one after the other, the last first: a
    level's structs become the sorted children of the struct above. One exchange by (part, block)
    serves all levels, and a block holds ``BLOCK`` nodes at most.
    """
    digits = [F.pmod(F.floor(F.col("rank") / F.lit(FAN ** k)), F.lit(FAN)).cast("int").alias(f"d{k}") for k in range(DIGITS)]
    rows = nodes.select(
        part, F.floor(F.col("rank") / F.lit(BLOCK)).cast("long").alias("block"), *digits, "n",
        _height(F.col("n")).alias("height"), "hash", F.col("data").alias("below"))
    for k in range(DIGITS):
        rest = [f"d{j}" for j in range(k + 1, DIGITS)]
        rows = rows.groupBy(part, "block", "n", "height", *rest).agg(
            F.sort_array(F.collect_list(F.struct(f"d{k}", "hash", "below"))).alias("below"))
        hashes = F.transform("below", lambda c: c["hash"])
        rows = rows.withColumn(
            "hash", F.when(F.col("height") > k, digest(F.array_join(hashes, ""))).otherwise(hashes[0]))
    return rows.select(part, "block", "n", "height", "hash", F.col("below").alias("tree"))


def _proofs(children: Column, height: Column, level: int) -> Column:
    """Array of (data, hash, proof) of the leaves of a tree, proofs from the lowest level upward."""
    def joined(array: Column, start, length) -> Column:
        return F.array_join(F.transform(F.slice(array, start, length), lambda c: c["hash"]), "")

    def step(i: Column) -> Column:
        sides = F.struct(
            joined(children, F.lit(1), i).alias("left"), joined(children, i + 2, F.lit(FAN)).alias("right"))
        return F.when(height > level, F.array(sides)).otherwise(F.array().cast("array<struct<left:string,right:string>>"))

    if level == 0:
        return F.transform(children, lambda c, i: F.struct(c["below"].alias("data"), c["hash"].alias("hash"), step(i).alias("proof")))
    return F.flatten(F.transform(children, lambda c, i: F.transform(
        _proofs(c["below"], height, level - 1),
        lambda leaf: F.struct(leaf["data"].alias("data"), leaf["hash"].alias("hash"), F.concat(leaf["proof"], step(i)).alias("proof")))))


def _tiers(nodes: DataFrame, part: str) -> list[DataFrame]:
    """Tables of blocks from the nodes up to those that end in one block for every part."""
    tiers, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while not tiers or most > 1:
        tiers.append(stored(_blocks(nodes, part)))
        size = F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")
        nodes = tiers[-1].select(part, F.col("block").alias("rank"), size.alias("n"), "hash", F.lit(None).alias("data"))
        most = -(-most // BLOCK)
    return tiers


def _descended(tiers: list[DataFrame], tops: DataFrame, part: str) -> DataFrame:
    """(part, rank, data, hash, subroot, root, proof) of all lowest nodes, from ``tops`` (part, subroot, root, proof).

    A block and the proof above it meet by grouping, then the block's tree is transformed and exploded.
    """
    above = tops.select(part, F.lit(0).cast("long").alias("block"), "subroot", "root", "proof")
    for tier in reversed(tiers):
        trees = tier.select(part, "block", "height", "tree")
        met = trees.unionByName(above, allowMissingColumns=True).groupBy(part, "block").agg(
            *(F.first(c, ignorenulls=True).alias(c) for c in ("height", "tree", "subroot", "root", "proof")))
        leaves = _proofs(F.col("tree"), F.col("height"), DIGITS - 1)
        met = met.select(part, "block", "subroot", "root", F.col("proof").alias("above"), F.posexplode(leaves).alias("at", "leaf"))
        rank = F.col("block") * BLOCK + F.col("at")  # blocks before the last are full
        above = met.select(
            part, rank.alias("block"), "leaf.data", "leaf.hash", "subroot", "root",
            F.concat("leaf.proof", "above").alias("proof"))
    return above.withColumnRenamed("block", "rank")


def manifest(
    docs: DataFrame, leaf: Column, part: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: (order, carried columns, leaf, subroot, root, proof).

    ``leaf`` is the hash of a row. In every ``part`` leaves ascend by ``order``, runs of ``FAN`` become
    the digest of their joined hashes until one is left, the subroot (a lone leaf is its own); the
    subroots in the order of their parts are joined likewise to the root. ``proof`` has an entry for each
    level from the leaf to the root: the joined hashes of the siblings to the ``left`` and to the ``right``,
    both empty in a run of one. ``folded(leaf, proof)`` gives the root back.

    Null parts are a part of their own and come first, null order comes first, rows equal in it are
    ordered by leaf. Repeated rows are leaves of their own. An empty table gives no rows. Only the
    columns named are read, and only hashes, ``order`` and carried columns are moved.
    """
    carry = carry or {}
    names = [f"c{k}" for k in range(len(carry))]
    rows = stored(docs.select(
        F.col(part).cast("string").alias("part"), F.col(order).alias("id"), leaf.alias("hash"),
        *(c.alias(n) for n, c in zip(names, carry.values()))))
    rows = _ranked(rows, "part", "id", "hash")
    nodes = rows.select("part", "rank", "n", "hash", F.struct("id", *names).alias("data"))
    tiers = _tiers(nodes, "part")
    subroots = tiers[-1].select("part", "hash", F.lit(0).alias("all"))
    subroots = _ranked(subroots, "all", "part", "hash").select("all", "rank", "n", "hash", F.struct("part").alias("data"))
    upper = _tiers(subroots, "all")
    top = upper[-1].select(
        "all", F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"),
        F.array().cast("array<struct<left:string,right:string>>").alias("proof"))
    tops = _descended(upper, top, "all").select("data.part", F.col("hash").alias("subroot"), "root", "proof")
    found = _descended(tiers, tops, "part")
    return found.select(
        F.col("data.id").alias(order), *(F.col(f"data.{n}").alias(c) for n, c in zip(names, carry)),
        F.col("hash").alias("leaf"), "subroot", "root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof lead to."""
    return F.aggregate(proof, leaf, lambda hash_, step: digest(F.concat(step["left"], hash_, step["right"])))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, from left to right."""
    return digest(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""))


def lower_ascii(text: Column) -> Column:
    """A text with A-Z in lower case and all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def tamper_proofs(docs: DataFrame, tampered: Column, fields: tuple[str, ...], text: str = "text",
                  part: str = "lang", order: str = "doc_id") -> DataFrame:
    """The manifest of ``docs`` checked against rows of which some have been changed.

    (order, leaf, subroot, root, proof_sha256, folded_root, verified): where ``tampered`` holds, the
    text has lost its capitals, and ``folded_root`` is the root that this row's leaf leads to with the
    siblings of the manifest. ``verified`` tells whether it is the root. Nulls and ties as in ``manifest``.
    """
    def leaf(change: bool) -> Column:
        return leaf_hash(*(lower_ascii(F.col(f)) if change and f == text else F.col(f) for f in fields))

    given = F.when(tampered, leaf(True))
    rows = manifest(docs, leaf(False), part, order, carry={"_given": given})
    root = folded(F.coalesce("_given", "leaf"), F.col("proof"))
    rows = rows.select(order, "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
