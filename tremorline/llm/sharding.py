"""Placing documents into shards by a tree of weighted hash draws."""
from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorline.llm.text import key_text, uniform, whole, without

#: Rows of a shard are numbered in so many pieces, so that no task sorts a whole shard.
PIECES = 4096


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    """Shards that a key descends to, and the later changes of weight, in order: ``weight`` gained, or lost where it is negative."""

    base: tuple[Shard, ...]
    log: tuple[Shard, ...] = ()

    def changed(self, *log: Shard) -> Tree:
        return Tree(self.base, (*self.log, *log))


def _even(shard: int, per_rack: int, racks_per_region: int) -> Shard:
    return Shard(shard // (per_rack * racks_per_region), shard // per_rack % racks_per_region, shard)


def even_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2, added: int = 0) -> Tree:
    """Shards 0..n-1 of equal weight and ``added`` later ones; a rack and a region are opened when the one before is full."""
    tree = Tree(tuple(_even(s, per_rack, racks_per_region) for s in range(shards)))
    return tree.changed(*[_even(s, per_rack, racks_per_region) for s in range(shards, shards + added)])


_NODE = "array<struct<name:string, weight:double, first:int, size:int, region:int, rack:int, shard:int>>"
_STEP = f"array<struct<name:string, chance:double, region:int, rack:int, shard:int, lost:boolean, nodes:{_NODE}>>"


def _nodes(shards: Sequence[Shard]) -> list[dict]:
    """The tree as a list, children of a node side by side: the root, its regions, their racks, their shards."""
    levels = [lambda s: (), lambda s: (s.region,), lambda s: (s.region, s.rack), lambda s: (s.region, s.rack, s.shard)]
    shards = sorted((s for s in shards if s.weight > 0), key=lambda s: (s.region, s.rack, s.shard))
    if not shards:
        raise ValueError("a tree needs a shard of positive weight")
    out: list[dict] = []
    places: dict[tuple, int] = {}
    for level in levels:
        for s in shards:
            path = level(s)
            if path not in places:
                places[path] = len(out)
                out.append({"name": "/".join(map(str, path)), "weight": 0.0, "first": 0, "size": 0,
                            "region": s.region, "rack": s.rack, "shard": s.shard})
                if path:
                    above = out[places[path[:-1]]]
                    above["first"] = above["first"] or len(out) - 1
                    above["size"] += 1
            out[places[path]]["weight"] += float(s.weight)
    return out


def _literal(value: list[dict], kind: str) -> Column:
    """A constant the optimizer folds, so that a plan has one expression for it however large the tree is."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _descend(tree: Column, key: Column, seed: str) -> Column:
    """The leaf a key reaches: at each of the three levels the child with the least ``-ln(u) / weight``; ties go to the first."""
    def leaf(nodes: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            def draw(child: Column, i: Column) -> Column:
                u = uniform(F.lit(seed), key, child["name"])
                return F.struct((-F.ln(u) / child["weight"]).alias("draw"), (F.get(nodes, at)["first"] + i).alias("node"))

            return F.array_min(F.transform(F.slice(nodes, F.get(nodes, at)["first"] + 1, F.get(nodes, at)["size"]), draw))["node"]

        return F.get(nodes, F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(0), step))

    def named(node: Column) -> Column:
        return F.struct(node["region"].alias("region"), node["rack"].alias("rack"), node["shard"].alias("shard"))

    # As arguments of functions the tree and the leaf stand in the plan once.
    return F.get(F.transform(F.transform(F.array(tree), leaf), named), F.lit(0))


def _steps(tree: Tree, known: int) -> list[dict]:
    """The changes of the log after the first ``known``, each with its chance to move a key."""
    weights = {s.shard: s for s in tree.base}
    out = []
    for number, change in enumerate(tree.log):
        old = weights.get(change.shard, Shard(change.region, change.rack, change.shard, 0.0))
        if (old.region, old.rack) != (change.region, change.rack):
            raise ValueError(f"shard {change.shard} is in another rack")
        if old.weight + change.weight < 0:
            raise ValueError(f"shard {change.shard} loses more than it has")
        weights[change.shard] = Shard(old.region, old.rack, old.shard, old.weight + change.weight)
        lost = change.weight < 0
        total = sum(s.weight for s in weights.values())
        step = {"name": f"change {number}", "region": old.region, "rack": old.rack, "shard": old.shard, "lost": lost,
                "chance": -change.weight / old.weight if lost else change.weight / total if change.weight else 0.0,
                "nodes": _nodes(list(weights.values())) if lost else None}
        if number >= known:
            out.append(step)
    return out


def follow(tree: Tree, place: Column, key: Column, seed: int = 0, known: int = 0) -> Column:
    """Where the changes after the first ``known`` leave a key that is at ``place``."""
    steps = _steps(tree, known)
    if not steps:
        return place

    def apply(at: Column, step: Column) -> Column:
        here = F.struct(step["region"].alias("region"), step["rack"].alias("rack"), step["shard"].alias("shard"))
        moves = uniform(F.lit(f"place {seed}"), key, step["name"]) < step["chance"]
        again = _descend(step["nodes"], key, f"place {seed} again")
        return F.when(~moves | (step["lost"] & (at["shard"] != step["shard"])), at).when(step["lost"], again).otherwise(here)

    return F.aggregate(_literal(steps, _STEP), place, apply)


def place(tree: Tree, key: Column, seed: int = 0) -> Column:
    """``struct(region, rack, shard)`` of the shard where the key lands.

    The key descends the base tree: regions draw ``-ln(u) / weight`` with their summed weight and u hashed from key and region,
    the least wins; its racks draw, then the rack's shards. So draws follow the path only, and a node wins with probability
    weight / total at each level. A base with other weights moves keys within and between subtrees whose weights differ.

    The log keeps movement least. A change that gains weight takes each key with probability gained / new total, straight to the shard
    that gained; nothing else moves. One that loses weight sends the shard's keys on with probability lost / old weight; these descend the
    tree as it is after the change. Either way shards hold shares by weight. A change costs one draw; a long log is best
    folded into a new base when rows are moved anyway. Shards of weight 0 take nothing.
    """
    return follow(tree, _descend(_literal(_nodes(tree.base), _NODE), key, f"place {seed}"), key, seed)


def shard_documents(docs: DataFrame, tree: Tree, grown: Sequence[Shard] = (), seed: int = 0, pieces: int = PIECES) -> DataFrame:
    """``docs`` with size, text_crc32, region, rack, shard, slot and, given further changes ``grown``, grown_shard.

    The shard follows from doc_id and the tree alone. size is the UTF-8 bytes of the text plus 1 and text_crc32 their
    unsigned CRC-32; a null text has no bytes. Slots number the rows of a shard from 0 without gaps, ordered by a
    hashed piece, then doc_id (nulls first), size, CRC. The piece hashes doc_id, size and CRC, so a null or repeated
    doc_id spreads unless its rows repeat in these, too. Rows with a null doc_id share a shard; repeated rows
    each get a slot. Columns of the input with the names of new ones are replaced. No rows in, no rows out.
    """
    added = ["size", "text_crc32", "region", "rack", "shard", "slot", "grown_shard"]
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    rows = without(docs, *added, "_place", "_grown", "_piece", "_count", "_start").withColumns({
        "size": F.octet_length(whole("text")).cast("long") + 1,
        "text_crc32": F.crc32(whole("text").cast("binary")),
        "_place": place(tree, F.col("doc_id"), seed),
    })
    if grown:
        rows = rows.withColumn("_grown", follow(tree.changed(*grown), F.col("_place"), F.col("doc_id"), seed, len(tree.log)))
    piece_key = F.md5(key_text(F.lit("piece"), F.col("doc_id"), F.col("size"), F.col("text_crc32")).cast("binary"))
    rows = rows.withColumns({
        "region": F.col("_place.region"), "rack": F.col("_place.rack"), "shard": F.col("_place.shard"),
        "_piece": (F.conv(F.substring(piece_key, 1, 8), 16, 10).cast("long") % pieces).cast("int"),
        **({"grown_shard": F.col("_grown.shard")} if grown else {}),
    }).drop("_place", "_grown")
    before = W.partitionBy("shard").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_count")).select(
        "shard", "_piece", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"))
    numbered = rows.withColumn("slot", F.row_number().over(W.partitionBy("shard", "_piece").orderBy(*order)))
    return (
        numbered.join(starts, ["shard", "_piece"])
        .withColumn("slot", F.col("_start") + F.col("slot").cast("long") - 1)
        .select(*[F.col(f"`{c}`") for c in without(docs, *added).columns],
                *[c for c in added if grown or c != "grown_shard"])
    )
