"""Sharding by weighted hash draws down a tree of regions, racks and shards.

At each level every child draws an exponential number from the hash of the row's key and the
child's name, divided by the child's weight; the smallest draw takes the row.  A child
thus receives rows in proportion to its weight, and no table of places is kept.

Weight that is added later draws by itself, at the root, as a *growth* of one shard: a row
moves only when a new draw beats the draw that had taken it, and it moves straight into the
shard that grew.  All other rows, and the rows of all other subtrees, stay where they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaintide.llm.common import fresh, written

OVERHEAD = 8  # bytes that a row takes besides its text


@dataclass(frozen=True)
class Tree:
    """Founding weights by region, rack and shard, and the growths since, in their order.

    Shards are numbered from 0 through regions and racks; a growth is (region, rack, shard,
    added weight).  Weights are above 0.
    """

    founding: tuple[tuple[tuple[float, ...], ...], ...]
    growths: tuple[tuple[int, int, int, float], ...] = ()

    @staticmethod
    def even(shards: int, regions: int = 2, racks: int = 3) -> Tree:
        """A tree of ``shards`` shards of weight 1, dealt to regions and racks as evenly as it goes."""
        def parts(n: int, k: int) -> list[int]:
            k = min(n, k)
            return [n * (i + 1) // k - n * i // k for i in range(k)]

        return Tree(tuple(tuple((1.0,) * n for n in parts(m, racks)) for m in parts(shards, regions)))

    def places(self) -> list[tuple[int, int]]:
        """Region and rack of every shard."""
        out = [(r, k) for r, racks in enumerate(self.founding) for k, weights in enumerate(racks) for _ in weights]
        return out + [(r, k) for r, k, shard, _ in self.growths if shard >= len(out)]

    def weights(self) -> list[float]:
        """The weight of every shard, with its growths."""
        out = [w for racks in self.founding for weights in racks for w in weights]
        for *_, shard, more in self.growths:
            out += [0.0] * (shard + 1 - len(out))
            out[shard] += more
        return out

    def grown(self, weight: float = 1.0, at: tuple[int, int] | None = None) -> Tree:
        """With one more shard, in the rack ``at`` or else in the lightest one (the first of several)."""
        places, weights = self.places(), self.weights()
        if at is None:
            racks = {p: 0.0 for p in places}
            for p, w in zip(places, weights):
                racks[p] += w
            at = min(racks, key=lambda p: (racks[p], p))
        return replace(self, growths=(*self.growths, (*at, len(places), weight)))

    def heavier(self, shard: int, more: float) -> Tree:
        """With ``more`` weight on a shard; only rows that this shard receives move."""
        return replace(self, growths=(*self.growths, (*self.places()[shard], shard, more)))


def draw(key: Column, name: Column, weight: Column) -> Column:
    """An exponential number that depends on key and name only, over ``weight``."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), name).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def _least(key: Column, children: Column) -> Column:
    """The ``child`` whose draw is the smallest."""
    return F.array_min(F.transform(children, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["child"].alias("child"))))["child"]


def _children(nodes: Sequence[tuple[str, float, int]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(c).alias("child")) for n, w, c in nodes])


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of the row with this key; null keys all share one."""
    named = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))
    regions, racks, shards, rack_no, number = [], [], [], 0, 0
    for r, region in enumerate(tree.founding):
        below = []
        for k, weights in enumerate(region):
            shards.append(_children([(f"shard {number + s}", w, number + s) for s, w in enumerate(weights)]))
            below.append((f"rack {r}.{k}", sum(weights), rack_no))
            rack_no, number = rack_no + 1, number + len(weights)
        racks.append(_children(below))
        regions.append((f"region {r}", sum(w for _, w, _ in below), r))
    growths = [(f"growth {i}", w, -1 - i) for i, (*_, w) in enumerate(tree.growths)]
    # a variable of a lambda is computed once, a column may be copied
    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    leaf = lambda k, r: _least(k, F.element_at(F.array(*shards), bind(_least(k, F.element_at(F.array(*racks), r + 1)), lambda x: x) + 1))
    settled = F.array(*[F.lit(shard) for *_, shard, _ in tree.growths]) if growths else None
    choose = lambda k, r: F.when(r >= 0, leaf(k, r)).otherwise(F.element_at(settled, -r)) if growths else leaf(k, r)
    return bind(named, lambda k: bind(_least(k, _children(regions + growths)), lambda r: choose(k, r))).cast("int")


def gapless(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the place of each row in its group, from 0, in the order of ``order``.

    Rows are sorted in ranges, so a group or a run of equal rows of any size is spread over
    tasks; only one count for each range and group is brought together.  Rows that tie in
    ``order`` get their places in any order.  ``rows`` is to be a scan, whose rows keep their positions.
    """
    tie, part, at, first, before = fresh(rows, "_tie", "_part", "_at", "_first", "_before")
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(group, *order, tie).sortWithinPartitions(group, *order, tie)
    ranged = written(ranged.drop(tie).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}))
    counts = ranged.groupBy(group, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(before))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    return ranged.join(counts, [group, part]).select(*rows.columns, (F.col(at) - F.col(first) + F.col(before)).alias(name))


def shard_rows(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, size, text_crc32, law, region, rack, shard, slot, grown_shard.

    ``shard`` depends on the key and the tree alone, so every row of one key, null too, goes to
    one shard, and ``grown_shard`` is the shard after ``tree.grown()``: the same, or the new one.
    ``slot`` numbers the rows of a shard from 0 by key, size and checksum.  Null texts have no bytes.
    Kept columns called like a new one are replaced; other columns don't matter; an empty table
    gives no rows.  Texts are measured where they are read and don't move.
    """
    added = ("size", "text_crc32", "law", "region", "rack", "shard", "slot", "grown_shard")
    keep = [c for c in keep if c.lower() not in added]
    value = F.coalesce(F.col(text), F.lit(""))
    (by,) = fresh(docs, "_key")
    rows = docs.select(
        *keep, F.col(key).alias(by), (F.octet_length(value) + OVERHEAD).cast("bigint").alias("size"), F.crc32(value.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), tree).alias("shard"), shard_of(F.col(key), tree.grown()).alias("grown_shard"),
    )
    places = tree.places()
    at = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in places]), F.col("shard") + 1)
    return gapless(rows, "shard", [by, "size", "text_crc32"], "slot").select(
        *keep, "size", "text_crc32", F.lit("key").alias("law"), at(0).alias("region"), at(1).alias("rack"), "shard", "slot", "grown_shard",
    )


def totals(sharded: DataFrame) -> DataFrame:
    """Rows, bytes and rows that growing moves, by shard."""
    moved = F.count_if(F.col("grown_shard") != F.col("shard")).alias("n_leaving")
    return sharded.groupBy("region", "rack", "shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"), moved)
