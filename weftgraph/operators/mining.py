"""Frequent itemsets, association rules and sequential patterns.

Itemsets are sorted arrays. A level of Apriori is three joins: candidates from equal prefixes,
pruning by subsets, and counting by items; an index tree isn't needed.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import cut, drop_table


def level_one(tx: DataFrame, key: str = "tx_id", items: str = "items") -> DataFrame:
    """(itemset, support) of all single items, unpruned."""
    each = tx.select(F.col(key).alias("tx"), F.explode(F.array_distinct(items)).alias("item"))
    return each.groupBy(F.array("item").alias("itemset")).agg(F.count("*").alias("support"))


def pruned(sets: DataFrame, n: int, support: float) -> DataFrame:
    """Sets in at least the share ``support`` of n transactions; compared in integers."""
    least = -(-int(round(support * n * 1_000_000)) // 1_000_000)
    return sets.where(F.col("support") >= least)


def joined(frequent: DataFrame, k: int) -> DataFrame:
    """Candidates of k items: pairs of (k-1)-sets with an equal prefix, and all (k-1)-subsets frequent."""
    f = frequent.select("itemset")
    a = f.select(F.slice("itemset", 1, k - 2).alias("prefix"), F.element_at("itemset", -1).alias("x"))
    b = a.select(F.col("prefix").alias("p2"), F.col("x").alias("y"))
    # an empty prefix joins every pair of single items, so the key has the set's size as well
    c = a.join(b, (F.col("prefix") == F.col("p2")) & (F.col("x") < F.col("y"))).select(F.concat("prefix", F.array("x", "y")).alias("itemset"))
    if k < 3:
        return c
    subs = c.select("itemset", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.concat(F.slice("itemset", F.lit(1), i - 1), F.slice("itemset", i + 1, F.lit(k))))).alias("sub"))
    return subs.join(f.withColumnRenamed("itemset", "sub"), "sub").groupBy("itemset").agg(F.count("*").alias("c")).where(F.col("c") == k).select("itemset")


def counted(candidates: DataFrame, tx: DataFrame, k: int, key: str = "tx_id", items: str = "items") -> DataFrame:
    """(itemset, support): transactions that hold all items of a candidate, by an equi-join on the item."""
    c = candidates.select("itemset", F.explode("itemset").alias("item"))
    t = tx.select(F.col(key).alias("tx"), F.explode(F.array_distinct(items)).alias("item"))
    hits = c.join(t, "item").groupBy("itemset", "tx").agg(F.count("*").alias("c")).where(F.col("c") == k)
    return hits.groupBy("itemset").agg(F.count("*").alias("support"))


def apriori(tx: DataFrame, support: float, level: int | None = None, most: int = 32, key: str = "tx_id", items: str = "items") -> DataFrame:
    """The last level that isn't empty, or the given one. Every level ends in a written table."""
    return apriori_levels(tx, support, level, most, key, items)[-1]


def apriori_levels(tx: DataFrame, support: float, level: int | None = None, most: int = 32, key: str = "tx_id", items: str = "items") -> list[DataFrame]:
    """The levels until one is empty, or up to the given one; more than ``most`` levels are refused."""
    n = tx.count()
    now = pruned(level_one(tx, key, items), n, support)
    if level != 1:
        now = cut(now, "apriori")
    out = [now]
    for k in range(2, (level or most + 1) + 1):
        # items that are in no frequent set can't count again
        now = cut(pruned(counted(joined(now, k), tx, k, key, items), n, support), "apriori")
        if now.isEmpty():
            drop_table(now)
            break
        if not level and k > most:
            raise ValueError(f"sets of more than {most} items are frequent: raise the support or the bound")
        out.append(now)
    return out


def rules(levels: list[DataFrame], confidence: float, least: int = 2, deepest: bool = True) -> DataFrame:
    """(antecedent, consequent, confidence): splits of frequent sets with a confidence of at least that much.

    ``least``: items of a consequent, 2 at first; deepest: only sets of the last level.
    """
    whole = levels[-1] if deepest else _union(levels)
    known = _union(levels).withColumnRenamed("itemset", "antecedent").withColumnRenamed("support", "of")
    k = len(levels)
    splits = []
    for size in range(least, k):
        take = [F.array(*[F.col("itemset")[i] for i in pick]) for pick in combinations(range(k), size)]
        splits += take
    if not splits and deepest:
        return whole.select(F.col("itemset").alias("antecedent"), F.col("itemset").alias("consequent"), F.lit(0.0).alias("confidence")).where("false")
    if deepest:
        x = whole.select("itemset", "support", F.explode(F.array(*splits)).alias("consequent"))
    else:
        x = whole.select("itemset", "support", F.explode(subsets(F.col("itemset"))).alias("consequent")).where((F.size("consequent") >= least) & (F.size("consequent") < F.size("itemset")))
    x = x.withColumn("antecedent", F.array_except("itemset", "consequent")).join(known, "antecedent")
    return x.withColumn("confidence", F.col("support") / F.col("of")).where(F.col("confidence") >= confidence).select("antecedent", "consequent", "confidence")


def subsets(items: Column) -> Column:
    """All non-empty subsets of a small array."""
    n = F.size(items)
    bits = lambda m: F.filter(F.transform(items, lambda x, i: F.when(F.expr("1") == 1, F.struct(x.alias("x"), F.pmod(F.floor(m / F.pow(F.lit(2.0), i)), F.lit(2)).alias("b")))), lambda s: s["b"] == 1)
    return F.transform(F.sequence(F.lit(1), (F.pow(F.lit(2.0), n) - 1).cast("int")), lambda m: F.transform(bits(m), lambda s: s["x"]))


def _union(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def positions(rows: DataFrame, key: str, order: str, item: str) -> DataFrame:
    """Vertical form: (key, item, positions, n), positions numbered from 0 in each key."""
    w = Window.partitionBy(key)
    x = rows.withColumn("pos", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    return x.groupBy(key, item).agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.first("n").alias("n"))


def s_step(a: Column, b: Column, gap: int | None = None) -> Column:
    """Positions of b that follow a position of a: within gap + 1 of one, or anywhere behind the first."""
    if gap is None:
        return F.filter(b, lambda y: F.coalesce(y > F.array_min(a), F.lit(False)))
    return F.filter(b, lambda y: F.exists(a, lambda x: (y > x) & (y <= x + gap + 1)))


def i_step(a: Column, b: Column) -> Column:
    """Positions that both have."""
    return F.array_intersect(a, b)


def extend_sequence(seq: Column, item: Column) -> Column:
    return F.concat(seq, F.array(F.array(item)))


def extend_itemset(seq: Column, item: Column) -> Column:
    """The last itemset with one more item; the sequence it came from stays as it is."""
    return F.concat(F.slice(seq, F.lit(1), F.size(seq) - 1), F.array(F.array_sort(F.array_distinct(F.array_append(F.element_at(seq, -1), item)))))


def spam(vertical: DataFrame, key: str, item: str, support: float = 0.07, least: int = 0, most: int = 3, gap: int | None = None, itemsets: bool = False) -> DataFrame:
    """(key, sequence, support): sequences of a key's list whose end positions are at least that share of it.

    Depth-first over bitmaps held as Python integers, a key a group; sequences of length 1 are
    not returned; sizes go from ``least`` to ``most`` (0: no bound).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, name = int(pdf["n"].iloc[0]), pdf[key].iloc[0]
        need = -(-int(round(support * n * 1_000_000)) // 1_000_000)
        maps = {i: sum(1 << int(p) for p in ps) for i, ps in zip(pdf[item], pdf["positions"], strict=True)}
        single = {i: m for i, m in sorted(maps.items()) if m.bit_count() >= need}
        out = []

        def follow(m: int) -> int:
            if not m:
                return 0
            if gap is None:
                low = (m & -m).bit_length()
                return ((1 << n) - 1) >> low << low if low < n else 0
            x = 0
            for s in range(1, gap + 2):
                x |= m << s
            return x & ((1 << n) - 1)

        def grow(seq: list, m: int, s_items: list, i_items: list) -> None:
            size = len(seq)
            if sum(map(len, seq)) > 1 and size >= max(least, 1) and (not most or size <= most):
                out.append((name, [list(x) for x in seq], m.bit_count() / n))
            window = follow(m)
            s_next = [(i, x) for i in s_items if (x := window & single[i]).bit_count() >= need] if not most or size < most else []
            i_next = [(i, x) for i in i_items if (x := m & single[i]).bit_count() >= need] if itemsets else []
            names = [i for i, _ in s_next]
            for i, x in s_next:
                grow([*seq, [i]], x, names, [j for j in names if j > i])
            names = [i for i, _ in i_next]
            for i, x in i_next:
                grow([*seq[:-1], [*seq[-1], i]], x, [j for j, _ in s_next], [j for j in names if j > i])

        for i, m in single.items():
            grow([[i]], m, [*single], [j for j in single if j > i])
        return pd.DataFrame(out, columns=[key, "sequence", "support"])

    kind = vertical.schema[key].dataType.simpleString()
    return vertical.groupBy(key).applyInPandas(run, f"{key} {kind}, sequence array<array<string>>, support double")


def sequence_name(seq: Column) -> Column:
    """A sequence as one label: items joined by commas, itemsets by arrows."""
    return F.array_join(F.transform(seq, lambda s: F.array_join(s, ",")), ">")


def sequence_size(seq: Column) -> Column:
    return F.size(seq)


def sequence_length(seq: Column) -> Column:
    return F.aggregate(seq, F.lit(0), lambda a, s: a + F.size(s))


def itemset_order(items: Column) -> Column:
    """Sort key of itemsets: lexicographic, and on a shared prefix the longer set first."""
    return F.concat(items, F.array(F.lit("\U0010ffff")))


def item_at(items: Column, place: Column | int) -> Column:
    """The item at a place from 0; null beyond the end."""
    return F.get(items, F.lit(place) if isinstance(place, int) else place)


def item_added(items: Column, item: Column) -> Column:
    """The set with an item, in order; a set that has it stays as it is."""
    return F.array_sort(F.array_distinct(F.array_append(items, item)))


def item_removed(items: Column, item: Column) -> Column:
    return F.array_remove(items, item)


def inserted(sets: DataFrame, new: DataFrame) -> DataFrame:
    """Insert into a set of rows: rows that are there already stay as they are."""
    return sets.unionByName(new).distinct()


def contained(sets: DataFrame, tx: DataFrame, key: str = "tx_id", items: str = "items") -> DataFrame:
    """(key, itemset): the sets (itemset) that each transaction holds whole: an index probe as an equi-join on the item, then a count."""
    c = sets.select("itemset", F.explode("itemset").alias("item"), F.size("itemset").alias("k")).distinct()
    t = tx.select(key, F.explode(F.array_distinct(items)).alias("item"))
    return c.join(t, "item").groupBy(key, "itemset", "k").agg(F.count("*").alias("c")).where("c = k").select(key, "itemset")


def same_prefix(a: Column, b: Column) -> Column:
    """Equality of two itemsets of one size but for the last item; sets of one item are always equal."""
    return (F.size(a) == F.size(b)) & (F.slice(a, F.lit(1), F.size(a) - 1) == F.slice(b, F.lit(1), F.size(b) - 1))
