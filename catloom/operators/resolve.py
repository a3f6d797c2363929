"""Entity resolution: linking records, clusters, and the best value per field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from catloom.functions.values import as_col, has_text, nonempty, spread_nulls
from catloom.runtime import cut_lineage


def cluster_id(key: Column | str) -> Column:
    """36-character id that depends on the key alone."""
    return F.regexp_replace(F.md5(as_col(key)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _link(df: DataFrame, column: str, seq: str, name: str) -> DataFrame:
    firsts = df.where(has_text(column)).groupBy(F.col(column).alias("_k")).agg(F.min(seq).alias(name))
    return df.join(firsts, spread_nulls(df, column) == F.col("_k"), "left").drop("_k")


def link_by_external_id(df: DataFrame, external_id: str, seq: str, name: str = "id_leader") -> DataFrame:
    """First record with the same external id; null without one."""
    return _link(df, external_id, seq, name)


def link_by_exact_key(df: DataFrame, key: str, seq: str, name: str = "key_leader") -> DataFrame:
    """First record with the same key."""
    return _link(df, key, seq, name)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of an undirected graph; the component is its smallest node.

    Alternates large-star and small-star steps. Each is a minimum per node plus a join with it, so
    a hub is combined map-side and its edges never meet in one group; the number of rounds grows
    with the logarithm of the graph. Every round is checkpointed.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = cut_lineage(e)
    # Rounds end when the edge set no longer changes, told by its size and a sum over its rows.
    state = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first: then both sides of the join are exchanged, and the neighbours of a hub can be split at run time.
        low = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u")
        star = small.select("u", F.col("m").alias("v")).unionByName(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        e = cut_lineage(star.distinct())
        after = state(e)
        if after == before:
            break
        before = after
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def connect(df: DataFrame, key: str, external_id: str, seq: str, name: str = "cluster", leaders_too: bool = False) -> DataFrame:
    """Records joined by equal key or equal external id, transitively.

    The graph holds one node per distinct key and only ids that occur under several keys, so copies
    of a record never enter the iteration. ``cluster`` is the smallest ``seq`` of the component. ``leaders_too`` adds key_leader
    and id_leader, the first records of the same key and of the same id.
    """
    leaders = df.groupBy(key).agg(F.min(seq).alias("_lead"))
    ids = df.where(has_text(external_id)).select(external_id, key).distinct().join(leaders, key)
    hubs = ids.groupBy(external_id).agg(F.min("_lead").alias("_low"), F.max("_lead").alias("_high")).where("_low != _high")
    edges = ids.join(hubs, external_id).where("_lead != _low").select("_lead", "_low")
    parts = connected_components(edges, "_lead", "_low")
    mapping = (
        leaders.join(parts, F.col("_lead") == F.col("node"), "left")
        .select(F.col(key).alias("_key"), F.coalesce("component", "_lead").alias(name), F.col("_lead").alias("key_leader"))
    )
    joined = df.join(mapping, F.col(key) == F.col("_key")).drop("_key")
    return link_by_external_id(joined, external_id, seq) if leaders_too else joined.drop("key_leader")


def fuzzy_cluster(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(member, leader) of the greedy star clustering over similar pairs, smaller id first.

    Taken in id order, a record absorbs every later neighbour still standing, and an absorbed record
    absorbs nothing. Equivalently: a record leads when none of its smaller neighbours leads, which is a
    condition per neighbour. Each round settles the records whose conditions are all met or one of which is
    broken, and contracts chains: where a neighbour hangs on a single condition of its own, the condition moves on to
    what that one hangs on. So a path of n neighbours in id order takes about log2 n rounds.
    """
    graph = cut_lineage(pairs.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a < b").distinct())
    # v leads if, for each of its rows, p leads or not as ``want`` says.
    open_rows = graph.select(F.col("b").alias("v"), F.col("a").alias("p"), F.lit(False).alias("want"))
    fresh = graph.select(F.col("a").alias("node"), F.lit(True).alias("leads")).limit(0)
    found: list[DataFrame] = []
    while not open_rows.isEmpty():
        waiting = open_rows.select(F.col("v").alias("node")).unionByName(fresh.select("node")).distinct()
        first = open_rows.select(F.col("p").alias("node")).distinct().join(waiting, "node", "left_anti")
        known = cut_lineage(fresh.unionByName(first.withColumn("leads", F.lit(True))))
        found.append(known)
        told = open_rows.join(known, F.col("p") == F.col("node"), "left").select("v", "p", "want", "leads")
        # Copies of a condition are one; a condition and its opposite cannot both hold.
        told = told.groupBy("v", "p").agg(F.min("want").alias("want"), (F.min("want") != F.max("want")).alias("clash"), F.first("leads").alias("leads"))
        broken = F.col("clash") | F.coalesce(F.col("leads") != F.col("want"), F.lit(False))
        told = cut_lineage(told.select("v", "p", "want", broken.alias("broken"), F.col("leads").isNull().alias("open")))
        state = cut_lineage(told.groupBy("v").agg(
            F.bool_or("broken").alias("broken"), F.count_if("open").alias("n"), F.min_by(F.struct("p", "want"), F.when(F.col("open"), F.col("p"))).alias("only")))
        fresh = state.where("broken or n = 0").select(F.col("v").alias("node"), (~F.col("broken")).alias("leads"))
        chained = state.where("not broken and n = 1").select(F.col("v").alias("u"), F.col("only.p").alias("q"), F.col("only.want").alias("w"))
        left = told.where("open").drop("broken").join(fresh.select(F.col("node").alias("v")), "v", "left_anti")
        moved = left.join(chained, F.col("p") == F.col("u"), "left")
        open_rows = cut_lineage(moved.select(
            "v", F.coalesce("q", "p").alias("p"), F.when(F.col("u").isNull(), F.col("want")).otherwise(F.col("want") == F.col("w")).alias("want")).distinct())
    leaders = graph.select(F.col("a").alias("node")).limit(0)
    for part in found:
        leaders = leaders.unionByName(part.where("leads").select("node"))
    # What the last round settled is no neighbour of anything open, but may lead.
    leaders = cut_lineage(leaders.unionByName(fresh.where("leads").select("node")).distinct())
    absorbed = graph.join(leaders.withColumnRenamed("node", "a"), "a")
    return absorbed.join(leaders.withColumnRenamed("node", "b"), "b", "left_anti").groupBy(F.col("b").alias("member")).agg(F.min("a").alias("leader"))


def merge_ready(pairs: DataFrame, hi: int = 90, min_length: int = 3) -> DataFrame:
    return pairs.where((F.col("ratio") >= hi) & (F.length("text_a") > min_length) & (F.length("text_b") > min_length))


def in_review(lo: int = 80, hi: int = 90, min_length: int = 3) -> Column:
    """Too similar to ignore and too different to merge."""
    return (F.col("ratio") >= lo) & (F.col("ratio") < hi) & (F.length("text_a") > min_length)


def review_queue(pairs: DataFrame, lo: int = 80, hi: int = 90, min_length: int = 3) -> DataFrame:
    return pairs.where(in_review(lo, hi, min_length))


def absorb(df: DataFrame, stars: DataFrame, cluster: str) -> DataFrame:
    """Move the clusters of absorbed members under their leader."""
    return (
        df.join(stars, F.col(cluster) == F.col("member"), "left")
        .withColumn(cluster, F.coalesce("leader", cluster))
        .drop("member", "leader")
    )


def survivorship(df: DataFrame, cluster: str, seq: str, filled: Sequence[str], base: Sequence[str] = ()) -> DataFrame:
    """One row per cluster: the first non-empty value of ``filled``; ``base`` from the first record."""
    types = {field.name: field.dataType for field in df.schema}
    firsts = [F.min_by(c, F.when(nonempty(c, types[c]), F.col(seq))).alias(c) for c in filled]
    kept = [F.min_by(c, seq).alias(c) for c in base]
    return df.groupBy(cluster).agg(F.min(seq).alias(seq), F.count("*").alias("n_records"), *kept, *firsts)


def first_identifier(df: DataFrame, cluster: str, seq: str, ids: Sequence[str]) -> DataFrame:
    return df.groupBy(cluster).agg(*[F.min_by(c, F.when(has_text(c), F.col(seq))).alias(c) for c in ids])


def union_values(df: DataFrame, cluster: str, seq: str, array: str, identity: Sequence[str], last_in_base: bool = True) -> DataFrame:
    """Distinct array elements of a cluster as rows (cluster, first_seq, first_pos, element).

    ``identity`` names the fields that make two elements equal (null equals null). Order is that of
    first occurrence. When the base record itself repeats an element its last value counts, if
    ``last_in_base``. Rows rather than one array: a cluster may hold any share of the data;
    ``paged_collect`` nests them in bounded pages.
    """
    rows = df.select(F.col(cluster), F.col(seq).alias("_seq"), F.posexplode(array).alias("_pos", "element"))
    keys = [F.col("element")[field].alias("_k_" + field) for field in identity]
    names = ["_k_" + field for field in identity]
    first = F.struct("_seq", "_pos", F.col("element").alias("_first"))
    # The last value inside the first record that has the element.
    last = F.max_by("element", F.struct((-F.col("_seq")).alias("s"), F.col("_pos")))
    best = rows.groupBy(cluster, *keys).agg(F.min_by(first, F.struct("_seq", "_pos")).alias("_w"), last.alias("_last"))
    value = F.col("_w._first")
    if last_in_base:
        base = df.groupBy(F.col(cluster).alias("_c")).agg(F.min(seq).alias("_base"))
        best = best.join(base, F.col(cluster) == F.col("_c"))
        value = F.when(F.col("_w._seq") == F.col("_base"), F.col("_last")).otherwise(value)
    return best.select(cluster, F.col("_w._seq").alias("first_seq"), F.col("_w._pos").alias("first_pos"), value.alias("element"))


class MergeStats:
    """Counts of a merge, gathered while its jobs run: each step hands its rows through an observation, and none is run twice.

    The figures are there once the observed DataFrames were computed; :meth:`frame` waits for them.
    """

    def __init__(self):
        self.parts: list[Observation] = []

    def _watch(self, df: DataFrame, *counts: Column) -> DataFrame:
        part = Observation()
        self.parts.append(part)
        return df.observe(part, *counts)

    def inputs(self, df: DataFrame, seq: str, id_leader: str, key_leader: str) -> DataFrame:
        """Records with the first record of the same external id and of the same key; an id match counts before a key match."""
        by_id = F.coalesce(F.col(id_leader) < F.col(seq), F.lit(False))
        by_key = ~by_id & (F.col(key_leader) < F.col(seq))
        return self._watch(df, F.count(F.lit(1)).alias("total_input"), F.count_if(by_id).alias("id_matches"), F.count_if(by_key).alias("exact_matches"))

    def pairs(self, pairs: DataFrame, lo: int = 80, hi: int = 90) -> DataFrame:
        """Similar pairs; those left to a person are counted."""
        return self._watch(pairs, F.count_if(in_review(lo, hi)).alias("review_queue_size"))

    def stars(self, stars: DataFrame) -> DataFrame:
        """Clusters that similar names move under another one."""
        return self._watch(stars, F.count(F.lit(1)).alias("fuzzy_matches"))

    def merged(self, df: DataFrame) -> DataFrame:
        return self._watch(df, F.count(F.lit(1)).alias("clusters"))

    def filtered(self, df: DataFrame, non_retail: str, excluded: str) -> DataFrame:
        """Merged rows with the flags of the two exclusions; a row that both would drop counts for the first."""
        return self._watch(
            df, F.count_if(non_retail).alias("non_retail_filtered"), F.count_if(~F.col(non_retail) & F.col(excluded)).alias("tech_filtered"))

    def values(self) -> dict[str, int | float]:
        """All counts. ``dedup_rate`` is the share of records merged away, in percent; filtered rows do not count as merged."""
        found: dict[str, int | float] = {}
        for part in self.parts:
            found |= part.get
        clusters = found.pop("clusters")
        found["total_output"] = clusters - found.get("non_retail_filtered", 0) - found.get("tech_filtered", 0)
        found["dedup_rate"] = round((1 - clusters / max(found["total_input"], 1)) * 100, 1)
        return found

    def frame(self, spark: SparkSession) -> DataFrame:
        found = self.values()
        kinds = {k: "double" if k == "dedup_rate" else "long" for k in found}
        return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} {kinds[k]}" for k in found))
