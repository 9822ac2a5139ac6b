"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label every node of an undirected edge table with the smallest node it reaches: columns node, component.

    Alternates large-star and small-star steps until every component is a star
    around its smallest node.  Steps are aggregates and joins on node, written
    to the shared folder; only a count and a checksum reach the driver.
    """
    a, b = F.col(src), F.col(dst)
    e = edges.filter(a.isNotNull() & b.isNotNull())
    alone = e.filter(a == b).select(a.alias("node"), a.alias("component"))
    e = e.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialize(e, "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = stars.unionByName(roots)
    return found.unionByName(alone.distinct().join(found, "node", "left_anti"))


#: Values that name nobody (fixed values).
UNKNOWN = ("", "unknown", "nan", "none", "-1")


def identity_list(value, sep: str = ";"):
    """Trimmed, distinct, sorted identities of a separated text, without the values that name nobody."""
    parts = F.transform(F.split(F.coalesce(value.cast("string"), F.lit("")), sep), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: ~F.lower(x).isin(*UNKNOWN))))


def identity_edges(df: DataFrame, key: str, identities: dict) -> DataFrame:
    """Edges (src, dst) from each row to its typed identity nodes; null and unknown identities make none."""
    nodes = F.array(*[F.when(c.isNotNull() & ~F.lower(c.cast("string")).isin(*UNKNOWN), F.concat(F.lit(f"{kind}:"), c.cast("string"))) for kind, c in identities.items()])
    own = F.concat(F.lit("row:"), F.lpad(F.col(key).cast("string"), 20, "0"))
    return df.select(own.alias("src"), F.explode(F.array_compact(nodes)).alias("dst"))


#: Identities within a data set and across all: kind -> columns that hold one, or a list of them.
SCOPED = {"source": ("source_id", "parent_ids"), "speaker": ("speaker_id", "speaker_ids"), "locked_group": ("group_id",)}
GLOBAL = {"media_sha256": ("sha256",), "source_sha256": ("source_sha256",), "duplicate": ("duplicate_group_id",), "speaker": ("global_speaker_ids",)}


def identity_nodes(df: DataFrame, dataset: str = "dataset") -> Column:
    """The distinct typed identities (scope, kind, id) of a row, of those columns that the table has; columns named _ids hold lists."""

    def typed(ids: Column, scope: Column, kind: str) -> Column:
        return F.transform(ids, lambda x: F.struct(scope.alias("scope"), F.lit(kind).alias("kind"), x.alias("id")))

    lists = []
    for scope, kinds in ((F.coalesce(F.col(dataset).cast("string"), F.lit("")) if dataset in df.columns else F.lit(""), SCOPED), (F.lit("global"), GLOBAL)):
        for kind, columns in kinds.items():
            for c in (c for c in columns if c in df.columns):
                value = F.col(c).cast("string")
                ids = identity_list(value) if c.endswith("_ids") else F.array_compact(F.array(F.when(value != "", value)))
                lists.append(typed(ids, scope, kind))
    return F.array_distinct(F.concat(*lists))


def identity_groups(df: DataFrame, key: str, identities: dict) -> DataFrame:
    """Rows that share an identity, directly or through others, form a group: key, group_id (the smallest key in it)."""
    found = connected_components(identity_edges(df, key, identities))
    own = df.select(key, F.concat(F.lit("row:"), F.lpad(F.col(key).cast("string"), 20, "0")).alias("node"))
    labelled = own.join(found, "node", "left").select(key, F.coalesce("component", "node").alias("component"))
    return labelled.join(labelled.groupBy("component").agg(F.min(key).alias("group_id")), "component").select(key, "group_id")


def leaking_groups(groups: DataFrame, rows: DataFrame, key: str, split: str) -> DataFrame:
    """Groups whose rows are in more than one split."""
    return groups.join(rows.select(key, split), key).groupBy("group_id").agg(F.countDistinct(split).alias("splits"), F.count("*").alias("rows")).filter("splits > 1")


def allot(sizes: list[tuple], ratios: dict[str, float], locked: dict | None = None, least_groups: int = 3) -> dict:
    """Greedy split of groups (id, size): largest first, each to the split that leaves the least squared distance to the targets.

    Sizes, not rows, come to the driver; ties take the split declared first.
    Locked groups keep their split and count toward it; a group locked to
    several (a set) joins what was kept apart and is refused, and so are fewer
    than `least_groups` groups where nothing is locked.  Once as many groups
    are left as splits are empty, they go to those.
    """
    if any(not 0 < r < 1 for r in ratios.values()) or abs(sum(ratios.values()) - 1) > 1e-9:
        raise ValueError("ratios must lie between 0 and 1 and add up to 1")
    locked, total = locked or {}, sum(n for _, n in sizes)
    if sizes and len(sizes) < least_groups and not locked:
        raise ValueError(f"at least {least_groups} independent groups are needed")
    off, out = {k: -r * total for k, r in ratios.items()}, {}
    filled: set = set()

    def place(group, size, split) -> None:
        off[split] += size
        out[group] = split
        if size:
            filled.add(split)

    for group, size in sizes:
        if group in locked:
            held = locked[group] if isinstance(locked[group], set) else {locked[group]}
            if len(held) > 1:
                raise ValueError(f"group {group} joins splits that were kept apart: {sorted(held)}")
            place(group, size, *held)
    free = sorted((x for x in sizes if x[0] not in locked), key=lambda x: (-x[1], str(x[0])))
    for left, (group, size) in zip(range(len(free), 0, -1), free):
        empty = [k for k in ratios if k not in filled]
        place(group, size, min(empty if len(empty) == left else ratios, key=lambda k: size * (size + 2 * off[k])))
    return out


def allot_by_kind(groups: list[tuple], targets: dict[str, dict[str, int]], weight: float | None = None) -> dict:
    """Greedy split of groups (id, members of each kind, weight) by targets of members of each kind in each split.

    Largest groups first, then heaviest, then by id.  A group goes where the
    squared distances to the targets grow least; of equals, where the splits'
    shares of the weight stay nearest to their shares of the members.
    """
    people = max(1, sum(sum(kinds.values()) for _, kinds, _ in groups))
    weight = sum(w for *_, w in groups) if weight is None else weight
    missing = {s: dict(t) for s, t in targets.items()}
    short = {s: weight * sum(t.values()) / people for s, t in targets.items()}
    out = {}
    for group, kinds, w in sorted(groups, key=lambda g: (-sum(g[1].values()), -g[2], str(g[0]))):
        grown = {s: (sum(n * (n - 2 * missing[s].get(k, 0)) for k, n in kinds.items()), w * (w - 2 * short[s])) for s in targets}
        split = min(targets, key=grown.__getitem__)
        for k, n in kinds.items():
            missing[split][k] = missing[split].get(k, 0) - n
        short[split] -= w
        out[group] = split
    return out


def form_parts(groups: list[tuple], per_kind: dict[str, int], targets: dict[str, dict[str, int]], first_part: int = 1) -> tuple[dict, list]:
    """Frozen parts of whole groups (id, members of each kind, weight, first review): group -> (part, split), and the groups left over.

    A part takes groups in order of first review, skipping those that don't
    fit, until each kind has exactly its number; where that can't be reached no
    part is made and what is left stays for a later run.
    """
    if any(sum(t.get(k, 0) for t in targets.values()) != n for k, n in per_kind.items()):
        raise ValueError("the targets of the splits must add up to the members of a part, for each kind")
    waiting, out, part = sorted(groups, key=lambda g: (g[3], str(g[0]))), {}, first_part
    while True:
        room, taken = dict(per_kind), []
        for g in waiting:
            if any(room.values()) and all(n <= room.get(k, 0) for k, n in g[1].items()):
                taken.append(g)
                room = {k: n - g[1].get(k, 0) for k, n in room.items()}
        if any(room.values()) or not taken:
            return out, [g[0] for g in waiting]
        splits = allot_by_kind([g[:3] for g in taken], targets)
        out.update({g: (part, s) for g, s in splits.items()})
        waiting, part = [g for g in waiting if g[0] not in splits], part + 1


def split_registry(groups: DataFrame, rows: DataFrame, group: str, split: str) -> DataFrame:
    """split, groups, rows, members (its groups in order) of an assignment of groups to splits."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    joined = groups.join(sizes, group, "left")
    return joined.groupBy(split).agg(F.count("*").alias("groups"), F.sum(F.coalesce("_n", F.lit(0))).alias("rows"), F.array_sort(F.collect_list(group)).alias("members"))
