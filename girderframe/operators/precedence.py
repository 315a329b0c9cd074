"""Construction precedence between classes and scored schedule matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girderframe.functions.classify import level_order
from girderframe.session import stored, stored_if_any
from girderframe.sources import rules as R


def superclass_members(classified: DataFrame) -> DataFrame:
    """(object_id, class): each object under its class and every superclass."""
    table = R.class_table(classified.sparkSession)
    # The class table has a few dozen rows, fixed by the rules.
    return classified.join(F.broadcast(table), "class").select("object_id", F.col("superclass").alias("class"))


def class_nodes(classified: DataFrame, scope: str) -> DataFrame:
    """(class, key, objects) for one scope column: level_name, area_name or unit_name."""
    rows = classified.filter(F.col("class").isNotNull() & F.col(scope).isNotNull())
    # Rows that are counted already carry their number of objects.
    objects = F.sum("objects") if "objects" in classified.columns else F.count(F.lit(1))
    return rows.groupBy("class", F.col(scope).alias("key")).agg(objects.alias("objects"))


def precedence_edges(classified: DataFrame, rules=None) -> DataFrame:
    """Edges between (class, key) nodes that the precedence rules imply.

    Objects are aggregated to class nodes first; object pairs follow from membership and
    are never written out. ``classified`` has class, level_name, area_name and unit_name.
    """
    spark = classified.sparkSession
    table = R.precedence_table(spark, rules)
    scopes = {"same_level": "level_name", "same_area": "area_name", "same_unit": "unit_name"}
    # One pass over the objects; all else reads the small counted table.
    counted = classified.filter("class is not null").groupBy("class", *scopes.values()).agg(F.count(F.lit(1)).alias("objects"))
    classified = stored(counted, "class_counts")
    out = None
    for condition, scope in scopes.items():
        nodes = class_nodes(classified, scope)
        rule = F.broadcast(table.filter(F.col("condition") == condition))
        before = nodes.select(F.col("class").alias("pred_class"), "key", F.col("objects").alias("pred_objects"))
        after = nodes.select(F.col("class").alias("succ_class"), "key", F.col("objects").alias("succ_objects"))
        edges = before.join(rule, "pred_class").join(after, ["succ_class", "key"]).select(
            "condition", "priority", "pred_class", F.col("key").alias("pred_key"), "succ_class",
            F.col("key").alias("succ_key"), "pred_objects", "succ_objects",
        )
        out = edges if out is None else out.unionByName(edges)
    always = F.broadcast(table.filter("condition = 'always'"))
    totals = classified.groupBy("class").agg(F.sum("objects").alias("objects"))
    before = totals.select(F.col("class").alias("pred_class"), F.col("objects").alias("pred_objects"))
    after = totals.select(F.col("class").alias("succ_class"), F.col("objects").alias("succ_objects"))
    everywhere = before.join(always, "pred_class").join(after, "succ_class").select(
        "condition", "priority", "pred_class", F.lit("").alias("pred_key"), "succ_class",
        F.lit("").alias("succ_key"), "pred_objects", "succ_objects",
    )
    return out.unionByName(everywhere).unionByName(_level_edges(classified, rules))


def _level_edges(classified: DataFrame, rules=None) -> DataFrame:
    """Edges from each level of a class to its next higher level.

    Further levels follow by transitivity. A class has at most as many rows here as there
    are named levels.
    """
    wanted = {a: p for a, b, c, p in (R.PRECEDENCE_RULES if rules is None else rules) if c == "lower_level_first" and a == b}
    priority = F.lit(wanted.get("*"))
    for name, value in wanted.items():
        if name != "*":
            priority = F.when(F.col("class") == name, F.lit(value)).otherwise(priority)
    nodes = class_nodes(classified, "level_name")
    ordered = nodes.withColumn("order_no", level_order(F.col("key"))).filter(F.col("order_no").isNotNull())
    per_order = ordered.groupBy("class", "order_no").agg(
        F.sum("objects").alias("objects"), F.min("key").alias("key")
    )
    up = Window.partitionBy("class").orderBy("order_no")
    linked = per_order.withColumns(
        {"succ_key": F.lead("key").over(up), "succ_objects": F.lead("objects").over(up)}
    ).filter(F.col("succ_key").isNotNull())
    return linked.withColumn("priority", priority.cast("int")).filter("priority is not null").select(
        F.lit("lower_level_first").alias("condition"), "priority", F.col("class").alias("pred_class"),
        F.col("key").alias("pred_key"), F.col("class").alias("succ_class"), "succ_key",
        F.col("objects").alias("pred_objects"), "succ_objects",
    )


def inverse_edges(edges: DataFrame) -> DataFrame:
    """mustFollow edges from mustPrecede edges."""
    swap = {"pred_class": "succ_class", "pred_key": "succ_key", "succ_class": "pred_class", "succ_key": "pred_key"}
    return edges.select(*[F.col(old).alias(new) for new, old in swap.items()])


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Both directions of a symmetric relation, each once."""
    columns = ["pred_class", "pred_key", "succ_class", "succ_key"]
    return edges.select(*columns).unionByName(inverse_edges(edges)).distinct()


NAME_CUTOFF = 0.6
_ATTRIBUTES = ["level_name", "category", "path"]


def name_tokens(name: Column) -> Column:
    """Distinct lower-case word tokens of a name."""
    words = F.split(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda t: t != ""))


def name_similarity(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Jaccard similarity of two names with ``na`` and ``nb`` tokens, by the arrays that hold what they share; values under the cut-off count as 0."""
    both = F.size(F.array_intersect(a, b))
    ratio = F.try_divide(both.cast("double"), na + nb - both)
    return F.when(ratio >= NAME_CUTOFF, ratio).otherwise(F.lit(0.0))


# A token counts as common from one in so many names on; at most a few hundred tokens are.
COMMON_SHARE = 200
# Candidate pairs of one block up to which it is compared in one task, and rows of a side in one part of a larger block.
BLOCK_PAIRS, PART_ROWS = 4_000_000, 1_000


def common_tokens(names: DataFrame, share: int = COMMON_SHARE) -> dict[str, int]:
    """Tokens that at least one in ``share`` names holds, with the number of names: a bounded list."""
    total = names.count()
    counted = names.select(F.explode(name_tokens(F.col("name"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    return {r["token"]: r["uses"] for r in counted.filter(F.col("uses") * share >= total).collect()}


def rarest_first(name: Column, common: dict[str, int]) -> Column:
    """Distinct tokens of a name: those that are not common by text, then the common ones from rare to frequent.

    Any order that both sides share is exact; this one keeps common tokens out of the prefixes.
    """
    order = {t: k + 1 for k, t in enumerate(sorted(common, key=lambda t: (common[t], t)))}
    ranks = F.create_map(*[x for t, k in order.items() for x in (F.lit(t), F.lit(k))]) if order else F.create_map().cast("map<string,int>")
    ranked = F.transform(name_tokens(name), lambda t: F.struct(F.coalesce(F.element_at(ranks, t), F.lit(0)).alias("rank"), t.alias("token")))
    return F.transform(F.array_sort(ranked), lambda r: r["token"])


def _described(df: DataFrame, key: str, common: dict[str, int]) -> DataFrame:
    """Distinct descriptions by attributes and tokens with their smallest key: equal ones are compared once."""
    filled = [F.coalesce(c, F.lit("")).alias(c) for c in _ATTRIBUTES]
    rows = df.select(key, *filled, rarest_first(F.col("name"), common).alias("tokens")).groupBy(*_ATTRIBUTES, "tokens").agg(F.min(key).alias(key))
    known = F.array(*map(F.lit, common)).cast("array<string>")
    rare = F.size(F.array_except("tokens", known))
    return rows.withColumns({"n": F.size("tokens"), "rare": F.slice("tokens", F.lit(1), rare), "often": F.slice("tokens", rare + 1, F.size("tokens"))})


#: What a name that shares no rare token is compared by.
_OUTLINE = [*_ATTRIBUTES, "often", "n"]


def _in_blocks(described: DataFrame, key: str, side: str, sets: list[tuple[list[str], float]], tokens: str) -> DataFrame:
    """(block, least, at, key, tokens, n, attributes) for every attribute set and token of the prefix for its similarity.

    Names with a Jaccard similarity of ``least`` or more share one of the first n - ceil(least n) + 1 of their n
    tokens. A block is the hash of the set's attributes and the token; equal hashes of different blocks only give
    more candidates. ``tokens`` names the part of the tokens that makes blocks: ``rare`` ones, which come first, or
    those that occur ``often``.
    """
    n = F.col("n")
    before = F.lit(0) if tokens == "rare" else n - F.size(tokens)
    entries = []
    for shared, least in sets:
        keep = F.when(n > 0, n - F.ceil(n * F.lit(least) - 1e-9).cast("int") + 1).otherwise(0)
        keep = F.greatest(keep - before, F.lit(0))
        same = [F.lit(",".join(shared)), *[F.col(c) for c in shared]]
        entries.append(F.transform(F.slice(tokens, F.lit(1), keep), lambda t, i: F.struct(F.xxhash64(*same, t).alias("block"), F.lit(least).alias("least"), (i + before).alias("at"))))
    columns = [F.col("e.block").alias("block"), F.col("e.least").alias("least"), F.col("e.at").alias(f"at_{side}"), F.col(key), F.col(tokens if tokens == "often" else "tokens").alias(f"t{side}"), n.alias(f"n{side}"), *[F.col(c).alias(f"{side}_{c}") for c in _ATTRIBUTES]]
    return described.select("*", F.explode(F.concat(*entries)).alias("e")).select(*columns)


def _split_blocks(probe: DataFrame, build: DataFrame, block_pairs: int, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``part``: blocks with very many pairs are dealt into parts on both sides by their measured size.

    Part numbers pair every part of the one side with every part of the other; no pair is lost or met twice.
    """
    sizes = probe.groupBy("block").agg(F.count(F.lit(1)).alias("rows_a")).join(build.groupBy("block").agg(F.count(F.lit(1)).alias("rows_b")), "block")
    hot = stored_if_any(sizes.filter(F.col("rows_a") * F.col("rows_b") > block_pairs), "hot_blocks")
    if hot is None:
        return probe.withColumn("part", F.lit(0)), build.withColumn("part", F.lit(0))
    parts = hot.select("block", F.ceil(F.col("rows_a") / part_rows).alias("parts_a"), F.ceil(F.col("rows_b") / part_rows).alias("parts_b"))

    def dealt(rows: DataFrame, key: str, own: str, other: str, number) -> DataFrame:
        marked = rows.join(parts, "block", "left").withColumns({own: F.coalesce(own, F.lit(1)), other: F.coalesce(other, F.lit(1))})
        mine = F.pmod(F.xxhash64(key), F.col(own))
        return marked.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col(other) - 1), lambda theirs: number(mine, theirs)))).drop("parts_a", "parts_b")

    return (
        dealt(probe, "row_id", "parts_a", "parts_b", lambda mine, theirs: mine * F.col("parts_b") + theirs),
        dealt(build, "object_id", "parts_b", "parts_a", lambda mine, theirs: theirs * F.col("parts_b") + mine),
    )


def _best(scored: DataFrame) -> DataFrame:
    """The highest score of each row, ties by object id."""
    return scored.groupBy("row_id").agg(F.min_by(F.struct("object_id", "score"), F.struct(-F.col("score"), F.col("object_id"))).alias("_m")).select("row_id", "_m.*")


def scored_matches(
    schedule: DataFrame,
    objects: DataFrame,
    weights: dict[str, float] = R.MATCH_WEIGHTS,
    least: float = R.MIN_MATCH_SCORE,
    block_pairs: int = BLOCK_PAIRS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Best object per schedule row by weighted score, when the score reaches ``least``.

    Both frames carry level_name, category, path and name; schedule rows have ``row_id``,
    objects ``object_id``. The score adds the weights of equal levels, categories and paths
    and the weighted similarity of the names; ties go to the smallest object id.

    The name weight alone never reaches the limit, so an accepted pair shares some set of
    attributes, and that set fixes how similar the names must be. Rows of all sets meet in one
    join on the block of attributes and rare name tokens (prefix filtering); the lengths of the
    names and the position of the token rule out pairs before they are formed, and blocks with
    very many pairs are split on both sides. Names that share no rare token are as similar as their
    common tokens and lengths say, so they are compared by these alone, once for all names with the
    same outline, and the smallest object stands for its outline. Where the attributes suffice, one
    object stands for all whose names are not similar.
    """
    weight = {"level_name": weights["level"], "category": weights["category"], "path": weights["path"]}
    common = common_tokens(schedule.select("name").unionByName(objects.select("name")))
    a = stored(_described(schedule, "row_id", common), "plan_names")
    b = stored(_described(objects, "object_id", common), "object_names")
    candidates: list[DataFrame] = []
    sets: list[tuple[list[str], float]] = []

    def named(df: DataFrame, side: str, key: str, tokens: str) -> DataFrame:
        return df.select(key, F.col(tokens).alias(f"t{side}"), F.col("n").alias(f"n{side}"), *[F.col(c).alias(f"{side}_{c}") for c in _ATTRIBUTES])

    for bits in range(1, 8):
        shared = [c for i, c in enumerate(_ATTRIBUTES) if bits >> i & 1]
        needed = (least - sum(weight[c] for c in shared)) / weights["name"]
        if needed > 1 + 1e-9:
            continue
        if needed <= 1e-9:
            first = b.groupBy(*shared).agg(F.min_by(F.struct(*b.columns), "object_id").alias("_o")).select("_o.*")
            candidates.append(named(a, "a", "row_id", "tokens").join(named(first, "b", "object_id", "tokens"), [F.col(f"a_{c}") == F.col(f"b_{c}") for c in shared]))
        sets.append((shared, min(1.0, max(needed, NAME_CUTOFF))))

    def met(x: DataFrame, y: DataFrame, tokens: str) -> DataFrame:
        probe, build = _split_blocks(_in_blocks(x, "row_id", "a", sets, tokens), _in_blocks(y, "object_id", "b", sets, tokens), block_pairs, part_rows)
        na, nb, limit = F.col("na"), F.col("nb"), F.col("least")
        # From the first shared token on, no more than the shorter rest can be shared.
        reach = F.least(na - F.col("at_a"), nb - F.col("at_b"))
        possible = (na >= limit * nb - 1e-9) & (nb >= limit * na - 1e-9) & (reach >= limit / (1 + limit) * (na + nb) - 1e-9)
        # The rows of all blocks are far larger than the stored names, whose size must not lead to a broadcast.
        found = probe.join(build.drop("least").hint("merge"), ["block", "part"]).filter(possible)
        return found.drop("block", "part", "least", "at_a", "at_b")

    def best_of(pairs: DataFrame) -> DataFrame:
        score = F.lit(0.0)
        for c in _ATTRIBUTES:
            score = score + F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), weight[c]).otherwise(0.0)
        score = F.round(score + name_similarity(F.col("ta"), F.col("tb"), F.col("na"), F.col("nb")) * weights["name"], 6)
        return _best(pairs.select("row_id", "object_id", score.alias("score")).filter(F.col("score") >= least))

    if sets:
        candidates.append(met(a, b, "rare"))
    if not candidates:
        return schedule.select("row_id", F.lit(None).cast(objects.schema["object_id"].dataType).alias("object_id"), F.lit(0.0).alias("score")).limit(0)
    pairs = candidates[0]
    for frame in candidates[1:]:
        pairs = pairs.unionByName(frame)
    best = best_of(pairs)
    if common:
        outlines = a.groupBy(*_OUTLINE).agg(F.min("row_id").alias("row_id"))
        places = b.groupBy(*_OUTLINE).agg(F.min("object_id").alias("object_id"))
        by_outline = best_of(met(stored(outlines, "plan_outlines"), stored(places, "object_outlines"), "often"))
        by_outline = outlines.join(by_outline, "row_id").drop("row_id")
        best = _best(best.unionByName(a.hint("merge").join(by_outline, _OUTLINE).select("row_id", "object_id", "score")))
    described = [*_ATTRIBUTES, "tokens"]
    per_description = a.hint("merge").join(best, "row_id").select(*described, "object_id", "score")
    rows = schedule.select("row_id", *[F.coalesce(c, F.lit("")).alias(c) for c in _ATTRIBUTES], rarest_first(F.col("name"), common).alias("tokens"))
    return rows.hint("merge").join(per_description, described).select("row_id", "object_id", "score")
