"""URL filter: host and path rules first, then a tree of path templates per host.

Only DataFrame functions are used.

1. Segments that look like numbers or hexadecimal ids become `*`. Pages are counted by (host,
   path) after that, with the labelled and blocked ones among them; all later steps work on
   these rows.
2. Level by level from the root, as deep as paths go: a node whose children are many and mostly
   seen once is variable, and its children become `*`. A node of fewer than `least_pages` pages
   is not split; what lies below it is `**`.
3. At the same level a child whose share of blocked pages does not differ significantly from
   that of all its siblings (two-proportion z test) is merged with the others like it into
   the branch `~`. Children with too few labelled pages, or siblings with too few, stay.
4. A node's purity is its share of blocked pages, smoothed by `weight` pages of its parent's
   purity; the root's parent is the share overall. A template is the node at which a page ends,
   and is rejected if it has `min_labelled` labelled pages and its purity reaches `reject_from`.

Defined results: a null url or one without `://` has an empty host and path; repeated rows
repeat; labels may be null everywhere, then nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.llm.components import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIABLE_SEGMENT = r"^([0-9]+(\.[a-z]+)?|[0-9a-f-]{8,})$"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

Rule = tuple[str, str]  # (rule like "example.org/path/", "allow" or "block")


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Longest rule that fits, as a struct (rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shape(path: Column) -> Column:
    """Segments of a path, id-like ones as `*`."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike(VARIABLE_SEGMENT), "*").otherwise(s))


COUNTS = ["pages", "labelled", "blocked"]


def template_tree(counted: DataFrame, weight: float = 4.0, min_values: int = 8, min_ratio: float = 0.5,
                  min_labelled: int = 5, z_limit: float = 1.96, least_pages: int = 5) -> DataFrame:
    """(host, shape, template, purity, evidence) of rows (host, shape, pages, labelled, blocked).

    `evidence` is the number of labelled pages of the template's node.
    """
    def smoothed(parent: Column) -> Column:
        return (F.col("blocked") + weight * parent) / (F.col("labelled") + weight)

    overall = counted.agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("share")).scalar()
    roots = counted.groupBy("host").agg(*[F.sum(c).alias(c) for c in COUNTS]).select(
        "host", F.lit("").alias("template"), smoothed(F.coalesce(overall, F.lit(0.5))).alias("purity"),
        F.col("labelled").alias("evidence"))
    growing = checkpointed(counted.join(roots, "host"))
    shown = ["host", "shape", "template", "purity", "evidence"]
    ended, level = [], 0
    while not growing.isEmpty():
        level += 1
        child = F.try_element_at("shape", F.lit(level))
        placed = growing.withColumn("child", child)
        ended.append(placed.where(F.col("child").isNull()).select(*shown))
        placed = placed.where(F.col("child").isNotNull())
        node, key = ["host", "template"], ["host", "template", "child"]
        # Pages that end here are not split further, but they are siblings' company.
        whole = growing.groupBy(*node).agg(
            *[F.sum(c).alias(f"all_{c}") for c in COUNTS], F.first("purity").alias("above"))
        children = placed.groupBy(*key).agg(*[F.sum(c).alias(c) for c in COUNTS])
        values = children.groupBy(*node).agg(F.count(F.lit(1)).alias("values"), F.sum("pages").alias("below"))
        beside = children.join(whole.join(values, node), node)
        variable = (F.col("values") >= min_values) & (F.col("values") >= min_ratio * F.col("below"))
        rest = F.col("all_labelled") - F.col("labelled")
        share = F.col("all_blocked") / F.nullif("all_labelled", F.lit(0))
        gap = (F.col("blocked") / F.nullif("labelled", F.lit(0))
               - (F.col("all_blocked") - F.col("blocked")) / F.nullif(rest, F.lit(0)))
        spread = share * (1 - share) * (1 / F.nullif("labelled", F.lit(0)) + 1 / F.nullif(rest, F.lit(0)))
        similar = ((F.col("labelled") >= min_labelled) & (rest >= min_labelled)
                   & (gap * gap <= z_limit * z_limit * spread))
        name = (F.when(F.col("all_pages") < least_pages, "/**").when(variable, "/*")
                .when(F.coalesce(similar, F.lit(False)), "/~").otherwise(F.concat(F.lit("/"), "child")))
        named = checkpointed(beside.withColumn("grown", F.concat("template", name)).withColumn("closed", name == "/**"))
        grown = named.groupBy("host", "grown").agg(
            *[F.sum(c).alias(c) for c in COUNTS], F.first("above").alias("above")
        ).select("host", "grown", smoothed(F.col("above")).alias("purity"), F.col("labelled").alias("evidence"))
        moved = placed.select("host", "shape", *COUNTS, "template", "child").join(
            named.select(*key, "grown", "closed"), key).join(grown, ["host", "grown"]).select(
            "host", "shape", *COUNTS, F.col("grown").alias("template"), "purity", "evidence", "closed")
        moved = checkpointed(moved)
        ended.append(moved.where("closed").select(*shown))
        growing = moved.where(~F.col("closed")).drop("closed")
    tree = counted.select("host", "shape", F.lit("").alias("template"), F.lit(0.0).alias("purity"),
                          F.lit(0).cast("bigint").alias("evidence")).limit(0)
    for rows in ended:
        tree = tree.unionByName(rows)
    return tree


def url_verdicts(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", id_col: str = "page_id",
                 reject_from: float = 0.8, min_labelled: int = 5, **tree_options) -> DataFrame:
    """(id, host, path, rule, template, purity, verdict) of every page.

    Pages that a rule fits are the labelled ones. A rule's verdict holds; other pages get
    the verdict of their template.
    """
    host, path = F.col("host"), F.col("path")
    own = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"),
                       url_path(F.col(url_col)).alias("path"))
    own = own.withColumns({"shape": shape(path), "found": matching_rule(host, path, rules)})
    counted = checkpointed(own.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("pages"), F.count("found").alias("labelled"),
        F.count(F.when(F.col("found.verdict") == "block", 1)).alias("blocked"),
    ))
    known = template_tree(counted, min_labelled=min_labelled, **tree_options)
    judged = own.join(known, ["host", "shape"])
    rejected = (F.col("evidence") >= min_labelled) & (F.col("purity") >= reject_from)
    return judged.select(
        id_col, "host", "path", F.col("found.rule").alias("rule"), "template", "purity",
        F.coalesce(F.col("found.verdict"), F.when(rejected, "block").otherwise("allow")).alias("verdict"),
    )
