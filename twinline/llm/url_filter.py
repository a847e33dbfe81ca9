"""URL filters: a sort-merge range join of urls with prefix rules.

A rule is a host and a path; it fits the host, all its subdomains, and every path
that starts with the rule's. Written with its labels reversed and closed by a dot
(``org.example.``), a rule's host is a prefix of every key it fits, so a rule is an
interval of the sorted keys, and intervals either nest or are disjoint. The same
holds for paths. Both are matched by one sorted sweep (:func:`sweep`): rules and keys
are sorted together, and a stack of the rules that are open at each key is kept in
window slots, one for each nesting depth.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Keys of one part that a sort range holds at least, before the part is dealt over several.
RANGE_ROWS = 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a text without ``://``."""
    rest = F.expr("''")
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(known, F.substr(url, F.instr(url, "://") + 3)).otherwise(rest)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """``www.example.org`` as ``org.example.www.``, so that a parent domain is a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _last_label(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def sweep(points: DataFrame, rules: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rules whose ``(part, key)`` is a prefix of each point's, outermost first.

    ``points`` has part, key and more; ``rules`` has part and key, without repeats.
    Returns the points with ``stack``, an array of the keys of open rules; points of a
    part without rules are left out.

    A part with many points is dealt by hash over several sort ranges, each of which
    gets that part's rules. A range holds at least as many points as the part has
    rules, so the copies of rules never outnumber points and rules together.
    """
    # A rule opens at its key and closes behind the last text that starts with it
    # (0xFF is no byte of UTF-8). The running balance is the nesting depth.
    at = F.col("key").cast("binary")
    edges = rules.select("part", "key", at.alias("at"), F.lit(1).alias("step")).union(
        rules.select("part", "key", F.concat(at, F.unhex(F.lit("FF"))), F.lit(-1))
    )
    depth = F.sum("step").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    opens = edges.withColumn("depth", depth).filter("step = 1").select("part", "key", "at", "depth")
    deepest = opens.agg(F.max("depth")).first()[0] or 0

    sizes = points.groupBy("part").agg(F.count("*").alias("points"))
    ranges = (
        rules.groupBy("part")
        .agg(F.count("*").alias("rules"))
        .join(sizes, "part")
        .select("part", F.ceil(F.col("points") / F.greatest(F.lit(range_rows), "rules")).cast("int").alias("ranges"))
    )
    carried = [c for c in points.columns if c not in ("part", "key")]
    dealt = points.join(ranges, "part").select(
        "part",
        F.pmod(F.xxhash64("key", *carried), F.col("ranges").cast("long")).cast("int").alias("range"),
        at.alias("at"),
        F.lit(0).alias("depth"),
        "key",
        *carried,
    )
    copied = opens.join(ranges, "part").select(
        "part", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("range"), "at", "depth", "key"
    )
    # A rule sorts before a point of the same key.
    order = Window.partitionBy("part", "range").orderBy("at", F.desc("depth"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    slots = {
        f"slot{d}": F.last(F.when(F.col("depth") == d, F.col("key")), ignorenulls=True).over(so_far)
        for d in range(1, deepest + 1)
    }
    # What a slot last held is open only if the point still lies within it.
    frames = F.array(*slots) if slots else F.expr("array()")
    stack = F.filter(frames, lambda k: F.coalesce(F.startswith(F.col("key"), k), F.lit(False)))
    return (
        dealt.unionByName(copied, allowMissingColumns=True)
        .withColumns(slots)
        .filter("depth = 0")
        .select("part", "key", *carried, stack.cast("array<string>").alias("stack"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with the columns host, path, rule and verdict.

    ``rules`` has host, path and verdict (allow or block), any number of rows. The
    longest rule (host and path together, then host) wins; the same rule given twice
    blocks if one of them does. A url that no rule fits has a null rule and the verdict
    ``otherwise``. Null and malformed urls have an empty host and path, which no rule
    fits. Repeated rows are each judged; an empty table gives an empty one; columns of
    the same names are replaced. Rules with an empty host or a null are ignored.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.withColumns({"host": host, "path": path})
    given = (
        rules.filter("length(host) > 0 and path is not null and verdict is not null")
        .groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))
    )

    # Distinct urls first: a host or url that fills the table is one row from here on.
    urls = rows.select("host", "path").distinct()
    hosts = urls.select("host").distinct()
    by_host = sweep(
        hosts.select(_last_label(F.col("host")).alias("part"), reversed_host(F.col("host")).alias("key"), "host"),
        given.select(_last_label(F.col("rule_host")).alias("part"), reversed_host(F.col("rule_host")).alias("key")).distinct(),
    ).select("host", F.explode("stack").alias("rule_key"))
    known = given.withColumn("rule_key", reversed_host(F.col("rule_host")))
    # The part is the fitting rule's host; within it, the key is the path.
    by_path = sweep(
        urls.join(by_host, "host").select(F.col("rule_key").alias("part"), F.col("path").alias("key"), "host"),
        known.select(F.col("rule_key").alias("part"), F.col("rule_path").alias("key")),
    )
    fits = (
        by_path.filter(F.size("stack") > 0)
        .select("host", F.col("key").alias("path"), F.col("part").alias("rule_key"), F.element_at("stack", -1).alias("rule_path"))
        .join(known, ["rule_key", "rule_path"])
    )
    rule = F.concat("rule_host", "rule_path")
    best = (
        fits.groupBy("host", "path")
        .agg(F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return (
        rows.select(*kept, "host", "path")
        .join(best, ["host", "path"], "left")
        .select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
    )
