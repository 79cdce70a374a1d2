"""A Merkle manifest of a dataset: trees by language under one root, and proofs that a recursive query climbs leaf by leaf."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

#: Levels that one round builds and one step of the climb ascends, so a group has 2 ** LEVELS nodes at most.
LEVELS = 12
#: The `tree` of what has reached the root.
ROOT = -1
#: Rows of a table of places that are sent to every task; more are joined by a shuffle.
SMALL_ROWS = 100_000

#: Levels of a group from the nodes `base` up, `steps` times; a last node without a neighbour is hashed alone.
_BUILT = """
aggregate(sequence(1, steps), array(base), (levels, k) -> concat(levels, array(transform(
  sequence(0, (size(element_at(levels, -1)) - 1) div 2),
  i -> sha2(concat(element_at(levels, -1)[2 * i], coalesce(get(element_at(levels, -1), 2 * i + 1), '')), 256)))))
"""
#: Each node of a group's lowest level, with its neighbours on the way up, empty where there is none.
_SIBLINGS = """
transform(levels[0], (own, at) -> struct(at, transform(sequence(0, steps - 1), k -> coalesce(unhex(get(levels[k], shiftright(at, k) ^ 1)), X'')) AS siblings))
"""
#: What becomes of the digest `folded` over the levels whose neighbours are `siblings`; bit k of `turns` is set where that of level k is on the left.
_FOLDED = """
unhex(aggregate(if(size(siblings) = 0, CAST(array() AS ARRAY<INT>), sequence(0, size(siblings) - 1)), lower(hex(folded)), (d, k) -> sha2(
  if(shiftright(turns, k) % 2 = 1, concat(lower(hex(siblings[k])), d), concat(d, lower(hex(siblings[k])))), 256)))
"""


def leaf(n_chars: Column) -> Column:
    """The digest of a row of documents with n_chars in place of its own."""
    values = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v.cast("string")), F.lit(":"), v.cast("string")), F.lit("-")) for v in values)), 256))


def tampered() -> Column:
    """Whether tampering touches the row: 7 divides the unsigned crc32 of the decimal doc_id. A null id is not touched."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def ordered_leaves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row as a leaf with its tree and place (doc_id, tree, idx, leaf, changed), and the trees (tree, lang, n); both written.

    `changed` is the tampered leaf, null where nothing is tampered. Rows are
    sorted into ranges of (lang, doc_id, leaf) and numbered by counts of the
    ranges, so that no task orders a language. Rows that are alike in all
    three take any order, as it changes no digest.
    """
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    own = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(tampered(), leaf(more)).alias("changed"), F.monotonically_increasing_id().alias("tie"))
    rows = cut(own.repartitionByRange("lang", "doc_id", "leaf", "tie").sortWithinPartitions("lang", "doc_id", "leaf", "tie").drop("tie").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    runs = rows.groupBy("lang", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("before", F.sum("n").over(Window.partitionBy("lang").orderBy("part")) - F.col("n"))
    trees = cut(runs.groupBy("lang").agg(F.sum("n").alias("n")).withColumn("tree", (F.row_number().over(Window.orderBy("lang")) - 1).cast("long")))  # a row a language
    by_lang = _sent(trees.select(F.col("lang").alias("of"), "tree"))
    runs = cut(runs.join(by_lang, F.col("lang").eqNullSafe(F.col("of"))).select("tree", "part", "before", "first", "of"))
    numbered = rows.withColumn("in", part).join(_sent(runs), (F.col("in") == F.col("part")) & F.col("lang").eqNullSafe(F.col("of")))
    return cut(numbered.select("doc_id", "tree", (F.col("before") + F.col("at") - F.col("first")).alias("idx"), "leaf", "changed")), trees


def _rounds(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Builds trees from nodes (tree, idx, digest, height) up, `height` being the greatest: the link rows of each round, and the last node of each tree (tree, digest).

    A round takes 2 ** LEVELS nodes that follow each other as one group, so
    its rounds are as many as LEVELS goes into the greatest height. A link row
    (tree, level, idx, siblings, turns, up_idx, last) leads LEVELS levels up,
    or to the top of its tree.
    """
    lone = nodes.where("height = 0")
    links = [lone.select("tree", F.lit(0).alias("level"), "idx", F.array().cast("array<binary>").alias("siblings"), F.lit(0).cast("bigint").alias("turns"), F.lit(0).cast("bigint").alias("up_idx"), F.lit(True).alias("last"))]
    ended = [lone.select("tree", "digest")]
    for level in range(0, height, LEVELS):
        group = nodes.where(F.col("height") > level).groupBy("tree", "height", F.shiftright("idx", LEVELS).alias("group")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("rows"))
        group = group.select("tree", "height", "group", F.transform("rows", lambda r: F.lower(F.hex(r["digest"]))).alias("base"), F.least(F.lit(LEVELS), F.col("height") - level).cast("int").alias("steps"))
        built = cut(group.select("tree", "height", "group", "steps", F.expr(_BUILT).alias("levels")))
        each = built.select("tree", "height", "group", F.inline(F.expr(_SIBLINGS)).alias("at", "siblings"))
        place = F.col("at").cast("bigint")
        links.append(each.select("tree", F.lit(level).alias("level"), (F.col("group") * (1 << LEVELS) + place).alias("idx"), "siblings", place.alias("turns"), F.col("group").alias("up_idx"), (F.col("height") <= level + LEVELS).alias("last")))
        above = built.select("tree", F.col("group").alias("idx"), F.unhex(F.element_at("levels", -1)[0]).alias("digest"), "height")
        ended.append(above.where(F.col("height") <= level + LEVELS).select("tree", "digest"))
        nodes = above.where(F.col("height") > level + LEVELS)
    return links, reduce(DataFrame.unionByName, ended)


def _height(n: Column) -> Column:
    """Levels above n nodes: how often runs of two must be hashed until one is left."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def build(leaves: DataFrame, trees: DataFrame) -> tuple[DataFrame, DataFrame, str | None]:
    """Node rows that name their parent (tree, level, idx, siblings, turns, up_idx, last), subroots (tree, subroot), and the root as hex.

    A row is stored for each node of every LEVELS-th level, `siblings` holds
    the levels up to its parent's. The last row of a language leads over its
    subroot to the root.
    """
    most = max(0, (trees.agg(F.max("n")).first()[0] or 0) - 1).bit_length()
    sized = leaves.join(_sent(trees.select("tree", _height(F.col("n")).alias("height"))), "tree")
    links, tops = _rounds(sized.select("tree", "idx", F.col("leaf").alias("digest"), "height"), most)
    subroots = cut(tops.withColumnRenamed("digest", "subroot"))
    count = subroots.count()
    height = max(0, count - 1).bit_length()
    (lone, *upper), root = _rounds(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"), F.lit(height).alias("height")), height)
    way = (upper or [lone])[0].select(F.col("idx").alias("tree"), "siblings", "turns", F.col("up_idx").alias("at"))
    for more in upper[1:]:
        up = more.select(F.col("idx").alias("at"), F.col("siblings").alias("more"), F.col("turns").alias("more_turns"), "up_idx")
        way = way.join(up, "at").select("tree", F.concat("siblings", "more").alias("siblings"), F.expr("turns | shiftleft(more_turns, size(siblings))").alias("turns"), F.col("up_idx").alias("at"))
    over = _sent(cut(way.select("tree", F.col("siblings").alias("over"), F.col("turns").alias("over_turns"))))
    nodes = reduce(DataFrame.unionByName, links)
    ends = nodes.where("last").join(over, "tree").withColumns({"siblings": F.concat("siblings", "over"), "turns": F.expr("turns | shiftleft(over_turns, size(siblings))")}).drop("over", "over_turns")
    last = root.first()
    return cut(nodes.where("not last").unionByName(ends)), subroots, bytes(last.digest).hex() if last else None


#: A row for each leaf and step. The engine shuffles and keeps the rows of every step, so a step ascends LEVELS levels.
_CLIMB = f"""
WITH RECURSIVE climb(doc_id, own, leaf, tree, level, idx, folded, proof) AS (
  SELECT doc_id, tree, leaf, tree, 0, idx, coalesce(changed, leaf), X'' FROM {{leaves}}
  UNION ALL
  SELECT doc_id, own, leaf, if(last, {ROOT}L, n.tree), n.level + {{levels}}, up_idx, {_FOLDED}, aggregate(siblings, proof, (a, s) -> concat(a, s))
  FROM climb c JOIN {{nodes}} n ON n.tree = c.tree AND n.level = c.level AND n.idx = c.idx WHERE c.tree <> {ROOT}
)
SELECT doc_id, own AS tree, leaf, folded, proof FROM climb WHERE tree = {ROOT}
"""


def climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every leaf (doc_id, tree, idx, leaf, changed) to the root: doc_id, tree, leaf, folded, proof. A written table.

    Siblings are appended and the tampered digest is folded on the way. The
    recursive query runs in a session of its own, whose limit of rows is
    lifted; the caller's settings stay as they are.
    """
    spark = leaves.sparkSession
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    names = {k: f"merkle_{k}_{uuid.uuid4().hex}" for k in ("leaves", "nodes")}
    leaves.createGlobalTempView(names["leaves"])
    nodes.createGlobalTempView(names["nodes"])
    try:
        return cut(own.sql(_CLIMB.format(**{k: f"global_temp.{v}" for k, v in names.items()}, levels=LEVELS)), session=spark)
    finally:
        for v in names.values():
            spark.catalog.dropGlobalTempView(v)


def prove(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows are leaves in the order of doc_id, a null id first, within their
    lang, a null lang being a language too; rows of one id are ordered by
    their digest. A null value is hashed as `-`. A null n_chars cannot be
    tampered with. One document alone has an empty proof. An empty table has
    no rows. Other columns are not read.
    """
    leaves, trees = ordered_leaves(docs)
    nodes, subroots, root = build(leaves, trees)
    ended = climb(leaves, nodes).join(_sent(subroots), "tree")
    text = lambda c: F.lower(F.hex(c)).alias(c)
    whole = F.lit(root).cast("string")
    return ended.select("doc_id", text("leaf"), text("subroot"), whole.alias("root"), F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.lower(F.hex("folded")) == whole).alias("verified"))
