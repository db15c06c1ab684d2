"""Parent links to full hierarchies: path, depth, top, descendants and cycles of every node.

The trees are cut into heavy chains: each inner node passes its chain on to the child with the largest subtree, so that any way to a top
node crosses at most log2(n) chains. Chains are laid out so that a chain, and every subtree, is an interval of positions. All steps are
joins and aggregates over integer ids whose number grows with the logarithm of the depth; none collects a tree or a chain into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.scratch import Scratch
from tessera.sources.tables import key_of

SEPARATOR = " > "
#: Nodes of a chain whose labels one task joins at once.
BLOCK = 64
#: Parts into which the children of one parent are dealt when their intervals are laid out.
DEALT = 16


def climb(links: DataFrame, scratch: Scratch, adds: Sequence[str] = (), own: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Follow ``up`` from each ``id`` to its end by pointer doubling.

    ``links`` has (id, up, adds...): each ``up`` is null or the id of another row. Gives three tables: (id, top, steps, adds...), the adds
    summed over the way, for the ways that end; (id, far) for those that never do; with ``own``, a column of sizes, (id, below): the sum of
    the sizes of all nodes below each node that has any. Takes log2(longest way) rounds; a round moves only the nodes still under way.
    """
    ended = [scratch.keep(links.where("up is null").select("id", F.col("id").alias("top"), F.lit(0).cast("long").alias("steps"), *[F.lit(0).cast("long").alias(a) for a in adds]), "ended")]
    going = scratch.keep(links.where("up is not null").select("id", F.col("up").alias("far"), F.lit(1).cast("long").alias("steps"), *[F.col(a).cast("long").alias(a) for a in adds], *([F.col(own).cast("long").alias("size")] if own else [])), "going")
    below: list[DataFrame] = []
    latest, n, k = going, going.count(), 0
    while n:
        known = going.select("id", F.col("far").alias("top"), "steps", *adds)
        for e in ended:
            known = known.unionByName(e)
        known = known.select(F.col("id").alias("k_id"), F.col("top").alias("k_far"), F.col("steps").alias("k_steps"), *[F.col(a).alias(f"k_{a}") for a in adds])
        step = going.join(known, going["far"] == known["k_id"])
        fields = ["id", F.col("k_far").alias("far"), (F.col("steps") + F.col("k_steps")).alias("steps"), *[(F.col(a) + F.col(f"k_{a}")).alias(a) for a in adds]]
        if own:
            gained = scratch.keep(going.groupBy("far").agg(F.sum("size").alias("gain")), "gained")
            below.append(gained)
            step = step.join(gained.select(F.col("far").alias("g_id"), "gain"), F.col("id") == F.col("g_id"), "left")
            fields.append((F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"))
        stepped = scratch.keep(step.select(*fields, (F.col("k_steps") < 2**k).alias("fin")), "step", by="fin")
        ended.append(stepped.where("fin").select("id", F.col("far").alias("top"), "steps", *adds))
        going = stepped.where("not fin").drop("fin")
        scratch.drop(latest, "fin=false" if k else "")
        latest = stepped
        left = going.count()
        if left == n:  # no way has a length in this power of two, so none is longer: what is left never ends
            break
        n, k = left, k + 1
    all_ended = ended[0]
    for e in ended[1:]:
        all_ended = all_ended.unionByName(e)
    sums = None
    if own:
        sums = links.select(F.col("id").alias("far"), F.lit(0).cast("long").alias("gain")).limit(0)
        for b in below:
            sums = sums.unionByName(b)
        sums = sums.groupBy(F.col("far").alias("id")).agg(F.sum("gain").alias("below"))
    return all_ended, going.select("id", "far"), sums


def _smallest_on_cycle(loops: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, least): for nodes whose way up ends in a cycle, the smallest key on that cycle. ``loops`` has (id, up, key)."""
    state = scratch.keep(loops.select("id", F.col("up").alias("far"), F.col("key").alias("least")), "loop")
    n, reach = state.count(), 1
    while reach < n:  # afterwards each far is on its cycle and each least covers a whole turn
        ahead = state.select(F.col("id").alias("a_id"), F.col("far").alias("a_far"), F.col("least").alias("a_least"))
        after = scratch.keep(state.join(ahead, F.col("far") == F.col("a_id")).select("id", F.col("a_far").alias("far"), F.least("least", "a_least").alias("least")), "loop")
        scratch.drop(state)
        state, reach = after, reach * 2
    turn = state.select(F.col("id").alias("a_id"), F.col("least").alias("a_least"))
    return state.join(turn, F.col("far") == F.col("a_id")).select("id", F.col("a_least").alias("least"))


def _segments(nodes: DataFrame) -> DataFrame:
    """Adds ``seg``: the labels of the node's chain from its head down to the node. Chains of one node need no shuffle."""
    alone = nodes.where("chain_len = 1").withColumn("seg", F.col("label"))
    chained = nodes.where("chain_len > 1").withColumn("block", F.floor(F.col("pos") / BLOCK))
    within = Window.partitionBy("chain", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    chained = chained.withColumn("seg", F.array_join(F.collect_list("label").over(within), SEPARATOR))
    last = chained.where((F.col("pos") % BLOCK == BLOCK - 1)).select(F.col("chain").alias("b_chain"), (F.col("block") + 1).alias("b_block"), "seg")
    before = Window.partitionBy("b_chain").orderBy("b_block").rowsBetween(Window.unboundedPreceding, 0)
    last = last.select("b_chain", "b_block", F.array_join(F.collect_list("seg").over(before), SEPARATOR).alias("b_seg"))
    chained = chained.join(last, (F.col("chain") == F.col("b_chain")) & (F.col("block") == F.col("b_block")), "left")
    chained = chained.withColumn("seg", F.concat_ws(SEPARATOR, "b_seg", "seg")).drop("block", "b_chain", "b_block", "b_seg")
    return alone.unionByName(chained)


def hierarchy(nodes: DataFrame, key: str, parent: str, label: Column, carry: Sequence[str] = (), intervals: bool = True) -> DataFrame:
    """Every node with its path, depth, top node and place in the order of subtrees.

    ``nodes`` has one row per key (see ``current_rows``). Keys are compared trimmed; a null or blank parent is none. Result, one row per
    node with a key: key, parent (trimmed), ``status`` (rooted: the way up ends at a node without a parent; dangling: it ends at a parent
    key without a row; cycle: it ends in a cycle), ``top_node`` (the topmost node with a row, for cycles the smallest key on the cycle),
    ``depth`` (0 at the top), ``path`` (labels from the top down; a null label is blank), ``carry`` columns and, with ``intervals``,
    ``pos_first``, ``pos_last`` and ``tree_size``: a node's descendants are the nodes of the same ``top_node`` with pos_first < their
    pos_first <= pos_last. Depth, path and interval are null for cycles. An empty table gives an empty result.
    """
    scratch = Scratch(nodes.sparkSession, "hierarchy")
    keyed = nodes.select(key_of(key).alias("key"), key_of(parent).alias("pkey"), F.coalesce(label, F.lit("")).alias("label"), *[F.col(c).alias(f"c_{c}") for c in carry]).where("key is not null")
    keyed = scratch.keep(keyed.withColumn("id", F.monotonically_increasing_id()), "keyed")
    ids = keyed.select(F.col("key").alias("p_key"), F.col("id").alias("up"))
    linked = keyed.where("pkey is not null").join(ids, F.col("pkey") == F.col("p_key"), "left").drop("p_key")
    base = scratch.keep(linked.unionByName(keyed.where("pkey is null").withColumn("up", F.lit(None).cast("long"))), "base")
    scratch.drop(keyed)

    # Most nodes are leaves; what they need follows from their parent. The rest is done for inner nodes (and tops) alone, each of the
    # size of itself and its leaves.
    links = base.select("id", "up")
    fan = scratch.keep(links.where("up is not null").groupBy(F.col("up").alias("f_id")).agg(F.count("*").alias("kids")), "fan")
    split = scratch.keep(links.join(fan, F.col("id") == F.col("f_id"), "left").select("id", "up", (F.col("kids").isNull() & F.col("up").isNotNull()).alias("leaf")), "split", by="leaf")
    leaves = split.where("leaf").select("id", "up")
    leafy = leaves.groupBy(F.col("up").alias("l_id")).agg(F.count("*").alias("leaves"))
    inner = scratch.keep(split.where("not leaf").join(leafy, F.col("id") == F.col("l_id"), "left").select("id", "up", (F.coalesce("leaves", F.lit(0)) + 1).alias("own")), "inner")

    first = scratch.child("climb")
    ended, endless, below = climb(inner, first, own="own")
    loops = endless.select("id").join(base.select("id", "up", "key"), "id")
    cycles = scratch.keep(_smallest_on_cycle(loops, scratch), "cycles")
    size = (F.col("own") + F.coalesce("below", F.lit(0))).alias("size")
    sized = scratch.keep(ended.join(inner, "id").join(below, "id", "left").select("id", "up", "top", "steps", "own", size), "sized")
    first.drop()
    largest = F.max(F.struct("size", (-F.col("id")).alias("minus"))).alias("h")
    heavy = sized.where("up is not null").groupBy("up").agg(largest).select(F.col("up").alias("h_up"), (-F.col("h.minus")).alias("h_id"), F.col("h.size").alias("h_size"))
    if intervals:
        heavy = heavy.join(sized.select(F.col("id").alias("h_up"), F.col("own").alias("h_own")), "h_up")
    else:
        heavy = heavy.withColumn("h_own", F.lit(0).cast("long"))
    heavy = scratch.keep(heavy, "heavy")
    chained = sized.join(heavy, F.col("id") == F.col("h_id"), "left").select("id", F.col("up").alias("attach"), F.col("h_up").alias("up"), F.col("h_own").alias("gap"), "top", F.col("steps").alias("head_depth"), "size")
    chained = scratch.keep(chained, "chained")
    second = scratch.child("climb")
    on_chain, _, _ = climb(chained.select("id", "up", "gap"), second, adds=["gap"])
    on_chain = scratch.keep(on_chain.select("id", F.col("top").alias("chain"), F.col("steps").alias("pos"), "gap"), "on_chain")
    second.drop()

    # One row per chain: the chain above it and where on that it hangs.
    heads = chained.where("up is null").select(F.col("id").alias("head"), "attach", "top", "head_depth", "size")
    hung = heads.join(on_chain.select(F.col("id").alias("a_id"), F.col("chain").alias("a_chain"), F.col("gap").alias("a_gap")), F.col("attach") == F.col("a_id"), "left").drop("a_id")
    lengths = on_chain.groupBy(F.col("chain").alias("head")).agg(F.count("*").alias("chain_len"))
    hung = hung.join(lengths, "head")
    if intervals:
        light = heads.where("attach is not null").select(F.col("head").alias("id"), F.col("attach").alias("up"), "size")
        placed = _dealt_starts(light).join(heavy, F.col("up") == F.col("h_up"))
        hung = hung.join(placed.select(F.col("id").alias("head"), (F.col("start") + F.col("h_size") + F.col("h_own")).alias("offset")), "head", "left")
    else:
        hung = hung.withColumn("offset", F.lit(0).cast("long"))
    hung = scratch.keep(hung, "hung")
    third = scratch.child("climb")
    over, _, _ = climb(hung.select(F.col("head").alias("id"), F.col("a_chain").alias("up"), (F.col("a_gap") + F.coalesce("offset", F.lit(0))).alias("base")), third, adds=["base"])
    chains = over.select(F.col("id").alias("chain"), F.col("steps").alias("level"), "base").join(hung.select(F.col("head").alias("chain"), "attach", "chain_len", "top", "head_depth"), "chain")

    labelled = on_chain.join(base.select("id", "label"), "id").join(chains, "chain")
    levels = _segments(labelled).select("id", "level", "attach", "top", (F.col("head_depth") + F.col("pos")).alias("depth"), (F.col("base") + F.col("gap")).alias("pos_first"), "seg")
    levels = scratch.keep(levels, "levels", by="level")
    third.drop()
    hangers = scratch.keep(hung.where("attach is not null").select(F.col("attach").alias("id")).distinct(), "hangers")
    deepest = levels.agg(F.max("level")).first()[0]
    path = levels.where("level = 0").select("id", "top", "depth", "pos_first", F.col("seg").alias("path"))
    above = path
    for level in range(1, (deepest or 0) + 1):
        above = above.join(hangers, "id", "left_semi").select(F.col("id").alias("a_id"), F.col("path").alias("a_path"))
        here = levels.where(F.col("level") == level).join(above, F.col("attach") == F.col("a_id"))
        above = scratch.keep(here.select("id", "top", "depth", "pos_first", F.concat_ws(SEPARATOR, "a_path", "seg").alias("path")), "paths")
        path = path.unionByName(above)

    # Each node from its parent; then its place.
    over_it = path.select(F.col("id").alias("o_id"), F.col("top").alias("o_top"), F.col("depth").alias("o_depth"), F.col("path").alias("o_path"), F.col("pos_first").alias("o_first"))
    under = base.where("up is not null").join(over_it, F.col("up") == F.col("o_id"))
    under = under.select(*base.columns, F.col("o_top").alias("top"), (F.col("o_depth") + 1).alias("depth"), F.concat_ws(SEPARATOR, "o_path", "label").alias("path"))
    tops = base.where("up is null").select("*", F.col("id").alias("top"), F.lit(0).cast("long").alias("depth"), F.col("label").alias("path"))
    rooted = under.unionByName(tops)
    if intervals:
        own_place = path.select("id", "pos_first").join(sized.select("id", "size"), "id").select("id", "pos_first", (F.col("pos_first") + F.col("size") - 1).alias("pos_last"))
        ranked = _dealt_starts(leaves.withColumn("size", F.lit(1).cast("long")))
        leaf_place = ranked.join(over_it, F.col("up") == F.col("o_id")).select("id", (F.col("o_first") + 1 + F.col("start")).alias("pos_first"))
        rooted = rooted.join(own_place.unionByName(leaf_place.withColumn("pos_last", F.col("pos_first"))), "id")
    ends = sized.where("up is null").select("id", F.col("size").alias("tree_size")).join(base.where("up is null").select("id", "key", "pkey"), "id")
    ends = ends.select(F.col("id").alias("top"), F.col("pkey").isNotNull().alias("dangles"), F.col("key").alias("top_node"), "tree_size")
    rooted = rooted.join(ends, "top").withColumn("status", F.when(F.col("dangles"), "dangling").otherwise("rooted"))
    caught = base.join(cycles.withColumnRenamed("id", "o_id"), F.col("up") == F.col("o_id")).withColumn("status", F.lit("cycle")).withColumn("top_node", F.col("least"))
    names = [F.col("key").alias(key), F.col("pkey").alias(parent), "status", "top_node", *[F.col(f"c_{c}").alias(c) for c in carry]]
    out = rooted.select(*names, "depth", "path", *(["pos_first", "pos_last", "tree_size"] if intervals else []))
    return out.unionByName(caught.select(*names), allowMissingColumns=True)


def _dealt_starts(rows: DataFrame) -> DataFrame:
    """(id, up, start): the sum of the sizes of the siblings before each row. Siblings are dealt into parts, so that no task holds all
    children of a parent with very many."""
    rows = rows.withColumn("deal", F.pmod(F.hash("id"), F.lit(DEALT)))
    parts = rows.groupBy("up", "deal").agg(F.sum("size").alias("dealt"))
    parts = parts.withColumn("before", F.sum("dealt").over(Window.partitionBy("up").orderBy("deal")) - F.col("dealt")).drop("dealt")
    run = F.sum("size").over(Window.partitionBy("up", "deal").orderBy("id")) - F.col("size")
    return rows.withColumn("run", run).join(parts, ["up", "deal"]).select("id", "up", (F.col("before") + F.col("run")).alias("start"))


def descendants(tree: DataFrame, key: str) -> DataFrame:
    """(key, descendant, distance): each node with each node below it.

    ``tree`` is the result of ``hierarchy`` with intervals. A node's ancestors are the nodes of its tree whose interval holds its position.
    Both sides are cut into dyadic intervals so that the match is an equi-join: an interval falls into at most 2*log2(n) of them and a
    position into log2(n). Nodes of cycles have no descendants.
    """
    placed = tree.where("pos_first is not null").select(F.col(key).alias("k"), "top_node", "depth", "pos_first", "pos_last", F.explode(F.sequence(F.lit(0), F.floor(F.log2("tree_size")).cast("int"))).alias("bit"))
    # The blocks of 2^bit positions that lie in [lo, hi) while the block of twice the size around them doesn't: at most two per bit.
    size = F.expr("shiftleft(1L, bit)")
    lo, hi = F.col("pos_first") + 1, F.col("pos_last") + 1
    spans = placed.where("pos_last > pos_first").withColumns({"a": F.ceil(lo / size), "b": F.floor(hi / size), "oa": F.ceil(lo / (size * 2)) * 2, "ob": F.floor(hi / (size * 2)) * 2}).where("a < b")
    spans = spans.withColumn("block", F.explode(F.array_distinct(F.array(F.col("a"), F.col("b") - 1)))).where("oa >= ob or block < oa or block >= ob")
    spans = spans.select("k", "top_node", "depth", "bit", "block")
    points = placed.select(F.col("k").alias("descendant"), "top_node", F.col("depth").alias("d_depth"), "bit", F.expr("shiftright(pos_first, bit)").alias("block"))
    pairs = spans.join(points, ["top_node", "bit", "block"])
    return pairs.select(F.col("k").alias(key), "descendant", (F.col("d_depth") - F.col("depth")).alias("distance"))
