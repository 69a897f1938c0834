"""Trie of shared conversation prefixes, rolled up by centroid decomposition.

Building. Turns are sorted over the cluster and numbered by counts per partition
and conversation. Each turn becomes a 128-bit digest of its place, role and
text, and the prefix of d turns is the sum of its first d digests (two levels of
running sums, so a long conversation is many short windows). Equal sums of equal
depth are one node; its name is its smallest member and its depth, and
``members`` says for every conversation which node its first d turns are.

Rolling up. The parent edges form one tree. A component of it (a connected part,
with the node nearest the root as its top) is split at its centroid, the deepest
node with at least half of the component below it: the total of what lies below
the centroid is final there and is added to every node on the path from the
centroid to the top, the sizes on that path shrink by as much, and the centroid
goes. What is left are the parts below it and the part above, each at most half
as large; all components are split at once, so there are as many rounds as
halvings. Components of at most LOCAL_NODES go on in one task each by the same
rule. Paths and sides are found in ``members``: the prefixes of a node's smallest
member are its ancestors.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm.common import drop, store

BASE_EVERY = 20              # conversation c takes its first turns from c - c % BASE_EVERY
MOST_TAKEN = 3               # as many as crc32(c) % (MOST_TAKEN + 1)
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_TURNS = 4096           # turns of one running sum
LOCAL_NODES = 2048           # components up to this size are rolled up in one task
ENDS_TOGETHER = 8192         # ids joined to one text before hashing
LOW_BITS = (1 << 32) - 1
LOW_PLACE = (1 << 33) - 1    # bits of monotonically_increasing_id within a partition


# ---------------------------------------------------------------- rebuilt turns

def _digests(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))


def _numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(conv, pos, taken, given, h1, h2, words) of the original turns, and (conv, n, base, taken, given, length); stored.

    ``taken``: the number of a conversation's own first turns that go; ``given``: of those that its base gives.
    """
    digests, first = store(_digests(conversations), "trie-digests")
    # partitions cut one conversation, even one place of it, where rows are many
    ordered = digests.repartitionByRange("conv", "turn", "h1", "h2", "row").sortWithinPartitions("conv", "turn", "h1", "h2", "row")
    at = F.monotonically_increasing_id()
    rows, second = store(ordered.drop("turn", "row").withColumn("at", at).withColumn("part", F.shiftright("at", 33))
                         .withColumn("at", F.col("at").bitwiseAND(LOW_PLACE)), "trie-sorted")
    parts = rows.groupBy("conv", "part").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n"))
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.withColumn("base", F.col("conv") - F.col("conv") % BASE_EVERY).withColumn(
        "taken", F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_TAKEN + 1))
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    given = F.least("taken", F.coalesce("base_n", F.lit(0)))
    convs, third = store(convs.select("conv", "n", "base", "taken", given.alias("given"), (given + F.greatest(F.col("n") - F.col("taken"), F.lit(0))).alias("length")),
                         "trie-conversations")
    placed = rows.join(parts.select("conv", "part", "least", "before").join(convs.select("conv", "taken", "given"), "conv"), ["conv", "part"])
    numbered, fourth = store(placed.select("conv", (F.col("at") - F.col("least") + F.col("before")).alias("pos"), "taken", "given", "h1", "h2", "words"),
                             "trie-numbered")
    for path in (first, second):
        drop(conversations.sparkSession, path)
    return numbered, convs, [third, fourth]


def rebuilt_turns(numbered: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, h1, h2, words): the turns of every rebuilt conversation, from depth 1."""
    own = numbered.where("pos >= taken").select("conv", (F.col("pos") - F.col("taken") + F.col("given") + 1).alias("depth"), "h1", "h2", "words")
    heads = numbered.where((F.col("pos") < MOST_TAKEN) & (F.col("conv") % BASE_EVERY == 0)).select(F.col("conv").alias("base"), "pos", "h1", "h2", "words")
    given = convs.where("given > 0").join(heads, "base").where("pos < given").select("conv", (F.col("pos") + 1).alias("depth"), "h1", "h2", "words")
    return own.unionByName(given)


def prefix_keys(turns: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, words): the 128-bit key of every prefix."""
    halves = [F.xxhash64("depth", "h1", "h2"), F.xxhash64(F.lit(1), "depth", "h1", "h2")]
    parts = [p for h in halves for p in (F.shiftrightunsigned(h, 32), h.bitwiseAND(LOW_BITS))]     # sums stay within a long
    names = [f"s{i}" for i in range(4)]
    cut = turns.select("conv", "depth", "words", F.expr(f"(depth - 1) div {CHUNK_TURNS}").alias("chunk"), *[p.alias(n) for p, n in zip(parts, names)])
    inner = Window.partitionBy("conv", "chunk").orderBy("depth")
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("conv", "chunk").agg(*[F.sum(n).alias(n) for n in names])
    before = totals.select("conv", "chunk", *[F.sum(n).over(earlier).alias(f"b{n}") for n in names]).where("chunk > 0")
    sums = cut.select("conv", "depth", "words", "chunk", *[F.sum(n).over(inner).alias(n) for n in names]).join(before, ["conv", "chunk"], "left")
    mod = [(F.col(n) + F.coalesce(f"b{n}", F.lit(0))).bitwiseAND(LOW_BITS) for n in names]
    return sums.select("conv", "depth", F.shiftleft(mod[0], 32).bitwiseOR(mod[1]).alias("k1"), F.shiftleft(mod[2], 32).bitwiseOR(mod[3]).alias("k2"), "words")


# ---------------------------------------------------------------- nodes

def members_of(keys: DataFrame, convs: DataFrame) -> tuple[DataFrame, str]:
    """(conv, depth, rep, n_convs, words) for depths from 0: the node of every prefix, named by its smallest member; stored."""
    nodes = keys.groupBy("depth", "k1", "k2").agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n_convs"))
    found = keys.join(nodes, ["depth", "k1", "k2"]).select("conv", "depth", "rep", "n_convs", "words")
    root = convs.agg(F.min("conv"), F.count(F.lit(1))).first()
    top = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(root[0]).cast("long").alias("rep"),
                       F.lit(root[1]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    return store(found.unionByName(top), "trie-members")


def steps_of(members: DataFrame) -> tuple[DataFrame, str]:
    """(conv, depth, rep, next): the node of every prefix and the next one's, null at the end; stored."""
    following = members.select("conv", (F.col("depth") - 1).alias("depth"), F.col("rep").alias("next"))
    return store(members.select("conv", "depth", "rep").join(following, ["conv", "depth"], "left"), "trie-steps")


def nodes_of(members: DataFrame, steps: DataFrame, convs: DataFrame) -> DataFrame:
    """(rep, depth, parent, n_convs, n_children, size, leaves, saved): every node; ``size`` counts the nodes below and itself.

    A conversation owns the nodes whose smallest member it is, the last so many
    of its path. A node's size is the sum, over its members, of the owned nodes
    at or below it.
    """
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")

    def rows(source, **values):
        columns = {"n_convs": none, "words": none, "parent": none, "n_children": zero, "size": zero} | values
        return source.select("rep", "depth", *[v.alias(k) for k, v in columns.items()])
    owned = members.where("conv = rep").groupBy("conv").agg(F.min("depth").alias("start"))
    owners = convs.select("conv", "length").join(owned, "conv")
    edges = steps.where("next = conv")                        # from a node to one that the conversation owns
    found = [rows(members.where("conv = rep"), n_convs=F.col("n_convs"), words=F.col("words")),
             rows(edges.select(F.col("next").alias("rep"), (F.col("depth") + 1).alias("depth"), F.col("rep").alias("up")), parent=F.col("up")),
             rows(edges, n_children=F.lit(1).cast("long")),
             rows(members.join(owners, "conv"), size=F.col("length") - F.greatest("start", "depth") + 1)]
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    summed = every.groupBy("rep", "depth").agg(F.max("n_convs").alias("n_convs"), F.max("words").alias("words"), F.max("parent").alias("parent"),
                                               F.sum("n_children").alias("n_children"), F.sum("size").alias("size"))
    return summed.select("rep", "depth", "parent", "n_convs", "n_children", "size", (F.col("n_children") == 0).cast("long").alias("leaves"),
                         ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))


# ---------------------------------------------------------------- rollup

def rolled_up(parent: list[int], values: list[tuple[int, ...]]) -> list[list[int]]:
    """Subtree sums of one component; a node stands after its parent (-1: the top), ``values`` has one tuple a node."""
    total = [[0] * len(v) for v in values]
    waiting = [list(range(len(parent)))]
    side, size = [0] * len(parent), [0] * len(parent)
    while waiting:
        nodes = waiting.pop()
        inside = set(nodes)
        for v in nodes:
            size[v] = 1
        for v in reversed(nodes):
            if parent[v] in inside:
                size[parent[v]] += size[v]
        centroid = min((v for v in nodes if 2 * size[v] >= len(nodes)), key=size.__getitem__)
        above, below = [], {}
        for v in nodes:                                       # parents first
            up = parent[v]
            if v == centroid:
                side[v] = -2
            elif up in inside and side[up] == -2:
                side[v] = v
            else:
                side[v] = side[up] if up in inside and side[up] >= 0 else -1
            if side[v] == -1:
                above.append(v)
            elif side[v] >= 0:
                below.setdefault(side[v], []).append(v)
        amount = list(values[centroid])
        for part in below.values():
            for v in part:
                for i, x in enumerate(values[v]):
                    amount[i] += x
        v = centroid
        while v in inside:                                    # the centroid and its path to the top
            for i, x in enumerate(amount):
                total[v][i] += x
            v = parent[v]
        waiting += [part for part in (above, *below.values()) if part]
    return total


NODE = ["rep", "depth", "parent", "n_convs", "n_children"]
ROLLED = ", ".join(f"{c} long" for c in (*NODE, "n_leaves", "saved_tokens"))


def _local_rollup(batches):
    """Rows sorted by component and depth; a component has at most LOCAL_NODES of them."""
    def finish(rows):
        at = {(r["rep"], r["depth"]): i for i, r in enumerate(rows)}
        parent = [at.get((r["parent"], r["depth"] - 1), -1) for r in rows]
        for r, (leaves, saved) in zip(rows, rolled_up(parent, [(r["leaves"], r["saved"]) for r in rows])):
            out["n_leaves"].append(r["add_leaves"] + leaves)
            out["saved_tokens"].append(r["add_saved"] + saved)
            for c in NODE:
                out[c].append(r[c])

    def batch_of():
        return pa.record_batch({c: pa.array(v, pa.int64()) for c, v in out.items()})
    out, rows, last = {c: [] for c in (*NODE, "n_leaves", "saved_tokens")}, [], None
    for batch in batches:
        for r in batch.to_pylist():
            now = (r["comp_rep"], r["comp_depth"])
            if rows and now != last:
                finish(rows)
                rows = []
            rows.append(r)
            last = now
        if out["rep"]:
            yield batch_of()
            for v in out.values():
                v.clear()
    if rows:
        finish(rows)
        yield batch_of()


def whole_tree(nodes: DataFrame, root: int) -> DataFrame:
    """``nodes`` as one component, whose top is the root, with nothing added yet."""
    zero = F.lit(0).cast("long")
    return nodes.withColumns({"comp_rep": F.lit(root).cast("long"), "comp_depth": zero, "add_leaves": zero, "add_saved": zero})


def rollup(state: DataFrame, steps: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """NODE columns, n_leaves and saved_tokens of every node, summed over its subtree; ``state`` (:func:`whole_tree`) and ``steps`` are stored."""
    zero, comp = F.lit(0).cast("long"), ["comp_rep", "comp_depth"]
    small, finished, columns = [], [], state.columns
    while True:
        # a component's top has all of it below
        tops = state.where("rep = comp_rep AND depth = comp_depth").where(F.col("size") > local_nodes).select(*comp, F.col("size").alias("comp_size"))
        tops, _ = store(tops, "trie-tops")
        if tops.isEmpty():
            small.append(state)
            break
        small.append(state.join(tops, comp, "left_anti"))
        large = state.join(tops, comp)
        centroids = large.where(F.col("size") * 2 >= F.col("comp_size")).groupBy(*comp).agg(F.min(F.struct("size", "depth", "rep")).alias("c")).select(
            *comp, F.col("c.rep").alias("c_rep"), F.col("c.depth").alias("c_depth"))
        # the ancestor of each node at the centroid's depth, and the next one towards the node
        seen = steps.select(F.col("conv").alias("rep"), F.col("depth").alias("c_depth"), F.col("rep").alias("ancestor"), "next")
        sided, sided_path = store(
            large.join(centroids, comp).join(seen, ["rep", "c_depth"], "left")
            .withColumn("under", F.coalesce((F.col("depth") >= F.col("c_depth")) & (F.col("ancestor") == F.col("c_rep")), F.lit(False)))
            .withColumn("centre", F.col("under") & (F.col("depth") == F.col("c_depth"))).drop("ancestor", "comp_size"), "trie-sides")
        totals, _ = store(sided.where("under").groupBy(*comp, "c_rep", "c_depth").agg(
            F.sum("leaves").alias("t_leaves"), F.sum("saved").alias("t_saved"), F.count(F.lit(1)).alias("t_size")), "trie-totals")
        finished.append(store(sided.where("centre").join(totals.select(*comp, "t_leaves", "t_saved"), comp).select(
            *NODE, (F.col("add_leaves") + F.col("t_leaves")).alias("n_leaves"), (F.col("add_saved") + F.col("t_saved")).alias("saved_tokens")), "trie-centroids")[0])
        # the centroid's path to its top: prefixes of its smallest member
        path = (totals.join(steps.select(F.col("conv").alias("c_rep"), "depth", "rep"), "c_rep")
                .where("depth >= comp_depth AND depth < c_depth").select("rep", "depth", "t_leaves", "t_saved", "t_size"))
        added = {c: F.coalesce(F.col(c), zero) for c in ("t_leaves", "t_saved", "t_size")}
        state, _ = store(
            sided.where("NOT centre").join(path, ["rep", "depth"], "left")
            .withColumns({"size": F.col("size") - added["t_size"], "add_leaves": F.col("add_leaves") + added["t_leaves"],
                          "add_saved": F.col("add_saved") + added["t_saved"], "comp_rep": F.when(F.col("under"), F.col("next")).otherwise(F.col("comp_rep")),
                          "comp_depth": F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("comp_depth"))})
            .select(*columns), "trie-components")
        drop(steps.sparkSession, sided_path)
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    done = rest.repartition(*comp).sortWithinPartitions(*comp, "depth", "rep").mapInArrow(_local_rollup, ROLLED)
    for more in finished:
        done = done.unionByName(more)
    return done


# ---------------------------------------------------------------- ends

def _joined_ids(batches):
    """Runs of one node's ids, joined; a long run is several rows."""
    for batch in batches:
        reps, depths, ids = (batch.column(c).to_pylist() for c in ("rep", "depth", "conv"))
        out, at = [], 0
        while at < len(ids):
            end = at + 1
            while end < len(ids) and end - at < ENDS_TOGETHER and reps[end] == reps[at] and depths[end] == depths[at]:
                end += 1
            out.append((reps[at], depths[at], ids[at], ",".join(map(str, ids[at:end]))))
            at = end
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], ["rep", "depth", "first", "ids"])


def _hashed_ids(batches):
    """One digest a node; its rows follow each other."""
    now, digest = None, None
    for batch in batches:
        out = []
        for rep, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("rep", "depth", "ids"))):
            if now != (rep, depth):
                if now:
                    out.append((*now, digest.hexdigest()))
                now, digest = (rep, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], ["rep", "depth", "ends_sha256"])
    if now:
        yield pa.record_batch([pa.array([v]) for v in (*now, digest.hexdigest())], ["rep", "depth", "ends_sha256"])


def ends_of(members: DataFrame, convs: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256) of the nodes where conversations end.

    Ids are joined to texts where they lie after a sort over the cluster; only
    the texts of a node, a few rows even for very many ids, meet in a task.
    """
    last = convs.select("conv", F.col("length").alias("depth")).join(members.select("conv", "depth", "rep"), ["conv", "depth"])
    ordered = last.select("rep", "depth", "conv").repartitionByRange("rep", "depth", "conv").sortWithinPartitions("rep", "depth", "conv")
    texts, _ = store(ordered.mapInArrow(_joined_ids, "rep long, depth long, first long, ids string"), "trie-ends")
    return texts.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first").mapInArrow(
        _hashed_ids, "rep long, depth long, ends_sha256 string")


# ---------------------------------------------------------------- whole

def trie(conversations: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text), the root included.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. Null role or text is empty;
    a null turn comes first; turns of one number are ordered by their digests;
    repeated rows are turns of their own. Rows without a conv_id belong to no
    conversation and are left out. An empty table has no conversation, so no
    root and no rows. Other columns are ignored.
    """
    numbered, convs, paths = _numbered(conversations)
    keys, keys_path = store(prefix_keys(rebuilt_turns(numbered, convs)), "trie-prefixes")
    drop(conversations.sparkSession, paths[1])
    members, _ = members_of(keys, convs)
    drop(conversations.sparkSession, keys_path)
    steps, _ = steps_of(members)
    root = convs.agg(F.min("conv")).first()[0]
    tree, _ = store(whole_tree(nodes_of(members, steps, convs), root if root is not None else 0), "trie-components")
    done = rollup(tree, steps, local_nodes)
    none = hashlib.sha256(b"").hexdigest()
    return done.join(ends_of(members, convs), ["rep", "depth"], "left").select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
