"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. Documents with one set are one class, so exact copies cost one row. The
classes enter several trees; in a tree a class follows, at every node, the branches that the node has, and goes to the
child that its minwise token there selects. Nodes of up to `leaf` classes are compared exhaustively, in blocks; larger
ones are compared with a few leaders, and their classes go on to the children.

Comparing a node. Tasks hold the minwise tokens of a block of a node, one byte each, and find its candidates: pairs of
different components that agree often enough and are of similar size. A cluster of candidates is handed on as a spanning
tree of its best pairs, so a dense cluster of m classes costs m - 1 pairs and not their square. These are confirmed on
full sets. Clusters that have other candidates and are still in different components then get their texts in one task,
where each class outside the largest component is compared with all others on full sets. Texts are never dealt by pair
beyond the trees.

Recall. A pair of Jaccard similarity s shares a child with probability s. The root has two branches, deeper nodes 1 / s
on average, so pairs at the threshold are neither lost nor doubled. With t trees a pair at the threshold is missed with
probability (1 - f(g(..g(1)))) ** t, where g stands for a generation below the root's children and f for the root:
1.5e-5 if those children are leaves, 5e-4 one generation down. Classes whose nodes lie deeper than the target recall
allows enter further rounds of independent trees, until the product of the rounds' probabilities meets the target.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing, store

#: members that all others of a large node are compared with, at each level
LEADERS = 3
#: shingles of a block: nodes of long texts are cut into more blocks
HEAVY = 1 << 20


@dataclass(frozen=True)
class Join:
    """percent: the least similarity of a link. width: words a shingle. trees: independent trees of a round. branches:
    of each tree's root. coordinates: minwise tokens of a document. leaf: classes of a node that is compared
    exhaustively. block: classes of a node that meet in one task. screen: pairs that agree in fewer of the coordinates
    than this share aren't confirmed; at the threshold, a pair falls below 76 of 128 with probability 5e-5. recall: of
    pairs at the threshold, the share to be found."""

    percent: int = 75
    width: int = 5
    trees: int = 4
    branches: int = 2
    coordinates: int = 128
    leaf: int = 4096
    block: int = 512
    screen: float = 0.59
    recall: float = 0.998
    seed: int = 11

    def missed(self, generations: int) -> float:
        """The probability that all trees of a round lose a pair at the threshold whose leaves lie so many generations
        below the root's children."""
        s, q = self.percent / 100, 1.0
        for _ in range(generations):
            q = 1 - (1 - s * q) * (1 - s * q * min(1.0, 1 / s - 1))
        return (1 - s * q) ** (self.branches * self.trees)

    @property
    def reach(self) -> int:
        """The generations below the root's children that one round reaches at the target recall."""
        return next((d for d in range(64) if self.missed(d + 1) > 1 - self.recall), 64)


def signatures(docs: DataFrame, id_col: str, text_col: str, join: Join) -> DataFrame:
    """id, mark (xxhash64 of the text), sid (16 bytes that stand for the shingle set; null for an empty one),
    n_shingles, roots (a minwise token for each branch of the roots) and sig (a byte of each minwise token)."""
    schema = f"id {dict(docs.dtypes)[id_col]}, mark long, sid binary, n_shingles long, roots array<int>, sig binary"
    draw = np.random.default_rng(join.seed)
    factors = draw.integers(0, 1 << 63, join.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = draw.integers(0, 1 << 64, join.coordinates, dtype=np.uint64)
    first = min(join.trees * join.branches, join.coordinates)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.small_slices(batch, (2,)):
                sets, cuts = hashing.shingle_sets(part.column(2), join.width)
                n, sizes = part.num_rows, np.diff(cuts)
                full = np.flatnonzero(sizes)
                least = np.zeros((n, join.coordinates), np.uint32)
                if len(full):
                    for k in range(join.coordinates):
                        tokens = ((sets * factors[k] + terms[k]) >> np.uint64(32)).astype(np.uint32)
                        least[full, k] = np.minimum.reduceat(tokens, cuts[:-1][full])
                # the low bits: least tokens have small high ones
                sigs = [row.tobytes() for row in (least & np.uint32(255)).astype(np.uint8)]
                roots = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * first, pa.array(least[:, :first].ravel().view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(class_keys(sets, cuts), pa.binary()), pa.array(sizes, pa.int64()), roots, pa.array(sigs, pa.binary())],
                    names=["id", "mark", "sid", "n_shingles", "roots", "sig"],
                )

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(task, schema)


def class_keys(sets: np.ndarray, cuts: np.ndarray) -> list[bytes | None]:
    """Sixteen bytes for each set: two sums over its members, each mixed in another way."""
    one, two = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashing.mix64(sets * np.uint64(f)))]) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
    out = np.empty((len(cuts) - 1, 2), np.uint64)
    out[:, 0], out[:, 1] = one[cuts[1:]] - one[cuts[:-1]], two[cuts[1:]] - two[cuts[:-1]]
    return [row.tobytes() if size else None for row, size in zip(out, np.diff(cuts), strict=True)]


class Forest:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart."""
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _by_group(batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch], pa.RecordBatch], least: int = 4096, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """work on whole groups (rows that are equal in the first column, which sorts them), several at a time."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= least or size >= most_bytes:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            group = whole.column(0).to_numpy()
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield work(whole.slice(0, cut))
            held = [whole.slice(cut)]
            rows, size = whole.num_rows - cut, held[0].nbytes
    if rows:
        yield work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def candidates(members: DataFrame, join: Join) -> DataFrame:
    """Of (group, half, same, cid, component, n, sig) rows: (a, b, null) for the pairs of each cluster's spanning tree,
    and (cid, null, cluster) for each member of a cluster that has candidate pairs beside its tree. Pairs of one half
    count only where same holds."""
    cut = int(join.screen * join.coordinates)
    corner: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def pairs_of(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        sizes = np.diff(np.append(starts, len(group)))
        two = starts[sizes == 2]
        if len(two):
            yield two, two + 1
        i, j, n = [], [], 0
        for at, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if m not in corner:
                if len(corner) > 64:
                    corner.clear()
                corner[m] = tuple(x.astype(np.int32) for x in np.triu_indices(m, 1))
            i.append(corner[m][0] + at)
            j.append(corner[m][1] + at)
            n += len(i[-1])
            if n >= 1 << 16:
                yield np.concatenate(i), np.concatenate(j)
                i, j, n = [], [], 0
        if n:
            yield np.concatenate(i), np.concatenate(j)

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        group, half, cid, component, n = (rows.column(k).to_numpy() for k in (0, 1, 3, 4, 5))
        same = np.asarray(rows.column(2).to_numpy(zero_copy_only=False), bool)
        sig = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint8).reshape(len(cid), -1)
        found = []
        for i, j in pairs_of(group):
            fits = (component[i] != component[j]) & ((half[i] != half[j]) | same[i]) & (100 * np.minimum(n[i], n[j]) >= join.percent * np.maximum(n[i], n[j]))
            i, j = i[fits], j[fits]
            for at in range(0, len(i), 1 << 14):
                x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                agree = np.count_nonzero(sig[x] == sig[y], axis=1)
                near = agree >= cut
                found.append((x[near], y[near], agree[near]))
        i, j, agree = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))
        a, b = np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])
        # one order for a pair wherever it turns up: trees of several nodes then have their pairs in common
        order = np.lexsort((hashing.mix64(a.view(np.uint64) * np.uint64(3) + b.view(np.uint64)), -agree))
        forest, tree, loose = Forest(len(cid)), [], []
        for k, x, y in zip(order.tolist(), i[order].tolist(), j[order].tolist(), strict=True):
            (tree if forest.join(x, y) else loose).append(k)
        busy = {forest.root(int(i[k])) for k in loose}
        rest = [(x, r) for x in np.unique(np.concatenate([i, j])).tolist() if (r := forest.root(x)) in busy] if busy else []
        who = np.array([x for x, _ in rest], np.int64)
        top = np.array([r for _, r in rest], np.int64)
        key = hashing.mix64(group[top].view(np.uint64) ^ hashing.mix64(cid[top].view(np.uint64))).view(np.int64)
        none = lambda m: pa.nulls(m, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([a[tree], cid[who]])), pa.concat_arrays([pa.array(b[tree]), none(len(who))]), pa.concat_arrays([none(len(tree)), pa.array(key)])], names=["a", "b", "cluster"]
        )

    rows = members.select("group", "half", "same", "cid", "component", "n", "sig").repartition("group").sortWithinPartitions("group")
    return rows.mapInArrow(lambda batches: _by_group(batches, work), "a long, b long, cluster long")


def similar(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have at least percent of their union in common. texts: cid, text."""
    both = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.small_slices(batch, (2, 3)):
                sides = []
                for ids, texts in ((0, 2), (1, 3)):  # a text's set is made once
                    _, first, back = np.unique(part.column(ids).to_numpy(), return_index=True, return_inverse=True)
                    sides.append((*hashing.shingle_sets(part.column(texts).take(pa.array(first)), width), back))
                (x, xc, xi), (y, yc, yi) = sides
                keep = []
                for i, j in zip(xi.tolist(), yi.tolist(), strict=True):
                    one, two = x[xc[i] : xc[i + 1]], y[yc[j] : yc[j + 1]]
                    place = np.searchsorted(one, two)
                    place[place == len(one)] = 0
                    common = int((one[place] == two).sum())
                    keep.append(100 * common >= percent * (len(one) + len(two) - common))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(task, "a long, b long")


def linked_in_clusters(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Of (cluster, cid, component, text) rows, links (a, b) that join all components of a cluster which links join.
    Every class outside a cluster's largest component is compared with all others on full sets."""

    def one(cid: np.ndarray, component: np.ndarray, text: pa.Array) -> list[tuple[int, int]]:
        sets, cuts = hashing.shingle_sets(text, width)
        _, member = np.unique(component, return_inverse=True)
        _, word = np.unique(sets, return_inverse=True)
        sizes, there = np.diff(cuts), np.zeros(len(sets), np.int32)
        forest, links = Forest(int(member.max()) + 1), []
        for x in np.flatnonzero(member != np.bincount(member).argmax()).tolist():
            own = word[cuts[x] : cuts[x + 1]]
            there[own] = 1
            common = np.add.reduceat(there[word], cuts[:-1])
            there[own] = 0
            linked = np.flatnonzero(100 * common >= percent * (sizes[x] + sizes - common))
            _, first = np.unique(member[linked], return_index=True)
            links += [(int(cid[x]), int(cid[y])) for y in linked[first] if forest.join(int(member[x]), int(member[y]))]
        return links

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        cluster, cid, component = (rows.column(k).to_numpy() for k in range(3))
        edges = [*np.flatnonzero(np.diff(cluster, prepend=cluster[0] - 1)).tolist(), len(cluster)]
        links = [x for a, b in zip(edges, edges[1:], strict=False) for x in one(cid[a:b], component[a:b], rows.column(3).slice(a, b - a))]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])

    rows = rows.select("cluster", "cid", "component", "text").repartition("cluster").sortWithinPartitions("cluster")
    return rows.mapInArrow(lambda batches: _by_group(batches, work, 512), "a long, b long")


def _starred(links: DataFrame, most: int = 200_000) -> DataFrame:
    """Links that connect the same: those that a task has at a time become stars around their least ends."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(ids))
        for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
            forest.join(x, y)
        root = np.fromiter((forest.root(x) for x in range(len(ids))), np.int64, len(ids))
        leaf = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[leaf]), pa.array(ids[root[leaf]])], names=["a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield stars(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2)))
                held, n = [], 0
        if n:
            yield stars(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2)))

    return links.select("a", "b").mapInArrow(task, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(cid, component) for every end of the links (a, b): the least id that it is connected with.

    Each round gives every node its least neighbour, follows that pointer once more, and contracts the links; stars
    end after one round and the number of nodes at least halves in each. All steps are pre-aggregated or joins."""
    stars = store.written(_starred(links), "stars")
    edges = stars.union(stars.select("b", "a")).distinct()
    label = None
    while label is None or not edges.isEmpty():
        least = store.written(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")), "pointers")
        hop = store.written(least.join(least.select(F.col("a").alias("p"), F.col("p").alias("pp")), "p").select("a", F.col("pp").alias("p")), "pointers")
        if label is None:
            label = hop.select(F.col("a").alias("cid"), F.col("p").alias("component"))
        else:
            label = store.written(label.join(hop.withColumnRenamed("a", "component"), "component", "left").select("cid", F.coalesce("p", "component").alias("component")), "labels")
        moved = edges.join(hop, "a").select(F.col("p").alias("x"), F.col("b").alias("a")).join(hop, "a")
        edges = store.written(moved.select(F.col("x").alias("a"), F.col("p").alias("b")).filter("a <> b").distinct(), "edges")
    return label


def _joined(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """comp, a table of (cid, component), after more links."""
    if comp is None:
        return components(links)
    more = components(_placed(links, comp).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    moved = comp.join(more.select(F.col("cid").alias("component"), F.col("component").alias("to")), "component", "left")
    return store.written(moved.select("cid", F.coalesce("to", "component").alias("component")).union(more.join(comp, "cid", "left_anti")), "components")


def _placed(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs that aren't in one component, with their components ca and cb."""
    for x in "ab":
        pairs = pairs.join(comp.select(F.col("cid").alias(x), F.col("component").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    return pairs.filter("ca <> cb")


def _in_components(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return rows.withColumn("component", F.col("cid"))
    return rows.join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid"))


def _roots(kin: DataFrame, seed: int) -> DataFrame:
    """(node, cid, n): the children of the trees' roots that each class goes to."""
    return kin.select(F.posexplode("roots").alias("branch", "token"), "cid", "n").select(F.xxhash64(F.lit(seed), "branch", "token").alias("node"), "cid", "n")


def _children(rows: DataFrame, kin: DataFrame, join: Join) -> DataFrame:
    """(node, cid, n): the children of (node, cid) rows. A node has one branch and with probability 1 / s - 1 a second;
    it also chooses the coordinate whose minwise token selects the child that a class goes to."""

    def child(branch: int) -> Column:
        chosen = F.xxhash64("node", F.lit(branch), F.lit(join.seed))
        token = F.substring("sig", F.pmod(chosen, F.lit(join.coordinates)).cast("int") + 1, F.lit(1))
        there = F.xxhash64("node", F.lit(branch), token)
        return there if not branch else F.when(F.pmod(F.shiftright(chosen, 20), F.lit(1000)) < round(1000 * (100 / join.percent - 1)), there)

    nodes = F.explode(F.array(child(0), child(1))).alias("node")
    return rows.select("node", "cid").join(kin.select("cid", "n", "sig"), "cid").select(nodes, "cid", "n").filter("node is not null")


def _members(frontier: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The rows of nodes that have classes of several components, with the node's number of classes (m), of shingles
    (weight), and its leaders: the classes of the least hashes."""
    rows = _in_components(frontier, comp)
    leaders = [F.min_by("cid", F.xxhash64("node", "cid", F.lit(k))).alias(f"lead{k}") for k in range(LEADERS)]
    found = rows.groupBy("node").agg(F.count("*").alias("m"), F.sum("n").alias("weight"), F.min("component").alias("c0"), F.max("component").alias("c1"), *leaders)
    return rows.join(found.filter("c0 <> c1").drop("c0", "c1"), "node")


def _in_blocks(small: DataFrame, join: Join) -> DataFrame:
    """Each member of a node of b blocks once for each of the b pairs of blocks that its own is in; same: where a block
    is paired with itself."""
    blocks = F.greatest(F.ceil(F.col("m") / join.block), F.ceil(F.col("weight") / HEAVY), F.lit(1)).cast("int")
    rows = small.withColumn("blocks", blocks).withColumn("half", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.select("node", "cid", "component", "half", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return rows.select(F.xxhash64("node", F.least("half", "other"), F.greatest("half", "other")).alias("group"), "half", (F.col("half") == F.col("other")).alias("same"), "cid", "component")


def _one_round(classes: DataFrame, comp: DataFrame | None, texts: DataFrame | None, gather: Callable[[DataFrame], DataFrame], join: Join) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None, int]:
    """One round of trees over classes: comp with its links, the texts it needed, the classes that went deeper than the
    target recall allows (or None), and the generations that were reached."""
    frontier, kin, level, deep = _roots(classes, join.seed), classes, 0, None
    while True:
        # rows of one component have nothing to look for; what a level found counts in the next
        members = store.written(_members(frontier, comp), "members")
        if members.isEmpty():
            return comp, texts, deep, level
        small, large = members.filter(F.col("m") <= join.leaf), members.filter(F.col("m") > join.leaf)
        blocks = _in_blocks(small, join).join(kin.select("cid", "n", "sig"), "cid")
        near = store.written(candidates(blocks, join), "candidates")
        pairs, clusters = near.filter("b is not null").select("a", "b"), near.filter("b is null").select(F.col("a").alias("cid"), "cluster")
        crowded = not large.isEmpty()
        if crowded:
            lead = F.explode(F.array(*[f"lead{k}" for k in range(LEADERS)])).alias("lead")
            lead = large.select("cid", lead).filter("cid <> lead").select(F.least("cid", "lead").alias("a"), F.greatest("cid", "lead").alias("b")).distinct()
            pairs = pairs.union(_screened(lead, kin, join))
        if texts is None:
            needed = near.select("a").union(near.select("b")).union(large.select("cid")) if crowded else near.select("a").union(near.select("b"))
            texts = store.written(gather(needed.toDF("cid").filter("cid is not null").distinct()), "texts")
        links = store.written(similar(pairs.distinct(), texts, join.width, join.percent), "links")
        if not links.isEmpty():
            comp = _joined(comp, links)
        left = _in_components(clusters, comp)
        apart = left.groupBy("cluster").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("cluster")
        left = store.written(left.join(apart, "cluster"), "clusters")
        if not left.isEmpty():
            links = store.written(linked_in_clusters(left.join(texts, "cid"), join.width, join.percent), "links")
            if not links.isEmpty():
                comp = _joined(comp, links)
        if not crowded:
            return comp, texts, deep, level
        if not level:  # from here on only these matter
            kin = store.written(kin.join(large.select("cid").distinct(), "cid", "left_semi"), "kin")
        level += 1
        rows = large.select("node", "cid")
        if level == join.reach + 1:
            deep = store.written(rows.select("cid").distinct(), "deep")
        frontier = _children(rows, kin, join)


def classes_of(sigs: DataFrame) -> DataFrame:
    """A row for each shingle set: cid, sid, the row that stands for it (least and mark: the one with the least id),
    n, roots and sig."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")).alias("first")
    found = sigs.filter("sid is not null").groupBy("sid").agg(first, F.first("n_shingles").alias("n"), F.first("roots").alias("roots"), F.first("sig").alias("sig"))
    return store.written(found.select(F.monotonically_increasing_id().alias("cid"), "sid", F.col("first.id").alias("least"), F.col("first.mark").alias("mark"), "n", "roots", "sig"), "classes")


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id, kept, mark (xxhash64 of the text) and first.

    component_id is the least id reachable over links, itself included, and kept says that it is the row's own. Rows
    without words (null, empty, blank) have no shingles, are linked with nothing and kept. Rows with a null id belong
    to components but don't name them; where a component has no other id, or for a row without words, component_id is
    null, and rows with a null id are kept only if their component_id is null. Ids may repeat: rows stay separate, and
    kept may hold for several of a component. first holds for one (id, mark) of each component, the one with the least
    id and then the least mark, and for rows without words; rows that are equal in both share it. An empty table gives
    an empty one. Only the two named columns are read.
    """
    sigs = store.written(signatures(docs, id_col, text_col, join), "signatures")
    classes = classes_of(sigs)
    rows_of = docs.select(F.col(id_col).alias("least"), F.col(text_col).cast("string").alias("text")).filter("text is not null").withColumn("mark", F.xxhash64("text"))

    def gather(cids: DataFrame) -> DataFrame:
        """(cid, text). The texts are shuffled once, whatever the number of classes. Equal rows give one."""
        wanted = store.written(classes.select("cid", "least", "mark").join(cids, "cid", "left_semi"), "wanted").hint("shuffle_merge")
        found = rows_of.join(wanted, rows_of["least"].eqNullSafe(wanted["least"]) & (rows_of["mark"] == wanted["mark"]))
        return found.groupBy("cid").agg(F.first("text").alias("text"))

    comp, texts, kin, plan, missed = None, None, classes, join, 1.0
    while True:
        comp, texts, deep, generations = _one_round(kin, comp, texts, gather, plan)
        missed *= join.missed(generations)
        if deep is None or missed <= 1 - join.recall:
            break
        plan = replace(plan, seed=plan.seed + 1)  # fresh trees for these
        again = signatures(texts.join(deep, "cid", "left_semi"), "cid", "text", plan)
        kin = store.written(again.select(F.col("id").alias("cid"), F.col("n_shingles").alias("n"), "roots", "sig"), "kin")

    named = _in_components(classes.select("cid", "sid", "least", "mark"), comp)
    first = F.struct(F.col("least").isNull().alias("no_id"), "least", "mark")
    if comp is not None:
        named = named.join(named.groupBy("component").agg(F.min(first).alias("first")), "component")
    else:
        named = named.withColumn("first", first)
    out = sigs.select("id", "mark", "sid", "n_shingles").join(named.select("sid", "first"), "sid", "left")
    name, empty = F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("first.least")), F.col("sid").isNull()
    return out.select(
        F.col("id").alias(id_col), "n_shingles", name.alias("component_id"), F.col("id").eqNullSafe(name).alias("kept"), "mark", (empty | (F.col("id").eqNullSafe(F.col("first.least")) & (F.col("mark") == F.col("first.mark")))).alias("first")
    )


def _screened(pairs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """The pairs of similar size that agree often enough."""
    sig = {x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab"}
    both = pairs.join(sig["a"], "a").join(sig["b"], "b").filter(100 * F.least("n_a", "n_b") >= join.percent * F.greatest("n_a", "n_b"))
    cut = int(join.screen * join.coordinates)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(np.count_nonzero(one == two, axis=1) >= cut))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(task, "a long, b long")
