"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Documents of equal shingle sets (5 words) are one node with a number of copies. Each
node has TREES labels of DEPTH MinHash values. A tree is the sorted list of its labels:
neighbours that share a prefix of d values are a subtree of depth d of the prefix trie.
The labels of all trees are sorted once over all tasks, and each label's matched prefix
is shortened from DEPTH on, value by value, while the subtree has at most SMALL nodes
and down to FLOOR. A label whose prefix can't be shortened to FULL (its subtree is too
large, or lies at the border of two tasks) leaves its node short of recall; the sum over
the trees says how much. Nodes that stay below TARGET, for a pair at the threshold,
shorten all their prefixes to FULL values whatever the size of the subtrees, which meets
it: 1 - (1 - 0.8**6)**32 > 0.9999. (Of two nodes one at least reaches the target in the
first pass, or both are in the second.) Nodes that meet in a subtree form candidate
clusters (connected through subtrees, not by pairs). Each cluster's shingle sets are
brought together once, in blocks of bounded size, and all pairs of a block, or of two
blocks, are compared exactly by matrix products; per node only its number of links and
the root of its component leave the task, never the pairs.

Result: one row a document row: class_id (least id of its component of links) and
n_links (other rows with similarity of 4/5 or more, copies counted).

Defined cases: null or empty texts are copies of each other; texts of fewer than 5
words have one shingle, those without words one of their bytes; null ids are kept
and count as the least id; repeated rows are copies, rows of one id with different texts
are told apart by their sets; a long text is hashed by blocks and needs memory for its
set; an empty table gives no rows; columns other than id and text are not read, and
keep_one passes them on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.storage import bounded, cut, free_name
from gridloom.llm.textops import arrow_buffer, mix64, row_slices, seeds, shingles

SHINGLE_WORDS = 5
TREES, DEPTH, FULL, FLOOR, SMALL, TARGET, SIMILAR = 32, 8, 6, 5, 32, 0.9999, 0.8
#: A block of a cluster holds at most about so many shingles and nodes.
BLOCK_SHINGLES, BLOCK_NODES = 1 << 20, 256
#: Components are found by so many edges a task.
EDGES_A_TASK = 200_000
#: Subtrees of any size are met in so many parts first.
SALTS = 64
#: Nodes to verify are broadcast up to this many (24 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 500_000
_LEAST = -(1 << 63)
_A = (seeds(TREES * DEPTH, 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (seeds(TREES * DEPTH, 22) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of each text, and where each text's start."""
    hashes, ptr = shingles(data, offsets, SHINGLE_WORDS)
    text = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[fresh], np.concatenate([[0], np.cumsum(np.bincount(text[fresh], minlength=len(ptr) - 1))]).astype(np.int64)


def set_ids(hashes: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes ^ np.uint64(0xA5A5A5A5)))])
    size = np.diff(ptr).astype(np.uint64)
    return np.where(size > 0, mix64(total[ptr[1:]] - total[ptr[:-1]] + size), np.uint64(0)).view(np.int64)


def labels(hashes: np.ndarray, ptr: np.ndarray, rows: int = 2048) -> np.ndarray:
    """TREES * DEPTH MinHash values of each set."""
    out = np.full((len(ptr) - 1, TREES * DEPTH), np.uint32(0xFFFFFFFF))
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    text = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    for i in range(0, len(x), rows):
        values = x[i : i + rows, None] * _A + _B
        own = text[i : i + rows]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        at = own[first]
        out[at] = np.minimum(out[at], np.minimum.reduceat(values, first, 0))
    return out


def forest_labels(minima: np.ndarray) -> np.ndarray:
    """For each tree its label of DEPTH values of 16 bits, as two numbers: columns 2t and 2t + 1."""
    values = mix64(minima.astype(np.uint64).reshape(-1, TREES, DEPTH) + seeds(TREES * DEPTH, 23).reshape(TREES, DEPTH)) >> np.uint64(48)
    half = DEPTH // 2
    shift = np.uint64(16) * np.arange(half - 1, -1, -1).astype(np.uint64)
    words = [(values[:, :, k : k + half] << shift).sum(2, dtype=np.uint64) for k in (0, half)]
    return np.stack(words, 2).reshape(-1, 2 * TREES).view(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = arrow_buffer(batch.column(1))
        for i, j in row_slices(offs):
            hashes, ptr = shingle_sets(data, offs[i : j + 1])
            keys = forest_labels(labels(hashes, ptr))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * 2 * TREES, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(set_ids(hashes, ptr)), pa.array(np.diff(ptr)), lists], names=["id", "sid", "n", "keys"])


def common_prefix(tree: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """How many values each label shares with the one before it (0 with one of another tree, and for the first)."""
    out = np.zeros(len(tree), np.int64)
    halves = [(x[1:] ^ x[:-1]).view(np.uint64) for x in (hi, lo)]
    half, equal = DEPTH // 2, []
    for x in halves:
        equal.append(sum((x >> np.uint64(16 * (half - 1 - k)) == 0).astype(np.int64) for k in range(half)))
    out[1:] = np.where(tree[1:] == tree[:-1], equal[0] + np.where(equal[0] == half, equal[1], 0), 0)
    return out


def missed(depth: int) -> float:
    """Log chance that a pair at the threshold does not share a prefix of so many values."""
    return float(np.log1p(-(SIMILAR**depth)))


def shortened(shared: np.ndarray, sid: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Depth of each label's shortened prefix (DEPTH + 1: none) and the least node of its subtree.

    Subtrees that touch an end of the list are left out: they may go on in another task.
    """
    n = len(sid)
    depth, hub = np.full(n, DEPTH + 1), sid.copy()
    for d in range(FLOOR, DEPTH + 1):
        first = np.flatnonzero(np.concatenate([[True], shared[1:] < d])) if n else np.empty(0, np.int64)
        size = np.diff(np.append(first, n))
        fits = size <= small
        fits[:1] = fits[-1:] = False
        taken = np.repeat(fits, size) & (depth > DEPTH)
        depth[taken] = d
        if n:
            hub[taken] = np.repeat(np.minimum.reduceat(sid, first), size)[taken]
    return depth, hub


def _shorten(small: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted labels in; a row for each that meets others (hub) or that its node lacks for full recall (short)."""
    context = small + 1  # rows to either side that decide a label
    price = np.array([0.0] * (FULL + 1) + [missed(d) - missed(FULL) for d in range(FULL + 1, DEPTH + 1)] + [-missed(FULL)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, decided = [np.empty(0, np.int64)] * 4, 0

        def emit(upto: int) -> pa.RecordBatch:
            tree, hi, lo, sid = held
            depth, hub = shortened(common_prefix(tree, hi, lo), sid, small)
            own = slice(decided, upto)
            depth, hub, sid = depth[own], hub[own], sid[own]
            short = np.where(depth > FULL, price[depth], 0.0)
            keep = (hub != sid) | (short > 0)
            return pa.RecordBatch.from_arrays([pa.array(sid[keep]), pa.array(hub[keep]), pa.array(short[keep])], names=["sid", "hub", "short"])

        for batch in batches:
            held = [np.concatenate([old, new.cast(pa.int64()).to_numpy()]) for old, new in zip(held, batch.columns, strict=True)]
            upto = len(held[0]) - context
            if upto > decided:
                yield emit(upto)
                drop = max(0, upto - context)
                held, decided = [x[drop:] for x in held], upto - drop
        if len(held[0]) > decided:
            yield emit(len(held[0]))

    return run


def candidates(nodes: DataFrame) -> DataFrame:
    """a and b: each node that meets others, with the least node of each of its subtrees. nodes: sid and keys."""
    numbered = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.get("keys", 2 * t).alias("hi"), F.get("keys", 2 * t + 1).alias("lo")))
    each = nodes.select("sid", F.explode(numbered).alias("k")).select("k.tree", "k.hi", "k.lo", "sid")
    order = ("tree", "hi", "lo", "sid")
    met = cut(each.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shorten(SMALL), "sid long, hub long, short double"))
    lacking = met.where("short > 0").groupBy("sid").agg(F.sum("short").alias("short"))
    lacking = lacking.where(F.col("short") + TREES * missed(FULL) > F.lit(float(np.log(1 - TARGET)))).select("sid")
    # prefixes of FULL values, whatever the size of their subtrees: parts of a subtree meet, then their least nodes
    bits = 16 * (DEPTH - FULL)
    keys = each.join(lacking, "sid", "left_semi").select("sid", "tree", "hi", F.shiftright("lo", bits).alias("lo"))
    part = Window.partitionBy("tree", "hi", "lo", "salt")
    parts = cut(keys.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALTS))).withColumn("hub", F.min("sid").over(part)))
    tops = parts.groupBy("tree", "hi", "lo", "salt").agg(F.first("hub").alias("sid")).withColumn("hub", F.min("sid").over(Window.partitionBy("tree", "hi", "lo")))
    return met.select("sid", "hub").union(parts.select("sid", "hub")).union(tops.select("sid", "hub")).where("sid != hub").select(F.col("sid").alias("a"), F.col("hub").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node and root (least node) of each component of the edges (a, b). Least labels travel along edges and are shortened by jumps."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    parts = max(1, -(-both.count() // EDGES_A_TASK))  # small tables go on in few tasks and files
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")).coalesce(parts))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        jump = step.join(label.select(F.col("node").alias("new"), F.col("root").alias("far")), "new", "left")
        new = cut(jump.select("node", F.least("new", F.coalesce("far", "new")).alias("new"), "root").coalesce(parts))
        if new.where("new != root").isEmpty():
            return label
        label = new.select("node", F.col("new").alias("root"))


def stars(edges: DataFrame) -> DataFrame:
    """Fewer edges of the same components: a node keeps the least of its b's (at most a few a tree, or one a block), and links the others to that one."""
    hubs = edges.groupBy("a").agg(F.collect_set("b").alias("hubs")).withColumn("b", F.least("a", F.array_min("hubs")))
    return hubs.select(F.explode(F.array_union("hubs", F.array("a"))).alias("a"), "b").where("a != b").distinct()


def compare(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, across: bool = True, rows: int = 512, columns: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Linked copies of each set, and the least index of its component.

    Only pairs across the sides count (none if all are on one side); all pairs if not across.
    """
    m = len(sets)
    if across and (m == 0 or side.min() == side.max()):
        return np.zeros(m, np.int64), np.arange(m)
    size = np.array([len(s) for s in sets], np.int64)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), size)
    often = np.bincount(place, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    keep = often[place]
    row, col = row[keep], number[place[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    n_cols = int(often.sum())
    bounds = np.searchsorted(col, np.arange(0, n_cols + columns, columns))
    linked = np.zeros((m, m), bool)
    for lo in range(0, m, rows):
        hi = min(m, lo + rows)
        common = np.zeros((hi - lo, m), np.float32)
        for c in range(len(bounds) - 1):
            part = slice(bounds[c], bounds[c + 1])
            dense = np.zeros((m, min(columns, n_cols - c * columns)), np.float32)
            dense[row[part], col[part] - c * columns] = 1
            common += dense[lo:hi] @ dense.T
        linked[lo:hi] = 9 * common >= 4 * (size[lo:hi, None] + size[None, :])
    np.fill_diagonal(linked, False)
    if across:
        linked &= side[:, None] != side[None, :]
    root = np.full(m, -1)
    for i in range(m):
        if root[i] < 0:
            front = np.array([i])
            root[i] = i
            while len(front):
                reached = linked[front].any(0) & (root < 0)
                root[reached] = i
                front = np.flatnonzero(reached)
    return linked @ copies, root


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of nodes' texts, once for each pair of blocks that the node's block belongs to."""
    for batch in batches:
        data, offs = arrow_buffer(batch.column(1))
        sid, cid, copies, blocks = (batch.column(k).to_numpy() for k in (2, 3, 4, 5))
        for i, j in row_slices(offs):
            hashes, ptr = shingle_sets(data, offs[i : j + 1])
            own = set_ids(hashes, ptr) == sid[i:j]  # another row of the same id has its own node
            rows: list[tuple] = []
            for t in np.flatnonzero(own):
                n, me = int(blocks[i + t]), int(sid[i + t] % blocks[i + t])
                raw = hashes[ptr[t] : ptr[t + 1]].tobytes()
                rows += [(int(cid[i + t]), min(me, other), max(me, other), int(me > other), int(sid[i + t]), int(copies[i + t]), raw) for other in range(n)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["cid", "i", "j", "side", "sid", "copies", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups arrive one after the other, each of bounded size."""
    key, held = None, {}

    def result() -> pa.RecordBatch:
        sids = np.array(list(held), np.int64)
        linked, root = compare([s for _, _, s in held.values()], np.array([c for _, c, _ in held.values()], np.int64), np.array([s for s, _, _ in held.values()]), across=key[1] != key[2])
        return pa.RecordBatch.from_arrays([pa.array(sids), pa.array(linked.astype(np.int64)), pa.array(sids[root])], names=["sid", "links", "root"])

    for batch in batches:
        for cid, i, j, side, sid, copies, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (cid, i, j) != key:
                if len(held) > 1:
                    yield result()
                key, held = (cid, i, j), {}
            held[sid] = side, copies, np.frombuffer(raw, np.uint64)
    if len(held) > 1:
        yield result()


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (_LEAST for null), sid, n_links, and class_id and class_sid, the least id of the class with its node, of each row."""
    rows = bounded(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    nodes_of = cut(rows.mapInArrow(_scan, "id long, sid long, n long, keys array<long>"))
    nodes = cut(nodes_of.groupBy("sid").agg(F.count("*").alias("copies"), F.min("id").alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")))

    clusters = components(stars(candidates(nodes.where("n > 0"))))

    # blocks of clusters
    members = clusters.select(F.col("node").alias("sid"), F.col("root").alias("cid")).join(nodes.select("sid", "copies", "first", "n"), "sid")
    totals = members.groupBy("cid").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_NODES)).cast("int").alias("blocks"))
    members = cut(members.join(totals, "cid"))
    wanted = members.select(F.col("first").alias("id"), "sid", "cid", "copies", "blocks")
    small = members.count() <= BROADCAST_ROWS
    lookup = F.broadcast if small else (lambda df: df)
    # a text is found by its id; where one id (null, or repeated) stands for several nodes, by its set as well
    several = cut(wanted.groupBy("id").count().where("count > 1").select("id"))
    texts = rows.join(lookup(wanted.join(lookup(several), "id", "left_anti")), "id").select("id", "text", "sid", "cid", "copies", "blocks")
    if not several.isEmpty():
        shared = rows.join(lookup(several), "id", "left_semi").mapInArrow(_with_node(1, "sid"), "id long, text string, sid long")
        texts = texts.unionByName(shared.join(lookup(wanted), ["id", "sid"]).select("id", "text", "sid", "cid", "copies", "blocks"))
    sets = texts.mapInArrow(_sets_of, "cid long, i int, j int, side int, sid long, copies long, shingles binary")
    found = cut(sets.repartition("cid", "i", "j").sortWithinPartitions("cid", "i", "j").mapInArrow(_verify, "sid long, links long, root long"))
    split = members.where("blocks > 1").select("sid")
    links = found.groupBy("sid").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if not split.isEmpty():  # components of clusters of several blocks are joined over the blocks
        across = components(stars(found.join(split, "sid", "left_semi").select(F.col("sid").alias("a"), F.col("root").alias("b")).where("a != b")))
        links = links.join(across.select(F.col("node").alias("sid"), F.col("root").alias("joined")), "sid", "left").select("sid", "links", F.coalesce("joined", "root").alias("root"))

    linked = nodes.where("copies > 1").select("sid").union(links.where("links > 0").select("sid")).distinct().join(nodes.select("sid", "copies", "first"), "sid").join(links, "sid", "left")
    linked = linked.select("sid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "sid").alias("root"), "first")
    classes = linked.groupBy("root").agg(F.min(F.struct("first", "sid")).alias("c")).select("root", F.col("c.first").alias("class_id"), F.col("c.sid").alias("class_sid"))
    special = linked.join(classes, "root").select("sid", "n_links", "class_id", "class_sid")
    out = nodes_of.select("id", "sid").join(special, "sid", "left")
    return out.select("id", "sid", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_sid", "sid").alias("class_sid"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id and n_links of each row."""
    real = lambda c: F.when(F.col(c) != _LEAST, F.col(c))
    return _classes(docs, id_col, text_col).select(real("id").alias("doc_id"), real("class_id").alias("class_id"), "n_links")


def _with_node(where: int, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the node of their text (column where)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = arrow_buffer(batch.column(where))
            sids = [set_ids(*shingle_sets(data, offs[i : j + 1])) for i, j in row_slices(offs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.empty(0, np.int64), *sids]))], names=[*batch.schema.names, name])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: of the least id, and of the least node where that id has several.

    Most ids go or stay whole. Rows of an id of which only a part stays (ids that are null or repeated) are told apart by their nodes.
    """
    own_id, own_node = free_name("own_id", docs.columns), free_name("own_node", docs.columns)
    stays = (F.col("id") == F.col("class_id")) & (F.col("sid") == F.col("class_sid"))
    rows = cut(_classes(docs, id_col, text_col).select("id", "sid", stays.alias("stays")))
    ids = rows.groupBy("id").agg(F.count("*").alias("n"), F.count_if("stays").alias("kept"))
    gone = cut(ids.where("n > 1 or kept = 0").select(F.col("id").alias(own_id), (F.col("kept") > 0).alias("part")))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    keyed = docs.withColumn(own_id, F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)))
    kept = keyed.join(gone.select(own_id), own_id, "left_anti").select(*docs.columns)
    parts = gone.where("part").select(own_id)
    if parts.isEmpty():
        return kept
    some = keyed.join(parts, own_id, "left_semi").select(*docs.columns)
    some = bounded(some).mapInArrow(_with_node(docs.columns.index(text_col), own_node), T.StructType([*docs.schema.fields, T.StructField(own_node, T.LongType())]))
    some = some.withColumn(own_id, F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)))
    wanted = rows.where("stays").select(F.col("id").alias(own_id), F.col("sid").alias(own_node)).join(parts, own_id, "left_semi")
    some = some.join(wanted, [own_id, own_node], "left_semi").dropDuplicates([own_id, own_node])
    return kept.unionByName(some.select(*docs.columns))
