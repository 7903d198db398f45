"""Similarity self-join on word 5-shingles by chosen paths.

Texts with the same set of shingles form one class; only one of a class is
joined. A class is a set of 128 tokens (position, minimum of the hashed
shingles under the position's function), of which two classes share about
their Jaccard similarity. A run splits the classes recursively: each node
samples positions, 1/similarity of them on average, and every class goes to
the child named by its token at each sampled position. Nodes of at most
LEAF classes, and nodes at the last depth, are compared by brute force on
the tokens (in a large one, members near the same pivot are connected
through it and not compared with each other); a node whose sample is empty takes one position all the same,
so that no path ends above a leaf. Runs are independent, and are repeated
until two classes of the lowest similarity meet with the target recall. Classes that may be similar are connected to
clusters, and each cluster is verified by brute force on its exact
shingles, in blocks of bounded size, so that all links inside are found and
counted, also those that no run had met. What is written per class never
depends on the number of links: counts and a spanning forest, no pairs.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.components import components
from riskweave.llm.frames import Scratch, batch, spans, utf8, with_fallback, written
from riskweave.llm.words import mix, shingle_hashes, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
POSITIONS = 128
LEAF = 128
MAX_DEPTH = 4
RECALL = 0.995
# Members of a large leaf that all others are compared with first.
PIVOTS = 4
# Classes of one brute-force block; a block pair is one unit of work.
BLOCK = 256
# Standard deviations that the estimate on tokens may fall short.
SLACK = 4.0
SEED = 20

FACTORS = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

SKETCH = pa.schema([("doc_id", pa.int64()), ("set_id", pa.binary()), ("n_shingles", pa.int64()), ("tokens", pa.binary())])
NODES = pa.schema([("node", pa.int64()), ("set_id", pa.binary())])
EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])
LINKS = pa.schema([("set_id", pa.binary()), ("other", pa.binary()), ("links", pa.int64())])


def survival(depth: int, similarity: float = SIMILARITY) -> float:
    """Chance that two sets of the lowest similarity t share a leaf of one run
    at ``depth``. A branching process: a node has Poisson(1/t) children, but
    one at least, and the pair shares each with chance t."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p) + similarity * p * math.exp(-1 / similarity)
    return p


def runs_for(recall: float, similarity: float = SIMILARITY, depth: int = MAX_DEPTH) -> int:
    """Runs until the target recall is reached at the greatest depth."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth, similarity)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, and their bounds."""
    n = len(offsets) - 1
    hashes, doc, _ = word_hashes(data, offsets)
    sh, doc = shingle_hashes(hashes, doc, n, SHINGLE_WORDS)
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    sh, doc = sh[new], doc[new]
    return sh, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])


def set_ids(sh: np.ndarray, bounds: np.ndarray) -> list:
    """16 bytes of two sums over each set of shingles; null for an empty set."""
    ids: list = [None] * (len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        one = np.add.reduceat(mix(sh + np.uint64(1)), bounds[full])
        two = np.add.reduceat(mix(sh ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds[full])
        for d, x, y in zip(full.tolist(), one, two):
            ids[d] = x.tobytes() + y.tobytes()
    return ids


def sketches(data: np.ndarray, offsets: np.ndarray) -> tuple[list, np.ndarray, list]:
    """(set id, number of distinct shingles, tokens) of each document; tokens
    are the upper 32 bits of the minima."""
    sh, bounds = shingle_sets(data, offsets)
    n, size = len(offsets) - 1, np.diff(bounds)
    full = np.flatnonzero(size)
    tokens = np.zeros((n, POSITIONS), np.uint32)
    if len(full):
        for k in range(POSITIONS):
            tokens[full, k] = np.minimum.reduceat(sh * FACTORS[k], bounds[full]) >> np.uint64(32)
    return set_ids(sh, bounds), size, [t.tobytes() for t in tokens]


def sketch(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            for i, j in spans(offsets):
                ids, size, tokens = sketches(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                yield batch(SKETCH, doc_id=b.column("doc_id").slice(i, j - i), set_id=ids, n_shingles=size, tokens=tokens)

    return with_fallback(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, set_id binary, n_shingles bigint, tokens binary")


def sampled(node: np.ndarray, similarity: float) -> np.ndarray:
    """(nodes x positions): which positions each node has sampled; one of
    the smallest hash if the sample would be empty."""
    chance = 1 / (similarity * POSITIONS)
    h = mix(node.astype(np.uint64)[:, None] ^ FACTORS[None, :])
    taken = (h >> np.uint64(11)).astype(np.float64) / 2.0 ** 53 < chance
    taken[np.arange(len(node)), h.argmin(1)] = True  # the smallest is in every sample that is not empty
    return taken


def children(node: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) for every sampled position of every row."""
    row, position = np.nonzero(sampled(node, similarity))
    name = mix(node.astype(np.uint64)[row] * np.uint64(31) + np.uint64(position + 1))
    return row, mix(name ^ (tokens[row, position].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).astype(np.int64)


def split(rows: DataFrame, similarity: float, roots: list[int] | None = None) -> DataFrame:
    """Next level: (node, set_id, tokens) -> (node, set_id); the first level
    takes every row of (set_id, tokens) at all ``roots``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            tokens = np.frombuffer(b"".join(b.column("tokens").to_pylist()), np.uint32).reshape(n, POSITIONS)
            at = b.column("node").to_numpy() if roots is None else None
            for node in [at] if roots is None else [np.full(n, r, np.int64) for r in roots]:
                row, child = children(node, tokens, similarity)
                yield batch(NODES, node=child, set_id=b.column("set_id").take(pa.array(row)))

    return rows.mapInArrow(run, "node bigint, set_id binary")


def leaves(sets: DataFrame, similarity: float, recall: float, scratch: Scratch) -> DataFrame:
    """(node, set_id, n) of all leaves with two and more classes, of all runs."""
    roots = [int(mix(np.array([SEED + r], np.uint64)).astype(np.int64)[0]) for r in range(runs_for(recall, similarity))]
    level = split(sets.select("set_id", "tokens"), similarity, roots)
    out = None
    for depth in range(1, MAX_DEPTH + 1):
        level = scratch.written(level, "path-nodes")
        size = level.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("members"))
        size = scratch.written(size.where("n > 1"), "path-sizes")
        ends = size if depth == MAX_DEPTH else size.where(F.col("n") <= LEAF)
        # Leaves with the same members (close copies meet in many runs) are compared once; nodes that go on
        # all go on, whoever is in them, since a run may lose what another finds.
        ends = ends.groupBy("n", "members").agg(F.min("node").alias("node")).select("node", "n")
        done = level.join(ends, "node")
        out = done if out is None else out.unionByName(done)
        if depth < MAX_DEPTH:
            large = level.join(size.where(F.col("n") > LEAF).select("node"), "node")
            level = split(large.join(sets.select("set_id", "tokens"), "set_id").select("node", "set_id", "tokens"), similarity)
    return out


def in_blocks(rows: DataFrame, group: str, n: str) -> DataFrame:
    """Adds the block pairs (p <= q) that a member of a group of ``n`` takes
    part in, and ``part``, its own block: groups of one block have one pair."""
    blocks = F.ceil(F.col(n) / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("set_id", F.lit(3)), F.col("blocks")).cast("int"))
    return (rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other")).drop("blocks", "other"))


def by_group(rows: DataFrame, keys: list[str], run, schema: str, number: int | None = None) -> DataFrame:
    """Apply ``run(first key columns, table)`` to each group of ``keys``, group
    after group from sorted partitions: only one group is held at a time."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], 0)) + 1
            for s, e in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
                now = tuple(k[s] for k in key)
                if last is not None and now != last:
                    yield from run(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(s, e - s))
                last = now
        if held:
            yield from run(pa.Table.from_batches(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def forest(similar: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    n = len(similar)
    todo, edges = np.ones(n, bool), []
    for start in range(n):
        if not todo[start]:
            continue
        todo[start], queue = False, [start]
        while queue:
            a = queue.pop()
            found = np.flatnonzero(similar[a] & todo)
            todo[found] = False
            edges += [(a, b) for b in found.tolist()]
            queue += found.tolist()
    return edges


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), POSITIONS)


def likely_edges(members: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Edges that connect the classes of a leaf whose tokens agree enough."""
    least = POSITIONS * similarity - SLACK * math.sqrt(POSITIONS * similarity * (1 - similarity))

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, tokens = t.column("set_id").combine_chunks(), matrix(t.column("tokens"))
        agree = np.zeros((len(ids), len(ids)), np.uint8)
        for k in range(POSITIONS):
            agree += tokens[:, k, None] == tokens[None, :, k]
        edges = forest(agree >= least)
        if edges:
            a, b = zip(*edges)
            yield batch(EDGES, a=ids.take(pa.array(a)), b=ids.take(pa.array(b)))

    def pairs(rows: DataFrame) -> DataFrame:
        return by_group(rows, ["node", "p", "q"], run, "a binary, b binary")

    near = scratch.written(near_pivots(members.where(F.col("n") > LEAF), least), "near-pivots")
    to_pivots = near.select(F.explode("near").alias("b"), F.col("set_id").alias("a")).where("a <> b").select("a", "b")
    return pairs(in_blocks(members.where(F.col("n") <= LEAF), "node", "n")).unionByName(to_pivots).unionByName(pairs(across(near)))


def near_pivots(members: DataFrame, least: float) -> DataFrame:
    """(node, set_id, tokens, near, group): ``near`` holds the pivots of the
    leaf that agree with the class in ``least`` tokens, ``group`` is the
    place of the first of them, 0 without any. Pivots are the classes of the
    smallest hashes of a leaf."""
    order = Window.partitionBy("node").orderBy(F.xxhash64("set_id"), "set_id")
    chosen = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS)
    chosen = chosen.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "set_id", "tokens"))).alias("pivots"))
    rows = members.select("node", "set_id", "tokens").join(
        chosen.select("node", F.col("pivots.set_id").alias("pivot_ids"), F.array_join(F.transform("pivots.tokens", F.base64), ",").alias("pivots")), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for b in batches:
            tokens, near, group = matrix(b.column("tokens")), [], []
            for k, (ids, text) in enumerate(zip(b.column("pivot_ids").to_pylist(), b.column("pivots").to_pylist())):
                if text not in known:
                    known = {text: np.stack([np.frombuffer(base64.b64decode(x), np.uint32) for x in text.split(",")])}
                found = np.flatnonzero((known[text] == tokens[k]).sum(1) >= least).tolist()
                near.append([ids[f] for f in found])
                group.append(found[0] + 1 if found else 0)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("set_id"), b.column("tokens"), pa.array(near, pa.list_(pa.binary())),
                                              pa.array(group, pa.int32())], ["node", "set_id", "tokens", "near", "group"])

    return rows.mapInArrow(run, "node bigint, set_id binary, tokens binary, near array<binary>, group int")


def across(near: DataFrame) -> DataFrame:
    """Block pairs of the large leaves: blocks hold classes of one group, and
    blocks of the same pivot's group are not paired with each other."""
    groups = range(PIVOTS + 1)
    sizes = near.groupBy("node").agg(F.array(*[F.ceil(F.count_if(F.col("group") == g) / BLOCK).cast("int") for g in groups]).alias("sizes"))
    rows = near.select("node", "set_id", "tokens", "group").join(sizes, "node")
    first = F.aggregate(F.slice("sizes", 1, F.col("group")), F.lit(0), lambda a, x: a + x)
    total = F.aggregate("sizes", F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("first", first).withColumn("own", F.element_at("sizes", F.col("group") + 1))
    rows = rows.withColumn("part", F.col("first") + F.pmod(F.xxhash64("set_id", F.lit(3)), F.col("own")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), total - 1), lambda x: (F.col("group") == 0) | (x < F.col("first")) | (x >= F.col("first") + F.col("own")))
    return (rows.withColumn("other", F.explode(others)).select("node", "set_id", "tokens", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")))


def verified(members: DataFrame, similarity: float) -> DataFrame:
    """Exact comparison inside clusters: (cluster, n, set_id, text) -> rows
    (set_id, other, links): a spanning link (other not null) or the number
    of verified links that a block pair adds to a class."""
    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, p, q = t.column("set_id").combine_chunks(), t.column("p")[0].as_py(), t.column("q")[0].as_py()
        part = t.column("part").to_numpy()
        data, offsets = utf8(t.column("text").combine_chunks())
        sh, bounds = shingle_sets(data, offsets)
        n, size = len(ids), np.diff(bounds)
        owner = np.repeat(np.arange(n), size)
        _, column, times = np.unique(sh, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], column[shared]
        _, column = np.unique(column, return_inverse=True)
        common = np.zeros((n, n), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):  # slices of the shingles
            i, j = np.searchsorted(column, [lo, lo + 8192])
            m = np.zeros((n, min(8192, int(column[j - 1]) - lo + 1)), np.float32)
            m[owner[i:j], column[i:j] - lo] = 1
            common += m @ m.T
        total = size[:, None] + size[None, :]
        similar = common.astype(np.float64) * (1 + similarity) >= similarity * total - 1e-9
        np.fill_diagonal(similar, False)
        edges = forest(similar)
        if not edges:
            return
        counted = similar & (((part[:, None] == p) & (part[None, :] == q)) | ((part[:, None] == q) & (part[None, :] == p)))
        links = counted.sum(1)
        some = np.flatnonzero(links)
        yield batch(LINKS, set_id=ids.take(pa.array(some)), other=[None] * len(some), links=links[some])
        a, b = zip(*edges)
        yield batch(LINKS, set_id=ids.take(pa.array(a)), other=ids.take(pa.array(b)), links=[0] * len(a))

    return by_group(in_blocks(members, "cluster", "n"), ["cluster", "p", "q"], run, "set_id binary, other binary, links bigint")


def similar_classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, set_id, first of every row of ``docs``.

    class_id: the smallest doc_id of the component of linked texts that the
    row belongs to; n_links: the number of other different texts (sets of
    shingles) with Jaccard similarity of at least ``similarity``; n_copies:
    rows with the same set of shingles, this one included.

    Words are runs of letters and digits, case folded; a text of one to four
    words is one shingle. Null, empty and wordless texts have no shingle:
    they link to nothing, n_copies is 1 and class_id their own doc_id.
    Repeated rows are copies of each other. A null doc_id is larger than any
    (class_id is null only if all of the component's are). set_id names the
    set of shingles (null: none); first marks the row that stands for its
    component, or the equal rows that do. An empty table gives an empty
    result; other columns are not read.
    """
    rows = written(sketch(docs), "sketches")
    filled = rows.where("set_id is not null")
    sets = filled.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.first("tokens").alias("tokens"))
    sets = written(sets, "classes")
    scratch = Scratch()
    met = leaves(sets, similarity, recall, scratch).join(sets.select("set_id", "tokens"), "set_id")
    clusters = written(components(likely_edges(met, similarity, scratch)).select(F.col("node").alias("set_id"), F.col("root").alias("cluster")), "clusters")
    scratch.drop()
    size = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    # The text of one row of each class in a cluster, by doc_id and set (doc_ids may repeat or be null).
    wanted = clusters.join(size, "cluster").join(sets.select("set_id", "doc_id"), "set_id")
    texts = wanted_texts(docs, wanted.select("set_id", "doc_id"))
    links = written(verified(wanted.select("set_id", "cluster", "n").join(texts, "set_id"), similarity), "links")
    roots = components(links.where("other is not null").select(F.col("set_id").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy("set_id").agg(F.sum("links").alias("n_links"))
    classes = (sets.select("set_id", "doc_id", "n_copies").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
               .join(counts, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    least = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_id")).alias("least"))
    classes = classes.join(least, "root").select(
        "set_id", F.col("least.doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies",
        (F.col("least.set_id") == F.col("set_id")).alias("leads"))
    columns = ["doc_id", "class_id", "n_links", "n_copies", "set_id", "first"]
    alone = rows.where("set_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"),
                                                F.lit(1).cast("bigint").alias("n_copies"), "set_id", F.lit(True).alias("first"))
    found = filled.select("set_id", "doc_id").join(classes, "set_id")
    return found.withColumn("first", F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id"))).select(columns).unionByName(alone)


def with_set_id(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the set of shingles of its text as column ``name``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            ids = [x for i, j in spans(offsets) for x in set_ids(*shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))]
            yield b.append_column(name, pa.array(ids, pa.binary()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, text): one text of every class in ``wanted`` (set_id, doc_id).
    Rows are matched by doc_id first, so that only these texts are read into
    sets again; of several matching rows any one serves."""
    base = with_fallback(docs, doc_id="bigint", text="string")
    some = base.join(wanted.select(F.col("doc_id").alias("d"), "set_id"), F.col("doc_id").eqNullSafe(F.col("d")), "inner").select("set_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            keep = []
            want = b.column("set_id").to_pylist()
            for i, j in spans(offsets):
                ids = set_ids(*shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
                keep += [x == y for x, y in zip(ids, want[i:j])]
            yield b.filter(pa.array(keep, pa.bool_()))

    return some.mapInArrow(run, "set_id binary, text string").dropDuplicates(["set_id"])
