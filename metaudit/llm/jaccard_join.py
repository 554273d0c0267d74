"""N-gram Jaccard join: similar texts by a count-vector R-tree, with exact verification.

A text's set is that of its word shingles. Equal sets make one class. Shingles are put in one
global order, rarest first by a sketch of counts, and two sets as similar as asked must share
one of the first shingles of each (prefix filter), which makes groups of classes. Within a
group, classes are points: how many of a set's shingles hash to each of ``GROUPS`` groups. The
sum of the smaller coordinates bounds the overlap of two sets. Small groups give their pairs,
which the bound thins. Large groups, families of near copies, are joined to families and cut
into blocks; each pair of blocks is searched in one task with an R-tree over the points, which
bounds whole nodes. What is left is verified by its shingles. Families give only links that
join what was apart, never all pairs.

Nothing is cut off: the prefix filter and the bounds lose no pair, and the order of shingles
affects speed alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StructField, StructType, VariantType

from metaudit.functions.joins import meet
from metaudit.llm.components import components
from metaudit.llm.shared import saved
from metaudit.llm.texts import columns_of
from metaudit.llm.words import BASE_WORDS, Texts, grams, mix, prefix, range_hash, sliced

SKETCH_BITS = 20  # cells of the count sketch: 4 MB, whatever the data
SKETCH_BLOCK = 4096
MARK_BITS = 26  # bits that mark the texts to fetch: 8 MB; beyond its capacity more texts are fetched, none is missed
GROUPS = 32
SMALL_GROUP = 64
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1_000_000
LEAF = 32


def shingle_sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin."""
    hashes = texts.word_hashes()
    starts, keys = grams(hashes, texts.first, n)
    short = np.flatnonzero((texts.n_words > 0) & (texts.n_words < n))
    whole = range_hash(prefix(hashes, BASE_WORDS), texts.first[short], texts.first[short + 1], BASE_WORDS)
    doc = np.concatenate([np.searchsorted(texts.first, starts, "right") - 1, short])
    keys = np.concatenate([keys, whole])
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    return keys[new], np.searchsorted(doc[new], np.arange(texts.n + 1))


def class_keys(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits for the set of each text; equal sets, equal keys."""
    sums = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(mix(keys + np.uint64(0x632BE59BD9B4E019)), out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def cells_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def marks_of(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def each_set(source: DataFrame, n: int, work, schema: StructType) -> DataFrame:
    """Run ``work(ids, keys, first)`` over slices of texts and give its columns as rows."""
    def run(batches):
        for batch in batches:
            for i, j, texts in sliced(batch.column(1), lower=True):
                columns = work(batch.column(0).slice(i, j - i), *shingle_sets(texts, n))
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                                                     schema.names)

    return source.mapInArrow(run, schema)


def count_sketch(source: DataFrame, n: int) -> np.ndarray:
    """How many texts have a shingle of each cell; tasks send blocks of cells, which are added block by block."""
    def gather(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for _, _, texts in sliced(batch.column(1), lower=True):
                np.add.at(counts, cells_of(shingle_sets(texts, n)[0]), 1)
        blocks = counts.reshape(-1, SKETCH_BLOCK)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([blocks[b].tobytes() for b in used], pa.binary())], ["block", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                total += np.frombuffer(x, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                         ["block", "counts"])

    add.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    rows = source.mapInArrow(gather, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    for r in rows.collect():
        sketch[r["block"] * SKETCH_BLOCK:(r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(bytes(r["counts"]), np.int64)
    return np.log2(sketch + 1).astype(np.float32)


def prefixes(source: DataFrame, n: int, percent: int, order) -> DataFrame:
    """The rarest shingles of each class: (h, node, first), ``first`` for those that a smaller set must share."""
    def work(_, keys, first):
        sizes = np.diff(first)
        node = class_keys(keys, first)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.lexsort((keys, order.value[cells_of(keys)], doc))
        place = np.arange(len(keys)) - first[doc]
        probe = sizes - -(-percent * sizes // 100) + 1
        index = sizes - -(-2 * percent * sizes // (100 + percent)) + 1
        use = place < probe[doc]
        at = doc[use]
        # copies within a slice say nothing new
        _, one = np.unique(node, return_index=True)
        single = np.zeros(len(node), bool)
        single[one] = True
        keep = single[at]
        return [keys[rank][use][keep].view(np.int64), node[at][keep], place[use][keep] < index[at][keep]]

    return each_set(source, n, work, StructType.fromDDL("h long, node long, first boolean"))


def summaries(source: DataFrame, n: int) -> DataFrame:
    schema = StructType([StructField("id", LongType()), *StructType.fromDDL("node long, n long").fields])
    return each_set(source, n, lambda ids, keys, first: [ids, class_keys(keys, first), np.diff(first).astype(np.int64)], schema)


def points(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Count vectors: how many shingles of each set fall to each group."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    group = (mix(keys) & np.uint64(GROUPS - 1)).astype(np.int64)
    return np.bincount(doc * GROUPS + group, minlength=(len(first) - 1) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))


def fetched_sets(source: DataFrame, n: int, marks) -> DataFrame:
    """Sets and points of the texts whose id is marked."""
    def work(ids, keys, first):
        ids = ids.to_numpy(zero_copy_only=False)
        at = marks_of(ids)
        take = np.flatnonzero((marks.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
        if not len(take):
            return None
        sizes = np.diff(first)
        keep = np.repeat(np.isin(np.arange(len(sizes)), take), sizes)
        node = class_keys(keys, first)[take]
        own = keys[keep]
        begin = np.concatenate([[0], np.cumsum(sizes[take])])
        return [node, sizes[take].astype(np.int64), lists(points(own, begin).ravel(), np.arange(len(take) + 1) * GROUPS),
                lists(own.view(np.int64), begin)]

    return each_set(source, n, work, StructType.fromDDL("node long, n long, point array<int>, shingles array<long>"))


def similar(overlap, a, b, percent: int):
    """Whether an overlap (or a bound of it) makes two sets of these sizes similar."""
    return (100 + percent) * overlap >= percent * (a + b)


class CountTree:
    """R-tree over count vectors: leaves of LEAF points, sorted by size, with their upper corners and smallest size."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((vectors.argmax(1), sizes))
        self.vectors, self.sizes = vectors[self.order], sizes[self.order]
        heads = np.arange(0, len(sizes), LEAF)
        self.leaves = np.maximum.reduceat(self.vectors, heads) if len(sizes) else vectors
        self.leaf_least = self.sizes[heads]
        top = np.arange(0, len(heads), LEAF)
        self.nodes = np.maximum.reduceat(self.leaves, top) if len(sizes) else vectors
        self.node_least = self.leaf_least[top]

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Entries whose bound allows similarity with the point."""
        def below(held, least, limit):
            children = (held[:, None] * LEAF + np.arange(LEAF)).ravel()
            return children[children < limit]

        def passing(corners, least, at):
            return at[similar(np.minimum(corners[at], point).sum(1), size, least[at], percent)]

        held = passing(self.nodes, self.node_least, np.arange(len(self.nodes)))
        held = passing(self.leaves, self.leaf_least, below(held, None, len(self.leaves)))
        held = passing(self.vectors, self.sizes, below(held, None, len(self.vectors)))
        return self.order[held]


def linked(nodes: np.ndarray, side: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, shingles: np.ndarray,
           first: np.ndarray, percent: int, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block, or across two blocks, that join what was apart."""
    parent = np.arange(len(nodes))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    _, local = np.unique(shingles, return_inverse=True)
    flags = np.zeros(local.max(initial=-1) + 1, bool)
    inside = np.flatnonzero(side == 0) if across else np.arange(len(nodes))
    tree = CountTree(vectors[inside], sizes[inside])
    out: list[tuple[int, int]] = []
    for q in np.flatnonzero(side == 1) if across else np.arange(len(nodes)):
        found = inside[tree.search(vectors[q], sizes[q], percent)]
        found = found if across else found[found < q]
        if not len(found):
            continue
        own = local[first[q]:first[q + 1]]
        flags[own] = True
        length = first[found + 1] - first[found]
        at = np.repeat(first[found], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        shared = np.add.reduceat(flags[local[at]].astype(np.int64), np.cumsum(length) - length)
        flags[own] = False
        for x in found[similar(shared, sizes[found], sizes[q], percent)]:
            a, b = root(x), root(q)
            if a != b:
                parent[a] = b
                out.append((x, q))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return nodes[pairs[:, 0]], nodes[pairs[:, 1]]


def family_links(members: DataFrame, percent: int) -> DataFrame:
    """Links within families: (family, node, n, point, shingles) in blocks, one task per pair of blocks."""
    size = members.groupBy("family").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("k"))
    block = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    rows = (members.join(size, "family").withColumn("block", block).withColumn("other", other)
            .select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                    (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "n", "point", "shingles"))

    def search(key, batch):
        table = batch.combine_chunks()
        get = lambda name: table.column(name).chunk(0) if table.column(name).num_chunks else table.column(name).combine_chunks()
        sets = get("shingles")
        first = np.asarray(sets.offsets).astype(np.int64)
        a, b = linked(get("node").to_numpy(), get("side").to_numpy(),
                      np.asarray(get("point").flatten()).reshape(-1, GROUPS).astype(np.int64), get("n").to_numpy(),
                      np.asarray(sets.flatten()), first - first[0], percent, key[1].as_py() != key[2].as_py())
        return pa.table([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.groupBy("family", "i", "j").applyInArrow(search, "a long, b long")


def pair_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar: first by the bound of their points, then by their shingles."""
    def side(of, *columns):
        return sets.select(F.col("node").alias(of), *[F.col(c).alias(f"{of}_{c}") for c in columns])

    bound = F.aggregate(F.zip_with("a_point", "b_point", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    left = (pairs.join(side("a", "n", "point"), "a").join(side("b", "n", "point"), "b")
            .where(similar(bound, F.col("a_n"), F.col("b_n"), percent)).select("a", "b", "a_n", "b_n"))
    shared = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return (left.join(side("b", "shingles"), "b").join(side("a", "shingles"), "a")
            .where(similar(shared, F.col("a_n"), F.col("b_n"), percent)).select("a", "b"))


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                   percent: int = 80) -> DataFrame:
    """Per row: the id, n_shingles, component_id and n_copies (rows with the same set).

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``. Two texts are linked when
    100 * |intersection| >= percent * |union| of their sets of ``shingle``-word shingles; a
    shorter text is one shingle as a whole, and a null or empty one has none and is linked with
    nothing. ``component_id`` is the smallest id reachable by links. Ids are integers. A row
    with a null id links nothing; it has the component of the rows with its set, or null. Rows
    may repeat. 64-bit hashes stand for shingles and sets.
    """
    found = grouped(docs, id_col, text_col, shingle, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"), "n_copies")


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """Per row: id, node (its set), n, n_copies, and least and least_node, the first id and set of its component."""
    spark = docs.sparkSession
    everything = columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    source = everything.where("id IS NOT NULL")
    order = spark.sparkContext.broadcast(count_sketch(source, shingle))
    summary = saved(summaries(everything, shingle))
    classes = saved(summary.groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("n_copies")))

    rows = prefixes(source, shingle, percent, order)
    meeting = rows.where("first").groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = saved(rows.join(meeting, "h").where("low <> high OR node <> low").select("h", "node").distinct())
    sized = shared.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("low"))

    small = shared.join(sized.where(F.col("m").between(2, SMALL_GROUP)).select("h"), "h")
    together = small.groupBy("h").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    tails = F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.struct(
        F.element_at("nodes", i).alias("a"), F.slice("nodes", i + 1, F.size("nodes")).alias("rest")))
    pairs = (together.select(F.explode(tails).alias("t")).select("t.a", F.explode("t.rest").alias("b")).distinct())
    pairs = saved(pairs)

    stars = shared.join(sized.where(F.col("m") > SMALL_GROUP).select("h", "low"), "h")
    families = saved(components(stars.select(F.col("node").alias("a"), F.col("low").alias("b"))))

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(families.select("node")).distinct()
    chosen = classes.where("id IS NOT NULL").join(wanted, "node")
    marks = spark.sparkContext.broadcast(mark_words(chosen))
    sets = saved(fetched_sets(source, shingle, marks))

    members = sets.join(families.select("node", F.col("component").alias("family")), "node")
    links = family_links(members, percent).union(pair_links(pairs, sets, percent))
    found = components(links)

    # components are told to classes, and classes to rows, with hot ones apart
    labelled = saved(classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "node")))
    heads = saved(labelled.groupBy("component").agg(first.alias("first"), F.count(F.lit(1)).alias("members"))
                  .select("component", "members", F.col("first.id").alias("least"), F.col("first.node").alias("least_node")))
    told = saved(meet(labelled.drop("id"), heads, ["component"], "members").drop("component", "members"))
    return meet(summary.select("id", "node"), told, ["node"], "n_copies")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                percent: int = 80) -> DataFrame:
    """Of each group the row with the smallest id (then set, then text); rows with a null id or no word stay.

    Rows are judged by id and set, so texts that share an id are judged each by itself. Only texts that
    may go are shuffled: bits of the ids in question, a fixed 8 MB, let the others pass, and an exact
    join decides on the rest.
    """
    rows = grouped(docs, id_col, text_col, shingle, percent).where("id IS NOT NULL AND n > 0").groupBy("id", "node").agg(
        F.count(F.lit(1)).alias("c"), F.max((F.col("id") == F.col("least")) & (F.col("node") == F.col("least_node"))).alias("stays"))
    judged = saved(rows.where("c > 1 OR NOT stays").select(F.col("id").alias("_id"), F.col("node").alias("_node"), "stays"))
    marks = docs.sparkSession.sparkContext.broadcast(mark_words(judged.select(F.col("_id").alias("id"))))
    place = docs.columns.index(text_col)
    with_node = StructType([*docs.schema.fields, StructField("_set", LongType())])

    def marked(wanted: bool):
        def run(batches):
            for batch in batches:
                ids = batch.column(id_col)
                at = marks_of(ids.fill_null(0).to_numpy(zero_copy_only=False))
                hit = (marks.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
                hit &= ids.is_valid().to_numpy(zero_copy_only=False)
                left = batch.filter(pa.array(hit == wanted))
                if not wanted:
                    yield left
                    continue
                for i, j, texts in sliced(left.column(place), lower=True):
                    node = class_keys(*shingle_sets(texts, shingle))
                    yield pa.RecordBatch.from_arrays([*left.slice(i, j - i).columns, pa.array(node)], with_node.names)
        return docs.mapInArrow(run, with_node if wanted else docs.schema)

    maybe = marked(True)
    maybe = maybe.join(judged, (maybe[id_col].cast("long") == judged["_id"]) & (maybe["_set"] == judged["_node"]), "left")
    hashed = [c.name for c in docs.schema if not isinstance(c.dataType, (MapType, VariantType))]
    alike = Window.partitionBy("_id", "_node").orderBy(text_col, F.xxhash64(*hashed))
    again = maybe.where("stays").withColumn("_place", F.row_number().over(alike)).where("_place = 1")
    return marked(False).unionAll(maybe.where("stays IS NULL").select(*docs.columns)).unionAll(again.select(*docs.columns))


def mark_words(chosen: DataFrame) -> np.ndarray:
    """Bits of the chosen ids as 64-bit words; at most 2**MARK_BITS bits come to the driver."""
    schema = "word long, bits long"

    def run(batches):
        for batch in batches:
            at = marks_of(batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    words = np.zeros(1 << (MARK_BITS - 6), np.int64)
    for r in chosen.select("id").mapInArrow(run, schema).groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        words[r["word"]] = r["bits"]
    return words.view(np.uint64)
