"""N-gram Jaccard join of transcripts: a blocked sparse product of documents by shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from callweave.llm.common import short_batches
from callweave.session import settle

SHINGLE_WORDS = 5
# Percent of the union that two linked sets share at least.
THRESHOLD = 80
# Counters of the word sketch: 4 million, whatever the size of the corpus.
SKETCH_BITS = 22
# Texts that a task counts before it passes its counters on, and the least count that it does pass on.
SKETCH_TEXTS, SKETCH_LEAST = 60_000, 2
# Most pairs whose keys are sent to all executors; more are joined by a shuffle.
BROADCAST_PAIRS = 500_000
# Rows that share one left side of a product in a task.
CHUNK_ROWS = 500
# Sets of a block, and columns of a dense product.
BLOCK_ROWS = 256
PRODUCT_COLUMNS = 4096
MEMO_WORDS = 200_000


def link_near_copies(calls: DataFrame, key: str = "call_id", text: str = "text") -> DataFrame:
    """Components of transcripts whose sets of five-word shingles overlap by 80 % or more.

    Words are lower-cased (A-Z) and separated by ASCII white space; a text with
    fewer than five words is one shingle. The links are exact:

    1. Equal sets become one node. Shingles have a fixed order by the number of texts
       that hold their rarest word, counted over all texts. Two sets of sizes m and n that are
       linked share a shingle among their first n - ceil(0.8 n) + 1.
    2. The product of the incidence matrix over these columns with its transpose is
       summed up in blocks of columns. First every node is only multiplied with the
       smallest node of each column (a star), entries too small for the sizes are
       dropped, the rest is completed over all columns, and linked nodes are merged.
    3. What is left are columns with nodes of several components. Components that
       could be linked by the same bound form clusters, and inside each cluster the
       full product is made block by block (see `cross_links`).

    So a group of near copies costs a product per copy and not one per pair, each
    set travels once per block instead of once per pair, and no link between
    different components is missed. A passage that many texts share is last in
    their order and gives no column.

    Returns `key`, n_shingles and component_id, the smallest key that links reach.
    Null and empty texts have no shingle and are their own component, as are rows
    without key (component_id null). Rows of one key with different texts are linked each by its
    own text, and named by the smallest key like all others. Equal rows get equal results. Other columns are not
    read. An empty table gives an empty result.
    """
    texts = short_batches(calls).select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"))
    levels = word_levels(texts)
    features = settle(_features(texts, levels))
    torn = features.groupBy("_key").agg(F.min("_set").alias("_low"), F.max("_set").alias("_high")).where("_key IS NOT NULL AND _low < _high")
    if torn.isEmpty():
        out = _link(texts, features)
    else:
        # keys that name several texts can't name nodes, so digests of key and text do
        of_row = F.md5(F.concat(F.concat_ws(":", F.length(F.col("_key").cast("string")), F.col("_key").cast("string")).cast("binary"), F.coalesce("_text", F.lit(b""))))
        named = texts.select(F.col("_key").alias("_name"), F.when(F.col("_key").isNotNull(), of_row).alias("_key"), "_text")
        texts = named.drop("_name")
        out = settle(_link(texts, settle(_features(texts, levels))))
        names = settle(named.where("_key IS NOT NULL").select("_key", "_name").distinct())
        tops = settle(
            out.select("_key", "_component").distinct().join(names, "_key").groupBy("_component").agg(F.min("_name").alias("_top"))
        )
        out = out.join(names, "_key", "left").join(tops, "_component", "left")
        out = out.select(F.col("_name").alias("_key"), "_n", F.col("_top").alias("_component"))
    return out.select(F.col("_key").alias(key), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"))


def _link(texts: DataFrame, features: DataFrame) -> DataFrame:
    """Key, number of shingles and smallest key of the component, for rows whose key names one text."""
    described = features.where("_key IS NOT NULL AND _n > 0")
    copies = settle(
        described.groupBy("_set", "_n").agg(F.min("_key").alias("_first"), F.count("*").alias("_copies")).where("_copies > 1").drop("_copies")
    )
    nodes = described.join(copies, ["_set", "_n"], "left").where("_first IS NULL OR _first = _key")
    sizes = settle(nodes.groupBy("_key").agg(F.max("_n").alias("_n")))
    columns = nodes.select(F.explode("_rare").alias("_shingle"), F.col("_key").alias("_node"))

    stars = settle(columns.groupBy("_shingle").agg(F.min("_node").alias("_hub"), F.max("_node").alias("_other")).where("_hub < _other").drop("_other"))
    shared = settle(columns.join(stars, "_shingle"))
    products = shared.where("_hub < _node").groupBy(F.col("_hub").alias("_a"), F.col("_node").alias("_b")).agg(F.count("*").alias("_c"))
    tested = settle(possible(products, sizes).select("_a", "_b"))
    labels = components(settle(linked(texts, tested, sizes)), None)
    labels = components(settle(cross_links(texts, shared, labels, sizes)), labels)

    # the smallest key of a node is its own, since copies are named by their first
    found = features.select("_key", "_n", "_set").join(copies, ["_set", "_n"], "left")
    return (
        found.withColumn("_node", F.when(F.col("_n") > 0, F.coalesce("_first", "_key")).otherwise(F.col("_key")))
        .join(labels, F.col("_node") == F.col("_member"), "left")
        .select("_key", "_n", F.when(F.col("_key").isNotNull(), F.coalesce("_label", "_node")).alias("_component"))
    )


def possible(products: DataFrame, sizes: DataFrame) -> DataFrame:
    """Keeps pairs whose sizes and common rare shingles still allow a link.

    Of two linked sets of sizes m and n at least 4/9 (m + n) shingles are common.
    Those that are not rare in both are rare in neither, or behind the rare ones of one set.
    """
    a, b = sizes.select(F.col("_key").alias("_a"), F.col("_n").alias("_m")), sizes.select(F.col("_key").alias("_b"), "_n")
    need = F.ceil(F.lit(THRESHOLD) * (F.col("_m") + F.col("_n")) / F.lit(100 + THRESHOLD))
    later = F.greatest(*[F.ceil(F.col(c) * THRESHOLD / 100) - 1 for c in ("_m", "_n")])
    alike = 100 * F.least("_m", "_n") >= THRESHOLD * F.greatest("_m", "_n")
    return products.join(a, "_a").join(b, "_b").where(alike & (F.col("_c") + later >= need))


def linked(texts: DataFrame, pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs that are linked, from the products over all their columns.

    The sets are made from the texts again, only where a pair needs them. Rows of
    one left side follow its set in blocks of CHUNK_ROWS, so that the copies of one
    text are spread over tasks and a task holds two sets at a time.
    """
    kind = key_type(texts)
    counts = pairs.groupBy("_a").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("_chunks"))
    chunked = pairs.join(counts, "_a").select("_a", "_b", F.pmod(F.hash("_b"), F.col("_chunks")).cast("int").alias("_chunk"))
    right = chunked.select(F.col("_b").alias("_key"), "_a", "_chunk", "_b")
    left = chunked.groupBy("_a", "_chunk").agg(F.count("*")).select(F.col("_a").alias("_key"), "_a", "_chunk", F.lit(None).cast(kind).alias("_b"))
    wanted = settle(right.unionByName(left))
    if wanted.count() <= 2 * BROADCAST_PAIRS:
        wanted = F.broadcast(wanted)
    rows = texts.where(F.col("_text").isNotNull()).join(wanted, "_key").select("_a", "_chunk", "_b", "_text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in batches:
            found = [np.unique(shingles(hashes.words(t))).view(np.int64) for t in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], as_lists(found)], names=["_a", "_chunk", "_b", "_set"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, whose = None, None
        for batch in batches:
            out = []
            for a, b, row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), range(batch.num_rows)):
                values = batch.column(3)[row].values.to_numpy()
                if b is None:
                    mine, whose = values, a
                elif a == whose:
                    common = len(mine) + len(values) - len(np.union1d(mine, values))
                    if 100 * common >= THRESHOLD * (len(mine) + len(values) - common):
                        out.append(row)
                else:
                    raise ValueError("the set of a left side is missing")
            yield batch.take(pa.array(out, pa.int64())).select(["_a", "_b"])

    made = rows.mapInArrow(sets, f"_a {kind}, _chunk int, _b {kind}, _set array<bigint>")
    ordered = made.repartition("_a", "_chunk").sortWithinPartitions("_a", "_chunk", F.asc_nulls_first("_b"))
    return ordered.mapInArrow(products, f"_a {kind}, _b {kind}")


def cross_links(texts: DataFrame, shared: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs of components with a linked pair of members, for all components that `labels` leaves apart.

    Two components that have a link have as many common rare columns as two of
    their members need at least. Components with enough of them are put into
    clusters. The nodes of a cluster are cut into blocks; a large component has blocks of
    its own, which need no product among themselves. Each pair of blocks is one
    task's dense product over all columns that two of its sets share.
    """
    kind, none = key_type(texts), F.lit("0").cast(key_type(texts))
    named = shared.join(labels, shared["_node"] == labels["_member"], "left").select("_shingle", "_node", F.coalesce("_label", "_node").alias("_label"))
    named = settle(named)
    members = settle(named.select("_node", "_label").distinct().join(sizes.withColumnRenamed("_key", "_node"), "_node"))
    ranges = settle(members.groupBy("_label").agg(F.min("_n").alias("_low"), F.max("_n").alias("_high"), F.count("*").alias("_members")))
    mixed = named.groupBy("_shingle").agg(F.min("_label").alias("_first"), F.max("_label").alias("_last")).where("_first < _last").select("_shingle")
    held = named.join(mixed, "_shingle").select("_shingle", "_label").distinct().join(ranges.drop("_members"), "_label")
    held = settle(held)
    one = held.select("_shingle", F.col("_label").alias("_a"), F.col("_low").alias("_al"), F.col("_high").alias("_ah"))
    other = held.select("_shingle", F.col("_label").alias("_b"), F.col("_low").alias("_bl"), F.col("_high").alias("_bh"))
    part = THRESHOLD / 100
    alike = (F.col("_ah") >= part * F.col("_bl")) & (F.col("_bh") >= part * F.col("_al"))
    common = (
        one.join(other, "_shingle")
        .where((F.col("_a") < F.col("_b")) & alike)
        .groupBy("_a", "_b")
        .agg(F.count("*").alias("_c"), *(F.max(c).alias(c) for c in ("_al", "_ah", "_bl", "_bh")))
    )

    def least(low: str, small: str, large: str) -> Column:
        """Common rare columns that a set of at least `low` and a smaller one need: t / (1 + t) (m + n) - t n."""
        ratio = F.least(F.lit(1.0), F.greatest(F.lit(part), F.col(small) / F.col(large)))
        return F.col(low) * (part / (1 + part) * (1 + ratio) - part)

    enough = F.col("_c") + 1e-6 >= F.least(least("_bl", "_al", "_bh"), least("_al", "_bl", "_ah"))
    clusters = components(settle(common.where(enough).select("_a", "_b")), None)

    inside = members.join(clusters.select(F.col("_member").alias("_label"), F.col("_label").alias("_cluster")), "_label").join(
        ranges.select("_label", "_members"), "_label"
    )
    large = F.col("_members") >= BLOCK_ROWS
    packed = inside.where(~large).groupBy("_cluster").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_blocks"))
    placed = inside.join(packed, "_cluster", "left").select(
        "_cluster", "_node", "_label",
        # blocks of a large component are named by its label, the others by none
        F.when(large, F.col("_label")).alias("_own"),
        F.when(large, F.pmod(F.hash("_node"), F.ceil(F.col("_members") / BLOCK_ROWS)))
        .otherwise(F.pmod(F.hash("_label"), F.col("_blocks"))).alias("_block"),
    )
    placed = settle(placed)
    blocks = settle(placed.select("_cluster", "_own", "_block").distinct())
    left = blocks.select("_cluster", F.struct(F.coalesce("_own", none).alias("o"), F.col("_own").isNull().alias("s"), F.col("_block").alias("b")).alias("_x"))
    right = left.withColumnRenamed("_x", "_y")
    pairs = left.join(right, "_cluster").where("_x <= _y AND NOT (_x.o = _y.o AND NOT _x.s AND NOT _y.s)")
    pairs = pairs.select("_cluster", "_x", "_y", F.xxhash64("_cluster", "_x", "_y").alias("_product"))
    ends = pairs.select("_cluster", "_product", F.explode(F.array_distinct(F.array("_x", "_y"))).alias("_x"))
    named_blocks = placed.select(
        "_cluster", "_node", "_label", F.struct(F.coalesce("_own", none).alias("o"), F.col("_own").isNull().alias("s"), F.col("_block").alias("b")).alias("_x")
    )
    wanted = settle(named_blocks.join(ends, ["_cluster", "_x"]).select(F.col("_node").alias("_key"), "_product", "_label"))
    if wanted.count() <= 2 * BROADCAST_PAIRS:
        wanted = F.broadcast(wanted)
    rows = texts.where(F.col("_text").isNotNull()).join(wanted, "_key").select("_product", "_label", "_key", "_text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part_ in batches:
            found = [np.unique(shingles(hashes.words(t))).view(np.int64) for t in part_.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part_.columns[:3], as_lists(found)], names=["_product", "_label", "_key", "_set"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, names, held_sets = None, [], []

        def links() -> pa.RecordBatch:
            found = sorted(linked_labels(names, held_sets)) if held_sets else []
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], arrow) for i in (0, 1)], names=["_a", "_b"])

        for batch in batches:
            for product, label, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), range(batch.num_rows)):
                if product != current:
                    yield links()
                    current, names, held_sets = product, [], []
                names.append(label)
                held_sets.append(batch.column(3)[row].values.to_numpy())
        yield links()

    made = rows.mapInArrow(sets, f"_product bigint, _label {kind}, _key {kind}, _set array<bigint>")
    arrow = to_arrow_type(made.schema["_key"].dataType)
    return made.repartition("_product").sortWithinPartitions("_product").mapInArrow(products, f"_a {kind}, _b {kind}")


def linked_labels(labels: list, sets: list[np.ndarray]) -> set[tuple]:
    """Pairs of different labels with linked sets, from the product of sets by shingles in blocks of columns."""
    sizes = np.array([len(s) for s in sets])
    _, column, met = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    # a shingle of one set adds nothing
    row, column = row[met[column] > 1], column[met[column] > 1]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, PRODUCT_COLUMNS):
        start, stop = np.searchsorted(column, [first, first + PRODUCT_COLUMNS])
        dense = np.zeros((len(sets), PRODUCT_COLUMNS), np.float32)
        dense[row[start:stop], column[start:stop] - first] = 1
        common += dense @ dense.T
    union = sizes[:, None] + sizes[None, :] - common
    i, j = np.nonzero(100 * common >= THRESHOLD * union)
    return {(labels[x], labels[y]) for x, y in zip(i, j) if labels[x] < labels[y]}


def components(edges: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Smallest member of the component of each node with an edge; earlier labels are built upon.

    Each round every node takes the smallest label of its neighbours and then the
    label of its label, so chains shorten by half; rounds end when no label changes.
    """
    if labels is not None:
        # earlier components become single nodes again
        for end in ("_a", "_b"):
            named = labels.select(F.col("_member").alias(end), F.col("_label").alias("_named"))
            edges = edges.join(named, end, "left").withColumn(end, F.coalesce("_named", end)).drop("_named")
        merged = components(settle(edges.where("_a != _b").distinct()), None)
        moved = merged.select(F.col("_member").alias("_label"), F.col("_label").alias("_to"))
        kept = labels.join(moved, "_label", "left").select("_member", F.coalesce("_to", "_label").alias("_label"))
        return settle(kept.unionByName(merged.join(labels.select("_member"), "_member", "left_anti")))
    both = settle(edges.select("_a", "_b").unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))))
    current = settle(both.groupBy(F.col("_a").alias("_member")).agg(F.least(F.min("_b"), F.first("_a")).alias("_label")))
    while True:
        near = both.join(current, both["_b"] == current["_member"]).groupBy("_a").agg(F.min("_label").alias("_near"))
        hooked = current.join(near, current["_member"] == near["_a"]).select("_member", F.least("_label", "_near").alias("_new"), F.col("_label").alias("_old"))
        hooked = settle(hooked)
        jump = hooked.select(F.col("_member").alias("_new"), F.col("_new").alias("_next"))
        after = settle(hooked.join(jump, "_new", "left").select("_member", F.least("_new", "_next").alias("_label"), "_old"))
        done = after.where("_label != _old").isEmpty()
        current = after.select("_member", "_label")
        if done:
            return current


def word_levels(texts: DataFrame) -> np.ndarray:
    """For each bucket of words a level: four times the binary logarithm of the number of texts with it.

    Every text is counted. Tasks pass on the buckets they met twice or more, so the
    driver sees at most one number per bucket. The levels only order the columns:
    any order gives the same links, this one leaves columns of many texts unused.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, read = WordHashes(), np.zeros(1 << SKETCH_BITS, np.uint16), 0
        for batch in batches:
            for text in batch.column(0):
                counts[bucket(hashes.words(text.as_py()))] += 1  # once per text, however often it holds the word
                read += 1
                if read == SKETCH_TEXTS:
                    yield standing_out(counts)
                    counts[:] = read = 0
        yield standing_out(counts)

    seen = texts.where(F.col("_text").isNotNull()).select("_text").mapInArrow(count, "_bucket int, _n bigint")
    sums = seen.groupBy("_bucket").agg(F.sum("_n").alias("_n")).toArrow()
    level = np.zeros(1 << SKETCH_BITS, np.uint8)
    level[sums.column("_bucket").to_numpy()] = np.minimum(4 * np.log2(sums.column("_n").to_numpy()), 255).astype(np.uint8)
    return level


def standing_out(counts: np.ndarray) -> pa.RecordBatch:
    high = np.flatnonzero(counts >= SKETCH_LEAST).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(high), pa.array(counts[high].astype(np.int64))], names=["_bucket", "_n"])


def bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32)


def _features(texts: DataFrame, level: np.ndarray) -> DataFrame:
    """Per text: number of shingles, hash of the set, and its first shingles in the order of columns."""
    shared = texts.sparkSession.sparkContext.broadcast(level)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, levels = WordHashes(), shared.value
        for batch in batches:
            sizes, names, rare = [], [], []
            for text in batch.column(1):
                words = hashes.words(text.as_py() or b"")
                found, at = np.unique(shingles(words), return_index=True)
                n = len(found)
                sizes.append(n)
                names.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63))
                # a shingle is in no more texts than its rarest word
                rarest = windows(levels[bucket(words)], np.minimum)[at] if n else at
                first = n - (THRESHOLD * n + 99) // 100 + 1 if n else 0
                rare.append(found[np.argsort(rarest, kind="stable")[:first]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), as_lists(rare)],
                names=["_key", "_n", "_set", "_rare"],
            )

    return texts.mapInArrow(describe, f"_key {key_type(texts)}, _n bigint, _set bigint, _rare array<bigint>")


def key_type(texts: DataFrame) -> str:
    return texts.schema["_key"].dataType.simpleString()


def as_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


class WordHashes(dict):
    """64-bit hashes of the words that a task has met lately."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def words(self, text: bytes) -> np.ndarray:
        """Hashes of the words of a text in order."""
        if len(self) > MEMO_WORDS:
            self.clear()
        # on bytes, lower() and split() know ASCII only
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def windows(values: np.ndarray, join) -> np.ndarray:
    """Each window of five words joined into one value; all words of a shorter text make one window."""
    width = min(len(values), SHINGLE_WORDS)
    count = len(values) - width + 1 if width else 0
    out = values[:count].copy()
    for k in range(1, width):
        out = join(out, values[k : count + k])
    return out


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all shingles in order, repeats included."""
    rolled = windows(words, lambda before, word: before * _STEP + word)
    # a short text differs from a shingle of five words by its length
    rolled += np.uint64(min(len(words), SHINGLE_WORDS))
    rolled ^= rolled >> np.uint64(31)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(29)
    return rolled
