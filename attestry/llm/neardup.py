"""Near-duplicate groups: one-permutation MinHash, banded buckets, star-shaped candidates.

A document's set holds the hashes of its distinct word shingles. Documents with one and the same
set are one class, found by a sum of hashes; only classes go on. One permutation deals
a set's hashes into bins, each bin keeps its smallest, and an empty bin
borrows from the first filled bin of its own random order (optimal densification).
Bands of bins are bucket keys. Within a bucket, candidates form a star around the member that
shares most buckets with others, so n members give n - 1 pairs. Pairs are measured on the full sets.

A star may miss links between members that are not similar enough to its centre. So the measured pairs
also form clusters, at a lower similarity; where a cluster holds several groups, the sets
outside its largest group are compared with all its members, exactly, in blocks of bounded size. A block's
task returns only the links that join groups. Buckets that hold several clusters are compared
in the same way, but for pairs within a cluster, so every linked pair that shares a bucket is found. Sets too small to differ by more than one
shingle do not rely on chance: they meet in buckets of their exact set with one shingle left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.bloom import lookup, maybe_in
from attestry.llm.graph import connected_components
from attestry.llm.storage import files_of, stored
from attestry.llm.words import NOT_SPACE, Words, mix, pieces, text_bytes

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
SHINGLE = np.uint64(0xA24BAED4963EE407)
NODE, CHECK = np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D)
FEATURES = "doc_id long, n_shingles long, node long, check long, bands binary, small binary"
#: Measured pairs whose similarity is below the threshold by at most this many percent hold a cluster together.
SLACK = 20
#: Shingles of the sets that one side of a block holds.
BLOCK_SHINGLES = 500_000
COLUMNS = 2048
#: Sets of either side that are compared at once within a block.
TILE = 500
#: Bytes of text whose sets are built at once.
TEXT_BYTES = 1 << 19
DONORS = np.stack([np.random.RandomState(1000 + i).permutation(BINS) for i in range(BINS)])


def small_limit(percent: int) -> int:
    """Sets below this size are linked only with sets of one shingle more, or one less."""
    return -(-2 * percent // (100 - percent)) if percent < 100 else 1 << 30


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, sorted distinct shingle hashes, and their offsets per row."""
    data, offsets = text_bytes(column)
    for low, high in pieces(offsets, TEXT_BYTES):
        words = Words(data, offsets[low : high + 1], NOT_SPACE)
        hashes = words.hashes()
        count = np.diff(words.offsets)
        full = np.flatnonzero(np.arange(len(hashes)) + width <= words.offsets[1:][words.rows])
        value = np.zeros(len(full), np.uint64)
        for step in range(width):
            value = value * SHINGLE + hashes[full + step]
        rows = words.rows[full]
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            whole = np.full(len(short), 7, np.uint64)
            for step in range(width - 1):
                more = count[short] > step
                at = words.offsets[short] + step
                whole[more] = whole[more] * SHINGLE + hashes[at[more]]
            value, rows = np.concatenate((value, mix(whole))), np.concatenate((rows, short))
        value = mix(value)
        order = np.lexsort((value, rows))
        value, rows = value[order], rows[order]
        fresh = np.ones(len(value), dtype=bool)
        fresh[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
        value, rows = value[fresh], rows[fresh]
        yield low, value, np.searchsorted(rows, np.arange(high - low + 1))


def set_sums(value: np.ndarray, offsets: np.ndarray, salt: np.uint64) -> np.ndarray:
    """One hash per set, the same for every order of its members."""
    run = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value ^ salt), out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


def signatures(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Densified one-permutation signatures, a row of 32-bit values per non-empty set."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bins = ((value >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    place = rows * BINS + bins
    first = np.ones(len(place), dtype=bool)
    first[1:] = place[1:] != place[:-1]  # sets are sorted, so a bin's first hash is its smallest
    out = np.zeros((len(offsets) - 1) * BINS, np.uint32)
    filled = np.zeros(len(out), dtype=bool)
    out[place[first]] = (value[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    filled[place[first]] = True
    out, filled = out.reshape(-1, BINS), filled.reshape(-1, BINS)
    sparse = np.flatnonzero(~filled.all(axis=1))
    for begin in range(0, len(sparse), 500):
        some = sparse[begin : begin + 500]
        donor = filled[some][:, DONORS].argmax(axis=2)
        borrowed = np.take_along_axis(out[some], DONORS[np.arange(BINS), donor], axis=1)
        out[some] = np.where(filled[some], out[some], borrowed)
    return out


def band_keys(lines: np.ndarray) -> np.ndarray:
    """Bucket keys of signatures, one per band."""
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(lines), 1))
    for row in range(ROWS):
        keys = mix(keys * SHINGLE + lines[:, row : BANDS * ROWS : ROWS])
    return keys


def document_features(documents: DataFrame, width: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """Set size, 128-bit set key, bucket keys of the signature, and small-set keys of every row; no text."""
    limit = small_limit(percent)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, value, offsets in shingle_sets(batch.column(1), width):
                count = np.diff(offsets)
                one = mix(value ^ NODE)
                node, check = set_sums(value, offsets, NODE), set_sums(value, offsets, CHECK)
                keys = band_keys(signatures(value, offsets))
                bands = [keys[i].tobytes() if n >= limit else None for i, n in enumerate(count)]
                small = [
                    np.append(node[i], node[i] - one[offsets[i] : offsets[i + 1]]).tobytes() if 0 < n <= limit else None
                    for i, n in enumerate(count)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, len(count)),
                        pa.array(count, pa.int64()),
                        pa.array(node.view(np.int64)),
                        pa.array(check.view(np.int64)),
                        pa.array(bands, pa.binary()),
                        pa.array(small, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "node", "check", "bands", "small"],
                )

    return documents.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(features, FEATURES)


def buckets(
    classes: DataFrame, percent: int, some: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda batch: batch
) -> DataFrame:
    """``key, node, n, rank``: a row per class and bucket, of those that ``some`` leaves; the lowest rank is the star's centre."""
    limit = small_limit(percent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4000):
                part = batch.slice(begin, 4000)
                node = part.column(0).to_numpy()
                count = part.column(1).to_numpy()
                key, owner, rank = [], [], []
                banded = [i for i, s in enumerate(part.column(2)) if s.is_valid]
                if banded:
                    keys = np.stack([np.frombuffer(part.column(2)[i].as_py(), np.uint64) for i in banded])
                    key.append(keys.T.ravel())
                    owner.append(np.tile(banded, BANDS))
                    rank.append(np.zeros(keys.size, np.int8))
                for i, keys in enumerate(part.column(3)):
                    if keys.is_valid:
                        values = np.frombuffer(keys.as_py(), np.uint64)
                        # The whole set is a key only where a set of one shingle more can be linked to it.
                        values = values if count[i] < limit else values[1:]
                        key.append(mix(values + np.uint64(1)))
                        owner.append(np.full(len(values), i))
                        rank.append((np.arange(len(values)) + (count[i] >= limit) > 0).astype(np.int8))
                if key:
                    at = np.concatenate(owner)
                    yield some(
                        pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.concatenate(key).view(np.int64)),
                                pa.array(node[at]),
                                pa.array(count[at]),
                                pa.array(np.concatenate(rank)),
                            ],
                            ["key", "node", "n", "rank"],
                        )
                    )

    return classes.select("node", "n_shingles", "bands", "small").mapInArrow(
        rows, "key long, node long, n long, rank byte"
    )


def near_sizes(percent: int) -> F.Column:
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * percent


def class_sets(wanted: DataFrame, documents: DataFrame, width: int) -> DataFrame:
    """``doc_id, node, set``: the full sets of the given classes (``node, doc_id``), from the texts of their first documents.

    Neither texts nor sets move: a filter of the documents' ids stands before the sets are built. It lets some other
    documents pass, so a set is that of its class only together with the ``doc_id``. The filter is looked up by the
    process that builds the sets, so a task has one Python process.
    """
    some = lookup(wanted.select("doc_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(some, batches):
            if not batch.num_rows:
                continue
            for low, value, offsets in shingle_sets(batch.column(1), width):
                packed = [value[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(offsets) - 1)]
                node = pa.array(set_sums(value, offsets, NODE).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(packed)), node, pa.array(packed, pa.binary())], ["doc_id", "node", "set"]
                )

    return documents.select("doc_id", "text").mapInArrow(sets, "doc_id long, node long, set binary")


def measured(pairs: DataFrame, wanted: DataFrame, sets: DataFrame, files: int | None = None) -> DataFrame:
    """The pairs ``a, b`` with the sizes of the sets' intersection and union."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, union = [], []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                both = np.concatenate([np.frombuffer(s.as_buffer(), np.uint64) for s in (one, two)])
                both.sort(kind="stable")
                common.append(int((both[1:] == both[:-1]).sum()))
                union.append(len(both) - common[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64())],
                ["a", "b", "common", "union"],
            )

    for end in ("a", "b"):
        pairs = pairs.join(wanted.select(F.col("node").alias(end), F.col("doc_id").alias(f"{end}_doc")), end)
    left, right = sets.alias("l"), sets.alias("r")
    return (
        stored(pairs, "near-measured", files).join(left, (F.col("a") == F.col("l.node")) & (F.col("a_doc") == F.col("l.doc_id")))
        .select("a", "b", "b_doc", F.col("l.set").alias("one"))
        .join(right, (F.col("b") == F.col("r.node")) & (F.col("b_doc") == F.col("r.doc_id")))
        .select("a", "b", "one", F.col("r.set").alias("two"))
        .mapInArrow(measure, "a long, b long, common long, union long")
    )


def links_across(members: DataFrame, wanted: DataFrame, sets: DataFrame, percent: int, files: int | None = None) -> DataFrame:
    """Links ``a, b`` between the groups of each cluster.

    ``members`` holds ``cluster, node, n, label, part``; nodes of one part have no links left to find among them. Sets outside
    the cluster's largest part meet all of its sets; both sides are
    cut into blocks, and each pair of blocks is compared by itself. Only sets of these blocks are sent.
    """
    groups = members.groupBy("cluster", "part").agg(
        F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    groups = stored(groups, "near-groups", files)
    clusters = groups.groupBy("cluster").agg(
        F.max(F.struct("size", "part"))["part"].alias("main"), F.sum("shingles").alias("all"), F.count("*").alias("groups")
    ).where("groups > 1")
    outer = groups.alias("g").join(clusters, "cluster").groupBy("cluster", "main", "all").agg(
        F.sum(F.when(F.col("part") != F.col("main"), F.col("shingles"))).alias("outside"),
        F.min(F.when(F.col("part") != F.col("main"), F.col("least"))).alias("least"),
        F.max(F.when(F.col("part") != F.col("main"), F.col("most"))).alias("most"),
    )
    clusters = stored(outer.select(
        "cluster",
        "main",
        "least",
        "most",
        F.ceil(F.col("outside") / BLOCK_SHINGLES).cast("int").alias("rows"),
        F.ceil(F.col("all") / BLOCK_SHINGLES).cast("int").alias("columns"),
    ), "near-mixed", files)

    def place(parts: str) -> F.Column:
        return F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")

    def each(parts: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    # Sets too small or too large for any set outside the largest part are left out.
    fits = (F.col("n") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("n") * percent)
    held = members.join(clusters, "cluster").where((F.col("part") != F.col("main")) | fits)
    held = held.withColumn("outside", F.col("part") != F.col("main"))
    held = held.withColumn("_i", F.when(F.col("outside"), place("rows")).otherwise(F.lit(-1))).withColumn("_j", place("columns"))
    # A set outside is on the left of its row of blocks and on the right of its column; where these cross it is sent once.
    left = held.where("outside").withColumn("j", each("columns")).select(
        "cluster", "node", "label", F.lit(True).alias("left"), (F.col("j") == F.col("_j")).alias("right"), F.col("_i").alias("i"), "j"
    )
    right = held.withColumn("i", each("rows")).where("i <> _i").select(
        "cluster", "node", "label", F.lit(False).alias("left"), F.lit(True).alias("right"), "i", F.col("_j").alias("j")
    )
    blocks = stored(left.unionByName(right).join(wanted, "node"), "near-blocks", files)
    needed = sets.where(maybe_in(blocks.select("node").distinct(), "node"))
    blocks = blocks.join(needed, ["node", "doc_id"]).drop("doc_id")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return block_links(rows, percent)

    return blocks.groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long")


def block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links ``a, b`` that join groups, of one block's rows ``node, label, left, right, set``.

    Besides the sets themselves, memory follows ``TILE``, not the block.
    """
    sides = [rows[rows["left"]], rows[rows["right"]]]
    lists = [[np.frombuffer(s, np.uint64) for s in side["set"]] for side in sides]
    sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in lists]
    nodes, labels = ([side[c].to_numpy() for side in sides] for c in ("node", "label"))
    group = {x: x for x in np.concatenate(labels).tolist()}

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    found = []
    for i, j in itertools.product(*(range(0, len(side), TILE) for side in lists)):
        left, right = slice(i, i + TILE), slice(j, j + TILE)
        common = shared_counts(lists[0][left], lists[1][right])
        linked = 100 * common >= percent * (sizes[0][left, None] + sizes[1][None, right] - common)
        for a, b in zip(*np.nonzero(linked & (labels[0][left, None] != labels[1][None, right])), strict=True):
            one, two = root(int(labels[0][i + a])), root(int(labels[1][j + b]))
            if one != two:
                group[one] = two
                found.append((nodes[0][i + a], nodes[1][j + b]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def mixed_buckets(shared: DataFrame, centers: DataFrame, labels: DataFrame, percent: int, files: int | None = None) -> DataFrame:
    """``cluster, node, n, label, part``: banded buckets that hold several parts and pairs without their centre.

    ``labels`` holds ``node, label, part``; a part is a cluster whose groups were compared before.
    Of buckets with the same members one stands for all. In the buckets of small sets the star is complete.
    """
    banded = centers.where((F.col("lead") == 0) & (F.col("m") >= small_limit(percent))).select("key")
    held = shared.where("size > 2").select("key", "node", "n").join(banded, "key").join(labels, "node", "left")
    held = held.withColumn("label", F.coalesce("label", "node")).withColumn("part", F.coalesce("part", "node"))
    held = stored(held, "near-held", files)
    mixed = held.groupBy("key").agg(
        F.count("*").alias("size"),
        F.min("part").alias("least"),
        F.max("part").alias("most"),
        F.bit_xor(F.xxhash64("node")).alias("one"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two"),
    ).where("least <> most")
    mixed = stored(mixed.groupBy("size", "one", "two").agg(F.min("key").alias("key")).select("key"), "near-open", files)
    return stored(held.join(mixed, "key").withColumnRenamed("key", "cluster"), "near-mixed-members", files)


def joined_labels(labels: DataFrame, more: DataFrame, files: int | None = None) -> DataFrame:
    """``labels`` after the links ``more`` between nodes of different groups."""
    if more.isEmpty():
        return labels
    joined = more.join(labels.alias("l"), F.col("a") == F.col("l.node"), "left").select(
        F.coalesce("l.label", "a").alias("a"), "b"
    ).join(labels.alias("r"), F.col("b") == F.col("r.node"), "left").select("a", F.coalesce("r.label", "b").alias("b"))
    over = stored(connected_components(joined, "near-joined", files), "near-over", files).select(
        F.col("node").alias("label"), F.col("label").alias("top")
    )
    # A group's label stands for all its nodes, and so does a node that had no link.
    labels = labels.unionByName(over.select(F.col("label").alias("node"), "label").join(labels.select("node"), "node", "left_anti"))
    labels = labels.join(over, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return stored(labels, "near-labels", files)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of membership matrices."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not left or not right:
        return out
    sides = [np.concatenate(side) for side in (left, right)]
    both = np.intersect1d(*sides)
    rows, columns = [], []
    for side, values in zip((left, right), sides, strict=True):
        row = np.repeat(np.arange(len(side)), [len(x) for x in side])
        column = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        known = both[column] == values if len(both) else np.zeros(len(values), dtype=bool)
        order = np.argsort(column[known], kind="stable")
        rows.append(row[known][order])
        columns.append(column[known][order])
    for low in range(0, len(both), COLUMNS):
        dense = []
        for side, row, column in zip((left, right), rows, columns, strict=True):
            a, b = np.searchsorted(column, (low, low + COLUMNS))
            part = np.zeros((len(side), COLUMNS), np.float32)
            part[row[a:b], column[a:b] - low] = 1
            dense.append(part)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def near_duplicates(
    documents: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``.

    Two rows are linked when their shingle sets have a Jaccard similarity of at least ``percent`` / 100;
    ``component_id`` is the smallest doc_id that links lead to, and ``kept`` marks the row of that id.
    A text with fewer than ``width`` words is one shingle; a null or wordless text has an empty set and
    is a component of its own. Repeated rows are linked like any equal sets. A row without doc_id is
    linked with nothing, has no component, and is kept. Other columns are not read; an empty
    table gives no rows.
    """
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    features = stored(document_features(docs, width, percent, "doc_id", "text"), "near-features")
    # Tables from here on are small beside the texts; written by every partition of a shuffle, they would be very many tiny files.
    number, shingles = features.agg(F.count("*"), F.sum("n_shingles")).first()
    files = files_of(number, shingles or 0)
    classes = (
        features.where("n_shingles > 0 and doc_id is not null")
        .groupBy("node", "check", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("small").alias("small"))
    )
    classes = stored(classes.drop("check"), "near-classes", files)

    sizes = buckets(classes, percent).groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    sizes = stored(sizes, "near-sizes", files)
    # Most keys have one class; these rows stay where they are.
    held = buckets(classes, percent, lookup(sizes.select("key")))
    shared = stored(held.join(sizes, "key"), "near-shared", files)
    weights = stored(shared.groupBy("node").agg(F.sum("size").alias("weight")), "near-weights", files)
    centers = (
        shared.join(weights, "node")
        .groupBy("key")
        .agg(F.min(F.struct("rank", -F.col("weight"), "node", "n")).alias("center"))
        .select("key", F.col("center.rank").alias("lead"), F.col("center.node").alias("a"), F.col("center.n").alias("m"))
    )
    centers = stored(centers, "near-centers", files)
    stars = (
        shared.join(centers, "key")
        .where("node <> a and lead = 0")
        .where(near_sizes(percent - SLACK))
        .select("a", F.col("node").alias("b"))
        .distinct()
    )
    stars = stored(stars, "near-stars", files)
    ends = stars.select(F.col("a").alias("node")).union(stars.select("b"))
    ends = ends.union(shared.where((F.col("size") > 2) & (F.col("n") >= small_limit(percent))).select("node")).distinct()
    wanted = stored(ends.join(classes.select("node", F.col("rep").alias("doc_id")), "node"), "near-ends", files)
    sets = stored(class_sets(wanted, docs, width), "near-sets")
    pairs = stored(measured(stars, wanted, sets, files), "near-pairs", files)
    links = pairs.where(F.col("common") * 100 >= F.col("union") * percent).select("a", "b")
    labels = connected_components(links, "near-links", files)

    clusters = connected_components(
        pairs.where(F.col("common") * 100 >= F.col("union") * (percent - SLACK)).select("a", "b"), "near-clusters", files
    ).withColumnRenamed("label", "cluster")
    members = clusters.join(labels, "node", "left").join(classes.select("node", F.col("n_shingles").alias("n")), "node")
    members = stored(members.withColumn("label", F.coalesce("label", "node")), "near-members", files)
    more = stored(links_across(members.withColumn("part", F.col("label")), wanted, sets, percent, files), "near-more")
    labels = joined_labels(labels, more, files)
    # A group lies within a cluster, and a cluster's groups have been compared: what is left lies between clusters.
    compared = members.select("node", F.col("cluster").alias("part")).join(labels, "node", "left")
    rest = mixed_buckets(shared, centers, compared, percent, files)
    labels = joined_labels(labels, stored(links_across(rest, wanted, sets, percent, files), "near-rest"), files)

    named = classes.select("node", "rep").join(labels, "node", "left").select(
        "node", "rep", F.coalesce("label", "node").alias("label")
    )
    named = stored(named, "near-named", files)
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    groups = stored(named.join(stored(least, "near-least", files), "label").select("node", "component_id"), "near-groups", files)
    found = features.select("doc_id", "n_shingles", "node").join(groups, "node", "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
