"""N-gram Jaccard join with count-vector R-trees.

A document is the set of its five-word shingles. Shingles are hashed into
groups; the counts per group are the coordinates of a point. For two points
the sum of the smaller coordinates bounds the overlap of the sets from above,
and so does the sum of the minima of a point and a box's upper corner: an
R-tree over the points skips whole boxes that cannot reach the overlap that
the similarity needs. Pairs that survive are verified on the full sets.

One tree over all documents would not spread over a cluster, so trees are
built per block. Two sets of similarity 3/4 share one of the first quarter of
their shingles in any fixed order. Of the nodes with such a shingle the one
with the fewest rare shingles is its centre, and a block is a centre with all
nodes that share one of its shingles. Rare shingles come first, so widely
shared passages make few blocks.

Work stays near linear in groups of copies. Equal sets are one node from the
start. Then each node is verified against the likeliest of its centres that
the bound allows, which is mostly the text that its neighbours were copied
from. Blocks that still hold different components are searched with trees,
first for each point's nearest one in another component, and when those are
joined for all pairs that are left, so that no link can be missing. Bounds go
before sets: only sets of pairs that a bound leaves are fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import FILTER_BITS, WORD, bitmap, cut, in_slices, in_small_batches, keyed_text, lean, split_by_keys, table
from tidelog.llm.components import forest_roots, hung

WORDS = 5
#: Linked if 4 * intersection >= 3 * union.
NUMERATOR, DENOMINATOR = 3, 4
#: A shingle is common if it is in so many sets; the MOST_COMMON most frequent
#: ones are told apart. They only order the shingles: results don't depend on them.
COMMON_LEAST, MOST_COMMON = 4, 1_000_000
#: So many shingles are counted together when a task looks for common ones.
COUNTED = 2_000_000
#: Points have a power of two of coordinates: for every shingle up to SINGLE_GROUPS
#: of them, so that bounds are tight for short texts, then for two to four each.
PER_GROUP, FEWEST_GROUPS, SINGLE_GROUPS, MOST_GROUPS = 4, 128, 512, 1 << 16
#: Points or boxes in a box of a tree, and points of a block that meet in one tree.
FAN, TILE = 32, 512
#: Rounds in which a node passes on its nearest point only, before all that are left.
NEAREST_ROUNDS = 1
#: Parts over which rows of one text or component are dealt.
SALTS = 8

_POWERS = np.array([pow(5, 2 * k + 1, 1 << 64) for k in range(WORDS)], dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray, by: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * by
    return h ^ (h >> np.uint64(32))


#: Masks for the last bytes of a word, and the white space bytes.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_GAPS = np.zeros(256, dtype=bool)
_GAPS[list(b" \t\n\x0b\x0c\r")] = True
#: Longer words are hashed one by one.
LONG_WORD = 256


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and starts of all words, eight bytes of every word at a time; `data` begins and ends with white space."""
    gap = _GAPS[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    at = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each place on
    found = lengths.astype(np.uint64) * _MIX[1]
    found = _mixed(found ^ (at[starts] & _MASKS[np.minimum(lengths, 8)]), _MIX[0])
    more = np.flatnonzero(lengths > 8)
    for done in range(8, LONG_WORD, 8):
        if not len(more):
            break
        left = np.minimum(lengths[more] - done, 8)
        found[more] = _mixed(found[more] ^ (at[starts[more] + done] & _MASKS[left]), _MIX[0])
        more = more[lengths[more] > done + 8]
    for i in more:
        found[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return found, starts


def shingle(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; A-Z count as a-z."""
    raw = [t.encode() for t in texts]
    data = b"\n" + b"\n".join(raw).lower() + b"\n"  # bytes: only A-Z change, only the six white space bytes split
    own, starts = word_hashes(data)
    ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))
    rolled = np.zeros(max(0, len(own) - WORDS + 1), dtype=np.uint64)
    for k in range(WORDS):
        rolled += own[k : k + len(rolled)] * _POWERS[k]
    rolled = _mixed(rolled, _MIX[0])
    sets, begin = [], 0
    for end in ends.tolist():
        count = end - begin
        if count >= WORDS:
            s = np.sort(rolled[begin : end - WORDS + 1])
            fresh = np.empty(len(s), dtype=bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            sets.append(s[fresh])
        elif count:
            whole = (own[begin:end] * _POWERS[:count]).sum(dtype=np.uint64, keepdims=True)
            sets.append(_mixed(whole + np.uint64(count), _MIX[1]))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
        begin = end
    return sets


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent signed 64-bit digests of each set, 0 if empty; the first names its node."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    both = np.zeros((2, len(sets)), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate(sets) + np.repeat(sizes, sizes).astype(np.uint64)
        first = (np.cumsum(sizes) - sizes)[full]
        for place, by in enumerate((_MIX[1], _MIX[0] ^ _MIX[1])):
            both[place, full] = np.add.reduceat(_mixed(flat, by), first)
    return both[0].view(np.int64), both[1].view(np.int64)


def point(shingles: np.ndarray) -> np.ndarray:
    """Group counts of a set. Groups go by the low bits, so halves of a point add up to a coarser one."""
    least = max(min(len(shingles), SINGLE_GROUPS), len(shingles) / PER_GROUP)
    groups = FEWEST_GROUPS
    while groups < MOST_GROUPS and groups < least:
        groups *= 2
    return np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def packed(p: np.ndarray) -> bytes:
    """A point as its coordinates in half a byte each, or as narrow as they allow, after their width in bytes (0: a half)."""
    most = p.max()
    if most < 16:
        return bytes(1) + (p[::2] | p[1::2] << 4).astype(np.uint8).tobytes()
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes((width,)) + p.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """A point from its bytes."""
    if data[0]:
        return np.frombuffer(data, f"<u{data[0]}", offset=1)
    both = np.frombuffer(data, np.uint8, offset=1)
    return np.stack([both & 15, both >> 4], axis=1).ravel()


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """A point, or an upper corner, on fewer groups."""
    return p if len(p) == groups else p.reshape(-1, groups).sum(axis=0, dtype=np.int64)


def bound(p: np.ndarray, q: np.ndarray) -> int:
    """The most that the sets of two points, or of a point and a box, can share."""
    groups = min(len(p), len(q))
    return int(np.minimum(folded(p, groups), folded(q, groups)).sum())


def needed(m: int, n: int) -> int:
    """The least intersection of linked sets of sizes m and n."""
    return -(-NUMERATOR * (m + n) // (NUMERATOR + DENOMINATOR))


class RTree:
    """A packed R-tree over count vectors, points in order of set size.

    A box holds its children's upper corners as the rows of a matrix, and
    their least and largest sizes, so a query is held against all children at
    once. Corners of unlike lengths meet on the coarser groups, on which the
    bound still holds.
    """

    def __init__(self, points: list[np.ndarray]) -> None:
        sizes = [int(p.sum()) for p in points]
        level = [(points[i], sizes[i], sizes[i], i) for i in sorted(range(len(points)), key=sizes.__getitem__)]
        while True:
            boxes = [self._box(level[at : at + FAN]) for at in range(0, len(level), FAN)]
            if len(boxes) < 2:
                break
            level = boxes
        self.root = boxes[0] if boxes else None

    @staticmethod
    def _box(inside: list[tuple]) -> tuple:
        groups = min(len(x[0]) for x in inside)
        corners = np.stack([folded(x[0], groups) for x in inside])
        least, most = np.array([x[1] for x in inside]), np.array([x[2] for x in inside])
        return corners.max(axis=0), int(least.min()), int(most.max()), (corners, least, most, [x[3] for x in inside])

    def search(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """Place and bound of each point that may be linked to q."""
        size = int(q.sum())
        fits = -(-NUMERATOR * size // DENOMINATOR)
        waiting = [self.root[3]] if self.root else []
        while waiting:
            corners, least, most, children = waiting.pop()
            groups = min(len(q), corners.shape[1])
            if corners.shape[1] > groups:
                corners = corners.reshape(len(corners), -1, groups).sum(axis=1, dtype=np.int64)
            most_shared = np.minimum(corners, folded(q, groups)).sum(axis=1, dtype=np.int64)
            need = -(-NUMERATOR * (size + np.maximum(least, fits)) // (NUMERATOR + DENOMINATOR))
            for i in np.flatnonzero((most >= fits) & (NUMERATOR * least <= DENOMINATOR * size) & (most_shared >= need)):
                if isinstance(children[i], int):
                    yield children[i], int(most_shared[i])
                else:
                    waiting.append(children[i])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """True if two sets have at least the similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _long(values: list[int] | np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64())


SETS = "kind int, id long, node long, other long, n long, text_hash long, point binary"


def shingle_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of kind 0: a document's set. Rows of kind 1: a shingle (`node`) repeated in a task, with its count (`n`).

    Texts are taken a few megabytes at a time. A task counts COUNTED shingles
    at once, each set once. Whatever f sets of the corpus share is seen twice
    in about f * f / (2 * windows) of the windows, so a shingle that goes
    unseen is in a few times sqrt(windows) sets at most, and goes with the rare ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "node", "other", "n", "text_hash", "point"]
        held: list[np.ndarray] = []
        names_held: set[int] = set()
        counted = 0

        def common() -> pa.RecordBatch:
            values = np.concatenate(held)
            values.sort()
            edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
            counts = np.diff(edges)
            often = counts > 1
            values, counts = values[edges[:-1][often]].view(np.int64), counts[often]
            held.clear()
            names_held.clear()
            none = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(values), np.int32)), none, _long(values), none, _long(counts), none, pa.nulls(len(values), pa.binary())], names)

        for batch in batches:
            for part in in_slices(batch, 1):
                sets = shingle(part.column(1).to_pylist())
                own, other = digests(sets)
                points = [packed(point(s)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(sets), np.int32)), part.column(0), _long(own), _long(other), _long([len(s) for s in sets]), part.column(2), pa.array(points, pa.binary())],
                    names,
                )
                for s, name in zip(sets, own.tolist(), strict=True):
                    if len(s) and name not in names_held:
                        names_held.add(name)
                        held.append(s)
                        counted += len(s)
                if counted >= COUNTED:
                    yield common()
                    counted = 0
        if held:
            yield common()

    return in_small_batches(_hashed(df, id_col, text_col).select("id", "text", "text_hash")).mapInArrow(lean(run), SETS)


def _hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed_text(df, id_col, text_col).select("id", "text", F.xxhash64("text").alias("text_hash"))


def prefixes(df: DataFrame, common: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`key, apart, size, node`: the first quarter of each set's shingles, rare ones first, with the set's size.

    A key is 48 bits of a shingle's hash, as it only names a block. `apart` is the part of the set's shingles that aren't common, from 0 to 100: the
    text that others were copied from has fewer of its own than its altered copies have.
    """
    sent = df.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = sent.value
        seen: set[int] = set()
        for batch in batches:
            for part in in_slices(batch, 0):
                keys, nodes, apart, sizes, lengths = [], [], [], [], []
                sets = shingle(part.column(0).to_pylist())
                for own, node in zip(sets, digests(sets)[0].tolist(), strict=True):
                    if not len(own) or node in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(node)
                    length = len(own) - -(-NUMERATOR * len(own) // DENOMINATOR) + 1
                    first, alone = own, 100
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                        hit = frequent[at] == own
                        first = own[~hit]
                        alone = 100 * len(first) // len(own)
                        if len(first) < length:
                            often = own[hit]
                            first = np.concatenate([first, often[np.lexsort((often, counts[at[hit]]))]])
                    keys.append((first[:length] >> np.uint64(16)).view(np.int64))
                    nodes.append(node)
                    apart.append(alone)
                    sizes.append(len(own))
                    lengths.append(length)
                if keys:
                    about = zip((apart, sizes, nodes), (np.int8, np.int32, np.int64), strict=True)
                    yield pa.RecordBatch.from_arrays([_long(np.concatenate(keys)), *(pa.array(np.repeat(np.array(x, kind), lengths)) for x, kind in about)], ["key", "apart", "size", "node"])

    return in_small_batches(keyed_text(df, id_col, text_col).select("text")).mapInArrow(lean(run), "key long, apart byte, size int, node long")


def fetch_sets(df: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`node, shingles` for the nodes that are `wanted`, each from the row that stands for it, and a few more.

    The filter is a bitmap of fixed size, put together by Spark; where it is
    full, it lets every text through. A node may come more than once.
    """
    sent = df.sparkSession.sparkContext.broadcast(bitmap(wanted.select("row_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.mod(batch.column(1).to_numpy(), FILTER_BITS)
            hit = (sent.value[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1)
            for part in in_slices(batch.filter(pa.array(hit.astype(bool))), 0):
                sets = shingle(part.column(0).to_pylist())
                full = [i for i, s in enumerate(sets) if len(s)]
                yield pa.RecordBatch.from_arrays([_long(digests(sets)[0][full]), pa.array([sets[i].tobytes() for i in full], pa.binary())], ["node", "shingles"])

    return in_small_batches(_hashed(df, id_col, text_col).select("text", _row_hash().alias("row_hash"))).mapInArrow(lean(run), "node long, shingles binary")


def _row_hash() -> Column:
    return F.xxhash64("id", "text_hash")


def within_bound(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs `a, b, n` whose sizes and points leave a link possible; points are fetched where sizes do."""
    fits = DENOMINATOR * F.least("size_a", "size_b") >= NUMERATOR * F.greatest("size_a", "size_b")
    place = nodes.select("node", "point")
    left, right = (place.withColumnsRenamed({"node": x, "point": f"point_{x}"}) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3, 7)), strict=True)
            near = [bound(unpacked(p), unpacked(q)) >= needed(m, n) for m, n, p, q in rows]
            yield batch.select(["a", "b", "n"]).filter(pa.array(near, pa.bool_()))

    held = pairs.filter(fits).join(left, "a").join(right, "b").select("a", "b", "n", "size_a", "size_b", "point_a", "point_b")
    return held.mapInArrow(lean(run), "a long, b long, n long")


#: Members of a group that are verified against its centre in one run.
MEMBERS = 1000


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs `a, b` whose sets are linked.

    Pairs are grouped under `a`, in runs of about a thousand so that a node
    with many partners is spread; its set goes along to each run. Rows come in
    order, so a set that comes twice is passed over and pairs stay distinct.
    """
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("runs"))
    members = pairs.join(runs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("run"), F.col("b").alias("node"))
    centres = runs.select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.col("a").alias("node"))
    rows = members.unionByName(centres).join(sets, "node").select("a", "run", "node", "shingles")
    dealt = rows.repartition("a", "run").sortWithinPartitions("a", "run", F.col("node") != F.col("a"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own, last = None, np.empty(0, np.uint64), None
        for batch in batches:
            left, right = [], []
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for (a, number, node), held in zip(keys, batch.column(3), strict=True):
                if (a, number, node) == last:
                    continue
                last = a, number, node
                if node == a:
                    centre, own = (a, number), np.frombuffer(held.as_py(), np.uint64)
                elif centre == (a, number) and linked(own, np.frombuffer(held.as_buffer(), np.uint64)):
                    left.append(a)
                    right.append(node)
            yield pa.RecordBatch.from_arrays([_long(left), _long(right)], ["a", "b"])

    return in_small_batches(dealt).mapInArrow(lean(run), "a long, b long")


def tree_pairs(blocks: DataFrame, nodes: DataFrame, nearest: bool) -> DataFrame:
    """Candidate pairs `a, b` between components, from R-trees per block; a pair may come from several blocks.

    All of them, or for each point only the one nearest to the similarity.

    `blocks` has `centre, node, size, root`; centres themselves were held against
    their blocks before and aren't in them. Linked sets differ in size by a third at
    most, so a block is cut into bands of sizes, each with the one below it,
    and sub-blocks of one component are left out. In a sub-block the nodes of
    its largest component, `main`, meet the others only, and those meet each
    other. Either kind is dealt into tiles of about TILE points, and every two
    tiles that have to meet do so in a task of their own. So a large component
    with a few nodes beside it takes no more than its own size times those few.
    """
    # bands a little wider than the ratio, so that rounding can't put linked sets two bands apart
    band = F.floor(F.log("size") / (F.log(F.lit(DENOMINATOR / NUMERATOR)) + 1e-6)).cast("int")
    sized = blocks.withColumn("own", band).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    sized = cut(sized.select("centre", "band", (F.col("own") == F.col("band")).alias("upper"), "node", "root"), "jaccard-bands")
    counts = sized.groupBy("centre", "band", "root").agg(F.count("*").alias("n"), F.max("upper").alias("upper"))
    whole = counts.groupBy("centre", "band").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max("upper").alias("any_upper"), F.max(F.struct("n", "root")).alias("main"))
    # the lower band meets itself in its own sub-block
    tiles = (whole.filter("roots > 1 and any_upper")).select("centre", "band", F.col("main.root").alias("main"), F.ceil(F.col("main.n") / TILE).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("main.n")) / TILE).cast("int").alias("others"))
    own = sized.join(tiles, ["centre", "band"]).withColumn("is_main", F.col("root") == F.col("main"))
    numbered = own.withColumn("tile", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    across = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(F.lit(True).alias("across"), F.col("tile").alias("low"), j.alias("high")))
    with_mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: F.struct(F.lit(True).alias("across"), i.alias("low"), F.col("tile").alias("high")))
    together = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(F.lit(False).alias("across"), F.least("tile", j).alias("low"), F.greatest("tile", j).alias("high")))
    meets = F.when(F.col("is_main"), across).otherwise(F.concat(with_mains, together))
    dealt = numbered.select("centre", "band", "upper", "node", "root", F.explode(meets).alias("m")).select("centre", "band", "m.*", "upper", "node", "root")
    key = ["centre", "band", "across", "low", "high"]
    met = dealt.join(nodes.select("node", "point"), "node").repartition(*key).sortWithinPartitions(*key, "node").select(*key, "upper", "node", "root", "point")

    def pairs(upper: list[bool], nodes: list[int], roots: list[int], points: list[bytes]) -> Iterator[tuple[int, int]]:
        if len(set(roots)) < 2 or not any(upper):
            return
        vectors = [unpacked(p) for p in points]
        sizes = [int(v.sum()) for v in vectors]
        tree = RTree(vectors)
        for i, q in enumerate(vectors):
            other = ((j, most) for j, most in tree.search(q) if roots[j] != roots[i] and (upper[i] or upper[j]))
            if nearest:
                best = max(((most / (sizes[i] + sizes[j]), nodes[j]) for j, most in other), default=None)
                if best:
                    yield min(best[1], nodes[i]), max(best[1], nodes[i])
            else:
                yield from ((nodes[j], nodes[i]) for j, _ in other if nodes[j] < nodes[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, ([], [], [], []), set()
        for batch in batches:
            for *key, upper, node, root, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    out.update(pairs(*held))
                    now, held = key, ([], [], [], [])
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([_long([p[0] for p in out]), _long([p[1] for p in out])], ["a", "b"])
                    out = set()
                for column, value in zip(held, (upper, node, root, place), strict=True):
                    column.append(value)
        out.update(pairs(*held))
        yield pa.RecordBatch.from_arrays([_long([p[0] for p in out]), _long([p[1] for p in out])], ["a", "b"])

    return met.mapInArrow(lean(run), "a long, b long")


def _of(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nodes that are in a pair."""
    return nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")


def _rooted(frame: DataFrame, rooted: DataFrame, node: str, name: str) -> DataFrame:
    """The frame with the root of a node column; nodes that hang on no other are their own."""
    own = rooted.select(F.col("node").alias(node), F.col("root").alias(name))
    return frame.join(own, node, "left").withColumn(name, F.coalesce(name, node))


def _dealt(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """Rows left joined to one row per key, which goes along to each of SALTS parts, as copies of one text share their key."""
    parts = keyed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    return rows.withColumn("part", F.pmod(F.xxhash64("id", "text_hash"), F.lit(SALTS))).join(parts, [key, "part"], "left").drop("part")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, text_hash, n_shingles, node, root` for every row; equal roots are one component.

    Null and empty texts have no shingles, a null root, and links to nothing;
    shorter texts than five words are one shingle. Repeated rows share a node.
    Other columns are ignored, texts taken whole, and an empty table gives an
    empty result. Sets are told apart by 128 bits; should two sets share the
    64 bits that name a node, the job fails rather than join them.
    """
    seen = cut(shingle_sets(df, id_col, text_col), "jaccard-sets")
    sets = seen.filter("kind = 0").select("id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"), "other", "point")
    frequent = seen.filter("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_LEAST)
    top = frequent.orderBy(F.desc("n"), "node").limit(MOST_COMMON).toPandas()
    values = top["node"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    common = values[order], top["n"].to_numpy(np.int64)[order]

    nodes = cut(
        sets.filter("node is not null")
        .groupBy("node")
        .agg(F.min("other").alias("other"), F.max("other").alias("last"), F.min(_row_hash()).alias("row_hash"), F.first("n_shingles").alias("n_shingles"), F.first("point").alias("point"))
        .withColumn("point", F.when(F.col("other") == F.col("last"), F.col("point")).otherwise(F.raise_error(F.lit("two shingle sets share a 64-bit name")).cast("binary")))
        .drop("other", "last"),
        "jaccard-nodes",
    )
    # the first node of each block, as the block streams by in order
    running = W.partitionBy("key").orderBy("apart", "node").rowsBetween(W.unboundedPreceding, W.currentRow)
    listed = prefixes(df, common, id_col, text_col).withColumns({"centre": F.first("node").over(running), "centre_size": F.first("size").over(running)})
    shared = listed.filter("centre <> node").groupBy("centre", "node").agg(F.count("*").alias("n"), F.max("centre_size").alias("centre_size"), F.max("size").alias("size"))
    starred = cut(shared, "jaccard-starred")
    hopeful = cut(within_bound(starred.withColumnsRenamed({"centre": "a", "node": "b", "centre_size": "size_a", "size": "size_b"}), nodes), "jaccard-hopeful")
    nearest = cut(hopeful.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), "jaccard-nearest")
    links = cut(verified(nearest, fetch_sets(df, _of(nodes, nearest), id_col, text_col)), "jaccard-links")
    # a centre comes before its nodes in the order of blocks, so these links are a forest
    rooted = forest_roots(links.select(F.col("b").alias("node"), F.col("a").alias("root")))
    for step in range(NEAREST_ROUNDS + 1):
        candidates = tree_pairs(_rooted(starred.select("centre", "node", "size"), rooted, "node", "root"), nodes, step < NEAREST_ROUNDS)
        if step == NEAREST_ROUNDS:
            apart = _rooted(_rooted(hopeful.select("a", "b"), rooted, "a", "root_a"), rooted, "b", "root_b").filter("root_a <> root_b")
            candidates = candidates.unionByName(apart.select("a", "b"))
        candidates = cut(candidates.distinct(), "jaccard-candidates")
        if candidates.isEmpty():
            continue
        more = cut(verified(candidates, fetch_sets(df, _of(nodes, candidates), id_col, text_col)), "jaccard-links")
        if not more.isEmpty():
            rooted = hung(more.unionByName(rooted.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    done = _dealt(sets.select("id", "text_hash", "n_shingles", "node"), rooted, "node")
    return done.select("id", "text_hash", "n_shingles", "node", F.coalesce("root", "node").alias("root"))


def with_component_ids(groups: DataFrame) -> DataFrame:
    """`id, n_shingles, component_id`: the least id of the component; its own where there are no links."""
    least = groups.filter("root is not null").groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # rows without words have no root to meet at
    wordless = groups.filter("root is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return _dealt(groups.filter("root is not null"), least, "root").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id")).unionByName(wordless)


def one_per_group(docs: DataFrame) -> DataFrame:
    """`documents` with one row of each component, that of the least doc_id (nulls last); rows without words all stay.

    Only keys of rows that go are joined to the documents, a bitmap spares the
    others a shuffle, and no column is added, so extra columns may have any name. Of equal rows of one id
    and text in a component the first by source and language stays.
    """
    groups = cut(similar_groups(docs), "jaccard-groups").filter("root is not null")
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    counted = groups.groupBy("root", "id", "text_hash").agg(F.count("*").alias("n"))
    first = cut(counted.groupBy("root").agg(F.min(F.struct(key.alias("k"), "n")).alias("s"), F.count("*").alias("keys")), "jaccard-first")
    several = first.filter("keys > 1").select("root", F.col("s.k").alias("first"))
    others = cut(_dealt(counted, several, "root").filter(F.col("first").isNotNull() & (key != F.col("first"))).select("id", "text_hash").distinct(), "jaccard-others")
    # one id and text more than once: all of those rows go here, and one of each comes back
    repeated = first.filter("s.n > 1").select("s.k.id", "s.k.text_hash")
    text_hash, doc_id = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))), docs["doc_id"].cast("long")

    def at(keys: DataFrame) -> Column:
        return text_hash.eqNullSafe(keys["text_hash"]) & doc_id.eqNullSafe(keys["id"])

    gone = cut(others.unionByName(repeated), "jaccard-gone")
    tried, stay = split_by_keys(docs, F.xxhash64(doc_id, text_hash), gone.select(F.xxhash64("id", "text_hash")))
    again = tried.join(repeated, at(repeated), "left_semi").select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    nth = F.row_number().over(W.partitionBy("row.doc_id", F.xxhash64("row.text")).orderBy("row.source", "row.lang"))
    back = again.select("row", nth.alias("nth")).filter("nth = 1").select("row.*")
    return stay.unionByName(tried.join(gone, at(gone), "left_anti")).unionByName(back)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all `documents`."""
    groups = cut(similar_groups(table(spark, sf_dir, "documents")), "jaccard-groups")
    return with_component_ids(groups).withColumnRenamed("id", "doc_id")


#: From the definition: all pairs that share a shingle, and what can be reached over links.
OP4_SQL = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(list_slice(w, i, i + {WORDS - 1}), ' ') for i in range(1, len(w) - {WORDS - 2})] END) AS g FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {DENOMINATOR} * shared >= {NUMERATOR} * (x.n + y.n - shared)
), r AS (
    SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other
), c AS (
    SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""
