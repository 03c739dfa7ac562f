"""Near-duplicate documents by SimHash and a binary trie self-join.

Fingerprints are 64 bits over word shingles. Equal fingerprints collapse to one
class first, so a group of copies of any size is one row of the join. Two
classes link when they differ in at most ``bits`` bits. A pair within that
budget agrees in at least one of ``bits + 1`` blocks of bits, so the trie is
dealt out by (block, value of the block): rows of one group share those bits,
and a task walks the binary trie of a group over pairs of nodes, adds the bits
in which their branches differ, and leaves a pair when it is over the budget.
A group that is too large is dealt out again by blocks of its other bits, in
which the same argument holds; what is still too large then is compared in
pieces. Links are reduced to a spanning forest in each task; no group emits all
its pairs.

Near-duplicates of a lower similarity differ in more bits than a trie can bear
as a budget. ``deduplicated`` therefore takes several short fingerprints of each
text, joins the tries of each, and keeps the pairs that are near in all bits
together; the closest of them, a least spanning forest, are compared by their
shingles, and the next ones where some of these fail.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, merged, whole_groups, written

#: Largest group that one task compares as a whole.
GROUP = 2000
#: Times that too large groups are dealt out again by other bits.
LEVELS = 3
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, n: int = 4) -> int:
    """SimHash of the whole text, as an unsigned integer; 0 without words.

    A-Z become lower case; a bit is 1 if over half the shingles' XXH64 values
    (seed 42) have it. Repeated shingles count as often as they come.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < n:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros((8, 8), np.int64)
    for start in range(0, len(h), 255):
        part = h[start : start + 255]
        for bit in range(8):
            lanes = np.add.reduce((part >> np.uint64(bit)) & _LANES)
            ones[bit] += np.frombuffer(np.uint64(lanes).tobytes(), np.uint8)
    bits = 2 * ones > len(h)
    return sum(1 << int(8 * lane + bit) for bit, lane in zip(*np.nonzero(bits), strict=True))


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py(), n) for t in batch.column(1)]
            signed = np.array(fp, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(signed)], ["doc_id", "fp"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fp long"
    )


def block_masks(free: list[int], blocks: int) -> list[tuple[int, list[int]]]:
    """Split free bit positions into blocks: (mask of a block, other positions)."""
    out = []
    for k in range(blocks):
        own = free[len(free) * k // blocks : len(free) * (k + 1) // blocks]
        out.append((sum(1 << b for b in own), [b for b in free if b not in own]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def trie_links(group: np.ndarray, fp: np.ndarray, budget: int) -> np.ndarray:
    """Root index of each row after linking rows of one group within the budget."""
    order = np.lexsort((fp, group))
    root = np.arange(len(fp))
    for i, j in trie_pairs(group[order], fp[order], budget):
        root = merged(root, i, j)
    back = np.empty(len(fp), np.int64)
    back[order] = order[root]
    return back


def trie_pairs(g: np.ndarray, x: np.ndarray, budget: int, top: int = 63) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one group within the budget; rows are sorted by (g, x).

    Walks the tries of all groups at once, one bit a level. A pair of nodes is
    two ranges of the sorted fingerprints; it goes on to the pairs of their
    children with the differing bits so far, unless these exceed the budget.
    """
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    ends = np.r_[starts[1:], len(x)]
    many = ends - starts > 1
    first = (starts[many], ends[many], starts[many], ends[many], np.zeros(many.sum(), np.int8))
    waiting = [(top, first)]
    while waiting:
        bit, (a0, a1, b0, b1, err) = waiting.pop()
        if len(a0) > 1 << 17:
            half = len(a0) // 2
            waiting += [(bit, tuple(y[half:] for y in (a0, a1, b0, b1, err)))]
            a0, a1, b0, b1, err = (y[:half] for y in (a0, a1, b0, b1, err))
        small = ((a1 - a0) * (b1 - b0) <= 64) if bit >= 0 else np.ones(len(a0), bool)
        if small.any():
            i, j = _crossed(*(y[small] for y in (a0, a1, b0, b1)))
            near = np.bitwise_count(x[i] ^ x[j]) <= budget
            yield i[near], j[near]
        if small.all():
            continue
        a0, a1, b0, b1, err = (y[~small] for y in (a0, a1, b0, b1, err))
        ones = np.r_[0, np.cumsum((x >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        parts = [
            (a0, am, b0, bm, err),
            (am, a1, bm, b1, err),
            (a0, am, bm, b1, err + 1),
            tuple(y[~same] for y in (am, a1, b0, bm, err + 1)),
        ]
        following = [np.concatenate(y) for y in zip(*parts, strict=True)]
        keep = (
            (following[1] > following[0])
            & (following[3] > following[2])
            & (following[4] <= budget)
            & ~((following[0] == following[2]) & (following[1] - following[0] < 2))
        )
        waiting.append((bit - 1, tuple(y[keep] for y in following)))


def _crossed(a0, a1, b0, b1):
    """All i in [a0, a1) with j in [b0, b1), i < j, of each pair of ranges."""
    na, nb = a1 - a0, b1 - b0
    size = na * nb
    pair = np.repeat(np.arange(len(a0)), size)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    i, j = a0[pair] + k // nb[pair], b0[pair] + k % nb[pair]
    keep = i < j
    return i[keep], j[keep]


def _linked(rows: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Spanning links (a, b) within the groups of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 50_000):
            change = np.zeros(table.num_rows, bool)
            for key in keys:
                v = table[key].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            fp = table["fp"].to_numpy()
            root = trie_links(np.cumsum(change), fp.view(np.uint64), budget)
            differ = fp[root] != fp
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp[root][differ]), pa.array(fp[differ])], ["a", "b"]
            )

    return (
        rows.select(*keys, "fp")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(run, "a long, b long")
    )


def links(
    classes: DataFrame, bits: int = 4, group: int = GROUP, levels: int = LEVELS, width: int = 64, by: tuple = (), linked=None, made: list | None = None
) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``bits`` bits.

    classes: one row for each distinct fingerprint, in column fp of ``width``
    bits. Only rows equal in the columns ``by`` are compared; linked gives the
    links of dealt rows. A group is dealt out again if it is over ``group`` rows
    and over twice what even bits give a group: else all rows of a large table
    would be. Tables that the links are read from are added to ``made``.
    """
    linked, made = linked or _linked, [] if made is None else made
    most = classes.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    group = max(group, 2 * most >> width // (bits + 1))
    own = [c for c in classes.columns if c not in by]
    paths = {0: (0, list(range(width - 1, -1, -1)))}
    rows, found = classes.withColumn("path", F.lit(0)), []
    for _ in range(levels):
        following, choices = {}, []
        for path, (mask, free) in paths.items():
            blocks = []
            for k, (block, rest) in enumerate(block_masks(free, bits + 1)):
                to = path * (bits + 1) + k + 1
                following[to] = (mask | block, rest)
                shared = F.col("fp").bitwiseAND(F.lit(_signed(mask | block)).cast("long"))
                blocks.append(F.struct(F.lit(to).alias("path"), shared.alias("bits")))
            choices.append(F.when(F.col("path") == path, F.array(*blocks)))
        pick = F.coalesce(*choices)
        keyed = rows.select(*by, *own, F.explode(pick).alias("k")).select(*by, "k.path", "k.bits", *own)
        keys = [*by, "path", "bits"]
        sizes = keyed.groupBy(*keys).count()
        hot = written(sizes.where(F.col("count") > group), "hot")
        made.append(hot)
        if hot.isEmpty():
            found.append(linked(keyed, keys, bits))
            break
        found.append(linked(keyed.join(hot, keys, "left_anti"), keys, bits))
        rows = written(keyed.join(hot.drop("count"), keys, "left_semi").distinct(), "hot-rows")
        made.append(rows)
        paths = following
    else:
        found.append(_in_pieces(rows, hot, bits, group, by, linked))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _in_pieces(rows: DataFrame, hot: DataFrame, budget: int, piece: int, by: tuple, linked) -> DataFrame:
    """Links within groups too large for a task: every two pieces meet in one."""
    keys = [*by, "path", "bits"]
    own = [c for c in rows.columns if c not in keys]
    n = (F.col("count") / (piece // 2) + 1).cast("int")
    mine = F.pmod(F.xxhash64(*own), F.col("n")).cast("int")
    dealt = (
        rows.join(hot.withColumn("n", n).drop("count"), keys)
        .withColumn("p", mine)
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(*keys, F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), *own)
    )
    return linked(dealt, [*keys, "p", "q"], budget)


def simhash_components(docs: DataFrame, n: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs (doc_id, text).

    component_id is the least doc_id reachable over links. Null or empty texts
    have the fingerprint zero and link like any other. Rows with one doc_id are
    rows of one document each; a null doc_id gives a null component_id only if
    the whole component has none. An empty table gives no rows; other columns
    are not read.
    """
    fps = written(fingerprints(docs, n), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    root = components(links(classes, bits)).withColumnRenamed("node", "fp")
    labelled = classes.join(root, "fp", "left").withColumn(
        "label", F.coalesce("component", "fp")
    )
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = written(labelled.join(least, "label").select("fp", "component_id"), "class-of")
    return fps.join(of_class, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


#: Short fingerprints of a text, their bits and the bits in which a pair may differ in one.
SHORT, SHORT_BITS, SHORT_BUDGET = 10, 32, 3
#: All bits of a text by which candidates are chosen; the short fingerprints are the first of them.
WIDE_BITS = 768
#: Standard deviations by which the bits of a similar pair may be off.
OFF = 2.3
#: Random odd numbers that make the words of a wide fingerprint from one hash.
_SPREAD = np.random.default_rng(20240607).integers(0, 1 << 63, WIDE_BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams, A-Z in lower case; of all words if fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = zip(*(words[i:] for i in range(n)), strict=False) if len(words) >= n else [words]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(s)) for s in shingles), np.uint64))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of WIDE_BITS bits of a set of shingles, in 64-bit words."""
    h = shingles[:, None] * _SPREAD
    h = (h ^ (h >> np.uint64(32))) * _SPREAD[::-1]
    h ^= h >> np.uint64(29)
    ones = np.zeros(64 * len(_SPREAD), np.int64)
    for start in range(0, len(h), 4096):
        ones += np.unpackbits(h[start : start + 4096].view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).view(np.uint64)


def forest(n: int, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the edges i-j of n nodes make a spanning forest of the least lengths."""
    # equal lengths go by the ends, so that the forests of groups with the same nodes agree
    i, j = np.minimum(i, j), np.maximum(i, j)
    order = np.lexsort((j, i, length))
    i, j = i[order], j[order]
    root, live, chosen = np.arange(n), np.arange(len(i)), [np.zeros(0, np.int64)]
    while True:
        a, b = root[i[live]], root[j[live]]
        live, a, b = live[a != b], a[a != b], b[a != b]
        if not len(live):
            return order[np.concatenate(chosen)]
        best = np.full(n, len(live))
        np.minimum.at(best, a, np.arange(len(live)))
        np.minimum.at(best, b, np.arange(len(live)))
        pick = live[np.unique(best[best < len(live)])]
        chosen.append(pick)
        root = merged(root, i[pick], j[pick])


def _chosen(n: int, i: np.ndarray, j: np.ndarray, length: np.ndarray, forests: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of so many disjoint spanning forests of n nodes, least lengths first, and those that are left."""
    left, chosen = np.arange(len(i)), [np.zeros(0, np.int64)]
    for _ in range(forests):
        if not len(left):
            break
        keep = forest(n, i[left], j[left], length[left])
        chosen.append(left[keep])
        left = np.delete(left, keep)
    return np.concatenate(chosen), left


def _nearest_links(most: int, forests: int):
    """Links (a, b) by class id of rows (cid, fp, wide, label) within ``most`` of all bits.

    Only pairs of different labels count. Each group gives so many disjoint
    spanning forests over its labels, and a row (a, a) for each end of a pair
    that is in none of them.
    """

    def linked(rows: DataFrame, keys: list[str], budget: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches, keys, 50_000):
                change = np.zeros(table.num_rows, bool)
                for key in keys:
                    v = table[key].to_numpy()
                    change[1:] |= v[1:] != v[:-1]
                fp, cid = table["fp"].to_numpy().view(np.uint64), table["cid"].to_numpy()
                wide = np.frombuffer(b"".join(table["wide"].to_pylist()), np.uint64).reshape(len(cid), -1)
                group = np.cumsum(change)
                order = np.lexsort((fp, group))
                wide, cid = wide[order], cid[order]
                _, label = np.unique(table["label"].to_numpy()[order], return_inverse=True)
                held, passed = [np.zeros(0, np.int64)] * 3, np.zeros(len(cid), bool)
                count = 0

                def reduced(held, label=label, passed=passed):
                    keep, left = _chosen(len(label), label[held[0]], label[held[1]], held[2], forests)
                    passed[held[0][left]] = passed[held[1][left]] = True
                    return [x[keep] for x in held]

                for i, j in trie_pairs(group[order], fp[order], budget, SHORT_BITS - 1):
                    other = label[i] != label[j]
                    i, j = i[other], j[other]
                    differ = np.bitwise_count(wide[i] ^ wide[j]).sum(1, dtype=np.int64)
                    near = differ <= most
                    held = [np.r_[x, y[near]] for x, y in zip(held, (i, j, differ), strict=True)]
                    if len(held[0]) > count + 1_000_000:
                        held = reduced(held)
                        count = len(held[0])
                held = reduced(held)
                again = np.unique(cid[passed])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[cid[held[0]], again]), pa.array(np.r_[cid[held[1]], again])], ["a", "b"]
                )

        return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")

    return linked


def _shingle_sets(texts: DataFrame, n: int) -> DataFrame:
    """(cid, shingles) of rows (cid, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), n).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["cid", "shingles"])

    return texts.mapInArrow(sets, "cid long, shingles binary")


def _similar(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose sets (cid, shingles) share that part of their distinct shingles."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    return edges.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")


def _verified_groups(dealt: DataFrame, sets_of, most: int, group: int, similarity: float) -> DataFrame:
    """(node, component) of rows (cid, wide, t, fp) linked by similar texts.

    A round takes a forest of the nearest pairs of each group and checks them by
    their shingles. Where a pair was left out of the forests and its ends are
    still apart, the next round takes four times as many forests over what the
    checked links join, until no pair is left out: a pair that fails hides none
    that would hold.
    """
    rows, forests, links_found, sets = dealt.withColumn("label", F.col("cid")), 1, None, None
    made, groups = [], None
    while True:
        found = written(
            links(rows, SHORT_BUDGET, group, LEVELS, SHORT_BITS, ("t",), _nearest_links(most, forests), made)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct(),
            "near-pairs",
        )
        made += [] if groups is None else [groups]
        for table in made:  # what the last round was read from
            dropped(table)
        edges = found.where("a <> b")
        if sets is None:  # every row with a near pair is in a forest of the first round
            sets = written(sets_of(edges.select(F.col("a").alias("cid")).union(edges.select("b")).distinct()), "shingles")
        similar = written(_similar(edges, sets, similarity), "similar")
        links_found = similar if links_found is None else links_found.union(similar)
        again = found.where("a = b").select(F.col("a").alias("cid"))
        groups = written(components(links_found), "groups")
        if again.isEmpty():
            dropped(found)
            return groups
        label = F.coalesce("component", "cid").alias("label")
        asked = dealt.join(again, "cid", "left_semi").join(groups, F.col("cid") == F.col("node"), "left")
        rows = written(asked.select(*dealt.columns, label), "apart")
        made = [found, rows]
        forests *= 4


def bits_of(similarity: float, bits: int = WIDE_BITS) -> int:
    """Differing bits that a pair of this Jaccard similarity may have."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * share + OFF * np.sqrt(bits * share * (1 - share))))


def deduplicated(docs: DataFrame, n: int = 5, similarity: float = 0.8, group: int = GROUP) -> DataFrame:
    """The rows of docs (doc_id, text and others) without near-duplicates of others.

    Two texts link when the Jaccard similarity of their sets of word n-grams is
    ``similarity`` or more and their fingerprints show it, as those of 99 of 100
    random pairs at 0.80 to 0.82 do; equal texts always do, and all texts without
    a word. Each link that joins two groups is checked exactly. Of each
    group of texts linked directly or by others one row stays: that of the
    least doc_id, nulls last, then the least other values. A unique text stays,
    also with a null doc_id or with one that other rows have. An empty table
    gives no rows.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("__digest", F.md5(text.cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [wide_fingerprint(shingle_set(t.as_py(), n)).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(wide, pa.binary())], ["doc_id", "digest", "wide"])

    kind = dict(docs.dtypes)["doc_id"]
    fps = written(
        rows.select("doc_id", "__digest", "text").mapInArrow(run, f"doc_id {kind}, digest string, wide binary"),
        "fingerprints",
    )
    # all texts without a word are one class
    none = F.col("wide") == F.lit(bytes(WIDE_BITS // 8))
    fps = fps.withColumn("class", F.when(none, "").otherwise(F.col("digest")))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "digest")
    classes = fps.groupBy("class").agg(F.first("wide").alias("wide"), F.min(order).alias("least"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "text-classes")
    word = F.hex("wide")
    shorts = F.transform(
        F.sequence(F.lit(0), F.lit(SHORT - 1)),
        lambda t: F.conv(F.substring(word, t * (SHORT_BITS // 4) + 1, F.lit(SHORT_BITS // 4)), 16, 10).cast("long"),
    )
    dealt = classes.where("class <> ''").select("cid", "wide", F.posexplode(shorts).alias("t", "fp"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        asked = classes.join(wanted, "cid").select("cid", F.col("class").alias("__digest"))
        return _shingle_sets(rows.join(asked, "__digest").groupBy("cid").agg(F.first("text").alias("text")), n)

    groups = _verified_groups(dealt, sets_of, bits_of(similarity), group, similarity)
    least = (
        classes.join(groups, F.col("cid") == F.col("node"), "left")
        .groupBy(F.coalesce("component", "cid").alias("label"))
        .agg(F.min("least").alias("least"))
        .select("least.doc_id", "least.digest")
    )
    sizes = fps.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    same = [F.col("k.doc_id").eqNullSafe(F.col("s.doc_id")), F.col("k.digest") == F.col("s.digest")]
    kept = written(least.alias("k").join(sizes.alias("s"), same).select("k.doc_id", "k.digest", "copies"), "kept")

    def held(some: DataFrame) -> DataFrame:
        found = [F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")), F.col("r.__digest") == F.col("k.digest")]
        return rows.alias("r").join(some.alias("k"), found, "left_semi")

    out = held(kept.where("copies = 1")).select(*docs.columns)
    repeated = kept.where("copies > 1")
    if repeated.isEmpty():
        return out
    first = held(repeated).groupBy("doc_id", "__digest").agg(F.min(F.struct("text", *rest)).alias("__least"))
    return out.unionByName(first.select("doc_id", "__least.*").select(*docs.columns))
