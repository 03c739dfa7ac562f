"""Near-duplicate embeddings by cross-polytope hashing.

Equal vectors collapse to one class first. Each class is scaled to length one
and rotated by three rounds of random sign flips and a fast Hadamard transform;
the coordinate of greatest magnitude with its sign names the nearest vertex of
the cross-polytope, and ``hashes`` of these make a bucket in each table. The
number of hashes follows from the number of classes, so that buckets stay small
as the table grows, and the number of tables doubles with each hash beyond two,
which holds the recall. Besides its own bucket a vector looks into those with the
second nearest vertex in one place.

Codes are worked out once and kept. Buckets are first filled with codes and
sketches of sign bits, not vectors; a row stays only where some row of its
bucket has a near sketch. The vectors of these rows are then joined and pairs
verified by their cosine in double precision. A pair counts in the first table
and bucket where it meets only, so links are counted without listing pairs;
each task gives counts and a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, merged, whole_groups, written

#: Tables of buckets named by two hashes.
TABLES = 12
#: Rows that a bucket holds on the average, by its own vectors, at most.
LOAD = 8
#: Rows of a bucket that one task compares as a whole.
PIECE = 1500
#: Sign bits of a sketch, and standard deviations by which a linked pair may be off.
SKETCH = 256
SURE = 6
SEED = 20240229


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of 2.

    Four binary digits of the index at a time: the last ones are transformed
    and become the first, until all have been.
    """
    n, done = x.shape[1], 1
    while done < n:
        radix = min(16, n // done)
        y = x.reshape(-1, radix) @ _small_hadamard(radix)
        x = y.reshape(len(x), n // radix, radix).transpose(0, 2, 1).reshape(len(x), n)
        done *= radix
    return x


@lru_cache(maxsize=8)
def _small_hadamard(n: int) -> np.ndarray:
    i = np.arange(n)
    return 1.0 - 2.0 * (np.bitwise_count(i[:, None] & i) % 2)


@lru_cache(maxsize=16)
def signs(width: int, count: int) -> np.ndarray:
    """Random signs of each rotation's three rounds; the same on every machine."""
    rng = np.random.default_rng([SEED, width])
    return rng.choice([-1.0, 1.0], (count, 3, width))


def padded_width(dim: int) -> int:
    """Coordinates of a rotated vector: a power of two."""
    return 1 << max(1, (dim - 1).bit_length())


def scaled(x: np.ndarray) -> np.ndarray:
    """The rows times a power of two each, so that squares neither over- nor underflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def coded(x: np.ndarray, tables: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket codes (rows x tables x (1 + hashes): own first) and sketches (rows x SKETCH bits).

    Coordinates are rounded before they are compared, so vectors of one
    direction have one code, and ties go to the first coordinate.
    """
    width, count = padded_width(x.shape[1]), tables * hashes
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    v, bits = np.zeros((len(x), count, 2), np.int64), []
    rows = np.arange(len(x))
    for k, rounds in enumerate(signs(width, max(count, -(-SKETCH // width)))):
        if k >= count and k * width >= SKETCH:
            break
        y = padded
        for flips in rounds:
            y = hadamard(y * flips) / np.sqrt(width)
        y = np.round(y, 9)
        if k * width < SKETCH:
            bits.append(y < 0)
        if k < count:
            size = np.abs(y)
            for place in range(2):
                best = size.argmax(1)
                v[:, k, place] = 2 * best + (y[rows, best] < 0)
                size[rows, best] = -1
    v = v.reshape(len(x), tables, hashes, 2)
    scale = (2 * width) ** np.arange(hashes, dtype=np.int64)
    own = (v[..., 0] * scale).sum(2)
    looks = own[..., None] + (v[..., 1] - v[..., 0]) * scale
    sketch = np.packbits(np.concatenate(bits, 1)[:, :SKETCH], axis=1)
    return np.concatenate([own[..., None], looks], 2), sketch


def sketch_budget(width: int, least: float) -> int:
    """Differing sign bits that a pair of this cosine may have; all of them in few dimensions."""
    if width < 16:
        return SKETCH
    share = np.arccos(np.clip(least, -1, 1)) / np.pi
    return int(np.ceil(SKETCH * share + SURE * np.sqrt(SKETCH * share * (1 - share)) + 2))


def hashes_for(classes: int, width: int, load: int = LOAD) -> int:
    """Hashes of a bucket's name such that as many classes fill buckets to the load at most."""
    hashes = 2
    while (2 * width) ** hashes * load < classes and (2 * width) ** (hashes + 1) < 1 << 62:
        hashes += 1
    return hashes


def tables_for(hashes: int, tables: int = TABLES) -> int:
    """Tables that hold the recall of ``tables`` tables of two hashes."""
    return tables << (hashes - 2)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _coded_classes(classes: DataFrame, hashes_of: dict[int, int], tables: int) -> DataFrame:
    """(cid, n, embedding, dim, w, codes, sketch) of classes; hashes_of: by dimension.

    w is the number of codes of one table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = np.array(whole.column(2).value_lengths().to_pylist(), np.int64)
            for dim in np.unique(dims):
                alike = whole.filter(pa.array(dims == dim))
                for start in range(0, alike.num_rows, 2000):
                    batch = alike.slice(start, 2000)
                    x = scaled(_matrix(batch.column(2), int(dim)))
                    hashes = hashes_of[int(dim)]
                    codes, sketch = coded(x, tables_for(hashes, tables), hashes)
                    words = np.zeros((len(x), 32), np.uint8)
                    words[:, : sketch.shape[1]] = sketch
                    yield pa.RecordBatch.from_arrays(
                        [
                            *batch.columns,
                            pa.array(np.full(len(x), dim, np.int32)),
                            pa.array(np.full(len(x), 1 + hashes, np.int32)),
                            pa.array(list(codes.reshape(len(x), -1))),
                            pa.array([w.tobytes() for w in words], pa.binary()),
                        ],
                        ["cid", "n", "embedding", "dim", "w", "codes", "sketch"],
                    )

    kind = dict(classes.dtypes)["embedding"]
    return classes.select("cid", "n", "embedding").mapInArrow(
        run, f"cid long, n long, embedding {kind}, dim int, w int, codes array<long>, sketch binary"
    )


BUCKET = ["dim", "t", "bucket"]
KEYS = [*BUCKET, "p", "q"]


def _in_pieces(rows: DataFrame, piece: int) -> list[DataFrame]:
    """Rows of buckets with p and q; too large buckets in pieces, every two of which meet.

    A large bucket of own rows and rows that look into it is dealt by a hash.
    """
    sizes = rows.groupBy(*BUCKET).count()
    hot = written(sizes.where(F.col("count") > piece), "hot-buckets")
    zero = F.lit(0)
    flat = {"p": zero, "q": zero, "piece": zero}
    if hot.isEmpty():
        return [rows.withColumns(flat)]
    n = (F.col("count") / (piece // 2) + 1).cast("int")
    split = (
        rows.join(hot.select(*BUCKET, n.alias("__n")), BUCKET)
        .withColumn("piece", F.pmod(F.xxhash64("cid"), F.col("__n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        .withColumns({"p": F.least("piece", "other"), "q": F.greatest("piece", "other")})
        .drop("__n", "other")
    )
    return [rows.join(hot, BUCKET, "left_anti").withColumns(flat), split]


def _grouped(rows: DataFrame, run, schema: str) -> DataFrame:
    """run over whole groups of KEYS, own rows first in each."""
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, F.desc("own")).mapInArrow(run, schema)


def _bounds(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    change = np.zeros(table.num_rows, bool)
    for key in KEYS:
        v = table[key].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(np.r_[True, change[1:]]) if table.num_rows else np.zeros(0, np.int64)
    return starts, np.r_[starts[1:], table.num_rows]


def _pairs(table: pa.Table, starts: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple]:
    """(i, j) of the pairs of groups of which one is an own row, about ``most`` at a time."""
    p, q, piece, own, cid = (table[c].to_numpy(zero_copy_only=False) for c in ("p", "q", "piece", "own", "cid"))
    long = ends - starts
    end_of = np.repeat(ends, long)
    first = np.arange(long.sum()) + np.repeat(starts - np.cumsum(long) + long, long)
    row = first[own[first]]
    count = end_of[own[first]] - row - 1
    total = np.cumsum(count)
    at = 0
    while at < len(row):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        n = count[at:upto]
        i = np.repeat(row[at:upto], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = upto
        ok = (cid[i] != cid[j]) & ((p[i] == q[i]) | (piece[i] != piece[j]))
        yield i[ok], j[ok]


def _near_sketches(rows: DataFrame, least: float) -> DataFrame:
    """(dim, t, bucket, own, cid): rows with a near sketch in their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, KEYS, 50_000):
            table = table.combine_chunks()
            words = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(-1, 4)
            dim = table["dim"].to_numpy()
            budget = np.zeros(len(dim), np.int64)
            for d in np.unique(dim):
                budget[dim == d] = sketch_budget(padded_width(int(d)), least)
            hit = np.zeros(len(dim), bool)
            for i, j in _pairs(table, *_bounds(table), 1_000_000):
                differ = np.zeros(len(i), np.int64)
                for k in range(4):
                    differ += np.bitwise_count(words[i, k] ^ words[j, k])
                near = differ <= budget[i]
                hit[i[near]] = hit[j[near]] = True
            kept = table.filter(pa.array(hit)).select([*BUCKET, "own", "cid"])
            yield from kept.combine_chunks().to_batches()

    return _grouped(rows, run, "dim int, t int, bucket long, own boolean, cid long")


def _verified(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, n): n links of class a; where b is given, a link to join by.

    The rows of a group that come from one piece of a bucket have p = q or
    meet the rows of another piece, so that no pair is met twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, KEYS, 4000):
            table = table.combine_chunks()
            cid, size, t_of, bucket, dims = (table[c].to_numpy() for c in ("cid", "n", "t", "bucket", "dim"))
            count = np.zeros(len(cid), np.int64)
            root = np.arange(len(cid))
            starts, ends = _bounds(table)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims[starts] == dim)
                lo, hi = starts[own[0]], ends[own[-1]]  # one dimension's groups lie together
                x = scaled(_matrix(table["embedding"].combine_chunks().slice(lo, hi - lo), int(dim)))
                codes = _matrix_long(table["codes"].combine_chunks().slice(lo, hi - lo))
                codes = codes.reshape(hi - lo, -1, table["w"][int(lo)].as_py())
                square = np.einsum("ij,ij->i", x, x)
                for i, j in _pairs(table, starts[own], ends[own], max(2000, 6_400_000 // int(dim))):
                    dot = np.einsum("ij,ij->i", x[i - lo], x[j - lo])
                    near = dot >= least * np.sqrt(square[i - lo] * square[j - lo])
                    i, j = i[near], j[near]
                    first = _first_meeting(codes, i - lo, j - lo, cid[i] < cid[j], t_of[i], bucket[i])
                    i, j = i[first], j[first]
                    np.add.at(count, i, size[j])
                    np.add.at(count, j, size[i])
                    root = merged(root, i, j)
            some = np.flatnonzero(count)
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[cid[some], cid[root[moved]]]),
                    pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(cid[moved])]),
                    pa.array(np.r_[count[some], np.zeros(len(moved), np.int64)]),
                ],
                ["a", "b", "n"],
            )

    return _grouped(rows, run, "a long, b long, n long")


def _matrix_long(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _first_meeting(codes, i, j, ordered, t: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether pairs i-j meet in no earlier table than t, nor in another bucket of it first.

    Two vectors meet in a table where the own bucket of one is among the
    buckets of the other; if it is so both ways, in that of the lower id.
    """
    low, high = np.where(ordered, i, j), np.where(ordered, j, i)
    of_low = (codes[low, :, :1] == codes[high]).any(2)
    of_high = (codes[high, :, :1] == codes[low]).any(2)
    pair = np.arange(len(i))
    meet = of_low | of_high
    earlier = (meet & (np.arange(codes.shape[1]) < t[:, None])).any(1)
    at = np.where(of_low[pair, t], codes[low, t, 0], codes[high, t, 0])
    return ~earlier & meet[pair, t] & (at == bucket)


def near_duplicates(
    vectors: DataFrame, least: float = 0.9, tables: int = TABLES, load: int = LOAD, piece: int = PIECE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors.

    Reads vec_id and embedding. Links are pairs with a cosine of ``least`` or
    more; the hashing misses some far pairs (see the README for the recall),
    and reports none below. n_links counts other rows, copies included, that
    the row's own vector links with. Vectors that are null, empty, zero or have
    a null or non-finite component, vectors of different lengths, and rows with
    a null vec_id link with nothing. Rows with one vec_id are one vertex of the
    components, also if their vectors differ. An empty table gives no rows.
    """
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")
    )
    finite = F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    usable = (
        F.col("vec_id").isNotNull()
        & F.coalesce(finite, F.lit(False))
        & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    )
    classes = written(
        rows.where(usable)
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "vector-classes",
    )
    dims = {r["dim"]: r["count"] for r in classes.groupBy(F.size("embedding").alias("dim")).count().collect()}
    hashes_of = {dim: hashes_for(count, padded_width(dim), load) for dim, count in dims.items()}
    known = written(_coded_classes(classes, hashes_of, tables), "vector-codes")
    filled = known.select("dim", "w", "cid", "sketch", F.posexplode("codes").alias("at", "bucket")).select(
        "dim", F.expr("cast(at div w as int)").alias("t"), "bucket", F.expr("at % w = 0").alias("own"), "cid", "sketch"
    )
    near = [_near_sketches(part, least) for part in _in_pieces(filled, piece)]
    near = written(_all(near).distinct() if len(near) > 1 else near[0], "near-sketches")
    held = near.join(known.select("cid", "n", "embedding", "w", "codes"), "cid")
    found = written(_all([_verified(part, least) for part in _in_pieces(held, piece)]), "vector-links")
    counts = found.groupBy("a").agg(F.sum("n").alias("others"))
    joined = rows.withColumn("__usable", usable).join(
        classes.select(F.col("embedding").alias("__e"), "cid", "n", "least_id"),
        F.col("__usable") & (F.col("embedding") == F.col("__e")),
        "left",
    )
    member = written(joined.select("vec_id", "cid", "n"), "vector-members")
    # classes that hold one vec_id are joined like linked ones
    shared = member.where("cid is not null").groupBy("vec_id").agg(
        F.min("cid").alias("a"), F.max("cid").alias("__max"), F.collect_set("cid").alias("__all")
    )
    shared = shared.where(F.col("a") != F.col("__max")).select("a", F.explode("__all").alias("b"))
    groups = components(found.where("b is not null").select("a", "b").union(shared))
    labelled = classes.join(groups, F.col("cid") == F.col("node"), "left").select(
        "cid", "least_id", F.coalesce("component", "cid").alias("label")
    )
    least_of = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_class = labelled.join(least_of, "label").join(counts, F.col("cid") == F.col("a"), "left")
    of_class = written(of_class.select("cid", "component_id", "others"), "class-links")
    for table in (known, near, found, classes):
        dropped(table)
    out = member.join(of_class, "cid", "left")
    component = F.coalesce("component_id", "vec_id")
    n_links = F.coalesce(F.col("n") - 1 + F.coalesce("others", F.lit(0)), F.lit(0))
    return out.select(
        "vec_id",
        n_links.cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
