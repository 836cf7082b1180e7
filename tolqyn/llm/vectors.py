"""Problem 1: the most similar vectors of every vector, by collision counting.

A vector is projected onto m single random directions. Two vectors collide on a direction when one lies
in the window centred on the other's projection; a pair that collides on at least `threshold` directions
is verified by its true cosine. Widening the windows by a factor ("virtual rehashing") needs no new
hashes, since a wide window is the union of narrow ones.

Two forms:

* `search` for a stated set of queries against all rows, in blocks: windows widen around each query until enough rows of
  the block collide often enough.
* `similar` for all rows against all rows above a similarity. Counting in windows of the whole collection would meet a
  fixed share of all pairs, which is quadratic; so the projections are kept by cell. `tables` times over the space is cut into
  cells by the direction, out of a set of random ones, on which a vector, less the mean of all, lies farthest out. The size of the
  set follows the number of rows, so cells keep their size, and the number of tables follows from the chance that a pair at
  the least similarity shares a cell. Inside a cell windows start narrow and widen: a vector with k verified neighbours within the radius
  of its windows is done, the others go on up to the radius of the least similarity.

  A cell of more than `span` rows is cut again by directions around its own mean. What still is larger, and a cell whose
  candidates lie closer together than the codes can tell, is compared whole by true products, a block of its rows against all of
  them in each task. No pair of a cell is left out.

Equal vectors form one class and are compared once; every member takes part in the ranking.

Defined results: rows with a null, empty, all-zero or non-finite vector take no part; repeated rows count once;
vectors of different dimension are never compared; ties in similarity go to the smaller id; an empty table gives no rows;
other columns are ignored.
"""

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tolqyn.runtime import shared_dir, staged

SEED = 20240607
COUNTED = 24  # directions on which collisions are counted
WINDOW = 1.7  # half a window, in units of the radius (the spread of a projected difference)
WIDEN = (0.35, 0.6, 1.0)  # radii of the windows, as parts of the last
PART = 256  # directions of one set; larger numbers of cells take several sets


def directions(dim: int, n: int, *salt: int) -> np.ndarray:
    """n random directions of length about sqrt(dim), the same in every task."""
    rng = np.random.default_rng([SEED, dim, *salt])
    return rng.standard_normal((n, dim)).astype("f4")


def rotation(dim: int) -> np.ndarray:
    """An orthonormal basis of random directions: projections onto it keep the cosine."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).T.astype("f4")


def threshold(m: int, window: float, least: float) -> int:
    """The largest collision count that a pair at the radius reaches with at least this probability."""
    p = math.erf(window / math.sqrt(2))
    tail = 0.0
    for c in range(m, 0, -1):
        tail += math.comb(m, c) * p**c * (1 - p) ** (m - c)
        if tail >= least:
            return c
    return 1


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _by_dim(column: pa.Array):
    """(dimension, places, unit vectors) of a list column."""
    flat, lengths = _rows(column)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        own = np.flatnonzero(lengths == dim)
        x = flat[(starts[own][:, None] + np.arange(dim)).ravel()].reshape(-1, dim).astype("f8")
        yield int(dim), own, (x / np.linalg.norm(x, axis=1)[:, None]).astype("f4")


def unique_vectors(df: DataFrame, group: str, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(classes: grp, cls, vec binary of floats), (members: grp, cls, key; the k + 1 smallest keys of each class).

    A class is a 128-bit hash of the float values. Copies collapse before the shuffle."""
    rows = _fit(df, group, key, vector)
    rows = rows.withColumn("cls", F.concat_ws("-", F.hex(F.xxhash64("grp", "v")), F.hex(F.xxhash64(F.lit(1), "v", "grp"))))
    classes = rows.groupBy("cls").agg(F.first("grp").alias("grp"), F.first("v").alias("v"))
    w = Window.partitionBy("cls").orderBy("key")
    members = rows.select("cls", "key").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).select("cls", "key")
    return classes, members


def _fit(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """grp, key, v of the rows that have a key and a vector."""
    v = F.col(vector)
    fit = v.isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(key).isNotNull() & fit).select(F.coalesce(F.col(group), F.lit("")).alias("grp"), F.col(key).cast("string").alias("key"), v.cast("array<float>").alias("v"))


def sets_of(bits: float) -> list[int]:
    """Sizes of the sets of directions that give about 2^bits cells: a set of n gives 2n."""
    parts = max(1, math.ceil(bits / math.log2(2 * PART)))
    return [max(1, round(2 ** (bits / parts) / 2))] * parts


def farthest(x: np.ndarray, sets: list[int], *salt: int) -> np.ndarray:
    """The cell of every row: by set, the direction on which it lies farthest out, and to which side."""
    cell = np.zeros(len(x), "i8")
    for s, n in enumerate(sets):
        y = x @ directions(x.shape[1], n, 1, s, *salt).T
        at = np.abs(y).argmax(axis=1)
        cell = cell * (2 * n) + 2 * at + (y[np.arange(len(x)), at] > 0)
    return cell


def shared_cell(dim: int, sets: list[int], similarity: float, n: int = 4000) -> float:
    """The chance that two vectors of this cosine share a cell, from n random pairs."""
    x, z = (np.random.default_rng([SEED, i]).standard_normal((n, dim)) for i in (7, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.maximum(np.linalg.norm(z, axis=1)[:, None], 1e-12)
    y = similarity * x + math.sqrt(max(0.0, 1 - similarity**2)) * z
    return float((farthest(x.astype("f4"), sets, 0) == farthest(y.astype("f4"), sets, 0)).mean())


def _sums(batches):
    """Task: the sum of the unit vectors of each dimension, by place."""
    total: dict[int, np.ndarray] = {}
    count: dict[int, int] = {}
    for batch in batches:
        for dim, _, x in _by_dim(batch.column("v")):
            total[dim] = total.get(dim, 0) + x.sum(axis=0, dtype="f8")
            count[dim] = count.get(dim, 0) + len(x)
    for dim, t in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, "i4")), pa.array(np.arange(dim, dtype="i4")), pa.array(t), pa.array(np.full(dim, count[dim], "i8"))], ["dim", "at", "total", "n"])


def means(classes: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """By dimension: rows and the mean of their unit vectors; as many numbers as the dimensions add up to."""
    got = classes.select("v").mapInArrow(_sums, "dim int, at int, total double, n bigint").groupBy("dim", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    pdf = got.toPandas().sort_values(["dim", "at"])
    return {int(d): (int(own.n.iloc[0]), (own.total / own.n).to_numpy("f4")) for d, own in pdf.groupby("dim")}


def _codes(x: np.ndarray, floats: bool) -> pa.Array:
    """Unit vectors as they are, or their projections as one byte each after the step between codes, which follows the largest projection."""
    if not floats:
        y = x @ rotation(x.shape[1]).T
        step = np.abs(y).max(axis=1, keepdims=True) / 127
        x = np.concatenate([step.astype("<f4").view("u1"), np.rint(y / step).astype("i1").view("u1")], axis=1)
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())])
    return raw.cast(pa.binary())


def _projections(codes: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections of coded rows, and a bound on the length of what rounding took from each."""
    raw = np.frombuffer(codes, "u1").reshape(rows, -1)
    step = np.ascontiguousarray(raw[:, :4]).view("<f4")
    return np.ascontiguousarray(raw[:, 4:]).view("i1") * step, 0.5 * step[:, 0] * math.sqrt(raw.shape[1] - 4)


KEYS = ("tab", "cell", "sub", "grp", "dim")
KEYED = "tab smallint, cell bigint, sub bigint, grp string, dim int"


def _cells(tables: int, sets: list[int], mean: dict[int, np.ndarray], what: str):
    """Task: every row once per table with its cell. what: "count" gives rows per cell, "codes" projections, "floats" unit vectors."""

    def run(batches):
        for batch in batches:
            for dim, own, x in _by_dim(batch.column("v")):
                grp = batch.column("grp").take(pa.array(own))
                off = x - mean[dim]
                code = None if what == "count" else _codes(x, what == "floats")
                for t in range(tables):
                    cell = farthest(off, sets, t)
                    if what == "count":
                        one = pa.table({"grp": grp, "cell": pa.array(cell)}).group_by(["grp", "cell"]).aggregate([([], "count_all")])
                        n = one.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, t, "i2")), one["cell"].combine_chunks(), pa.array(np.zeros(n, "i8")), one["grp"].combine_chunks(), pa.array(np.full(n, dim, "i4")), one["count_all"].combine_chunks()], [*KEYS, "n"],
                        )
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), t, "i2")), pa.array(cell), pa.array(np.zeros(len(own), "i8")), grp, pa.array(np.full(len(own), dim, "i4")), batch.column("no").take(pa.array(own)), code], [*KEYS, "no", "code"],
                    )

    return run


def _cell_sums(batches):
    """Task over rows (keys, code of floats, n) of crowded cells: their sums by cell and place."""
    for batch in batches:
        if not batch.num_rows:
            continue
        grp = batch.column("grp").dictionary_encode().indices.to_numpy()
        ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype("i8") for c in ("tab", "cell", "dim")] + [grp.astype("i8")])
        _, first, which = np.unique(ids, axis=1, return_index=True, return_inverse=True)
        which = which.ravel()
        for w, r in enumerate(first):
            own = pa.array(np.flatnonzero(which == w))
            x = np.frombuffer(b"".join(batch.column("code").take(own).to_pylist()), "f4").reshape(len(own), -1)
            dim = x.shape[1]
            same = pa.array(np.full(dim, r))
            keys = [batch.column(c).take(same) for c in KEYS]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(dim, dtype="i4")), pa.array(x.sum(axis=0, dtype="f8")), batch.column("n").take(same)], [*KEYS, "at", "total", "n"])


def _deeper(inner: int, cell_rows: int, floats: bool):
    """Task over rows (keys, no, code of floats, n, mean) of crowded cells: `inner` cuts of each around its mean."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c) for c in ("tab", "cell", "grp", "dim", "no", "n")}
            plain = {c: cols[c].to_numpy(zero_copy_only=False) for c in ("tab", "cell", "dim", "n")}
            grp = cols["grp"].dictionary_encode().indices.to_numpy()
            _, which = np.unique(np.stack([plain["tab"], plain["cell"], plain["dim"], grp]).astype("i8"), axis=1, return_inverse=True)
            which = which.ravel()
            for w in range(which.max() + 1):
                own = np.flatnonzero(which == w)
                at = pa.array(own)
                x = np.frombuffer(b"".join(batch.column("code").take(at).to_pylist()), "f4").reshape(len(own), -1)
                mean = np.array(batch.column("mean")[int(own[0])].as_py(), "f4")
                sets = sets_of(max(1.0, math.log2(plain["n"][own[0]] / cell_rows)))
                code = _codes(x, floats)
                for r in range(inner):
                    sub = farthest(x - mean, sets, 2, int(plain["tab"][own[0]]), r) * inner + r + 1
                    yield pa.RecordBatch.from_arrays([*(cols[c].take(at) for c in ("tab", "cell")), pa.array(sub), cols["grp"].take(at), cols["dim"].take(at), cols["no"].take(at), code], [*KEYS, "no", "code"])

    return run


def _of_cells(batches, *more: str):
    """(key, its rows' numbers, raw codes) for stretches of equal keys in sorted batches; a key may go on in the next batch."""
    names = [*KEYS, *more]
    for batch in batches:
        if not batch.num_rows:
            continue
        grp = batch.column("grp").dictionary_encode()
        plain = {c: grp.indices.to_numpy() if c == "grp" else batch.column(c).to_numpy(zero_copy_only=False).astype("i8") for c in names}
        cut = np.flatnonzero(np.any([np.diff(plain[c]) != 0 for c in names], axis=0)) + 1
        no = batch.column("no").to_numpy()
        col = batch.column("code").cast(pa.large_binary())
        offs = np.frombuffer(col.buffers()[1], "i8")[col.offset : col.offset + len(col) + 1]
        raw = col.buffers()[2]
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            key = tuple(grp.dictionary[int(plain[c][s])].as_py() if c == "grp" else int(plain[c][s]) for c in names)
            yield key, no[s:e].copy(), bytes(memoryview(raw)[int(offs[s]) : int(offs[e])])


def _pairs(least: float, k: int, most: int):
    """Task over rows sorted by KEYS, cells of bounded size: the candidates of every row among those of its cell.

    Windows around a row widen until k neighbours within their radius are verified. Given out is whatever may be among the k best in view of
    the rounding of the codes; where that is more than `most`, nothing but the key of the cell, for true products."""

    def near(unit: np.ndarray, lost: np.ndarray) -> list | None:
        n, dim = unit.shape
        m = min(COUNTED, dim)
        radius = math.sqrt(max(0.0, 2 - 2 * least) / dim)
        scale = 127 / min(1.0, 6 / math.sqrt(dim))
        byte = np.clip(np.rint(unit[:, :m] * scale + 128), 0, 255).astype("u1")
        need = threshold(m, WINDOW, 0.998)
        halves = [min(126, math.ceil(WINDOW * radius * f * scale) + 1) for f in WIDEN]
        across = np.ascontiguousarray(byte.T)
        out = []
        for lo in range(0, n, 128):
            size = min(128, n - lo)
            left = across[:, lo : lo + size] + np.uint8(halves[-1])
            count = np.zeros((size, n), "u1")
            gap, hit = np.empty_like(count), np.empty(count.shape, bool)
            for d in range(m):
                np.subtract(left[d][:, None], across[d][None, :], out=gap)
                np.less_equal(gap, 2 * halves[-1], out=hit)
                np.add(count, hit.view("u1"), out=count)
            i, j = np.nonzero(count >= need)
            ok = i + lo != j
            i, j = i[ok], j[ok]
            a, b = byte[i + lo], byte[j]
            apart = np.maximum(a, b) - np.minimum(a, b)
            slack = lost[i + lo] + lost[j] + lost[i + lo] * lost[j] + 1e-6  # bound of the error of a product of codes
            dot = np.full(len(i), -2, "f4")
            done = np.zeros(size, bool)
            for f, half in zip(WIDEN, halves):
                new = np.flatnonzero((dot == -2) & ~done[i])
                new = new[(apart[new] <= half).sum(axis=1) >= need]
                dot[new] = np.einsum("ij,ij->i", unit[i[new] + lo], unit[j[new]])
                done |= np.bincount(i[dot >= 1 - f * f * (1 - least) + slack], minlength=size) >= k
            ok = np.flatnonzero(dot + slack >= least)
            ok = ok[np.lexsort((slack[ok] - dot[ok], i[ok]))]  # by the least that the cosine can be
            i, j, dot, slack = i[ok], j[ok], dot[ok], slack[ok]
            if not len(i):
                continue
            start = np.flatnonzero(np.r_[True, np.diff(i) != 0])
            length = np.diff(np.r_[start, len(i)])
            last = start + np.minimum(k, length) - 1
            ok = dot + slack >= np.repeat(np.where(length < k, -2, dot[last] - slack[last]), length)
            if np.bincount(i[ok]).max() > most:
                return None
            out.append((i[ok] + lo, j[ok]))
        return out

    def answer(key, no: np.ndarray, codes: list[bytes]):
        if len(no) < 2:
            return
        found = near(*_projections(b"".join(codes), len(no)))
        if found is None:
            empty = pa.array([None], pa.int64())
            one = [pa.array([key[0]], pa.int16()), pa.array([key[1]]), pa.array([key[2]]), pa.array([key[3]], pa.string()), pa.array([key[4]], pa.int32())]
            yield pa.RecordBatch.from_arrays([empty, empty, *one], ["a", "b", *KEYS])
        elif found:
            i, j = (np.concatenate(x) for x in zip(*found))
            none = [pa.nulls(len(i), t) for t in (pa.int16(), pa.int64(), pa.int64(), pa.string(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(no[i]), pa.array(no[j]), *none], ["a", "b", *KEYS])

    def run(batches):
        now, nos, codes = None, [], []
        for key, no, code in _of_cells(batches):
            if key != now and nos:
                yield from answer(now, np.concatenate(nos), codes)
                nos, codes = [], []
            now = key
            nos.append(no)
            codes.append(code)
        if nos:
            yield from answer(now, np.concatenate(nos), codes)

    return run


def _whole(least: float, keep: int):
    """Task over rows sorted by KEYS, block, own first: the `keep` best of each own row among all rows of the cell."""

    def meet(t, best, names, x, no, same):
        for lo in range(0, len(t), 256):
            dot = t[lo : lo + 256] @ x.T
            if same:
                i = np.arange(len(dot))
                dot[i, lo + i] = -2
            top = np.argpartition(-dot, keep - 1, axis=1)[:, :keep] if dot.shape[1] > keep else np.tile(np.arange(dot.shape[1]), (len(dot), 1))
            d = np.concatenate([best[lo : lo + 256], np.take_along_axis(dot, top, 1)], axis=1)
            n = np.concatenate([names[lo : lo + 256], no[top]], axis=1)
            order = np.argpartition(-d, keep - 1, axis=1)[:, :keep]
            best[lo : lo + 256], names[lo : lo + 256] = np.take_along_axis(d, order, 1), np.take_along_axis(n, order, 1)

    def run(batches):
        now, own, state = None, [], None

        def start():
            t, no = np.concatenate([x for x, _ in own]), np.concatenate([n for _, n in own])
            best, names = np.full((len(t), keep), -2, "f8"), np.zeros((len(t), keep), "i8")
            meet(t, best, names, t, no, True)
            return t, no, best, names

        def result(state):
            _, no, best, names = state
            i, j = np.nonzero(best >= least - 1e-6)
            return pa.RecordBatch.from_arrays([pa.array(no[i]), pa.array(names[i, j])], ["a", "b"])

        for (*key, mine), no, code in _of_cells(batches, "blk", "own"):
            if key != now:
                if state or own:
                    yield result(state or start())
                now, own, state = key, [], None
            x = np.frombuffer(code, "f4").reshape(len(no), -1).astype("f8")
            x /= np.linalg.norm(x, axis=1)[:, None]
            if mine:
                own.append((x, no))
            elif own:
                state = state or start()
                meet(state[0], state[2], state[3], x, no, False)
        if state or own:
            yield result(state or start())

    return run


def similar(
    df: DataFrame, group: str = "collection", key: str = "point_id", vector: str = "dense", k: int = 10, min_similarity: float = 0.9,
    recall: float = 0.98, cell_rows: int = 450, span: int = 4096, inner: int = 4, block: int = 32768, tables: int | None = None,
) -> DataFrame:
    """The k most similar vectors of every vector, as far as their cosine reaches min_similarity.

    Returns (grp, point, neighbour, similarity, place): place 1..k, ties by id. In a class of equal vectors the k + 1 smallest ids
    have rows; for any further member the first k of them are its neighbours.

    recall: the chance that a pair at min_similarity shares a cell in one of the tables, whose number follows from it (from
    random pairs, in view of how much the mean of all vectors takes of their length) unless given; closer pairs are met more often.
    All pairs of a cell meet in windows: cells up to `span` rows in one task, larger ones cut again `inner` times over around their own mean into cells
    of about `cell_rows`; the rest whole, a block of about `block` rows against the cell in each task."""
    spark = df.sparkSession
    classes, members = unique_vectors(df, group, key, vector, k)
    classes = staged(classes.withColumn("no", F.xxhash64("cls")), "vector-classes")
    mean = means(classes)
    total = sum(n for n, _ in mean.values())
    sets = sets_of(max(1.0, math.log2(max(2, total) / cell_rows)))
    if tables is None:
        dim, (_, centre) = max(mean.items(), key=lambda x: x[1][0], default=(2, (0, np.zeros(2))))
        # less the mean, a pair is as far apart but its vectors are shorter; below a half the least similarity no longer tells anything apart
        apart = max(0.5, 1 - (1 - min_similarity) / max(1e-6, 1 - float(centre @ centre)))
        chance = shared_cell(dim, sets, apart)
        tables = max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-9, 1 - chance)))) if chance < 1 else 1
    off = {d: m for d, (_, m) in mean.items()}
    rows = classes.select("grp", "no", "v")
    of_cell = f"{KEYED}, no bigint, code binary"

    def crowds(df: DataFrame) -> DataFrame:
        return df.where(F.col("n") > span)

    def cells(what: str) -> DataFrame:
        return rows.mapInArrow(_cells(tables, sets, off, what), f"{KEYED}, n bigint" if what == "count" else of_cell)

    hot = staged(crowds(cells("count").groupBy(*KEYS).agg(F.sum("n").alias("n"))), "hot-cells")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total * tables // 400_000)
    small, large = cells("codes"), None
    if hot.head(1):
        small = small.join(hot, list(KEYS), "left_anti")
        inside = cells("floats").join(hot, list(KEYS))
        sums = inside.mapInArrow(_cell_sums, f"{KEYED}, at int, total double, n bigint").groupBy(*KEYS, "at").agg(F.sum("total").alias("total"), F.max("n").alias("n"))
        centres = sums.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", (F.col("total") / F.col("n")).alias("x")))), lambda s: s["x"].cast("float")).alias("mean"))
        centres = staged(centres, "hot-cell-means")
        inside = inside.join(centres, list(KEYS))
        deep = inside.mapInArrow(_deeper(inner, cell_rows, False), of_cell)
        large = staged(crowds(deep.groupBy(*KEYS).agg(F.count("*").alias("n"))), "large-cells")
        small = small.unionByName(deep.join(large, list(KEYS), "left_anti"))
        n = max(n, 1 + (total * tables + (hot.agg(F.sum("n")).head()[0] or 0) * inner) // 400_000)
    found = small.repartitionByRange(n, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(_pairs(min_similarity, k, 16 * k), f"a bigint, b bigint, {KEYED}")
    found = staged(found.distinct(), "vector-candidates")
    pairs = found.where("a is not null").select("a", "b")
    whole = found.where("a is null").select(*KEYS)
    if large is not None:
        whole = whole.unionByName(large.select(*KEYS))
    if whole.head(1):
        # cells to be compared whole, with their sizes
        full = cells("floats")
        if large is not None:
            full = full.unionByName(inside.mapInArrow(_deeper(inner, cell_rows, True), of_cell))
        full = full.join(whole, list(KEYS))
        sizes = staged(full.groupBy(*KEYS).agg(F.count("*").alias("n")).select(*KEYS, F.ceil(F.col("n") / block).cast("int").alias("blocks")), "whole-cells")
        blocks = sizes.agg(F.sum("blocks")).head()[0]
        met = full.join(sizes, list(KEYS)).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.withColumn("own", F.pmod(F.xxhash64("no"), F.col("blocks")) == F.col("blk")).select(*KEYS, "blk", "own", "no", "code")
        met = met.repartition(max(n, blocks), *KEYS, "blk").sortWithinPartitions(*KEYS, "blk", F.desc("own"))
        pairs = staged(pairs.unionByName(met.mapInArrow(_whole(min_similarity, 4 * k), "a bigint, b bigint")).distinct(), "vector-pairs")
    # verification by the true cosine, only for vectors with a partner
    vec = classes.join(pairs.select(F.col("a").alias("no")).distinct(), "no", "left_semi").select("no", "grp", "cls", "v")
    a = vec.select(F.col("no").alias("a"), "grp", F.col("cls").alias("cls_a"), F.col("v").alias("va"))
    b = vec.select(F.col("no").alias("b"), F.col("grp").alias("grp_b"), F.col("cls").alias("cls_b"), F.col("v").alias("vb"))

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)

    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cosine = dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb"))
    true = (
        once.join(a, "a").join(b, "b").where(F.col("grp") == F.col("grp_b"))
        .select("grp", "cls_a", "cls_b", F.round(cosine, 9).alias("similarity")).where(F.col("similarity") >= min_similarity)
    )
    links = true.unionByName(true.select("grp", F.col("cls_b").alias("cls_a"), F.col("cls_a").alias("cls_b"), "similarity"))
    doubles = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").join(classes.select("cls", "grp"), "cls")
    links = links.unionByName(doubles.select("grp", F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), F.lit(1.0).alias("similarity")))
    rows = (
        links.join(members.select(F.col("cls").alias("cls_a"), F.col("key").alias("point")), "cls_a")
        .join(members.select(F.col("cls").alias("cls_b"), F.col("key").alias("neighbour")), "cls_b")
        .where(F.col("point") != F.col("neighbour"))
    )
    w = Window.partitionBy("grp", "point").orderBy(F.desc("similarity"), "neighbour")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("grp", "point", "neighbour", "similarity", "place")


def mutual(found: DataFrame) -> DataFrame:
    """(point_a, point_b): pairs of which each is a neighbour of the other, point_a < point_b."""
    pair = found.select("grp", F.least("point", "neighbour").alias("point_a"), F.greatest("point", "neighbour").alias("point_b"))
    return pair.groupBy("grp", "point_a", "point_b").agg(F.count("*").alias("n")).where("n = 2").select("point_a", "point_b").distinct()


QUERY_BLOCK = 4096  # query vectors that travel to the tasks at once


def _found(sent, k: int, share: float, m: int):
    """Task: around each query the windows on the projections of a block of rows widen until enough rows collide often; the k + 1
    best of all blocks of the task."""

    def byte(p: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(p * 32 + 128), 0, 255).astype("u1")  # projections have a spread of about 1: four of it fit

    def candidates(near: np.ndarray, codes: np.ndarray, want: int):
        """(query, row) of all rows that collide with a query on most directions, windows wide enough for `want` of them."""
        todo, half, out = np.arange(len(near)), 24, []
        while len(todo):
            count = np.zeros((len(todo), codes.shape[1]), "u1")
            gap, hit = np.empty_like(count), np.empty(count.shape, bool)
            low = np.maximum(near[todo].astype("i2") - half, 0).astype("u1")
            width = np.minimum(near[todo].astype("i2") + half, 255).astype("u1") - low
            for d in range(m):
                np.subtract(codes[d][None, :], low[:, d][:, None], out=gap)
                np.less_equal(gap, width[:, d][:, None], out=hit)
                np.add(count, hit.view("u1"), out=count)
            often = count >= math.ceil(0.6 * m)
            enough = (often.sum(axis=1) >= want) | (half >= 128)
            i, j = np.nonzero(often[enough])
            out.append((todo[enough][i], j))
            todo, half = todo[~enough], math.ceil(half * 1.25)
        return (np.concatenate(x) for x in zip(*out))

    def run(batches):
        best: dict = {}
        for batch in batches:
            grp = batch.column("grp").to_numpy(zero_copy_only=False)
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for dim, own, x in _by_dim(batch.column("v")):
                codes = byte(x @ directions(dim, m, 3).T)
                for g in np.unique(grp[own]):
                    if (g, dim) not in sent.value:
                        continue
                    ids, q = sent.value[g, dim]
                    part = np.flatnonzero(grp[own] == g)
                    once: dict = {}  # a repeated row counts once, in the windows too
                    for r in part:
                        once.setdefault((keys[own[r]], x[r].tobytes()), r)
                    part = np.array(list(once.values()))
                    names, rows, across = keys[own[part]], x[part], np.ascontiguousarray(codes[part].T)
                    near = byte(q @ directions(dim, m, 3).T)
                    want = min(len(part), max(4 * k, math.ceil(share * len(part))))
                    for lo in range(0, len(q), 64):
                        i, j = candidates(near[lo : lo + 64], across, want)
                        s = np.round(np.einsum("ij,ij->i", q[lo + i].astype("f8"), rows[j]), 9)
                        order = np.lexsort((names[j], -s, i))
                        i, j, s = i[order], j[order], s[order]
                        start = np.flatnonzero(np.r_[True, np.diff(i) != 0])
                        kept = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)])) < 2 * k + 2
                        for a, b, c in zip(i[kept], names[j[kept]], s[kept]):
                            mine = best.setdefault(ids[lo + a], {})
                            if c > mine.get(b, -2):  # a point of several vectors stands once, with its nearest
                                mine[b] = float(c)
                        for a in np.unique(i):
                            mine = best[ids[lo + a]]
                            if len(mine) > k + 1:
                                best[ids[lo + a]] = dict(sorted(mine.items(), key=lambda e: (-e[1], e[0]))[: k + 1])
        out = [(q, name, s) for q, mine in best.items() for name, s in mine.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.float64()))], ["point", "neighbour", "similarity"])

    return run


def search(
    df: DataFrame, queries: DataFrame, group: str = "collection", key: str = "point_id", vector: str = "dense", k: int = 10, share: float = 0.12, m: int = 96,
) -> DataFrame:
    """(point, neighbour, similarity, place): for each id of queries(key) the k most similar rows of its group.

    share: part of a block of rows that is verified by the true cosine at least; it sets the recall. Queries go in blocks of about
    QUERY_BLOCK, one after the other, so no more than one is with the tasks; a task returns k + 1 rows per query."""
    spark = df.sparkSession
    rows = _fit(df, group, key, vector)
    asked = rows.join(queries.select(F.col(key).cast("string").alias("key")).distinct(), "key", "left_semi").dropDuplicates(["grp", "key"])
    asked = staged(asked, "search-queries")
    blocks = 1 + asked.count() // QUERY_BLOCK
    path = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    schema = "point string, neighbour string, similarity double"
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("grp", "key"), F.lit(blocks)) == b).toPandas()
        packed = {}
        for (g, dim), own in part.groupby(["grp", part.v.map(len)]):
            q = np.stack([np.asarray(x, "f8") for x in own.v])
            packed[g, int(dim)] = (own.key.tolist(), (q / np.linalg.norm(q, axis=1)[:, None]).astype("f4"))
        sent = spark.sparkContext.broadcast(packed)
        rows.mapInArrow(_found(sent, k, share, m), schema).write.mode("append").parquet(path)
        sent.destroy()
    out = spark.read.schema(schema).parquet(path)
    w = Window.partitionBy("point").orderBy(F.desc("similarity"), "neighbour")
    out = out.where("point <> neighbour").groupBy("point", "neighbour").agg(F.max("similarity").alias("similarity"))
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
