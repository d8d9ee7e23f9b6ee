"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import discard, materialize
from quillsieve.llm.components import connected_components
from quillsieve.llm.tiles import deal, forest, runs

#: Bits of a code at most; a vector of fewer dimensions has one for each.
BITS = 64
#: Vectors the rotation is learned from, at most; all vectors are coded and compared.
SAMPLE_ROWS = 8192
#: Vectors of the sample on which layouts of the tables are weighed, and a layout's relative costs of a row and of a comparison.
WEIGHED, ROW_COST, PAIR_COST = 64, 3.0, 0.02
TILE = 1024


@dataclass
class Quantiser:
    """A code bit is the sign of a centred unit vector's projection on one of the orthonormal ``axes``.

    ``sketch`` keeps each projection as a whole number of ``step``, rounded down, so its sign is the
    code bit and its size says how far the vector is from having the other bit.
    """

    mean: np.ndarray
    axes: np.ndarray
    step: float

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((unit - self.mean) @ self.axes / self.step), -128, 127).astype(np.int8)


@dataclass
class Layout:
    """``tables`` keys of ``width`` bits each; a flip set may cost ``budget``, the sum of its bits' squared margins."""

    tables: int
    width: int
    budget: int


def margins(sketch: np.ndarray) -> np.ndarray:
    """Squared distance of each projection from zero, rounded down."""
    wide = sketch.astype(np.int64)
    return np.where(wide >= 0, wide, -wide - 1) ** 2


def fit(unit: np.ndarray, rounds: int = 40, seed: int = 5) -> Quantiser:
    """Principal axes of a sample of unit vectors, turned by the rotation that brings them nearest to signs."""
    mean = unit.mean(0)
    centred = unit - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    axes = vectors[:, ::-1][:, :BITS]
    bits = axes.shape[1]
    flat = centred @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (u @ vt).T
    axes = axes @ turn
    return Quantiser(mean, axes, max(float(np.abs(centred @ axes).max()), 1e-6) / 120)


def probes(sketch: np.ndarray, layout: Layout, table: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(row, key): a table's own keys and all that lie within its budget of flips; None beyond ``most`` of them."""
    part = sketch[:, table * layout.width : (table + 1) * layout.width]
    cost = margins(part)
    row = np.arange(len(part))
    key = ((part >= 0) << np.arange(layout.width)).sum(1)
    spent = np.zeros(len(part), np.int64)
    for k in range(layout.width):
        more = spent + cost[row, k]
        ok = more <= layout.budget
        row, key, spent = np.concatenate([row, row[ok]]), np.concatenate([key, key[ok] ^ (1 << k)]), np.concatenate([spent, more[ok]])
        if most is not None and len(row) > most:
            return None
    return row, key


def reach(threshold: float) -> float:
    """Largest distance of two unit vectors whose cosine is ``threshold``, with room for rounding."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) * (1 + 1e-6) + 1e-9


def layout_for(quantiser: Quantiser, unit: np.ndarray, vectors: float, pairs: float, threshold: float) -> Layout:
    """The cheapest layout for so many vectors and pairs of them within labels; every layout finds the same links.

    Of two unit vectors at ``threshold`` the projections differ by ``reach`` in all, squared and summed,
    and at a bit that differs by both margins. So in one of m tables the margins of one of the two
    vectors sum to reach**2 / 2m at most over the bits that differ: probing these flips meets the pair.
    """
    sketch = quantiser.sketch(unit[:WEIGHED])
    bits = quantiser.axes.shape[1]
    best, least = None, np.inf
    # keys much wider than the vectors are many only cost probes
    for width in range(2 if bits > 1 else 1, min(bits, 24, int(np.log2(vectors + 1)) + 4) + 1, 2):
        for tables in range(min(4, bits // width), bits // width + 1):
            layout = Layout(tables, width, int(reach(threshold) ** 2 / 2 / tables / quantiser.step**2))
            found = probes(sketch, layout, 0, most=len(sketch) * 2048)
            if found is None:
                continue
            each = len(found[0]) / len(sketch)
            cost = tables * (vectors * (1 + each) * ROW_COST + pairs * each / 2**width * PAIR_COST)
            if cost < least:
                best, least = layout, cost
    return best


def usable(embedding: Column, label: Column) -> Column:
    """Whether a vector can link: its label, itself and its components are there and finite, and one is not zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _sketches(column) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    raw = b"".join(array.to_pylist())
    return np.frombuffer(raw, np.int8).reshape(len(array), -1)


def near_vectors(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample_rows: int = SAMPLE_ROWS, layout: tuple[int, int] | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors link when their labels are equal, their lengths too, and their cosine in double precision
    is ``threshold`` or more. Candidates meet in the Hamming tables of their ITQ codes; the probes of a
    key follow from the margins of the projections, so that every link is met (see ``layout_for``),
    whatever the rotation, the layout of the tables ((tables, width), else the cheapest) and the number
    of vectors. Sketches rule out most of what meets; what is left is verified on the vectors
    themselves. Equal vectors of a label are one class with a count, so copies are compared once and
    all counted in n_links. Null, empty, zero or non-finite vectors and null labels link with nothing
    and are their own component. component_id is the smallest id reachable (null ids never; null for a
    lone null id); kept is whether the row has that id. Repeated rows are vectors of their own. Other
    columns are not read. Empty in, empty out.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("good", usable(F.col("vector"), F.col("label")))
    grouped = rows.filter("good").groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = materialize(grouped.withColumn("cls", F.monotonically_increasing_id()), "vectors")
    by_label = classes.groupBy(F.size("vector").alias("size"), "label").agg(F.count("*").cast("double").alias("n"))
    sizes = by_label.groupBy("size").agg(F.sum("n").alias("vectors"), F.sum(F.col("n") * F.col("n")).alias("pairs")).orderBy("size").collect()
    links = df.sparkSession.createDataFrame([], "edge boolean, a long, b long")
    for r in sizes:
        same = classes.filter(F.size("vector") == r["size"])
        sample = _unit(np.array([x[0] for x in same.select("vector").orderBy(F.xxhash64("vector")).limit(sample_rows).collect()], np.float64))
        quantiser = fit(sample)
        chosen = layout_for(quantiser, sample, r["vectors"], r["pairs"], threshold)
        if layout:
            width = min(layout[1], r["size"])
            tables = min(layout[0], min(BITS, r["size"]) // width)
            chosen = Layout(tables, width, int(reach(threshold) ** 2 / 2 / tables / quantiser.step**2))
        links = links.union(_links(same, quantiser, chosen, threshold))
    links = materialize(links, "links")
    counts = links.filter("NOT edge").groupBy("a").agg(F.sum("b").alias("far")).withColumnRenamed("a", "cls")
    nodes = connected_components(links.filter("edge").select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.join(counts, "cls", "left").join(nodes, F.col("cls") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select(F.col("label").alias("l"), F.col("vector").alias("v"), (F.col("n") - 1 + F.coalesce("far", F.lit(0))).cast("long").alias("n_links"), "component_id")
    good = rows.filter("good").join(named, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v"))).select("id", "n_links", "component_id")
    lone = rows.filter("NOT good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(lone).select(F.col("id").alias(id_col), "n_links", F.col("component_id").cast("long"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(classes: DataFrame, quantiser: Quantiser, layout: Layout, threshold: float) -> DataFrame:
    """(edge, a, b): links counted for class a from one tile (edge false), or a link that joins a and b (true)."""
    label_type, kind = dict(classes.dtypes)["label"], dict(classes.dtypes)["vector"]

    def keys(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                sketch = quantiser.sketch(_unit(_matrix(part.column(2))))
                packed = pa.array([x.tobytes() for x in sketch], pa.binary())
                for t in range(layout.tables):
                    row, key = probes(sketch, layout, t)
                    # side 0 has each vector under its own key, side 1 under every key that it probes
                    side = np.concatenate([np.zeros(len(sketch), np.int32), np.ones(len(row), np.int32)])
                    row, key = np.concatenate([np.arange(len(sketch)), row]), np.concatenate([key[: len(sketch)], key])
                    for a in range(0, len(row), 1 << 15):
                        at = pa.array(row[a : a + (1 << 15)])
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(at), pa.array(np.full(len(at), t, np.int32)), pa.array(key[a : a + (1 << 15)].astype(np.int32)), pa.array(side[a : a + (1 << 15)]), part.column(1).take(at), packed.take(at)],
                            names=["label", "t", "key", "side", "cls", "sketch"],
                        )

    keyed = materialize(classes.select("label", "cls", "vector").mapInArrow(keys, f"label {label_type}, t int, key int, side int, cls long, sketch binary"), "keys")
    order = ["label", "t", "key", "i", "j", "side", "cls", "sketch"]
    bits = quantiser.axes.shape[1]
    # sketches of vectors within reach differ by no more: rounding down moves them by less than one step a bit
    apart = (reach(threshold) / quantiser.step + np.sqrt(bits)) ** 2 * (1 + 1e-9)

    def meet(batches):
        """The rows of each tile that some row of the other side may link with."""
        for table, heads in runs(batches, 5):
            side, cls = table.column("side").to_numpy(), table.column("cls").to_numpy()
            sketch = _sketches(table.column("sketch")).astype(np.float32)
            norm = (sketch * sketch).sum(1)
            keep = np.zeros(len(side), bool)
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), table.num_rows]):
                mid = a + int(np.searchsorted(side[a:b], 1))
                if mid == a or mid == b:
                    continue
                # whole numbers below 2^24: exact in single precision
                near = norm[mid:b, None] + norm[None, a:mid] - 2 * (sketch[mid:b] @ sketch[a:mid].T) <= apart
                near &= cls[mid:b, None] != cls[None, a:mid]
                keep[a:mid] |= near.any(0)
                keep[mid:b] |= near.any(1)
            if keep.any():
                yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    tiles = f"label {label_type}, t int, key int, i int, j int, side int, cls long, sketch binary"
    left = materialize(deal(keyed, ["label", "t", "key"], "cls", TILE).select(*order).mapInArrow(meet, tiles), "meetings")
    discard(keyed)
    whole = left.join(classes.select("cls", "n", "vector"), "cls").select(*order, "n", "vector")
    whole = whole.repartition("label", "t", "key", "i", "j").sortWithinPartitions("label", "t", "key", "i", "j", "side")

    def first_meeting(t, sketch, cls, p, q):
        """Whether no earlier table, nor this one with the sides exchanged, shows the pairs (prober p, owner q)."""
        part = slice(0, (t + 1) * layout.width)
        x, y = sketch[p][:, part], sketch[q][:, part]
        differ = (x >= 0) != (y >= 0)
        by = [(differ * margins(z)).reshape(len(p), t + 1, layout.width).sum(2) <= layout.budget for z in (x, y)]
        return ~(by[0] | by[1])[:, :t].any(1) & ~(by[1][:, t] & (cls[q] < cls[p]))

    def compare(batches):
        for table, heads in runs(batches, 5):
            side, cls, n, tab = (table.column(c).to_numpy() for c in ("side", "cls", "n", "t"))
            sketch, unit = _sketches(table.column("sketch")), _unit(_matrix(table.column("vector")))
            who, counts, us, vs = [], [], [], []
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), table.num_rows]):
                mid = a + int(np.searchsorted(side[a:b], 1))
                if mid == a or mid == b:
                    continue
                near = unit[mid:b] @ unit[a:mid].T >= threshold
                near &= cls[mid:b, None] != cls[None, a:mid]
                every = np.argwhere(near)
                each = np.zeros(b - a, np.int64)
                for lo in range(0, len(every), 1 << 16):
                    p, q = every[lo : lo + (1 << 16), 0] + mid, every[lo : lo + (1 << 16), 1] + a
                    new = first_meeting(int(tab[a]), sketch, cls, p, q)
                    p, q = p[new], q[new]
                    if len(p):
                        np.add.at(each, p - a, n[q])
                        np.add.at(each, q - a, n[p])
                        u, v = forest(cls[p], cls[q])
                        us.append(u)
                        vs.append(v)
                hit = np.flatnonzero(each)
                who.append(cls[a + hit])
                counts.append(each[hit])
            if us:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                left, right = np.concatenate([*who, u]), np.concatenate([*counts, v])
                edge = np.arange(len(left)) >= len(left) - len(u)
                yield pa.RecordBatch.from_arrays([pa.array(edge), pa.array(left), pa.array(right)], names=["edge", "a", "b"])

    return whole.mapInArrow(compare, "edge boolean, a long, b long")


def drop_near_vectors(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", **options) -> DataFrame:
    """The rows whose id is the smallest of their component; all columns stay.

    Rows of a null id go, as nothing names them; of repeated ids all rows that have the smallest stay;
    rows without a usable vector or label stay; an empty table gives an empty one.
    """
    keep = near_vectors(df, threshold, id_col, **options).filter("kept").select(F.col(id_col).alias("__id")).distinct()
    return df.join(keep, df[id_col] == keep["__id"], "left_semi")
