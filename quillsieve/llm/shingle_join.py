"""What verifies and completes SimHash links by Jaccard similarity: a prefix-filtered join of word shingles that loses no pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import Members, blocks, discard, extend, field, materialize, text_bytes, with_columns
from quillsieve.llm.tiles import FEW, runs

SHINGLE = 5
#: Least similarity as a fraction, so that no comparison rounds.
NEAR, OF = 4, 5
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Counters that tell common shingles from rare ones, and their number in one row of a table.
SLOTS, CHUNK = 1 << 21, 1 << 16
#: Rows of a bucket that one tile compares, and pairs that one tile verifies.
TILE, PAIRS = 1024, 1 << 12
#: Places of a bucket's order within which rows are compared before all others.
NEXT = 3
#: Bits of a text's parity sketch: as many as it has shingles, within these bounds.
LEAST_BITS, MOST_BITS = 128, 1024


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending; a text of fewer words is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    got = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        got = got * MULTIPLIER + h[k : k + len(got)]
    got = (got ^ got >> np.uint64(32)) * MIX
    return np.unique(got ^ got >> np.uint64(29))


def _words(batch: pa.RecordBatch, text_col: str) -> Iterator[list[bytes]]:
    data, bounds = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
    raw = data.tobytes()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield raw[a:b].lower().split()


def _new_texts(batches, text_col: str):
    """(key, shingles) of each text that this task has not seen yet."""
    seen = set()
    for batch in blocks(batches, text_col):
        for key, words in zip(batch.column(batch.schema.get_field_index("__key")).to_pylist(), _words(batch, text_col)):
            if words and key not in seen:
                seen.add(key)
                yield key, shingles(words)


def parity(g: np.ndarray) -> bytes:
    """A bit for each slot of a power of two of them: whether an odd number of the shingles falls into it.

    Sketches of two sets differ in no more bits than shingles are in one set alone. Halves laid over
    each other make the sketch of half as many bits.
    """
    bits = LEAST_BITS
    while bits < min(len(g), MOST_BITS):
        bits *= 2
    counts = np.bincount((g >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1 > 0, bitorder="little").tobytes()


class Sketches:
    """Parity sketches of a table's rows, laid out so that rows of different lengths can be compared."""

    def __init__(self, column: pa.Array):
        raw = column.to_pylist()
        size = np.array([len(x) for x in raw])
        words = MOST_BITS // 64
        self.size = size
        self.whole = np.zeros((len(raw), words), np.uint64)
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            self.whole[at, : n // 8] = np.frombuffer(b"".join(raw[i] for i in at.tolist()), np.uint64).reshape(len(at), -1)

    def _folded(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        got = self.whole[at]
        n = self.size[at]
        while (longer := n > size).any():
            for full in np.unique(n[longer]).tolist():
                rows = np.flatnonzero(longer & (n == full))
                half = full // 16
                got[rows, :half] ^= got[rows, half : 2 * half]
                got[rows, half : 2 * half] = 0
                n[rows] = full // 2
        return got

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shingles that are in one of two texts alone, at least."""
        size = np.minimum(self.size[a], self.size[b])
        return np.bitwise_count(self._folded(a, size) ^ self._folded(b, size)).sum(1).astype(np.int64)


def keyed(df: DataFrame, text_col: str = "text", prints: Callable[[np.ndarray], int] = lambda g: 0) -> DataFrame:
    """Adds __row, a number of its own, __key, a hash of the text's words, and __print, ``prints`` of its shingles.

    Null and blank texts have key 0.
    """
    source = df.withColumn("__row", F.monotonically_increasing_id())
    columns = source.columns

    def run(batches):
        for batch in blocks(batches, text_col):
            words = list(_words(batch, text_col))
            key = np.array([xxhash.xxh64_intdigest(b" ".join(w)) if w else 0 for w in words], np.uint64)
            mark = np.array([prints(shingles(w)) for w in words], np.uint64)
            yield with_columns(batch, columns, {"__key": pa.array(key.view(np.int64)), "__print": pa.array(mark.view(np.int64))})

    return source.mapInArrow(run, extend(source, columns, [field("__key", "long"), field("__print", "long")]))


def commonness(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """A level for each of SLOTS slots of shingles, by how many texts hold one: 2 MB at any size of the corpus.

    It only sets the order in which a text's shingles are looked up, so neither shared slots nor counters
    that stop at 255 in a task can lose a pair.
    """

    def count(batches):
        found = np.zeros(SLOTS, np.uint8)
        for _, g in _new_texts(batches, text_col):
            at = np.unique(g & np.uint64(SLOTS - 1))
            found[at] += found[at] < 255
        parts = [found[lo : lo + CHUNK] for lo in range(0, SLOTS, CHUNK)]
        some = [(k, p.tobytes()) for k, p in enumerate(parts) if p.any()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([p for _, p in some], pa.binary())], names=["chunk", "counts"])

    def add(batches):
        total = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                total.setdefault(k, np.zeros(CHUNK, np.int64))
                total[k] += np.frombuffer(raw.as_buffer(), np.uint8)
        for k, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(8 * np.log2(1.0 + n), 255).astype(np.uint8).tobytes()], pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    level = np.zeros(SLOTS, np.uint8)
    for r in texts.select("__key", text_col).mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect():
        level[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["counts"]), np.uint8)
    return level


def postings(texts: DataFrame, level: np.ndarray, text_col: str = "text") -> DataFrame:
    """(token, key, n, pos): the first shingles of each text in the order of their commonness, n of all its shingles.

    Two sets of which the larger has n shingles share NEAR / OF of n at least, so each holds one of the
    common shingles among its first n - ceil(n * NEAR / OF) + 1.
    """
    shared = texts.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        held, rows = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["token", "key", "n", "pos"])

        for key, g in _new_texts(batches, text_col):
            n = len(g)
            first = n - -(-n * NEAR // OF) + 1
            g = g[np.lexsort((g, shared.value[g & np.uint64(SLOTS - 1)]))[:first]]
            held.append((g.view(np.int64), np.full(first, key, np.int64), np.full(first, n, np.int32), np.arange(first, dtype=np.int32)))
            rows += first
            if rows > 1 << 16:
                yield batch()
                held, rows = [], 0
        if held:
            yield batch()

    return texts.select("__key", text_col).mapInArrow(run, "token long, key long, n int, pos int")


def shared_postings(found: DataFrame) -> DataFrame:
    """The postings of tokens that stand in two rows or more, with their number c.

    ``found`` is worked out twice rather than written: it is about as large as the texts.
    """
    # counted apart, so that a join on a frequent token can be split
    counts = materialize(found.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1"), "tokens")
    return found.join(counts, "token")


def of_rows(texts: DataFrame, rows: DataFrame, make: Callable[[np.ndarray], bytes], out: str, text_col: str = "text") -> DataFrame:
    """(key, ``out``) made of the shingles of the texts whose __row is among ``rows`` (row), and of a few others.

    The texts are not joined, for that would move them all: a filter of bounded size goes to them, and
    what it lets pass beside the rows asked for falls out of the joins that use the result.
    """
    wanted = texts.sparkSession.sparkContext.broadcast(Members(rows, "row"))

    def run(batches):
        for batch in blocks(batches, text_col):
            batch = batch.filter(pa.array(wanted.value.maybe(batch.column(batch.schema.get_field_index("__row")).to_numpy())))
            if batch.num_rows:
                got = [make(shingles(w)) for w in _words(batch, text_col)]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("__key")), pa.array(got, pa.binary())], names=["key", out])

    return texts.select("__row", "__key", text_col).mapInArrow(run, f"key long, {out} binary")


def _may_link(key, n, pos, sketches, a, b) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that nothing known of them rules out; each filter keeps all pairs that are similar."""
    na, nb = n[a], n[b]
    # at the first common shingle, all that is still to come must suffice
    rest = np.minimum(na - pos[a], nb - pos[b])
    ok = (key[a] != key[b]) & (OF * np.minimum(na, nb) >= NEAR * np.maximum(na, nb)) & ((NEAR + OF) * rest >= NEAR * (na + nb))
    a, b = a[ok], b[ok]
    if sketches is None:
        return a, b
    # similar sets have at most this share of their shingles in one of them alone
    ok = np.ones(len(a), bool)
    for lo in range(0, len(a), 1 << 16):
        x, y = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
        ok[lo : lo + (1 << 16)] = (NEAR + OF) * sketches.apart(x, y) <= (OF - NEAR) * (n[x] + n[y])
    return a[ok], b[ok]


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])


def neighbours(shared: DataFrame) -> DataFrame:
    """Distinct (u, v), u < v, of rows at most NEXT places apart in their bucket, each bucket in an order of its own.

    Their number grows with the postings, not with the square of a bucket; what they link need not be paired again.
    """
    parts = F.ceil(F.col("c") / TILE).cast("int")
    dealt = shared.select("token", F.pmod(F.xxhash64("key"), parts).cast("int").alias("i"), F.xxhash64("token", "key").alias("at"), "key", "n", "pos")
    dealt = dealt.repartition("token", "i").sortWithinPartitions("token", "i", "at")

    def run(batches):
        for table, head in runs(batches, 2):
            key, n, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "pos"))
            bucket = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(key))))
            us, vs = [], []
            for step in range(1, min(NEXT, len(key) - 1) + 1):
                a = np.flatnonzero(bucket[step:] == bucket[:-step])
                a, b = _may_link(key, n, pos, None, a, a + step)
                us.append(key[a])
                vs.append(key[b])
            if us and sum(map(len, us)):
                yield _pairs(np.concatenate(us), np.concatenate(vs))

    return dealt.mapInArrow(run, "u long, v long").distinct()


def unsettled(shared: DataFrame, linked: DataFrame) -> DataFrame:
    """The postings of tokens that texts of different components (node, component) share, with their component."""
    placed = shared.join(linked, shared["key"] == linked["node"], "left").drop("node").withColumn("component", F.coalesce("component", "key"))
    placed = materialize(placed, "placed")
    mixed = materialize(placed.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("token"), "mixed")
    out = materialize(placed.join(mixed, "token", "left_semi"), "unsettled")
    discard(placed)
    return out


def candidates(open_: DataFrame) -> DataFrame:
    """Distinct (u, v), u < v, of texts that share a token, are not linked yet and are not ruled out.

    A bucket of over TILE rows is cut into parts; each part meets each in a tile of its own.
    """
    dealt = open_.withColumn("parts", F.ceil(F.col("c") / TILE).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "n", "pos", "component", "sketch")
    dealt = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def run(batches):
        for table, head in runs(batches, 3):
            i, j, own, key, n, pos, component = (table.column(c).to_numpy().astype(np.int64) for c in ("i", "j", "own", "key", "n", "pos", "component"))
            sketches = Sketches(table.column("sketch"))
            # each row meets the rows after it in its tile
            end = np.append(head[1:], len(key))
            after = np.repeat(end, end - head) - np.arange(len(key)) - 1
            done = np.cumsum(after)
            lo = 0
            while lo < len(key):
                hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + (1 << 18), side="right")))
                a = np.repeat(np.arange(lo, hi), after[lo:hi])
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after[lo:hi]) - after[lo:hi], after[lo:hi])
                lo = hi
                ok = (component[a] != component[b]) & ((i[a] == j[a]) | (own[a] != own[b]))
                a, b = _may_link(key, n, pos, sketches, a[ok], b[ok])
                if len(a):
                    yield _pairs(key[a], key[b])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that join what the pairs of similarity NEAR / OF or more join, given (key, grams) of each text.

    Pairs are gathered by the least text that u is paired with, in tiles, so a text is sent to few of them.
    """
    both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).union(pairs.select(F.col("v").alias("x"), F.col("u").alias("y")))
    label = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label"))
    placed = pairs.join(label, F.col("u") == F.col("x")).drop("x")
    sizes = placed.groupBy("label").agg(F.ceil(F.sqrt(F.count("*") / PAIRS)).cast("int").alias("parts"))
    placed = placed.join(sizes, "label").select("label", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("i"), F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("j"), "u", "v")
    placed = materialize(placed, "placed")
    ends = placed.select("label", "i", "j", F.col("u").alias("key")).union(placed.select("label", "i", "j", F.col("v").alias("key"))).distinct()
    ends = materialize(ends, "ends")
    if ends.count() <= FEW:
        # few places go to the texts' shingles, which then move once instead of twice
        ends = F.broadcast(ends)
    texts = ends.join(sets, "key").select("label", "i", "j", F.lit(0).alias("side"), F.col("key").alias("u"), F.lit(None).cast("long").alias("v"), "grams")
    rows = texts.union(placed.select("label", "i", "j", F.lit(1).alias("side"), "u", "v", F.lit(None).cast("binary").alias("grams")))
    rows = rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "side")

    def run(batches):
        for table, head in runs(batches, 3):
            us, vs = [], []
            for lo, hi in zip(head.tolist(), [*head[1:].tolist(), table.num_rows]):
                grams, above = {}, {}

                def root(x):
                    while x in above:
                        x = above[x]
                    return x

                part = table.slice(lo, hi - lo)
                for side, u, v, g in zip(*(part.column(c).to_pylist() for c in ("side", "u", "v", "grams"))):
                    if side == 0:
                        grams[u] = np.frombuffer(g, np.uint64)
                        continue
                    a, b = root(u), root(v)
                    if a == b:
                        continue
                    x, y = grams[u], grams[v]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if (NEAR + OF) * both >= NEAR * (len(x) + len(y)):
                        above[max(a, b)] = min(a, b)
                        us.append(u)
                        vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")
