"""SimHash near-duplicates by fuzzy Golay-code keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm import shingle_join
from quillsieve.llm.common import blocks, discard, extend, field, let_go, materialize, text_bytes, with_columns
from quillsieve.llm.components import connected_components
from quillsieve.llm.tiles import FEW, deal, forest, runs

SHINGLE, SEED, BITS_APART = 3, 42, 3
#: (first bit, bits) of the three segments of a fingerprint, each padded to the code's 23 bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the binary [23, 12, 7] Golay code.
GENERATOR = 0b101011100011
BITS_OF_BYTE = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
#: Rows of either side of a bucket that one tile compares.
TILE = 1024


def _syndromes(bits: int = 23) -> np.ndarray:
    out = []
    for k in range(bits):
        r = 1 << k
        for top in range(bits - 1, 10, -1):
            if r >> top & 1:
                r ^= GENERATOR << (top - 11)
        out.append(r)
    return np.array(out, np.int32)


class Golay:
    """Syndrome decoding: the 12-bit index of the codeword within three bits of a 23-bit word."""

    def __init__(self):
        self.column = _syndromes()
        one = 1 << np.arange(23)
        self.error = np.zeros(2048, np.int32)
        for i in range(23):
            for j in range(i, 23):
                for k in range(j, 23):
                    picked = {i, j, k}
                    s, e = 0, 0
                    for x in picked:
                        s ^= int(self.column[x])
                        e |= int(one[x])
                    self.error[s] = e
        self.part = [np.zeros(256, np.int32) for _ in range(3)]
        for t in range(3):
            for bit in range(8):
                if 8 * t + bit < 23:
                    self.part[t][np.arange(256) >> bit & 1 == 1] ^= self.column[8 * t + bit]

    def decode(self, words: np.ndarray, syndrome: np.ndarray | None = None) -> np.ndarray:
        s = self.syndrome(words) if syndrome is None else syndrome
        return (words ^ self.error[s]) >> 11

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.part[0][words & 255] ^ self.part[1][words >> 8 & 255] ^ self.part[2][words >> 16]

    def keys(self, words: np.ndarray) -> np.ndarray:
        """[n, 24] indices of the words and of all words one bit away; equal ones are -1 but for the first."""
        s = self.syndrome(words)
        found = [self.decode(words, s)] + [self.decode(words ^ (1 << k), s ^ self.column[k]) for k in range(23)]
        table = np.sort(np.stack(found, 1), 1)
        table[:, 1:][table[:, 1:] == table[:, :-1]] = -1
        return table


def fingerprint(raw: bytes) -> int:
    """64-bit SimHash of one text's UTF-8 bytes: the bits set in over half of the shingles' XXH64."""
    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        got = np.array([hashed(line, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(size) - 1
        start = end - size + 1
        got = np.fromiter([hashed(line[a:b], SEED) for a, b in zip(start[: 1 - SHINGLE].tolist(), end[SHINGLE - 1 :].tolist())], np.uint64, len(words) - SHINGLE + 1)
    return majority(got)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of some 64-bit hashes."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 64:
        counts = np.unpackbits(columns, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        # how often each byte stands at each of the eight places, times the bits of the byte
        counts = np.concatenate([np.bincount(columns[:, k], minlength=256) @ BITS_OF_BYTE for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, out: str = "simhash") -> DataFrame:
    """Adds the fingerprint as a signed long. Null and empty texts have fingerprint 0."""
    keep = df.columns if keep is None else list(keep)
    source = df.select(list(dict.fromkeys([*keep, text_col])))

    def run(batches):
        for batch in blocks(batches, text_col):
            data, bounds = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            raw = data.tobytes()
            got = np.array([fingerprint(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], np.uint64)
            yield with_columns(batch, keep, {out: pa.array(got.view(np.int64))})

    return source.mapInArrow(run, extend(source, keep, [field(out, "long")]))


def golay_keys(prints: DataFrame) -> DataFrame:
    """(key, side, simhash): what a fingerprint is found by, for a table of distinct fingerprints.

    With three bits apart in all, two of the three segments differ in one bit at most each. For each
    pair of segments a fingerprint has left keys - all indices near its first segment with the own
    index of its second - and right keys - its own first index with all near its second. A left and
    a right key of two fingerprints meet whenever both segments differ in one bit at most. A word
    that lies three bits from its codeword has six indices, any other one.
    """

    def run(batches):
        code = Golay()
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for lo in range(0, len(x), 8192):
                part = x[lo : lo + 8192]
                words = [(part >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int32) for a, n in SEGMENTS]
                own, near = [code.decode(w) for w in words], [code.keys(w) for w in words]
                key, side, row = [], [], []
                for p, (a, b) in enumerate(PAIRS):
                    for s, many, base in ((0, near[a], p << 24 | own[b].astype(np.int64)), (1, near[b], p << 24 | own[a].astype(np.int64) << 12)):
                        r, c = np.nonzero(many >= 0)
                        index = many[r, c].astype(np.int64)
                        key.append(base[r] | (index << 12 if s == 0 else index))
                        side.append(np.full(len(r), s, np.int8))
                        row.append(r)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(np.concatenate(side)), pa.array(part[np.concatenate(row)].view(np.int64))], names=["key", "side", "simhash"])

    return prints.select("simhash").mapInArrow(run, "key long, side byte, simhash long")


def _close(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(u.view(np.uint64) ^ v.view(np.uint64)) <= BITS_APART) & (u != v)


def link_forest(keys: DataFrame) -> DataFrame:
    """Links (u, v) that join what the verified pairs join: a spanning star of each batch of buckets.

    Large buckets are cut into tiles, so no task gets a whole one.
    """
    def run(batches):
        for table, head in runs(batches, 3):
            yield from within(table, head)

    def within(table, head):
        side, x = table.column("side").to_numpy(), table.column("simhash").to_numpy()
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(x))))
        n_left = np.bincount(group, side == 0, len(head)).astype(np.int64)
        n_right = np.bincount(group, side == 1, len(head)).astype(np.int64)
        both = np.flatnonzero(n_left * n_right > 0)
        us, vs, held = [], [], 0
        # side is part of the order: a bucket's left rows stand before its right ones
        pairs = np.cumsum(n_left[both] * n_right[both])
        lo = 0
        while lo < len(both):
            done = pairs[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(pairs, done + (1 << 20), side="right")))
            g = both[lo:hi]
            lo = hi
            l, r = n_left[g], n_right[g]
            # every left row of these buckets, repeated for each right row of its bucket
            of = np.repeat(np.arange(len(g)), l)
            left = head[g][of] + np.arange(len(of)) - np.repeat(np.cumsum(l) - l, l)
            times = r[of]
            a = np.repeat(left, times)
            b = np.repeat((head[g] + l)[of], times) + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
            u, v = x[a], x[b]
            near = _close(u, v)
            if near.any():
                u, v = forest(u[near], v[near])
                us.append(u)
                vs.append(v)
                held += len(u)
        if held:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    dealt = deal(keys, ["key"], "simhash", TILE).select("key", "i", "j", "side", "simhash")
    return dealt.mapInArrow(run, "u long, v long")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, simhash long, component_id) for every row: groups of fingerprints linked at three bits or fewer.

    component_id is the smallest id of the group, itself included; a null id is never the smallest
    (null if the whole group has null ids). Equal texts are compared once, as one fingerprint. Null,
    empty and blank texts have fingerprint 0 and link like any other. Repeated rows stay; other
    columns are not read; an empty table gives an empty table.
    """
    prints = materialize(fingerprints(df, text_col, [id_col]), "simhash")
    classes = materialize(prints.groupBy("simhash").agg(F.min(id_col).alias("least")), "classes")
    keys = materialize(golay_keys(classes), "golay")
    nodes = connected_components(link_forest(keys))
    linked = classes.join(nodes, classes["simhash"] == nodes["node"], "left").select("simhash", "least", F.coalesce("component", "simhash").alias("component"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "component").select(F.col("simhash").alias("__simhash"), "component_id")
    return prints.join(named, prints["simhash"] == named["__simhash"]).select(id_col, "simhash", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of ``simhash_groups``: the smallest id, a null id only where the whole group has null ids.

    Of rows that repeat that id one stays. All columns stay; an empty table gives an empty one.
    """
    stored = materialize(fingerprints(df.withColumn("__row", F.monotonically_increasing_id()), text_col, out="__print"), "simhash")
    prints = stored.select(F.col("__print").alias("simhash")).distinct()
    nodes = connected_components(link_forest(materialize(golay_keys(prints), "golay")))
    first = F.min(F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), F.col("__row").alias("row"))).alias("first")
    classes = stored.groupBy(F.col("__print").alias("simhash")).agg(first)
    groups = classes.join(nodes, classes["simhash"] == nodes["node"], "left").groupBy(F.coalesce("component", "simhash")).agg(F.min("first").alias("first"))
    return stored.join(groups.select(F.col("first.row").alias("__row")), "__row", "left_semi").select(df.columns)


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of texts linked by a Jaccard similarity of five-word shingles of 0.8 or more.

    Fingerprints of the shingle sets are linked through the Golay keys, which finds the nearest texts
    cheaply; each such link counts only if the shingles themselves are similar enough. Similar texts
    whose fingerprints lie more than three bits apart are found by a prefix-filtered join of what is
    not linked yet, which loses no pair (``shingle_join``).

    The row of the smallest id stays, one of a null id only where the whole group has null ids; ids may
    repeat. Texts of equal words are compared once; null, empty and blank ones are one group. All columns
    stay; an empty table gives an empty table.
    """
    join = shingle_join
    stored = materialize(join.keyed(df, text_col, lambda g: majority(g) if len(g) else 0), "keyed")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("__row"))
    leaders = materialize(stored.groupBy("__key").agg(F.min(order).alias("first"), F.min("__print").alias("simhash")).select(F.col("__key").alias("key"), F.col("first.__row").alias("row"), "first", "simhash"), "leaders")

    def rows_of(keys):
        """One row of each text that is asked for by its key."""
        return leaders.join(keys.distinct(), "key", "left_semi").select("row")

    def links(pairs):
        pairs = materialize(pairs, "pairs")
        nodes = pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key")))
        found = materialize(join.verified(pairs, join.of_rows(stored, rows_of(nodes), np.ndarray.tobytes, "grams", text_col)), "links")
        discard(pairs)
        return found

    # texts whose fingerprints link, as stars: of equal fingerprints to their least key, of linked ones between least keys
    prints = materialize(leaders.filter("key <> 0").groupBy("simhash").agg(F.min("key").alias("head")), "prints")
    equal = leaders.join(prints, "simhash").filter("key <> head AND key <> 0").select(F.col("head").alias("u"), F.col("key").alias("v"))
    keys = materialize(golay_keys(prints), "golay")
    forest = link_forest(keys)
    linked = forest.join(prints.select(F.col("simhash").alias("u"), F.col("head").alias("x")), "u").join(prints.select(F.col("simhash").alias("v"), F.col("head").alias("y")), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    stars = materialize(equal.union(linked), "stars")
    discard(keys)
    let_go(df.sparkSession)
    shared = materialize(join.shared_postings(join.postings(stored, join.commonness(stored, text_col), text_col)), "shared")
    let_go(df.sparkSession)
    near = links(join.neighbours(shared).union(stars).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    let_go(df.sparkSession)
    # what a few comparisons of each text link is not compared again; the rest is, in full
    open_ = join.unsettled(shared, connected_components(near))
    discard(shared)
    sketches = join.of_rows(stored, rows_of(open_.select("key")), join.parity, "sketch", text_col).dropDuplicates(["key"])
    rest = links(join.candidates(open_.join(sketches, "key")))
    discard(open_)
    whole = connected_components(near.union(rest))
    grouped = leaders.join(whole, leaders["key"] == whole["node"], "left").groupBy(F.coalesce("component", "key").alias("component")).agg(F.min("first").alias("first"))
    keep = materialize(grouped.select(F.col("first.__row").alias("__row")), "keep")
    gone = materialize(stored.select("__row").join(keep, "__row", "left_anti"), "gone")
    if gone.count() <= FEW:
        # few rows go, so they go to the rows and these stay where they are
        return stored.join(F.broadcast(gone), "__row", "left_anti").select(df.columns)
    return stored.join(keep, "__row", "left_semi").select(df.columns)
