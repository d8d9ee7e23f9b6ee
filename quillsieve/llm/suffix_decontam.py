"""Benchmark decontamination with suffix arrays of the training text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import BLOCK_BYTES, blocks, extend, field, text_bytes, with_columns

#: Bytes of benchmark text in one block, which is sought as a whole; a worker holds this many blocks and reads others as it needs them.
BENCHMARK_BYTES, HELD = 2 << 20, 8
#: Blocks that one pass over the documents seeks (256 MB of text at most); more blocks mean more passes.
BLOCKS = 128
#: Leading words by which a training suffix is admitted: no shorter match is ever reported.
ANCHOR = 3

_bytes = np.arange(256)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
WORD = (_bytes >= 128) | ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122))
VALUE = np.where(WORD, np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64), 0).astype(np.uint64)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first and last byte (exclusive) of every word, and each row's first word index (with the total)."""
    low = LOWER[data]
    word = WORD[low]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = word[inner]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), start, start, np.zeros(len(bounds), np.int64)
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    stop[inner - 1] = word[inner - 1]
    end = np.flatnonzero(stop) + 1
    # What stands before the first word is dropped; separators count nothing.
    offset = np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    power = np.cumprod(np.full(int((end - start).max()), MULTIPLIER))
    value = VALUE[low[start[0] :]]
    value *= power[np.minimum(offset, len(power) - 1)]
    hashed = np.add.reduceat(value, start - start[0])
    return hashed ^ (hashed >> np.uint64(29)), start, end, np.searchsorted(start, bounds)


class TestSuffixes:
    """Suffixes of a block of benchmark items, numbered words and admitted anchors; a few bytes for each word."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        where: dict[bytes, list] = {}
        spelled: dict[int, bytes] = {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            got, start, end, _ = tokens(raw, np.array([0, len(raw)]))
            low = LOWER[raw].tobytes()
            for h, a, b in zip(got.tolist(), start.tolist(), end.tolist()):
                if spelled.setdefault(h, low[a:b]) != low[a:b]:
                    raise RuntimeError(f"{low[a:b]!r} and {spelled[h]!r} share a hash")
            if len(got):
                where.setdefault(got.tobytes(), []).append(item)
        self.owners = [sorted({str(x) for x in ids if x is not None}) for ids in where.values()]
        words = [np.frombuffer(k, np.uint64) for k in where]
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(flat)
        #: the bytes of each numbered word, by which hits are verified
        self.spelled = [b""] + [spelled[h] for h in self.vocabulary.tolist()]
        #: words that one whole number holds side by side, and bits of each
        self.side, self.bits = (3, 21) if len(self.vocabulary) < (1 << 21) - 1 else (2, 31)
        number = np.searchsorted(self.vocabulary, flat) + 1
        size = np.array([len(w) for w in words], np.int64)
        self.item = np.repeat(np.arange(len(words)), size)
        last = np.repeat(np.cumsum(size), size)
        at = np.arange(len(flat))
        self.need = np.minimum(window, size)[self.item] if len(words) else np.zeros(0, np.int64)
        keep = last - at >= self.need
        self.at, self.left, self.item, self.need = at[keep], (last - at)[keep], self.item[keep], self.need[keep]
        self.anchor = int(min(ANCHOR, self.side, self.need.min())) if len(self.at) else 1
        self.words = np.concatenate([number, np.zeros(window + ANCHOR, np.int64)])
        self.anchors = np.unique(pack(self.words, self.at, self.anchor, self.bits))


def pack(words: np.ndarray, at: np.ndarray, n: int, bits: int) -> np.ndarray:
    key = words[at]
    for k in range(1, n):
        key = (key << bits) | words[at + k]
    return key


def suffix_array(words: np.ndarray, live: np.ndarray, depth: int, side: int, bits: int) -> np.ndarray:
    """``live`` positions sorted by their next ``depth`` words; ``words`` is padded with zeros.

    Groups that share a prefix are split by ``side`` more words at a time until they are single.
    """
    order = live
    rank = np.zeros(len(live), np.int64)
    active = np.arange(len(live))
    for d in range(0, depth, side):
        if not len(active):
            break
        key = pack(words, np.minimum(order[active] + d, len(words) - 4), side, bits)
        by = np.lexsort((key, rank[active]))
        order[active] = order[active][by]
        key, group = key[by], rank[active][by]
        new = np.ones(len(active), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        head = np.flatnonzero(new)
        rank[active] = active[head][np.cumsum(new) - 1]
        length = np.diff(np.append(head, len(active)))
        # A suffix that has met the end of its text or a foreign word can match nothing beyond it.
        active = active[np.repeat(length > 1, length) & (key & ((1 << bits) - 1) != 0)]
    return order


def search(words: np.ndarray, order: np.ndarray, test: TestSuffixes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By depth, the test suffixes that match so many words and their intervals of the suffix array."""
    who = np.arange(len(test.at))
    low, high = np.zeros(len(who), np.int64), np.full(len(who), len(order), np.int64)
    depth = 0
    while len(who):
        want = test.words[test.at[who] + depth]
        bounds = []
        for side in (0, 1):
            a, b = low.copy(), high.copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                seen = words[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, len(words) - 1)]
                right = open_ & ((seen < want) if side == 0 else (seen <= want))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            bounds.append(a)
        depth += 1
        keep = bounds[0] < bounds[1]
        who, low, high = who[keep], bounds[0][keep], bounds[1][keep]
        if len(who):
            yield depth, who, low, high
        more = test.left[who] > depth
        who, low, high = who[more], low[more], high[more]


class Shard:
    """The numbered words of a block of documents; each is hashed once and then sought in every block of the benchmark."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.low = LOWER[data].tobytes()
        self.hashed, self.start, self.end, self.first = tokens(data, bounds)
        self.rows = len(bounds) - 1
        self.n_words = np.diff(self.first)
        # one zero after each row keeps matches inside rows
        self.slot = np.arange(len(self.hashed)) + np.repeat(np.arange(self.rows), self.n_words)
        self.row_slot = self.first[:-1] + np.arange(self.rows)

    def hits(self, test: TestSuffixes) -> tuple[np.ndarray, list[set[int]], np.ndarray, np.ndarray]:
        """Hit flags by word, items by row, longest match that holds a window and its first word by row.

        Words are compared by hashes; those of the hits are then compared byte by byte, and where one
        differs the shard is sought anew without it.
        """
        rows = self.rows
        if not len(self.hashed) or not len(test.at):
            return np.zeros(len(self.hashed), bool), [set() for _ in range(rows)], np.zeros(rows, np.int64), np.full(rows, -1, np.int64)
        words = np.zeros(len(self.hashed) + rows + 8, np.int64)
        near = np.minimum(np.searchsorted(test.vocabulary, self.hashed), len(test.vocabulary) - 1)
        words[self.slot] = np.where(test.vocabulary[near] == self.hashed, near + 1, 0)
        while True:
            found = self._sought(words, test)
            spot = np.flatnonzero(found[0])
            named = words[self.slot[spot]].tolist()
            other = [k for k, w, a, b in zip(spot.tolist(), named, self.start[spot].tolist(), self.end[spot].tolist()) if self.low[a:b] != test.spelled[w]]
            if not other:
                return found
            words[self.slot[other]] = 0

    def _sought(self, words: np.ndarray, test: TestSuffixes):
        rows = self.rows
        items: list[set[int]] = [set() for _ in range(rows)]
        longest, place = np.zeros(rows, np.int64), np.full(rows, -1, np.int64)
        hit = np.zeros(len(words) + 1, np.int64)
        live = np.flatnonzero(words[:-8])
        key = pack(words, live, test.anchor, test.bits)
        live = live[test.anchors[np.minimum(np.searchsorted(test.anchors, key), len(test.anchors) - 1)] == key]
        if len(live):
            order = suffix_array(words, live, int(test.left.max()), test.side, test.bits)
            match = np.zeros(len(order), np.int64)
            for depth, who, low, high in search(words, order, test):
                enough = depth >= test.need[who]
                cover = np.zeros(len(order) + 1, np.int64)
                np.add.at(cover, low[enough], 1)
                np.add.at(cover, high[enough], -1)
                match[np.cumsum(cover[:-1]) > 0] = depth
                whole = test.need[who] == depth
                if whole.any():
                    low, high, owner = low[whole], high[whole], test.item[who[whole]]
                    size = high - low
                    at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                    begin = order[at]
                    np.add.at(hit, begin, 1)
                    np.add.at(hit, begin + depth, -1)
                    row = np.searchsorted(self.row_slot, begin, side="right") - 1
                    for pair in np.unique(row * len(test.owners) + np.repeat(owner, size)).tolist():
                        items[pair // len(test.owners)].add(pair % len(test.owners))
            row = np.searchsorted(self.row_slot, order, side="right") - 1
            np.maximum.at(longest, row, match)
            best = np.flatnonzero((match == longest[row]) & (match > 0))
            far = np.full(rows, np.iinfo(np.int64).max)
            np.minimum.at(far, row[best], order[best])
            place = np.where(longest > 0, far - self.row_slot, -1)
        return np.cumsum(hit)[self.slot] > 0, items, longest, place


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """The items in lists of about ``limit`` bytes each, read one list at a time; their sizes are counted first."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // limit))
    for part in range(parts):
        yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()]


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """Each document's words, words inside occurrences of benchmark windows, items and longest verbatim match.

    Every Arrow block of documents is a shard: its words are hashed once and numbered by each block of
    the benchmark; it gets a suffix array over them, and all suffixes of the items that begin a window
    are sought in it by binary search, word by word. The suffix array holds the suffixes that begin with
    an ``ANCHOR``-gram of the benchmark (fewer words where an item is shorter): no other suffix can match
    a window. Words are compared by 64-bit hashes and those of the hits byte by byte. The benchmark goes
    to the executors in blocks of a counted size, ``BLOCKS`` of them for each map-only pass; the driver
    holds one block at a time, and documents never shuffle.

    Returns the kept columns (default: the id) with n_words, n_hit (long), items (sorted distinct
    ids as strings), longest (words of the longest match that holds a window, 0: none) and
    longest_at (its first word, the first of several, -1: none). Null and empty texts have no words. An
    item without words has no window; null item ids are left out of ``items`` yet their hits count;
    repeated items and repeated documents count as what they are. An empty benchmark hits nothing, empty
    documents give no rows. Kept columns named as a result are replaced; others are not read.
    """
    keep = [id_col] if keep is None else list(keep)
    fields = [field("n_words", "long"), field("n_hit", "long"), field("items", "array<string>"), field("longest", "long"), field("longest_at", "long")]
    context = documents.sparkSession.sparkContext
    # one block at a time is on the driver; what it has sent lies in files
    tests = [context.broadcast(TestSuffixes(items, window)) for items in benchmark_blocks(benchmark, item_col, item_text_col, benchmark_bytes)]
    passes = [tests[k : k + BLOCKS] for k in range(0, len(tests), BLOCKS)] or [[]]
    out, before = documents, ()
    for part in passes:
        final = part is passes[-1]
        names = list(dict.fromkeys([*keep, text_col])) if not final else keep
        source = out.select(list(dict.fromkeys([*keep, text_col])) + list(before))
        news = [*fields, *([] if final else [field("__hits", "array<long>")])]
        out = source.mapInArrow(_seeker(part, text_col, names, bool(before), final), extend(source, names, news))
        before = ("items", "longest", "longest_at", "__hits")
    return out


def _seeker(tests, text_col: str, names: list[str], before: bool, final: bool):
    """One pass: every block of documents is hashed once and sought in all blocks of the benchmark."""

    def run(batches):
        for batch in blocks(batches, text_col, BLOCK_BYTES):
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            shard = Shard(*text_bytes(column(text_col)))
            first, rows = shard.first, shard.rows
            hit, owners = np.zeros(len(shard.hashed), bool), [set() for _ in range(rows)]
            longest, place = np.zeros(rows, np.int64), np.full(rows, -1, np.int64)
            if before:
                longest, place = column("longest").to_numpy().copy(), column("longest_at").to_numpy().copy()
                for row, known in enumerate(column("items").to_pylist()):
                    owners[row].update(known)
                spots = column("__hits")
                of = np.repeat(np.arange(rows), np.diff(spots.offsets.to_numpy()))
                hit[first[of] + spots.flatten().to_numpy()] = True
            for k, shared in enumerate(tests):
                test = shared.value
                more, found, far, at = shard.hits(test)
                hit |= more
                for row, some in enumerate(found):
                    for i in some:
                        owners[row].update(test.owners[i])
                place = np.where(far > longest, at, np.where((far == longest) & (far > 0), np.minimum(place, at), place))
                longest = np.maximum(longest, far)
                if k >= HELD:
                    # read again for the next block of documents, so that memory stays bounded
                    del shared._value
            total = np.concatenate([[0], np.cumsum(hit)])
            new = {"n_words": pa.array(shard.n_words, pa.int64()), "n_hit": pa.array(total[first[1:]] - total[first[:-1]], pa.int64()), "items": pa.array([sorted(x) for x in owners], pa.list_(pa.string())), "longest": pa.array(longest, pa.int64()), "longest_at": pa.array(place, pa.int64())}
            if not final:
                spot = np.flatnonzero(hit)
                row = np.searchsorted(first, spot, side="right") - 1
                new["__hits"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(spot, first), pa.int32()), pa.array(spot - first[row], pa.int64()))
            yield with_columns(batch, names, new)

    return run


def contamination_report(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``find_contamination`` with n_items, items_sha256 and contaminated in place of the item lists."""
    found = find_contamination(documents, benchmark, **options)
    return found.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": F.col("n_hit") > 0}).drop("items")


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents no word of which lies in an occurrence of a benchmark window; all columns stay.

    Null and empty texts stay, as do repeated rows; an empty table gives an empty one.
    """
    columns = documents.columns
    found = find_contamination(documents, benchmark, keep=columns, **options)
    return found.filter("n_hit = 0").select(columns)
