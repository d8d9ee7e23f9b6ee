"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding."""

from __future__ import annotations

import math
from dataclasses import dataclass, field as member

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quillsieve.llm.common import blocks, extend, field, text_bytes, with_columns

SPACE = 0x2581
#: Text of one block; its lattices take about two hundred bytes for each byte.
LATTICE_BYTES = 1 << 20
#: Characters below this have their pairs in a dense table.
NEAR = 0x250
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
SAMPLES = "array<struct<ids:binary,n_pieces:int,logprob:double,perturbed:double,log_inclusion:double>>"


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit counters."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@dataclass
class Pieces:
    """A piece vocabulary with its trie as a hash table; its size is the vocabulary's."""

    texts: list[str]
    logp: np.ndarray
    byte_ids: np.ndarray
    chars: np.ndarray = member(init=False)

    def __post_init__(self):
        normal = [(i, t) for i, t in enumerate(self.texts) if t and self.logp[i] > -math.inf]
        self.chars = np.array(sorted({ord(c) for _, t in normal for c in t}), np.uint32)
        number = {int(c): k + 1 for k, c in enumerate(self.chars)}
        self.near = int(np.searchsorted(self.chars, NEAR)) + 1
        self.low = np.zeros(0x3000, np.int32)
        for c, k in number.items():
            if c < len(self.low):
                self.low[c] = k
        trie: dict[tuple[int, int], int] = {}
        piece = [-1]
        pairs = set()
        for i, t in normal:
            at = 0
            for c in t:
                key = (at, number[ord(c)])
                if key not in trie:
                    trie[key] = len(piece)
                    piece.append(-1)
                at = trie[key]
            piece[at] = i
            pairs |= {(number[ord(a)], number[ord(b)]) for a, b in zip(t, t[1:])}
        self.piece = np.array(piece, np.int32)
        self.shift = len(self.chars).bit_length()
        size = 1 << max(4, (8 * len(trie)).bit_length() - 1)
        self.slots = np.full(size, -1, np.int64)
        self.to = np.zeros(size, np.int32)
        self.bits = size.bit_length() - 1
        keys = np.array([a << self.shift | c for a, c in trie], np.int64)
        for key, slot, to in zip(keys.tolist(), self._slot(keys).tolist(), trie.values()):
            while self.slots[slot] >= 0:
                slot = (slot + 1) % size
            self.slots[slot], self.to[slot] = key, to
        self.pair_keys = np.array(sorted(a << 32 | b for a, b in pairs), np.int64)
        self.pair_table = np.zeros((self.near, self.near), bool)
        for a, b in pairs:
            if a < self.near and b < self.near:
                self.pair_table[a, b] = True
        self.longest = max((len(t) for _, t in normal), default=1)
        joined = [b"" if self.logp[i] == -math.inf and i not in set(self.byte_ids.tolist()) else t.replace("▁", " ").encode() for i, t in enumerate(self.texts)]
        for value, i in enumerate(self.byte_ids.tolist()):
            if i >= 0:
                joined[i] = bytes([value])
        self.raw = joined

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def child(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next trie states, 0 for none."""
        key = state.astype(np.int64) << self.shift | char
        slot = self._slot(key)
        got = self.slots[slot]
        out = np.where(got == key, self.to[slot], 0)
        todo = np.flatnonzero((got != key) & (got >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) % len(self.slots)
            got = self.slots[slot[todo]]
            found = got == key[todo]
            out[todo[found]] = self.to[slot[todo[found]]]
            todo = todo[~found & (got >= 0)]
        return out

    def number(self, points: np.ndarray) -> np.ndarray:
        out = self.low[np.minimum(points, len(self.low) - 1)]
        far = np.flatnonzero(points >= len(self.low))
        if len(far):
            at = np.minimum(np.searchsorted(self.chars, points[far]), len(self.chars) - 1)
            out[far] = np.where(self.chars[at] == points[far], at + 1, 0)
        return out

    def together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether some piece has the two characters side by side; elsewhere every segmentation is cut."""
        out = self.pair_table[np.where(a < self.near, a, 0), np.where(b < self.near, b, 0)]
        far = np.flatnonzero(((a >= self.near) | (b >= self.near)) & (a > 0) & (b > 0))
        if len(far):
            key = a[far].astype(np.int64) << 32 | b[far]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            out[far] = self.pair_keys[at] == key
        return out


def load_pieces(model_file: str, alpha: float = 1.0) -> Pieces:
    """Reads a SentencePiece model on the driver.

    The lattice weighs a piece by alpha times its log-probability: the score of a unigram model; for
    a model of merge ranks (scores 0, -1, -2, ...) that of Zipf's law over the ranks.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    texts = [sp.id_to_piece(i) for i in range(n)]
    score = np.array([sp.get_score(i) for i in range(n)])
    odd = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)])
    if np.array_equal(score, np.round(score)):
        rank = np.cumsum(~odd)
        score = -np.log(np.maximum(rank, 1)) - math.log((1 / np.arange(1, max(2, rank[-1] + 1))).sum())
    logp = np.where(odd, -math.inf, alpha * score)
    byte_ids = np.full(256, -1, np.int32)
    for i in np.flatnonzero([sp.is_byte(i) for i in range(n)]):
        byte_ids[int(texts[i][3:5], 16)] = i
    if (byte_ids < 0).any():
        byte_ids[:] = sp.unk_id()
    return Pieces(texts, logp, byte_ids)


def id_type(pieces: Pieces) -> np.dtype:
    """Ids are packed little-endian, in two bytes where the vocabulary allows."""
    return np.dtype("<u2" if len(pieces.texts) <= 1 << 16 else "<u4")


class Lattices:
    """Lattices of distinct atoms: for each node its edges, their conditional log-probabilities and running sums."""

    def __init__(self, pieces: Pieces, chars: np.ndarray, points: np.ndarray, start: np.ndarray, size: np.ndarray):
        room = size + 1
        self.first = np.cumsum(room) - room
        nodes = int(room.sum())
        lane = np.repeat(self.first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        left = np.repeat(size, size) - (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        self.char = np.zeros(nodes, np.uint32)
        self.char[lane] = points[at]
        # A step gives a node one edge at most; ``rank`` is the edge's place among its node's, shortest first.
        from_, to, piece, rank = [], [], [], []
        count = np.zeros(nodes + 1, np.int32)

        def add(source, target, which):
            from_.append(source.astype(np.int32))
            to.append(target.astype(np.int32))
            piece.append(which)
            rank.append(count[source])
            count[source] += 1

        node, place, room_, state = lane, at, left, np.zeros(len(lane), np.int32)
        for step in range(pieces.longest):
            state = pieces.child(state, chars[place + step])
            live = np.flatnonzero(state)
            got = pieces.piece[state[live]]
            if step == 0:
                # a character that is no piece is spelt in bytes
                lone = np.ones(len(node), bool)
                lone[live] = got < 0
                lone = node[lone]
                add(lone, lone + 1, np.full(len(lone), -1, np.int32))
            full = node[live[got >= 0]]
            add(full, full + step + 1, got[got >= 0])
            live = live[room_[live] > step + 1]
            if not len(live):
                break
            node, place, room_, state = node[live], place[live], room_[live], state[live]
        self.edge = np.concatenate([[0], np.cumsum(count[:-1])])
        edges = int(self.edge[-1])
        # a node's longest piece comes first: mostly the likeliest, so a draw rarely looks further
        slot = np.concatenate([self.edge[f + 1] - 1 - r for f, r in zip(from_, rank)])
        self.to, self.piece = np.empty(edges, np.int32), np.empty(edges, np.int32)
        self.to[slot], self.piece[slot] = np.concatenate(to), np.concatenate(piece)
        del from_, to, piece, rank, slot
        self.logp = np.where(self.piece >= 0, pieces.logp[self.piece], -20.0)
        # behind: log mass of all paths from a node to its atom's end, from the last nodes backwards
        behind = np.zeros(nodes)
        by = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left, kind="stable")
        groups = np.searchsorted(left[by], np.arange(1, (int(left.max()) if len(left) else 0) + 2))
        order = lane[by]
        for a, b in zip(groups[:-1].tolist(), groups[1:].tolist()):
            some = order[a:b]
            n = count[some]
            head = np.cumsum(n) - n
            e = np.repeat(self.edge[some] - head, n) + np.arange(int(n.sum()))
            value = self.logp[e] + behind[self.to[e]]
            top = np.maximum.reduceat(value, head)
            behind[some] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n)), head))
            self.logp[e] = value - np.repeat(behind[some], n)
        run = np.cumsum(np.exp(self.logp))
        self.upto = run - np.repeat(np.concatenate([[0.0], run])[self.edge[:-1]], count[:-1])
        # rounding must not leave a gap at a node's last edge
        self.upto[self.edge[1:][count[:-1] > 0] - 1] = 2.0
        self.last = self.first + size


@dataclass
class Draw:
    """One segmentation of every atom of a block: its log-probability, and its edges in a flat array."""

    logp: np.ndarray
    offset: np.ndarray
    edges: np.ndarray


def draw(lattice: Lattices, atom: np.ndarray, counter: np.ndarray) -> Draw:
    """Ancestral samples of the atoms' segmentations; ``counter`` seeds each one."""
    node, end = lattice.first[atom], lattice.last[atom]
    logp, length = np.zeros(len(atom)), np.zeros(len(atom), np.int64)
    lanes, steps = np.arange(len(atom)), []
    at, stop, seed = node, end, counter
    k = 0
    while len(lanes):
        edge = lattice.edge[at]
        many = lattice.edge[at + 1] - edge > 1
        pick = np.flatnonzero(many)
        if len(pick):
            u = uniform(seed[pick] + np.uint64(k))
            e = edge[pick]
            more = np.flatnonzero(u > lattice.upto[e])
            while len(more):
                e[more] += 1
                more = more[u[more] > lattice.upto[e[more]]]
            edge[pick] = e
        logp[lanes] += lattice.logp[edge]
        steps.append((lanes, edge))
        at = lattice.to[edge]
        go = at < stop
        length[lanes] += 1
        lanes, at, stop, seed = lanes[go], at[go], stop[go], seed[go]
        k += 1
    offset = np.concatenate([[0], np.cumsum(length)])
    edges = np.empty(int(offset[-1]), np.int32)
    for k, (which, e) in enumerate(steps):
        edges[offset[which] + k] = e
    return Draw(logp, offset, edges)


def other_path(lattice: Lattices, atom: int, taken: list[list[int]], u: np.ndarray) -> tuple[list[int], float]:
    """A segmentation of one atom that is none of ``taken``, drawn from the rest of the mass; its log-probability."""
    node, end = int(lattice.first[atom]), int(lattice.last[atom])
    rest = [(path, math.exp(sum(lattice.logp[e] for e in path))) for path in taken]
    out, logp, k = [], 0.0, 0
    while node < end:
        a, b = int(lattice.edge[node]), int(lattice.edge[node + 1])
        p = np.exp(lattice.logp[a:b])
        for path, mass in rest:
            p[path[k] - a] = max(0.0, p[path[k] - a] - mass)
        edge = a + int(min(np.searchsorted(np.cumsum(p), u[k] * p.sum()), b - a - 1))
        share = math.exp(lattice.logp[edge])
        rest = [(path, mass / share) for path, mass in rest if path[k] == edge]
        out.append(edge)
        logp += float(lattice.logp[edge])
        node, k = int(lattice.to[edge]), k + 1
    return out, logp


def _last_where(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of each row's segment (all rows have one) and its place."""
    top = np.maximum.reduceat(value, first)
    hit = np.flatnonzero(value == np.repeat(top, np.diff(np.append(first, len(value)))))
    row = np.searchsorted(first, hit, side="right") - 1
    place = np.empty(len(first), np.int64)
    place[row[::-1]] = hit[::-1]
    return top, place


def sample_block(pieces: Pieces, data: np.ndarray, bounds: np.ndarray, seeds: np.ndarray, k: int) -> list[list[tuple[bytes, int, float, float, float]]]:
    """Of each text up to ``k`` distinct segmentations: packed ids, their number, logprob, perturbed, log_inclusion.

    The search goes over sets of segmentations that share a prefix of atoms and avoid what was emitted
    at the next atom. A set's perturbed score is the maximum of the Gumbel variables in it, drawn when
    the set arises: a Gumbel at the log of its mass, cut off at the score of the set it came from. The
    best set is taken, its maximal segmentation drawn, and the sets that remain of it go back.
    """
    rows = len(bounds) - 1
    out: list[list] = [[] for _ in range(rows)]
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds[:-1][full]]
    points = np.insert(np.where(points == 32, np.uint32(SPACE), points), begin, SPACE)
    begin = begin + np.arange(len(full))
    chars = pieces.number(points)
    cut = np.ones(len(points), bool)
    cut[1:] = ~pieces.together(chars[:-1], chars[1:])
    cut[begin] = True
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, len(points)))
    # equal atoms share a lattice
    offset = np.arange(len(points)) - np.repeat(start, length)
    power = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15 | 1, np.uint64))
    hashed = mix(np.add.reduceat(mix(points.astype(np.uint64) + np.uint64(1)) * power[offset], start))
    _, sample, atom = np.unique(hashed, return_index=True, return_inverse=True)
    lattice = Lattices(pieces, np.append(chars, np.zeros(pieces.longest, chars.dtype)), points, start[sample], length[sample])
    head = np.searchsorted(start, begin)
    number = np.diff(np.append(head, len(start)))
    row = np.repeat(np.arange(len(full)), number)
    base = mix(seeds[full])
    place = (start - begin[row]).astype(np.uint64) << np.uint64(8)
    # the expanded lattice of one atom never needs 256 counters unless it is that long; then they run on
    draws: list[Draw] = []
    pools: list[tuple[np.ndarray, np.ndarray]] = []
    score = -np.log(-np.log(uniform(base + np.uint64(0xA5))))
    open_ = np.ones(len(full), bool)
    emitted: list[tuple] = []
    # of the newest draw: whose atoms it shares up to where, and what is barred there
    source = np.full(len(full), -1)
    since = np.zeros(len(full), np.int64)
    barred: list[dict[int, list[list[int]]]] = []
    taken: list[tuple[int, int]] = []
    dtype = id_type(pieces)
    finals: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(k + 1):
        if s:
            tops, places = zip(*[_last_where(g, head) for g, _ in pools])
            source = np.argmax(tops, axis=0)
            score = np.max(tops, axis=0)
            since = np.array(places)[source, np.arange(len(full))]
            open_ = score > -math.inf
            emitted.append((score.copy(), open_.copy()))
            if s == k or not open_.any():
                break
            for g in range(len(pools)):
                at = since[open_ & (source == g)]
                pools[g][0][at] = -math.inf
        salt = base[row] + mix(np.uint64([s + 1]))[0]
        now = draw(lattice, atom, mix(salt ^ place))
        logp, counts, origin = now.logp.copy(), np.diff(now.offset), np.full(len(atom), s)
        start_at = now.offset[:-1].copy()
        extra: list[int] = []
        bars: dict[int, list[list[int]]] = {}
        if s:
            # before the atom where the set parts, as in the draw it came from
            old = np.arange(len(atom)) < since[row]
            for g in range(s):
                which = old & (source[row] == g)
                o, st, c, lp = finals[g]
                origin[which], start_at[which], counts[which], logp[which] = o[which], st[which], c[which], lp[which]
            own = base + mix(np.uint64([7919 * (s + 1)]))[0]
            for r in np.flatnonzero(open_).tolist():
                i, g = int(since[r]), int(source[r])
                known = barred[g].get(i)
                if known is None:
                    o, st, c, _ = finals[g]
                    known = [_edges(draws, o[i], st[i], c[i])]
                u = uniform(own[r] + np.arange(int(length[i]) + 1, dtype=np.uint64))
                path, lp = other_path(lattice, int(atom[i]), known, u)
                bars[i] = [*known, path]
                origin[i], start_at[i], counts[i], logp[i] = s, len(now.edges) + len(extra), len(path), lp
                extra += path
        now.edges = np.concatenate([now.edges, np.array(extra, np.int32)])
        draws.append(now)
        barred.append(bars)
        finals.append((origin, start_at, counts, logp))
        # the sets that part from this draw at each of its atoms, from where it is new
        through = np.cumsum(logp)
        before = through - logp - np.repeat((through - logp)[head], number)
        gone = np.exp(np.minimum(logp, 0.0))
        for i, paths in bars.items():
            gone[i] = sum(math.exp(sum(lattice.logp[e] for e in p)) for p in paths)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            where = before + np.log(np.maximum(0.0, np.where(gone < 1 - 1e-12, 1 - gone, 0.0)))
            cap = np.repeat(score, number)
            noise = -np.log(uniform(mix(salt + np.uint64(0x5DEECE66D)) ^ place))
            pool = np.where(np.isfinite(where), where - np.log(np.exp(np.minimum(where - cap, 700)) + noise), -math.inf)
        pool[np.arange(len(atom)) < np.repeat(since if s else head * 0 - 1, number)] = -math.inf
        pool[~open_[row]] = -math.inf
        pools.append((pool, open_.copy()))
        ids, bound = _ids(pieces, lattice, draws, origin, start_at, counts, head, dtype)
        whole = np.add.reduceat(logp, head)
        for r in np.flatnonzero(open_).tolist():
            taken.append((r, s))
            out[full[r]].append((ids[bound[r] * dtype.itemsize : bound[r + 1] * dtype.itemsize], int(bound[r + 1] - bound[r]), float(whole[r]), float(score[r])))
    # the best score that was not emitted is the threshold of inclusion
    left = np.max([_last_where(g, head)[0] for g, _ in pools], axis=0)
    for r, texts in zip(range(len(full)), (out[i] for i in full.tolist())):
        for n, (ids_, count, lp, g) in enumerate(texts):
            x = lp - left[r]
            chance = 0.0 if left[r] == -math.inf else (x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0)))))
            texts[n] = (ids_, count, lp, g, chance)
    return out


def _edges(draws: list[Draw], origin: int, start: int, count: int) -> list[int]:
    return draws[origin].edges[start : start + count].tolist()


def _ids(pieces, lattice, draws, origin, start, counts, head, dtype) -> tuple[bytes, np.ndarray]:
    """Packed piece ids of all rows and each row's bounds in them."""
    base = np.concatenate([[0], np.cumsum([len(d.edges) for d in draws])])
    edges = draws[0].edges if len(draws) == 1 else np.concatenate([d.edges for d in draws])
    n = int(counts.sum())
    ends = np.cumsum(counts)
    at = np.repeat(base[origin] + start - ends + counts, counts) + np.arange(n)
    chosen = edges[at]
    ids = lattice.piece[chosen]
    bound = np.append(np.concatenate([[0], ends])[head], n)
    lone = np.flatnonzero(ids < 0)
    if len(lone):
        spelt = [chr(int(c)).encode("utf-8", "replace") for c in lattice.char[lattice.to[chosen[lone]] - 1]]
        size = np.ones(n, np.int64)
        size[lone] = [len(b) for b in spelt]
        wide = np.repeat(ids, size)
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(spelt), np.uint8)
        span = size[lone]
        wide[np.repeat(first[lone] - np.cumsum(span) + span, span) + np.arange(len(flat))] = pieces.byte_ids[flat]
        bound = np.append(first, len(wide))[bound]
        ids = wide
    return ids.astype(dtype).tobytes(), bound


def sample_encodings(df: DataFrame, pieces: Pieces, k: int = 2, seed: int = 1, key_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, out: str = "samples", decodes: str | None = None) -> DataFrame:
    """Adds up to ``k`` distinct sampled segmentations of each whole text, best perturbed score first.

    Each has its ids (packed little-endian, see ``id_type``), n_pieces, logprob, the Gumbel-perturbed
    score by which it was found, and log_inclusion, the log of the chance to be among the first k given
    the next score. Samples depend on the seed, the key and the text alone; rows equal in both get equal
    samples; a null key is the key ''. Null and empty texts have no segmentation. A text with fewer than k
    segmentations gives those it has. The text is taken as it is, a blank before it and blanks written as
    U+2581, so a U+2581 of the text decodes to a blank. A column named as ``out`` is replaced. An empty
    table gives an empty one. ``decodes`` names a further column: whether each sample's ids, decoded, are
    the text (true where there is none).
    """
    keep = df.columns if keep is None else list(keep)
    source = df.select(list(dict.fromkeys([*keep, key_col, text_col])))
    kind = pa.list_(pa.struct([("ids", pa.binary()), ("n_pieces", pa.int32()), ("logprob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())]))
    names = [f.name for f in kind.value_type]

    def run(batches):
        for batch in blocks(batches, text_col, LATTICE_BYTES):
            data, bounds = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            keys = batch.column(batch.schema.get_field_index(key_col)).to_pylist()
            seeds = np.array([xxhash.xxh64_intdigest("" if x is None else str(x), seed) for x in keys], np.uint64)
            found = sample_block(pieces, data, bounds, seeds, k)
            flat = [x for row in found for x in row]
            count = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            columns = [pa.array([x[c] for x in flat], kind.value_type.field(c).type) for c in range(len(names))]
            listed = pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.StructArray.from_arrays(columns, names=names))
            new = {out: listed}
            if decodes:
                whole, raw = decode_all(pieces, [x[0] for x in flat]), data.tobytes()
                wanted = [raw[a:b].replace(b"\xe2\x96\x81", b" ") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                new[decodes] = pa.array([all(whole[i] == w for i in range(a, b)) for w, a, b in zip(wanted, count[:-1].tolist(), count[1:].tolist())])
            yield with_columns(batch, keep, new)

    return source.mapInArrow(run, extend(source, keep, [field(out, SAMPLES), *([field(decodes, "boolean")] if decodes else [])]))


def decode_all(pieces: Pieces, packed: list[bytes]) -> list[bytes]:
    """The UTF-8 bytes of many packed texts."""
    kind, piece = id_type(pieces), pieces.raw.__getitem__
    whole = [b"".join(map(piece, np.frombuffer(x, kind).tolist())) for x in packed]
    return [x[1:] if x[:1] == b" " else x for x in whole]


def decode_ids(pieces: Pieces, packed: bytes | None) -> str | None:
    """The text of packed ids: pieces joined, U+2581 as a blank, the first blank dropped."""
    if packed is None:
        return None
    raw = b"".join([pieces.raw[i] for i in np.frombuffer(packed, id_type(pieces)).tolist()])
    return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def decode(df: DataFrame, pieces: Pieces, ids_col: str = "ids", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the texts of packed ids; null ids give null, no ids the empty text.

    Repeated rows stay; a column named as ``out`` is replaced; an empty table gives an empty one.
    """
    keep = df.columns if keep is None else list(keep)
    source = df.select(list(dict.fromkeys([*keep, ids_col])))

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            yield with_columns(batch, keep, {out: pa.array([decode_ids(pieces, x) for x in ids], pa.string())})

    return source.mapInArrow(run, extend(source, keep, [field(out, "string")]))
