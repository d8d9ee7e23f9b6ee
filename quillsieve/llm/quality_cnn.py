"""Quality classifier: a byte-level convolutional network in numpy over all chunks of a document."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsieve.llm.common import blocks, extend, field, text_bytes, with_columns

WIDTH, FILTERS = 5, 16
#: A chunk is four cells long and the next one begins three cells later, so neighbours share a cell.
CELL, CHUNK_CELLS, HOP_CELLS = 64, 4, 3
STRIP = 1 << 13
#: The bounded sample of a fit: labelled rows at most, bytes of text among them, and bytes of one text; longer texts are scored but not learned from.
TRAIN_ROWS, TRAIN_BYTES, TRAIN_TEXT = 3000, 24 << 20, 3 << 19


@dataclass
class Network:
    """embed [WIDTH, 256, FILTERS] are the filters over one-hot bytes; out weighs mean and maximum of the chunks."""

    embed: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: float

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; texts of any length, empty ones are one chunk of padding."""
        cells, of = [], []
        for a, b in _slices(bounds):
            part, row = self._cells(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            cells.append(part)
            of.append(row + a)
        cells, of = np.concatenate(cells), np.concatenate(of)
        chunks, row, _ = _chunks(cells, of, len(bounds) - 1)
        return self._rows(np.maximum(chunks + self.bias, 0), row, len(bounds) - 1)[0]

    def _cells(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest responses in each cell of ``CELL`` positions, and each cell's row."""
        buffer, _, count = _padded(data, bounds)
        need = len(buffer) - WIDTH + 1
        got = np.empty((need // CELL, FILTERS), np.float32)
        # Two neighbouring bytes' terms are one row of a table of sums; STRIP positions stay in cache.
        pair = self.pairs()
        two = buffer[:-1].astype(np.intp) << 8 | buffer[1:]
        sums, more = np.empty((STRIP, FILTERS), np.float32), np.empty((STRIP, FILTERS), np.float32)
        for a in range(0, need, STRIP):
            b = min(need, a + STRIP)
            response, other = sums[: b - a], more[: b - a]
            np.take(pair[0], two[a:b], axis=0, out=response, mode="clip")
            for k in range(1, WIDTH // 2):
                response += np.take(pair[k], two[a + 2 * k : b + 2 * k], axis=0, out=other, mode="clip")
            response += np.take(self.embed[WIDTH - 1], buffer[a + WIDTH - 1 : b + WIDTH - 1], axis=0, out=other, mode="clip")
            np.max(response.reshape(-1, CELL, FILTERS), axis=1, out=got[a // CELL : b // CELL])
        return got, np.repeat(np.arange(len(count)), count)

    def pairs(self) -> list[np.ndarray]:
        if not hasattr(self, "_pairs"):
            self._pairs = [(self.embed[k][:, None] + self.embed[k + 1][None]).reshape(-1, FILTERS) for k in range(0, WIDTH - 1, 2)]
        return self._pairs

    def _rows(self, hidden: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.searchsorted(row, np.arange(rows))
        number = np.diff(np.append(first, len(row)))
        mean = np.add.reduceat(hidden, first, axis=0) / number[:, None]
        top = np.maximum.reduceat(hidden, first, axis=0)
        features = np.concatenate([mean, top], 1)
        return 1 / (1 + np.exp(-(features @ self.out + self.base))), features, number


def _slices(bounds: np.ndarray, limit: int = 1 << 19):
    a, rows = 0, len(bounds) - 1
    while a < rows:
        b = min(rows, max(a + 1, int(np.searchsorted(bounds, bounds[a] + limit, side="right")) - 1), a + 4096)
        yield a, b
        a = b


def _padded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows laid out in whole cells of zero-padded bytes, each after WIDTH - 1 zeros.

    So the windows at a row's end see zeros and never the next row, and a row's responses do not
    depend on its neighbours.
    """
    size = np.diff(bounds)
    count = (size + WIDTH - 1 + CELL - 1) // CELL
    start = (np.cumsum(count) - count) * CELL
    buffer = np.zeros(int(count.sum()) * CELL + WIDTH - 1, np.uint8)
    buffer[np.arange(len(data)) + np.repeat(start + WIDTH - 1 - bounds[:-1], size)] = data
    return buffer, start, count


def _chunks(cells: np.ndarray, of: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maxima over the overlapping chunks of each row's cells, their rows and first cells."""
    first = np.searchsorted(of, np.arange(rows))
    count = np.diff(np.append(first, len(of)))
    number = 1 + np.maximum(0, -(-(count - CHUNK_CELLS) // HOP_CELLS))
    row = np.repeat(np.arange(rows), number)
    begin = first[row] + HOP_CELLS * (np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number))
    last = (first + count - 1)[row]
    got = cells[begin]
    for k in range(1, CHUNK_CELLS):
        got = np.maximum(got, cells[np.minimum(begin + k, last)])
    return got, row, begin


def fit(texts: list[bytes], labels: np.ndarray, updates: int = 320, seed: int = 7, rate: float = 0.01, batch: int = 48) -> Network:
    """Learns filters and weights by Adam on the log loss; without both labels the network is constant."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float64)
    net = Network(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        net.base = float(np.log(share / (1 - share)))
        return net
    params = {"embed": net.embed, "bias": net.bias, "out": net.out, "base": np.array([0.0])}
    first = {k: np.zeros_like(v, np.float64 if v.dtype == np.float64 else np.float32) for k, v in params.items()}
    second = {k: v.copy() for k, v in first.items()}
    epochs = max(1, -(-updates * batch // len(texts)))
    step, total = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            step += 1
            grads = _gradients(net, [texts[i] for i in pick], labels[pick])
            now = rate * (1 - 0.9 * step / total)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(params[k].dtype)
            net.base = float(params["base"][0])
    return net


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    buffer, _, count = _padded(data, bounds)
    need, rows = len(buffer) - WIDTH + 1, len(texts)
    cells, where = np.empty((need // CELL, FILTERS), np.float32), np.empty((need // CELL, FILTERS), np.int64)
    for a in range(0, need, 1 << 16):
        b = min(need, a + (1 << 16))
        response = net.embed[0][buffer[a:b]]
        for k in range(1, WIDTH):
            response += net.embed[k][buffer[a + k : b + k]]
        response = response.reshape(-1, CELL, FILTERS)
        arg = response.argmax(1)
        where[a // CELL : b // CELL] = arg + a + CELL * np.arange(len(arg))[:, None]
        cells[a // CELL : b // CELL] = np.take_along_axis(response, arg[:, None], 1)[:, 0]
    of = np.repeat(np.arange(rows), count)
    chunks, row, begin = _chunks(cells, of, rows)
    last = np.searchsorted(of, np.arange(rows), side="right")[row] - 1
    hidden = np.maximum(chunks + net.bias, 0)
    prob, features, number = net._rows(hidden, row, rows)
    delta = (prob - labels) / rows
    down = delta[:, None] * net.out
    grad = (down[:, :FILTERS] / number[:, None])[row]
    top = hidden == features[row, FILTERS:]
    grad = (grad + down[row, FILTERS:] * top) * (hidden > 0)
    choice = np.stack([cells[np.minimum(begin + k, last)] for k in range(CHUNK_CELLS)]).argmax(0)
    cell = np.minimum(begin[:, None] + choice, last[:, None])
    position = np.take_along_axis(where, cell, 0)
    embed = np.zeros((WIDTH, 256, FILTERS), np.float32)
    column = np.broadcast_to(np.arange(FILTERS), position.shape)
    for k in range(WIDTH):
        flat = buffer[position + k].astype(np.int64) * FILTERS + column
        embed[k] = np.bincount(flat.ravel(), grad.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return {"embed": embed, "bias": grad.sum(0).astype(np.float32), "out": features.T @ delta, "base": np.array([delta.sum()])}


def split_of(id_column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % parts


def training_rows(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, longest: int = TRAIN_TEXT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[tuple[bytes, int]]:
    """At most ``rows`` labelled texts of ``size`` bytes in all: those whose ids have the least hashes.

    Rows with crc32(id) mod 4 = 2 are held out. Null labels, ids and texts and texts over ``longest``
    bytes are left out; of an id with several labels the least counts; repeated rows of one id and text
    count once. The lengths are summed before any text is fetched, so the driver never holds more than
    ``size`` bytes of them. Empty tables give no rows.
    """
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (split_of(F.col(id_col), 4) != 2))
    chosen = chosen.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = documents.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter(F.col("__text").isNotNull() & (F.octet_length("__text") <= longest))
    # ``chosen`` holds at most ``rows`` pairs of numbers
    found = texts.join(F.broadcast(chosen), "__id").withColumn("__hash", F.xxhash64("__text"))
    known = found.select(F.xxhash64("__id").alias("__order"), "__id", "__hash", F.octet_length("__text").alias("__size")).distinct().orderBy("__order", "__id", "__hash").limit(rows).collect()
    taken, held = [], 0
    for r in known:
        if held + r["__size"] > size:
            break
        held += r["__size"]
        taken.append((r["__id"], r["__hash"]))
    if not taken:
        return []
    wanted = documents.sparkSession.createDataFrame(taken, T.StructType([T.StructField("__id", documents.schema[id_col].dataType), T.StructField("__hash", T.LongType())]))
    got = found.join(F.broadcast(wanted), ["__id", "__hash"]).select("__id", "__hash", "__label", "__text").dropDuplicates(["__id", "__hash"])
    place = {key: k for k, key in enumerate(taken)}
    return [(r["__text"].encode(), r["__label"]) for r in sorted(got.collect(), key=lambda r: place[r["__id"], r["__hash"]])]


def train(documents: DataFrame, labels: DataFrame, **options) -> Network:
    rows = training_rows(documents, labels, **options)
    return fit([t for t, _ in rows], np.array([y for _, y in rows]))


def score_quality(df: DataFrame, network: Network, text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """Adds the probability of label 1, from all chunks of each whole text.

    Null and empty texts get the probability of an empty text. Equal texts get equal scores, so repeated
    rows stay and agree. Other columns are carried and never read; one named as ``out`` is replaced. An
    empty table gives an empty one.
    """
    keep = df.columns if keep is None else list(keep)
    source = df.select(list(dict.fromkeys([*keep, text_col])))

    def run(batches):
        for batch in blocks(batches, text_col):
            data, bounds = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            yield with_columns(batch, keep, {out: pa.array(network.score(data, bounds).astype(np.float64))})

    return source.mapInArrow(run, extend(source, keep, [field(out, "double")]))
