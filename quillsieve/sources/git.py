"""Git objects, trees, indexes, packs and references as tables.

Byte formats are decoded in Arrow batches; text formats with column expressions. Inputs are tables of
bytes that are already held (``path``, ``content``), for example from ``spark.read.format("binaryFile")``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillsieve.functions.text import trim

#: Bytes that one object may have after inflation, and objects that one pack may have.
MAX_OBJECT, MAX_PACK_OBJECTS, DELTA_ROUNDS = 128 << 20, 5_000_000, 20
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}


class Malformed(ValueError):
    pass


def inflate(raw: bytes, limit: int = MAX_OBJECT) -> bytes:
    machine = zlib.decompressobj()
    out = machine.decompress(raw, limit + 1)
    if len(out) > limit or not machine.eof:
        raise Malformed("object too large or cut off")
    return out


def loose_object(raw: bytes, sha1: str | None) -> tuple[str, bytes]:
    """Kind and content of a compressed loose object; its header, size and hash must hold."""
    try:
        data = inflate(raw)
    except zlib.error as e:
        raise Malformed(str(e)) from e
    head, _, body = data.partition(b"\0")
    kind, _, size = head.partition(b" ")
    if kind.decode("ascii", "replace") not in KINDS.values() or not size.isdigit() or int(size) != len(body):
        raise Malformed("bad header")
    if sha1 and hashlib.sha1(data).hexdigest() != sha1.lower():
        raise Malformed("hash differs")
    return kind.decode(), body


def tree_entries(data: bytes) -> list[tuple[str, str, str]]:
    """(mode, name, sha1) of a tree, up to where it is cut off."""
    out, at = [], 0
    while at < len(data):
        blank, end = data.find(b" ", at), data.find(b"\0", at)
        if blank < 0 or end < blank or end + 21 > len(data):
            break
        out.append((data[at:blank].decode("ascii", "replace"), data[blank + 1 : end].decode("utf-8", "replace"), data[end + 1 : end + 21].hex()))
        at = end + 21
    return out


def index_entries(data: bytes) -> list[tuple[str, str, int, int]]:
    """(sha1, path, mode, size) of an index of version 2 to 4; names that leave the tree become empty."""
    if data[:4] != b"DIRC" or len(data) < 12:
        raise Malformed("no index")
    version, count = struct.unpack(">II", data[4:12])
    if version not in (2, 3, 4):
        raise Malformed("unknown version")
    out, at, last = [], 12, b""
    for _ in range(count):
        if at + 62 > len(data):
            break
        mode, size = struct.unpack(">I", data[at + 24 : at + 28])[0], struct.unpack(">I", data[at + 36 : at + 40])[0]
        sha1, flags = data[at + 40 : at + 60].hex(), struct.unpack(">H", data[at + 60 : at + 62])[0]
        name_at = at + 62 + (2 if version >= 3 and flags & 0x4000 else 0)
        if version == 4:
            strip, name_at = _offset(data, name_at)
            end = data.find(b"\0", name_at)
            if end < 0 or strip > len(last):
                break
            name = last[: len(last) - strip] + data[name_at:end]
            at = end + 1
        else:
            end = data.find(b"\0", name_at)
            if end < 0:
                break
            name = data[name_at:end]
            at += (end - at + 8) // 8 * 8
        last = name
        path = name.decode("utf-8", "replace")
        if path.startswith("/") or ".." in path.split("/"):
            path = ""
        out.append((sha1, path, mode, size))
    return out


def _offset(data: bytes, at: int) -> tuple[int, int]:
    """A number in the offset encoding and where it ends."""
    byte = data[at]
    value, at = byte & 127, at + 1
    while byte & 128:
        byte = data[at]
        value, at = (value + 1) << 7 | byte & 127, at + 1
    return value, at


def pack_index(data: bytes) -> list[tuple[str, int]]:
    """(sha1, offset) of a pack index of version 1 or 2."""
    second = data[:4] == b"\xfftOc"
    start = 8 if second else 0
    if len(data) < start + 1024:
        raise Malformed("short index")
    n = struct.unpack(">I", data[start + 1020 : start + 1024])[0]
    if not 0 < n <= MAX_PACK_OBJECTS:
        raise Malformed("bad number of objects")
    at = start + 1024
    if not second:
        if len(data) < at + 24 * n:
            raise Malformed("short index")
        return [(data[at + 24 * i + 4 : at + 24 * i + 24].hex(), struct.unpack(">I", data[at + 24 * i : at + 24 * i + 4])[0]) for i in range(n)]
    places, far = at + 24 * n, at + 28 * n
    if len(data) < far:
        raise Malformed("short index")
    out = []
    for i in range(n):
        offset = struct.unpack(">I", data[places + 4 * i : places + 4 * i + 4])[0]
        if offset >> 31:
            wide = far + 8 * (offset & 0x7FFFFFFF)
            if wide + 8 > len(data):
                raise Malformed("short index")
            offset = struct.unpack(">Q", data[wide : wide + 8])[0]
        out.append((data[at + 20 * i : at + 20 * i + 20].hex(), offset))
    return out


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The object that a delta makes of its base."""
    at = 0

    def size() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = delta[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if not byte & 128:
                return value

    try:
        if size() != len(base):
            raise Malformed("base size differs")
        want, out = size(), bytearray()
        while at < len(delta):
            op = delta[at]
            at += 1
            if op & 128:
                place = length = 0
                for bit in range(4):
                    if op >> bit & 1:
                        place |= delta[at] << 8 * bit
                        at += 1
                for bit in range(3):
                    if op >> (4 + bit) & 1:
                        length |= delta[at] << 8 * bit
                        at += 1
                length = length or 0x10000
                if place + length > len(base):
                    raise Malformed("copy beyond the base")
                out += base[place : place + length]
            elif op:
                if at + op > len(delta):
                    raise Malformed("cut off")
                out += delta[at : at + op]
                at += op
            else:
                raise Malformed("reserved instruction")
            if len(out) > MAX_OBJECT:
                raise Malformed("object too large")
    except IndexError as e:
        raise Malformed("cut off") from e
    if len(out) != want:
        raise Malformed("result size differs")
    return bytes(out)


def pack_objects(pack: bytes, index: list[tuple[str, int]]) -> list[tuple[str, str, bytes]]:
    """(sha1, kind, content) of a pack's objects by offset; deltas are resolved in rounds and hashes checked."""
    if pack[:4] != b"PACK" or len(pack) < 12 or struct.unpack(">I", pack[4:8])[0] not in (2, 3) or struct.unpack(">I", pack[8:12])[0] > MAX_PACK_OBJECTS:
        raise Malformed("no pack")
    done: dict[int, tuple[str, bytes]] = {}
    waiting: dict[int, tuple[int | str, bytes]] = {}
    name = {offset: sha for sha, offset in index}
    place = {sha: offset for sha, offset in index}
    view = memoryview(pack)
    places = sorted(name)
    for offset, end in zip(places, [*places[1:], len(pack)]):
        try:
            at, byte = offset + 1, pack[offset]
            kind = byte >> 4 & 7
            while byte & 128:
                byte = pack[at]
                at += 1
            base: int | str | None = None
            if kind == 6:
                back, at = _offset(pack, at)
                base = offset - back
            elif kind == 7:
                base, at = pack[at : at + 20].hex(), at + 20
            # an object ends where the next one begins: nothing behind it is copied
            body = inflate(view[at:end])
        except (IndexError, zlib.error, Malformed):
            continue
        if kind in KINDS:
            done[offset] = (KINDS[kind], body)
        elif base is not None:
            waiting[offset] = (base, body)
    for _ in range(DELTA_ROUNDS):
        ready = {o: b if isinstance(b, int) else place.get(b, -1) for o, (b, _) in waiting.items()}
        ready = {o: b for o, b in ready.items() if b in done}
        if not ready:
            break
        for o, b in ready.items():
            kind, body = done[b]
            try:
                done[o] = (kind, apply_delta(body, waiting[o][1]))
            except Malformed:
                pass
            del waiting[o]
    out = []
    for offset in sorted(done):
        kind, body = done[offset]
        if hashlib.sha1(f"{kind} {len(body)}\0".encode() + body).hexdigest() == name[offset]:
            out.append((name[offset], kind, body))
    return out


def _decode(df: DataFrame, columns: list[str], schema: str, names: list[str], rows) -> DataFrame:
    """Rows of ``rows(*values)`` for each input row, led by its first column; what is malformed gives a row with ``error``."""

    def run(batches: Iterator[pa.RecordBatch]):
        kind = to_arrow_schema(wanted)
        for batch in batches:
            values = [batch.column(k).to_pylist() for k in range(len(columns))]
            out: list[tuple] = []
            for row in zip(*values):
                try:
                    out += [(row[0], *r, None) for r in rows(*row[1:])]
                except (Malformed, struct.error, TypeError) as e:
                    out.append((row[0], *[None] * len(names), str(e) or type(e).__name__))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind.field(i).type) for i in range(len(kind))], schema=kind)

    wanted = StructType.fromDDL(f"{columns[0]} {dict(df.dtypes)[columns[0]]}, {schema}, error string")
    return df.select(*columns).mapInArrow(run, wanted)


def read_loose(files: DataFrame) -> DataFrame:
    """(path, sha1, kind, data, error) of loose objects in files (path, content) named .../xx/38 hex digits."""
    named = files.withColumn("sha1", F.concat(*[F.regexp_extract("path", r"([0-9a-f]{2})/([0-9a-f]{38})$", g) for g in (1, 2)]))
    return _decode(named.filter("sha1 <> ''"), ["path", "content", "sha1"], "sha1 string, kind string, data binary", ["sha1", "kind", "data"], lambda content, sha1: [(sha1, *loose_object(content, sha1))])


def read_index(files: DataFrame) -> DataFrame:
    """(path, sha1, filename, mode, file_size, error) of the entries of index files."""
    return _decode(files, ["path", "content"], "sha1 string, filename string, mode long, file_size long", ["sha1", "filename", "mode", "file_size"], index_entries)


def read_trees(objects: DataFrame) -> DataFrame:
    """(tree, mode, name, sha1, error) of the entries of tree objects (sha1, data)."""
    return _decode(objects.select(F.col("sha1").alias("tree"), "data"), ["tree", "data"], "mode string, name string, sha1 string", ["mode", "name", "sha1"], tree_entries)


def read_packs(packs: DataFrame) -> DataFrame:
    """(path, sha1, kind, data, error) of the objects of packs (path, content, idx); a pack that cannot be read is one row."""
    return _decode(packs, ["path", "content", "idx"], "sha1 string, kind string, data binary", ["sha1", "kind", "data"], lambda content, idx: pack_objects(content, pack_index(idx)))


def commits(objects: DataFrame) -> DataFrame:
    """(sha1, tree, parents, author, author_email, author_ts, message) of commit objects (sha1, data)."""
    text = F.make_valid_utf8(F.col("data").cast("string"))
    parted = objects.withColumn("__t", text).withColumn("__head", F.substring_index("__t", "\n\n", 1)).withColumn("__lines", F.split("__head", "\n"))
    author = F.regexp_extract("__head", r"(?m)^author (.*)$", 1)
    parents = F.transform(F.filter("__lines", lambda x: F.startswith(x, F.lit("parent "))), lambda x: F.trim(F.substring(x, 8, 100)))
    return parted.select(
        "sha1",
        F.regexp_extract("__head", r"(?m)^tree ([0-9a-f]{40})", 1).alias("tree"),
        parents.alias("parents"),
        F.trim(F.regexp_extract(author, r"^(.*?)\s*<", 1)).alias("author"),
        F.regexp_extract(author, r"<([^>]*)>", 1).alias("author_email"),
        F.regexp_extract(author, r">\s*(-?[0-9]+)", 1).cast("long").alias("author_ts"),
        F.regexp_replace(F.when(F.contains("__t", F.lit("\n\n")), F.expr("substring(__t, length(__head) + 3)")).otherwise(""), r"^\s+|\s+\z", "").alias("message"),
    )


def tags(objects: DataFrame) -> DataFrame:
    """(sha1, target, target_type, name) of annotated tags (sha1, data); a target that is no hash is null."""
    text = F.make_valid_utf8(F.col("data").cast("string"))
    target = F.regexp_extract(text, r"(?m)^object ([0-9a-fA-F]{40})$", 1)
    return objects.select("sha1", F.when(target != "", target).alias("target"), F.regexp_extract(text, r"(?m)^type (.*)$", 1).alias("target_type"), F.regexp_extract(text, r"(?m)^tag (.*)$", 1).alias("name"))


def _lines(df: DataFrame, text: str) -> DataFrame:
    return df.select("*", F.posexplode(F.split(text, r"\r?\n", -1)).alias("pos", "line"))


def packed_refs(files: DataFrame, text: str = "text") -> DataFrame:
    """(path, sha1, ref_name, peeled) of packed-refs files (path, text); a ^ line belongs to the line before."""
    lines = _lines(files, text).filter((F.trim("line") != "") & ~F.startswith("line", F.lit("#")))
    after = F.lead("line").over(W.partitionBy("path").orderBy("pos"))
    rows = lines.withColumn("__next", after).filter(F.col("line").rlike(r"^[0-9a-fA-F]{40} \S"))
    return rows.select("path", F.left("line", F.lit(40)).alias("sha1"), F.trim(F.substring("line", 42, 4096)).alias("ref_name"), F.when(F.startswith("__next", F.lit("^")), F.trim(F.substring("__next", 2, 40))).alias("peeled"))


def ini_entries(files: DataFrame, text: str = "text") -> DataFrame:
    """(path, section, key, value) of INI-like files; [a "b"] is the section a.b."""
    lines = _lines(files, text).withColumn("line", trim(F.col("line"))).filter((F.col("line") != "") & ~F.col("line").rlike("^[#;]"))
    opened = F.when(F.col("line").rlike(r"^\[.*\]$"), F.regexp_replace(F.regexp_replace("line", r"^\[|\]$", ""), r'\s*"([^"]*)"', ".$1"))
    placed = lines.withColumn("section", F.last(opened, ignorenulls=True).over(W.partitionBy("path").orderBy("pos")))
    rows = placed.filter(~F.col("line").rlike(r"^\[.*\]$") & F.contains("line", F.lit("=")))
    return rows.select("path", "section", trim(F.substring_index("line", "=", 1)).alias("key"), trim(F.regexp_replace("line", r"^[^=]*=", "")).alias("value"))


def remotes(entries: DataFrame) -> DataFrame:
    """(path, name, url) of the remotes among INI entries."""
    return entries.filter(F.startswith("section", F.lit("remote.")) & (F.col("key") == "url")).select("path", F.substring("section", 8, 4096).alias("name"), F.col("value").alias("url"))


def head_kind(text: Column) -> Column:
    """struct<kind, value> of a HEAD file: a reference, a detached hash or unknown."""
    t = F.trim(F.regexp_replace(text, r"\s+\z", ""))
    ref = F.startswith(t, F.lit("ref: "))
    loose = t.rlike(r"^[0-9a-fA-F]{40}\z")
    return F.struct(F.when(ref, "ref").when(loose, "detached").otherwise("unknown").alias("kind"), F.when(ref, F.trim(F.substring(t, 6, 4096))).when(loose, t).alias("value"))


def hashes_in(df: DataFrame, text: str = "text") -> DataFrame:
    """(sha1) of every 40-digit hash in some texts, each once; not the null hash."""
    found = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\b([0-9a-f]{40})\b"), F.lit(1))).alias("sha1"))
    return found.filter(F.col("sha1") != "0" * 40).distinct()
