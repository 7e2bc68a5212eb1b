"""Token ids as flat binary files with a minimal perfect hash index in each file.

Documents are dealt to shards in ascending order of their key and written by Spark's own text writer: a document is a
record of raw little-endian ids and the record separator is its end id, so a shard starts with nothing but ids and can
be mapped into memory as one array. Behind the ids stands a footer: the keys, the offsets, and a minimal perfect hash of
the distinct keys whose slots hold a stored fingerprint and the place of the key's documents. A key is found in constant
time: its shard by the bounds in the catalogue, its slot by the hash, and the fingerprint turns strangers away.

    shard  = ids of document 0, end id, ids of document 1, end id, ..., footer, trailer, end id
    footer = arrays in numpy's format, see ``_ARRAYS``
    trailer = magic, bytes of ids, bytes of the footer
"""

from __future__ import annotations

import gc
import io
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm.common import staged
from plantlens.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
SHARD_BYTES = 32 << 20  # of text in a shard, about
SHARD_ROWS = 500_000  # documents in a shard, about
ROUTE_SHARDS = 2_000_000  # shards whose bounds a lookup sends to its tasks, 24 bytes each
AT_ONCE = 5_000  # texts or pieces whose encodings the library holds
HELD = 200_000  # pieces whose ids a worker holds
BLOCK = 2 << 20  # bytes of text whose pieces are brought together
MAGIC = b"IDSHARD1"
_TRAILER = struct.Struct("<8sQQ")
_ARRAYS = ("keys", "null", "offsets", "sizes", "bits", "left", "prints", "first", "rows")
GAMMA, LEVELS = 2, 24


# Encoding. A byte-level tokenizer never joins a character that is no blank with the blank behind it, so a text can be
# cut there, and pieces met before need not be encoded again. A blank and a run of letters before punctuation is one word
# to it, and the punctuation another, so such pieces are cut once more and their words go to the model itself.

_CUT = re.compile(r"(?<=\S)(?=[ \n\t\r])")
_RUN = re.compile(r"\s\s")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARKS = r"!-/:-@\[-`{-~"
_PARTS = rf"^(?P<stem>[{_LETTERS}]+)(?P<tail>[{_MARKS}]*)$"
_INSIDE = re.compile(rf" ?[{_LETTERS}]*[{_MARKS}]*")


class _Held:
    """Pieces and their ids, those met last in front; what is beyond HELD goes."""

    def __init__(self) -> None:
        self.pieces, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def looked_up(self, column: pa.Array, encode: Callable[[list[str]], list[bytes]]) -> pa.Array:
        """The ids of each piece; null has none."""
        distinct = column.dictionary_encode()
        pieces = distinct.dictionary
        at = pc.index_in(pieces, value_set=self.pieces)
        new = pc.is_null(at)
        ids = pc.replace_with_mask(self.ids.take(at), new, pa.array(encode(pieces.filter(new).to_pylist()), pa.large_binary()))
        unmet = np.ones(len(self.pieces), bool)
        unmet[at.drop_null().to_numpy()] = False
        rest = pa.array(np.flatnonzero(unmet)[: max(0, HELD - len(pieces))])
        self.pieces = pa.concat_arrays([pieces, self.pieces.take(rest)])
        self.ids = pa.concat_arrays([ids, self.ids.take(rest)])
        return ids.take(distinct.indices)


@lru_cache(2)
def _encoder(path: str):
    """The tokenizer, whether texts may be cut, how letters read in its vocabulary if words may be too, and held pieces and stems."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    split = found.pre_tokenizer
    byte_level = type(split).__name__ == "ByteLevel" and not split.add_prefix_space and found.normalizer is None
    added = [t.content for t in found.get_added_tokens_decoder().values()]
    by_word = byte_level and split.use_regex and type(found.model).__name__ == "BPE" and found.model.dropout is None and not any(map(_INSIDE.fullmatch, added))
    letters = [c for c in map(chr, range(0x250)) if re.match(f"[{_LETTERS}]", c)]
    spelt = {ord(c): split.pre_tokenize_str(c)[0][0] for c in letters} if by_word else None
    return found, byte_level, spelt, _Held(), _Held()


def tokenizer_path(path: str | None) -> str:
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def encoded(texts: list[str], dtype: str, path: str) -> list[bytes]:
    """The ids of each text as raw numbers, without an end id."""
    model, by_piece, spelt, exact, stems = _encoder(path)
    if not by_piece:
        return _ids(model, texts, dtype)
    collects = gc.isenabled()
    gc.disable()  # hundreds of thousands of small objects and no cycles
    try:
        return _by_piece(model, texts, dtype, spelt, exact, stems)
    finally:
        if collects:
            gc.enable()


def _ids(model, texts: list[str], dtype: str) -> list[bytes]:
    out: list[bytes] = []
    for start in range(0, len(texts), AT_ONCE):
        out += [np.array(e.ids, dtype).tobytes() for e in model.encode_batch_fast(texts[start : start + AT_ONCE], add_special_tokens=False)]
    return out


def _by_piece(model, texts: list[str], dtype: str, spelt: dict[int, str] | None, exact: _Held, stems: _Held) -> list[bytes]:
    """``exact`` holds pieces as they stand in texts, ``stems`` runs of letters without the blank before them."""
    heads, bodies = [], []
    for t in texts:
        if _RUN.search(t):
            heads.append(_CUT.split(t))
            bodies.append(None)
        else:
            head, blank, body = t.replace("\n", " \n").replace("\t", " \t").replace("\r", " \r").partition(" ")
            heads.append((head,))
            bodies.append(body if blank else None)
    pieces = pc.split_pattern(pa.array(bodies, pa.large_string()), " ")
    last = np.cumsum(pc.fill_null(pc.list_value_length(pieces), 0).to_numpy())
    words = pieces.flatten().dictionary_encode()
    ids = _word_ids(model, words.dictionary, dtype, spelt, exact, stems).take(words.indices)
    ends, raw = np.frombuffer(ids.buffers()[1], np.int64), memoryview(ids.buffers()[2])
    ends = ends[np.concatenate([[0], last])].tolist()
    whole = list(set().union(*heads))
    known = dict(zip(whole, exact.looked_up(pa.array(whole, pa.large_string()), lambda new: _ids(model, new, dtype)).to_pylist()))
    return [b"".join([*map(known.__getitem__, h), raw[a:b]]) for h, a, b in zip(heads, ends, ends[1:])]


def _word_ids(model, words: pa.Array, dtype: str, spelt: dict[int, str] | None, exact: _Held, stems: _Held) -> pa.Array:
    """The ids of distinct pieces that had a blank before them or start with another."""

    def whole(pieces: list[str]) -> list[bytes]:
        return _ids(model, pieces, dtype)

    def of_stems(found: list[str]) -> list[bytes]:
        tokens, flat, ends = model.model.tokenize, [], [0]
        for s in found:
            flat += [t.id for t in tokens(blank + s.translate(spelt))]
            ends.append(len(flat))
        raw, width = np.array(flat, dtype).tobytes(), np.dtype(dtype).itemsize
        return [raw[width * a : width * b] for a, b in zip(ends, ends[1:])]

    def as_it_stands(pieces: pa.Array) -> pa.Array:
        return exact.looked_up(pa.array([x if x[:1] in ("\n", "\t", "\r") else " " + x for x in pieces.to_pylist()], pa.large_string()), whole)

    if spelt is None:
        return as_it_stands(words)
    blank = model.pre_tokenizer.pre_tokenize_str(" ")[0][0]
    stem, tail = pc.extract_regex(words, _PARTS).flatten()
    cut = pc.is_valid(stem)
    both = pc.binary_join_element_wise(stems.looked_up(stem, of_stems), exact.looked_up(tail, whole), pa.scalar(b"", pa.large_binary()))
    return pc.replace_with_mask(both, pc.invert(cut), as_it_stands(words.filter(pc.invert(cut))))


# The hash: levels of bit arrays. A key has its place in the first level where no other key shares its bit; its slot is
# the number of bits set before. Keys that share in every level are listed in order behind all slots.


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    z = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def _print(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct signed 64-bit keys to the numbers 0 .. n-1, each used once; any other key gets some number or -1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, left: np.ndarray) -> None:
        self.sizes, self.bits, self.left = sizes, bits, left
        flags = np.unpackbits(bits)[: int(sizes.sum())]
        self.flags, self.rank = flags.astype(bool), np.cumsum(flags, dtype=np.int64) - flags

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, flags = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(64, GAMMA * len(keys))
            at = (_mix(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            flags.append(alone)
            keys = keys[~alone[at]]
        return cls(np.array(sizes, np.int64), np.packbits(np.concatenate([np.zeros(0, bool), *flags])), np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = self.flags[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_, base = open_[~hit], base + int(size)
        if len(self.left) and len(open_):
            at = np.minimum(np.searchsorted(self.left, keys[open_]), len(self.left) - 1)
            hit = self.left[at] == keys[open_]
            out[open_[hit]] = int(self.flags.sum()) + at[hit]
        return out


class Shard:
    """A shard file: its ids, and keyed access to them."""

    def __init__(self, content: bytes, dtype: str) -> None:
        width, view = np.dtype(dtype).itemsize, memoryview(content)
        end = len(view) - width - _TRAILER.size
        magic, size, footer = _TRAILER.unpack(view[end : end + _TRAILER.size])
        if magic != MAGIC or size + footer != end:
            raise ValueError("this is no shard of token ids")
        file = io.BytesIO(view[size:end])
        a = {name: np.load(file) for name in _ARRAYS}
        self.ids = np.frombuffer(view[:size], dtype)
        self.keys, self.null, self.offsets = a["keys"], a["null"], a["offsets"]
        self.hash, self.prints, self.first, self.rows = PerfectHash(a["sizes"], a["bits"], a["left"]), a["prints"], a["first"], a["rows"]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the first document of each key and how many follow on from it; 0 of them for a strange key."""
        slot = self.hash.slots(keys)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == _print(keys[known])
        # A print can agree by chance; the key beside the document decides.
        at = np.where(known, self.first[np.where(known, slot, 0)] if len(self.first) else 0, 0).astype(np.int64)
        if len(self.keys):
            known &= self.keys[at] == keys
        return at, np.where(known, self.rows[np.where(known, slot, 0)] if len(self.rows) else 0, 0).astype(np.int64)

    def document(self, number: int) -> np.ndarray:
        return self.ids[int(self.offsets[number]) : int(self.offsets[number + 1])]


def _footer(keys: list[int | None], lengths: list[int], payload: int) -> bytes:
    null = np.array([k is None for k in keys], bool)
    ids = np.array([0 if k is None else k for k in keys], np.int64)
    known = np.flatnonzero(~null)
    distinct, first, rows = np.unique(ids[known], return_index=True, return_counts=True)
    found = PerfectHash.build(distinct)
    slot = found.slots(distinct)
    prints, places, counts = (np.zeros(len(distinct), np.uint32) for _ in range(3))
    prints[slot], places[slot], counts[slot] = _print(distinct), known[first], rows
    out = io.BytesIO()
    for a in (ids, null, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), found.sizes, found.bits, found.left, prints, places, counts):
        np.save(out, a)
    footer = out.getvalue()
    return footer + _TRAILER.pack(MAGIC, payload, len(footer))


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, dtype: str = "<u2", tokenizer: str | None = None) -> None:
    """Writes ``docs`` under ``path``: folder ids with the shards, folder catalogue with a row for each shard.

    Shards and the documents in them ascend by key, rows without a key last; rows of one key stand together, ordered by a
    hash of the text, and may go on in the next shard, so a key may hold any share of all rows. Null texts are
    empty documents of the end id alone. ``end_id`` has to be below 128 as it is the writer's record separator. An
    empty table gives one empty shard.
    """
    if not 0 <= end_id < 128:
        raise ValueError("the end id has to be below 128")
    path_of = tokenizer
    width = np.dtype(dtype).itemsize

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, lengths, payload = tokenizer_path(path_of), [], [], 0
        for batch in batches:
            block = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // BLOCK
            starts = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), batch.num_rows]
            for start, end in zip(starts, starts[1:]):
                part = batch.slice(start, end - start)
                data = encoded([t or "" for t in part.column(1).to_pylist()], dtype, model)
                pa.default_memory_pool().release_unused()  # the worker stands beside the JVM's sort
                keys += part.column(0).to_pylist()
                lengths += [len(x) // width + 1 for x in data]
                payload += sum(map(len, data)) + width * len(data)
                yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], names=["data"])
        yield pa.RecordBatch.from_arrays([pa.array([_footer(keys, lengths, payload)], pa.binary())], names=["data"])
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-size[1] // SHARD_BYTES), -(-size[0] // SHARD_ROWS))
    parts = max(parts, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size[0] // 500)))
    # The last column splits rows that repeat key and text, which are alike in whatever order.
    rows = rows.select("*", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_last(), F.col("mark"), F.col("row")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    lines = dealt.mapInArrow(shards, "data binary").select(F.col("data").cast("string").alias("value"))
    lines.write.option("lineSep", int(end_id).to_bytes(width, "little").decode("ascii")).text(f"{path}/ids")
    _catalogue(docs.sparkSession, path, dtype).write.parquet(f"{path}/catalogue")


def _shard_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ids").select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("shard"), "path", "content")


def _catalogue(spark: SparkSession, path: str, dtype: str) -> DataFrame:
    """(shard, path, docs, n_ids, start, low, high): start counts the ids of all shards before; low and high bound the keys."""
    names = ["shard", "path", "docs", "n_ids", "low", "high"]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file, content in zip(*(batch.column(i) for i in range(3))):
                s = Shard(content.as_py(), dtype)
                known = s.keys[~s.null]
                row = [shard.as_py(), file.as_py(), len(s.keys), len(s.ids), *([int(known[0]), int(known[-1])] if len(known) else [None, None])]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if n == "path" else pa.int64()) for n, v in zip(names, row)], names=names)

    found = staged(_shard_files(spark, path).mapInArrow(heads, "shard long, path string, docs long, n_ids long, low long, high long"), "heads")
    before, starts = 0, []
    for r in found.select("shard", "n_ids").orderBy("shard").toLocalIterator():  # a row for each shard, not for each document
        starts.append((r["shard"], before))
        before += r["n_ids"]
    return found.join(spark.createDataFrame(starts, "shard long, start long"), "shard")


def documents(spark: SparkSession, path: str, dtype: str = "<u2", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, shard, offset, and ids on request) of every document, read from the shards.

    Every key goes through its shard's hash index: slot, fingerprint, place; rows without a key are read by their place.
    ``start`` counts all ids before, ``offset`` those of the shard; ids_crc32 is taken over unsigned 32-bit numbers.
    """
    schema = "id long, shard long, offset long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0), batch.column(1)):
                s = Shard(content.as_py(), dtype)
                distinct = np.unique(s.keys[~s.null])
                first, count = s.find(distinct)
                if count.sum() != len(s.keys) - s.null.sum():
                    raise ValueError("the index of a shard does not find all of its keys")
                numbers = np.concatenate([np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), np.flatnonzero(s.null)]).astype(np.int64)
                keys = pa.array(s.keys[numbers], pa.int64(), mask=s.null[numbers])
                found = [s.document(i) for i in numbers]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in found]
                columns = [keys, pa.array(np.full(len(numbers), shard.as_py()), pa.int64()), pa.array(s.offsets[numbers], pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                yield from pa.Table.from_arrays(columns, names=names).to_batches(10_000)

    found = _shard_files(spark, path).select("shard", "content").mapInArrow(rows, schema)
    starts = spark.read.parquet(f"{path}/catalogue").select("shard", F.col("start").alias("before"))
    return found.join(starts, "shard").select("id", (F.col("before") + F.col("offset")).alias("start"), *names[3:], "shard", "offset")


def lookup(spark: SparkSession, path: str, keys: DataFrame, dtype: str = "<u2") -> DataFrame:
    """(id, ids) of the documents of the wanted keys (the first column of ``keys``); keys that no document has give no row.

    Only shards whose bounds hold a wanted key are opened. Null keys find nothing; of repeated keys one is looked up.
    """
    catalogue = spark.read.parquet(f"{path}/catalogue").where("low is not null")
    if catalogue.count() > ROUTE_SHARDS:
        raise ValueError(f"more than {ROUTE_SHARDS} shards: write larger ones")
    bounds = catalogue.select("shard", "low", "high").orderBy("shard").toPandas()
    shard, low, high = (bounds[c].to_numpy(np.int64) for c in ("shard", "low", "high"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            first, last = np.searchsorted(high, k, "left"), np.searchsorted(low, k, "right")
            n = np.maximum(last - first, 0)
            at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(shard[at], pa.int64()), pa.array(np.repeat(k, n), pa.int64())], names=["shard", "id"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, wanted in zip(batch.column(0), batch.column(1)):
                s, k = Shard(content.as_py(), dtype), np.array(wanted.as_py(), np.int64)
                first, count = s.find(k)
                pairs = [(key, s.document(i).astype(np.int32)) for key, a, n in zip(k.tolist(), first, count) for i in range(a, a + n)]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.list_(pa.int32()))], names=["id", "ids"])

    wanted = keys.select(F.col(f"`{keys.columns[0]}`").cast("long").alias("id")).where("id is not null").distinct()
    routed = staged(wanted.mapInArrow(route, "shard long, id long").groupBy("shard").agg(F.collect_list("id").alias("wanted")), "routed")
    files = [r["path"] for r in catalogue.join(routed.select("shard"), "shard").select("path").collect()]
    if not files:
        return spark.createDataFrame([], "id long, ids array<int>")
    opened = spark.read.format("binaryFile").load(files).select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("shard"), "content")
    return opened.join(routed, "shard").select("content", "wanted").mapInArrow(fetch, "id long, ids array<int>")


def stored(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes ``docs`` (to a folder in the shared one unless ``path`` is given) and reads every document back."""
    path = path or scratch_path(docs.sparkSession, "token-ids")
    write(docs, path, **options)
    return documents(docs.sparkSession, path, options.get("dtype", "<u2"))
