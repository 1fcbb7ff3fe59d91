"""Token-ID output as wavelet matrices: one compressed, succinct file for each shard.

A shard holds the ids of consecutive documents in ascending doc_id order. Its file keeps one
bit-plane for each bit of the largest id (highest bit first; after each plane the zeros go before
the ones), cut into blocks of BLOCK bits that are compressed one by one, and stores what rank and
select need: the ones before every block of every plane. Access, counting and occurrence lookup
read the header and unpack the few blocks they touch; the directory of documents is a block of its own.

write_shards encodes documents where they lie, writes the ids, ranges them by doc_id and writes one
Parquet file for each shard (its image is the one cell of column `image`), so that Spark's committer
makes every shard appear whole or not at all on any store, also when executors are lost. Only ids
are shuffled, never texts, and images never are.

Order of documents: doc_id ascending, null first; equal doc_ids by a checksum of their ids. A null
text is empty, and an empty text has the end id alone. doc_id is an integer, or a string that Spark
casts to one: other strings raise CAST_INVALID_INPUT. A document is never split, so a shard may
exceed the target. Other columns of the table, whatever their names, take no part. An empty table
has no shards and no rows.
"""

from __future__ import annotations

import struct
import zlib
from itertools import accumulate, chain

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, staged

#: Ids in a shard, about, and bits of a block.
SHARD, BLOCK = 1 << 21, 1 << 16
#: Bytes of texts that are encoded at once, about: the more, the fewer words are met again.
TOGETHER = 1 << 24
#: Magic, bits, bits of a block, ids, documents, compressed size of the directory.
HEAD = struct.Struct("<4sIIqqq")
MAGIC = b"WVM2"


def build(ids: np.ndarray, doc_ids: list, counts: list[int]) -> bytes:
    """A shard's file: header, zeros of each plane, ones before each block, ends of the compressed
    blocks, directory, blocks."""
    a = ids.astype(np.uint16 if len(ids) == 0 or ids.max() < 1 << 16 else np.uint32)
    n, bits = len(a), max(1, int(a.max()).bit_length()) if len(a) else 1
    pack = zstandard.ZstdCompressor(level=1).compress
    zeros, ranks, blocks = [], [], []
    for level in range(bits - 1, -1, -1):
        one = ((a >> a.dtype.type(level)) & a.dtype.type(1)).astype(bool)
        plane = np.zeros(-(-n // BLOCK) * BLOCK // 8, np.uint8)
        packed = np.packbits(one, bitorder="little")
        plane[: len(packed)] = packed
        ones = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
        ranks.append(np.concatenate(([0], np.cumsum(ones))))
        blocks += [pack(b) for b in plane.reshape(-1, BLOCK // 8)]
        low = np.compress(~one, a)  # a quarter of the time of a mask as index, where bits follow no order
        zeros.append(len(low))
        a = np.concatenate((low, np.compress(one, a)))
    null = [d is None for d in doc_ids]
    directory = pack(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array(null, "u1").tobytes() + np.array(counts, "<i8").tobytes())
    ends = np.cumsum([0, *map(len, blocks)])
    return b"".join([HEAD.pack(MAGIC, bits, BLOCK, n, len(counts), len(directory)), np.array(zeros, "<i8").tobytes(), np.concatenate(ranks).astype("<i8").tobytes(), ends.astype("<i8").tobytes(), directory, *blocks])


class WaveletMatrix:
    """An opened shard: anything that can be sliced as bytes (bytes, a buffer, an mmap of a file)."""

    #: Unpacked blocks that are kept.
    held = 256

    def __init__(self, image):
        magic, self.bits, self.block, self.n, docs, size = HEAD.unpack(image[: HEAD.size])
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at, steps = HEAD.size, -(-self.n // self.block)

        def numbers(count):
            nonlocal at
            at += 8 * count
            return np.frombuffer(image[at - 8 * count : at], "<i8")

        self.zeros = numbers(self.bits)
        self.ranks = numbers(self.bits * (steps + 1)).reshape(self.bits, steps + 1)
        self.ends = numbers(self.bits * steps + 1)
        self.image, self.steps, self.docs, self._directory, self._blocks_at = image, steps, docs, (at, at + size), at + size
        self._unpack = zstandard.ZstdDecompressor().decompress
        self._kept: dict[int, np.ndarray] = {}

    def directory(self) -> tuple[list, np.ndarray]:
        """doc_ids and numbers of ids of the shard's documents."""
        raw = self._unpack(bytes(self.image[slice(*self._directory)]))
        ids, null = np.frombuffer(raw, "<i8", self.docs), np.frombuffer(raw, "u1", self.docs, 8 * self.docs)
        return [None if x else d for d, x in zip(ids.tolist(), null.tolist())], np.frombuffer(raw, "<i8", self.docs, 9 * self.docs)

    def _bytes(self, b: int) -> bytes:
        lo, hi = self.ends[b : b + 2].tolist()
        return self._unpack(bytes(self.image[self._blocks_at + lo : self._blocks_at + hi]))

    def _block(self, k: int, b: int) -> np.ndarray:
        key = k * self.steps + b
        if key not in self._kept:
            if len(self._kept) >= self.held:
                self._kept.clear()
            self._kept[key] = np.frombuffer(self._bytes(key), np.uint8)
        return self._kept[key]

    def _rank(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        b, rest = divmod(i, self.block)
        ones = int(self.ranks[k, b])
        if rest:
            part = self._block(k, b)[: (rest + 7) // 8]
            ones += int(np.bitwise_count(part).sum()) - (int(part[-1] >> (rest % 8)).bit_count() if rest % 8 else 0)
        return ones

    def _select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit of plane k: its block by the stored counts, then within."""
        before = self.ranks[k] if bit else np.minimum(np.arange(self.steps + 1) * self.block, self.n) - self.ranks[k]
        b = int(np.searchsorted(before, j, side="right")) - 1
        bits = np.unpackbits(self._block(k, b), bitorder="little")
        return b * self.block + int(np.flatnonzero(bits == bit)[j - int(before[b])])

    def access(self, i: int) -> int:
        """The id at place i."""
        out = 0
        for k in range(self.bits):
            ones = self._rank(k, i)
            bit = int(self._block(k, i // self.block)[i % self.block // 8]) >> (i % 8) & 1
            out = out << 1 | bit
            i = int(self.zeros[k]) + ones if bit else i - ones
        return out

    def _span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self._rank(k, lo), self._rank(k, hi)
            if token >> (self.bits - 1 - k) & 1:
                lo, hi = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often token stands in places lo to hi."""
        if token >> self.bits:
            return 0
        a, b = self._span(token, lo, self.n if hi is None else hi)
        return b - a

    def find(self, token: int, j: int = 0) -> int | None:
        """Place of the j-th occurrence of token."""
        if token >> self.bits:
            return None
        lo, hi = self._span(token, 0, self.n)
        if j >= hi - lo:
            return None
        i = lo + j
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            i = self._select(k, bit, i - int(self.zeros[k]) if bit else i)
        return i

    def all_ids(self) -> np.ndarray:
        """Every id in its place, rebuilt plane by plane from the last."""
        a = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            plane = b"".join(self._bytes(k * self.steps + b) for b in range(self.steps))
            one, z = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").view(bool), int(self.zeros[k])
            out = np.empty_like(a)
            out[np.flatnonzero(~one)] = a[:z]
            out[np.flatnonzero(one)] = a[z:] | a.dtype.type(1 << (self.bits - 1 - k))
            a = out
        return a


class WordCodec:
    """Encodes with the tokenizers library, one call for many distinct words.

    Sound where normaliser, pre-tokeniser and added tokens act within white-space-separated words
    (white space is only a separator to them), which `separable` checks on the tokenizer's own
    definition; any other tokenizer encodes whole texts.
    """

    limit = 1_200_000
    #: Lower-case letters that the checks and the table of _plain hold for; a run of letters up to there, and the punctuation behind it.
    letters = "".join(c for c in map(chr, range(0x130)) if c.isalpha() and c == c.lower())
    split = r"^(?P<core>[A-Za-zªµºÀ-ÖØ-öø-\x{12F}]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separable = self._separable()
        self.plain = self.separable and self._plain()
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cores: dict[str, bytes] = {"": b""}

    def _separable(self) -> bool:
        import json

        spec = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in spec.get("added_tokens") or [])
        return plain and steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("behavior") == "Removed" and "\\s" in str(split["pattern"]) and not spec.get("post_processor")

    def _plain(self) -> bool:
        """Whether lower-case letters below U+0130 reach the model whole, each byte as one sign, so that the model alone can be asked,
        and apart from punctuation behind them."""
        import json
        import string

        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.loads(self.tokenizer.to_str())
        split, *rest = spec["pre_tokenizer"]["pretokenizers"]
        level = [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
        marked = all(not t["content"].isalpha() for t in spec.get("added_tokens") or [])
        signs = ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {ord(c): signs.pre_tokenize_str(c)[0][0] for c in self.letters if not c.isascii()}
        tail = "".join(c for c in string.punctuation if c != "'")
        whole = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.letters * 2 + tail)] == [self.letters.translate(self.signs) * 2, tail]
        return level and marked and whole and "[\\p{L}]+" in str(split["pattern"].get("Regex")) and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")

    def _asked(self, items: list[str]) -> list[bytes]:
        """_raw for runs of letters below U+0130, lower-case: by the tokenizer's model, without its steps before."""
        tokenize, signs = self.tokenizer.model.tokenize, self.signs
        return self._cells([[t.id for t in tokenize(w if w.isascii() else w.translate(signs))] for w in items])

    def _raw(self, items: list[str]) -> list[bytes]:
        return self._cells([e.ids for e in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)])  # ids alone

    def _cells(self, ids: list[list[int]]) -> list[bytes]:
        whole, size = np.array(list(chain.from_iterable(ids)), self.type).tobytes(), self.type.itemsize
        cut = list(accumulate((size * len(x) for x in ids), initial=0))
        return [whole[a:b] for a, b in zip(cut, cut[1:])]

    def _letters(self, items: list[str]) -> list[bytes]:
        """_raw for runs of letters, many in one call: each is one pre-token, which the count shows."""
        e = self.tokenizer.encode(" ".join(items), add_special_tokens=False)
        word = np.array(e.word_ids)
        if not len(word) or word[-1] + 1 != len(items):
            return self._raw(items)
        ids, size = np.array(e.ids, self.type).tobytes(), self.type.itemsize
        cut = (size * np.searchsorted(word, np.arange(len(items) + 1))).tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]

    def _learn(self, missing: list[str]) -> None:
        """The ids of runs of letters, of punctuation and of other words not met before."""
        cores = self.cores
        letters = [w for w in missing if w.isalpha() and (w.isascii() or max(w) < "İ")]  # composed and lower-case: see encode
        for part, encode in ((letters, self._asked if self.plain else self._letters), (list(set(missing).difference(letters)), self._raw)):
            for lo in range(0, len(part), 2000):
                cores.update(zip(part[lo : lo + 2000], encode(part[lo : lo + 2000])))

    def _found(self, keys) -> "pa.LargeBinaryArray":  # noqa: F821
        """The ids of each of an Arrow array of distinct texts without white space, as cells."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(keys):
            return pa.array([], pa.large_binary())
        told = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.scalar("\n", keys.type))[0].as_py().split("\n")
        if missing := [w for w in told if w not in self.cores]:
            self._learn(missing)
        return pa.array(map(self.cores.__getitem__, told), pa.large_binary(), size=len(told))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of texts, one after another, and where each text's begin (and the last one's end).

        Of distinct words, those of letters with punctuation behind them are cut in two (each part is a pre-token of its own), and
        the letters lower-cased; so what is encoded are distinct runs of letters, of punctuation, and other words."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.fill_null("")
        if not self.separable:
            raw = self._raw(texts.to_pylist())
            return np.frombuffer(b"".join(raw), self.type), np.cumsum([0, *map(len, raw)]) // self.type.itemsize
        if len(self.cores) > self.limit:
            self.cores = {"": b""}
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        first = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        if self.plain:
            cut = pc.extract_regex(coded.dictionary, self.split)
            core = pc.coalesce(pc.utf8_lower(pc.struct_field(cut, "core")), coded.dictionary).dictionary_encode()
            tail = pc.coalesce(pc.struct_field(cut, "tail"), pa.scalar("", pa.large_string())).dictionary_encode()
            words = pc.binary_join_element_wise(*[self._found(x.dictionary).take(x.indices) for x in (core, tail)], pa.scalar(b"", pa.large_binary()))
        else:
            words = self._found(coded.dictionary)
        # the cells of the words taken one after another are the ids: copied word by word, not looked up id by id
        _, ends, cells = words.take(coded.indices).buffers()
        ends = np.frombuffer(ends, np.int64, len(coded) + 1) // self.type.itemsize if len(coded) else np.zeros(1, np.int64)
        return np.frombuffer(cells or b"", self.type, ends[-1]), ends[first]


_CODECS: dict[str, WordCodec] = {}


def word_codec(path: str) -> WordCodec:
    """One codec for each Python worker, kept from task to task."""
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def encoded(df: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """d, ids (little-endian, 2 or 4 bytes each by the tokenizer's size, with the end id): one row for each row of df."""

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        c = word_codec(path)

        def coded(held):
            d, texts = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
            ids, first = c.encode(texts)
            out = np.insert(ids, first[1:], end_id)
            offsets = (first + np.arange(len(first))) * c.type.itemsize
            cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
            for lo in range(0, len(texts), 1000):
                yield pa.RecordBatch.from_arrays([d.slice(lo, 1000), cells.slice(lo, 1000).cast(pa.binary())], names=["d", "ids"])

        held: list = []
        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                held.append(part)
                size += part.column(1).nbytes
                if size >= TOGETHER:
                    yield from coded(held)
                    held, size = [], 0
        if held:
            yield from coded(held)

    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))
    return in_batches(source, run, "d long, ids binary")


def write_shards(df: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes df, deals the ids by ranges of doc_id and writes the shards, a file each; returns the
    table read back: part, seq, n_docs, n_tokens, image."""
    width = "<u2" if _vocabulary(path) <= 1 << 16 > end_id else "<u4"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: list = []
        docs: list = []
        counts: list = []
        size = 0

        def shard():
            image = build(np.frombuffer(b"".join(held), width), docs, counts)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(docs)], pa.int64()), "n_tokens": pa.array([sum(counts)], pa.int64()), "image": pa.array([image], pa.binary())})

        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(d)
                held.append(ids)
                counts.append(len(ids) // np.dtype(width).itemsize)
                size += counts[-1]
                if size >= SHARD:
                    yield shard()
                    held, docs, counts, size, seq = [], [], [], 0, seq + 1
        if docs:
            yield shard()

    # rows alike in doc_id and ids may lie in any order; their number keeps them from one task
    order = [F.col("d").asc_nulls_first(), F.crc32("ids"), F.monotonically_increasing_id()]
    ids = staged(encoded(df, path, end_id, doc_id, text), "ids").withColumns({"c": order[1], "r": order[2]})
    ordered = ids.repartitionByRange(order[0], "c", "r").sortWithinPartitions(order[0], "c", "r").select("d", "ids")
    return staged(in_batches(ordered, run, "part int, seq int, n_docs long, n_tokens long, image binary"), "wavelet", maxRecordsPerFile="1", compression="uncompressed")


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def read_documents(shards: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32: from the images alone.

    Starts are prefix sums over shards, in two levels: over the parts, then within a part.
    """
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each task of the writer
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    starts = sizes.withColumn("within", within).join(before, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("start"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, seq, image in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2)):
                w = WaveletMatrix(memoryview(image.as_buffer()))
                ids, (docs, counts) = w.all_ids().astype("<u4"), w.directory()
                edges = np.concatenate(([0], np.cumsum(counts)))
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(edges.tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(docs), pa.int32()), "seq": pa.array([seq] * len(docs), pa.int32()), "d": pa.array(docs, pa.int64()), "at": pa.array(edges[:-1], pa.int64()), "n": pa.array(counts, pa.int64()), "crc": pa.array(crc, pa.int64())})

    rows = in_batches(shards.select("part", "seq", "image"), run, "part int, seq int, d long, at long, n long, crc long")
    return rows.join(starts, ["part", "seq"]).select(F.col("d").alias(doc_id), (F.col("start") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
