"""Token ids in binary shards, with keyed access by a minimal perfect hash.

Layout of a folder:

* ``tokens-NNNNNN.bin``: raw little-endian ids of one range of doc_id, documents
  in ascending order (null first), each closed by the end id; 16-bit if the
  vocabulary fits, else 32-bit.
* ``index-NNNNNN.mph``: one part of the index, chosen by the key's hash. Header
  (levels, bits, keys as 64-bit numbers), level sizes, packed bits, then per
  slot a 32-bit fingerprint of the key, shard, first id in the shard, ids.
* ``entries``: a table of the documents' addresses, from which the index is built.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.llm import files, perfect_hash
from skyquilt.llm.memory import bound_batches, tidy
from skyquilt.llm.queries import query, table

SHARD_CHARS = 8 << 20
PART_KEYS = 65_536
CACHE_WORDS = 400_000
#: Letters of the Latin-1 block.
LATIN = "À-ÖØ-öø-ÿ"
END = 0
ENTRY = "doc_id long, repeat long, shard int, first long, n_tokens long"
_SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("n", "<u8")])


class Encoder(dict):
    """Whole texts to ids by the tokenizers library; holds the ids of words met lately.

    A byte-level splitter never joins what precedes a single space with what
    follows it, so such texts are encoded word by word. A text with other white
    space before a space, or with one of the file's added tokens, is encoded as
    a whole. In a word of Latin letters, ASCII digits and ASCII punctuation the
    splitter's pieces are runs of each kind, which the library's model takes
    directly; a single line break between two such words is a piece of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        # native order is little-endian on every platform that Spark runs on
        self.code = {2: "H", 4: "I"}[np.dtype(self.dtype).itemsize]
        self.older: dict[str, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.runs = re.compile(r"\s ").search
        self.plain = re.compile(f"[A-Za-z{LATIN}]+").fullmatch
        self.simple = re.compile(f"[!-~{LATIN}]+").fullmatch
        self.closed = re.compile(f"([A-Za-z{LATIN}]+)([!-/:-@\\[-`{{-~]+)").fullmatch
        # the splitter's rule on such words: short forms, then runs with the space before them
        self.runs_of = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z{LATIN}]+| ?[0-9]+| ?[^A-Za-z{LATIN}0-9 ]+").findall
        self.by_word = self._parts_at_spaces()
        if self.by_word:
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.letters = {ord(c): split(c)[0][0] for c in map(chr, range(0xC0, 0x100)) if self.plain(c)}
            self.letters[32] = split(" ")[0][0]
            self.line = self._whole("\n")
            self.pieces: dict[str, bytes] = {}

    def _parts_at_spaces(self) -> bool:
        """Whether the file is byte-level with no normalizer and no added prefix, as the rule above needs."""
        made = json.loads(self.tokenizer.to_str())
        pre = made["pre_tokenizer"] or {}
        return pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not made["normalizer"]

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _made(self, piece: str) -> bytes:
        # of ASCII only the space has another letter, and a table is slow to ask
        letters = piece.replace(" ", self.letters[32]) if piece.isascii() else piece.translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        made = self.pieces.get(piece)
        if made is None:
            if len(self.pieces) >= CACHE_WORDS // 4:
                self.pieces.clear()
            self.pieces[piece] = made = self._made(piece)
        return made

    def _word(self, word: str) -> bytes:
        """Ids of a word with the space before it."""
        if self.plain(word):
            return self._made(f" {word}")
        if parts := self.closed(word):  # letters, then signs: the letters are known in any company
            return self[parts[1]] + self._piece(parts[2])
        first, *lines = word.split("\n")
        if not all(map(self.simple, (first, *lines))):
            return self._whole(f" {word}")
        if not lines:
            return b"".join(map(self._piece, self.runs_of(f" {word}")))
        out = [self[first]]
        for line in lines:
            out.append(self.line)
            out.extend(map(self._piece, self.runs_of(line)))
        return b"".join(out)

    def __missing__(self, word: str) -> bytes:
        if "\n" in word:  # two words that a line break joins hardly come again
            return self._word(word)
        if len(self) >= CACHE_WORDS:  # two generations: words in use are carried over
            self.older = dict(self)
            self.clear()
        made = self.older.get(word)
        self[word] = made = self._word(word) if made is None else made
        return made

    def encode(self, text: str) -> bytes:
        if not self.by_word or self.runs(text) or any(map(text.__contains__, self.added)):
            return self._whole(text)
        first, *rest = text.split(" ")
        return self._whole(first) + b"".join(map(self.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _shard_name(folder: str, shard: int) -> str:
    return f"{folder}/tokens-{shard:06d}.bin"


def _shard_writer(folder: str, vocabulary: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, shard = encoder(vocabulary), TaskContext.get().partitionId()
        width, end = np.dtype(enc.dtype).itemsize, np.array([END], enc.dtype).tobytes()
        sink, at, last, repeat = files.Sink(_shard_name(folder, shard)), 0, None, 0
        try:
            for part in parts:
                rows = []
                for missing, doc, text in zip(part["doc_id"].isna(), part["doc_id"], part["text"], strict=True):
                    data = (enc.encode(text) if text else b"") + end
                    doc = None if missing else int(doc)
                    repeat = repeat + 1 if at and doc == last else 0
                    last, n = doc, len(data) // width
                    sink.write(data)
                    rows.append((doc, repeat, shard, at, n))
                    at += n
                yield pd.DataFrame(rows, columns=["doc_id", "repeat", "shard", "first", "n_tokens"]).astype({"doc_id": "Int64"})
        except BaseException:
            sink.abandon()
            raise
        sink.close()

    return run


def _shard_totals(entries: DataFrame) -> pd.DataFrame:
    """One row per shard: ids of all shards before it, and repeats of its first id in them.

    Collected: its size is the number of shards, not of documents.
    """
    edge = F.struct("first", "doc_id", "repeat")
    # two aggregations over equal keys share one exchange
    rows = (entries.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.min(edge).alias("lo"), F.max(edge).alias("hi"))
            .orderBy("shard").collect())
    out, start, last, seen = [], 0, None, 0
    for r in rows:
        same = last is not None and r.lo.doc_id == last[0]
        before = seen if same else 0
        out.append((r.shard, start, r.lo.doc_id, before))
        start += r.n
        run = r.hi.repeat + 1
        seen = run + (before if r.hi.doc_id == r.lo.doc_id else 0)
        last = (r.hi.doc_id,)
    return pd.DataFrame(out, columns=["shard", "start", "edge_id", "before"])


def keys_of(doc_id: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """64-bit keys: a bijection of doc_id, changed by the number of the repeat."""
    key = perfect_hash.mix(doc_id.astype(np.int64).view(np.uint64))
    again = repeat > 0
    if again.any():
        key[again] = perfect_hash.mix(key[again] + repeat[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 7)
    return key


def prints(keys: np.ndarray) -> np.ndarray:
    return (perfect_hash.mix(keys, 101) >> np.uint64(32)).astype(np.uint32)


def index_bytes(keys: np.ndarray, shard: np.ndarray, first: np.ndarray, n: np.ndarray) -> bytes:
    bits, sizes = perfect_hash.build(keys)
    slots = np.zeros(len(keys), _SLOT)
    at = perfect_hash.Lookup(bits, sizes).slots(keys)
    for name, values in (("print", prints(keys)), ("shard", shard), ("first", first), ("n", n)):
        slots[name][at] = values
    head = np.array([len(sizes), len(bits), len(keys)], "<i8")
    return head.tobytes() + sizes.astype("<i8").tobytes() + np.packbits(bits).tobytes() + slots.tobytes()


class Part:
    """One part of the index in memory; a lookup takes a constant number of steps per key."""

    def __init__(self, data: bytes):
        levels, n_bits, n = np.frombuffer(data, "<i8", 3)
        at = 24 + 8 * int(levels)
        sizes = np.frombuffer(data, "<i8", int(levels), 24)
        packed = np.frombuffer(data, np.uint8, -(-int(n_bits) // 8), at)
        self.find = perfect_hash.Lookup(np.unpackbits(packed, count=int(n_bits)).astype(bool), sizes)
        self.slots = np.frombuffer(data, _SLOT, int(n), at + len(packed))

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there by its fingerprint, and its slot's record."""
        if not len(self.slots):
            return np.zeros(len(keys), bool), np.zeros(len(keys), _SLOT)
        at = self.find.slots(keys)
        rows = self.slots[np.maximum(at, 0)]
        return (at >= 0) & (rows["print"] == prints(keys)), rows


def _part_name(folder: str, part: int) -> str:
    return f"{folder}/index-{part:06d}.mph"


def _with_part(rows: DataFrame, parts: int) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "repeat"), F.lit(parts)).cast("int"))


class TokenFiles:
    """Handle of a written folder."""

    def __init__(self, spark: SparkSession, folder: str, dtype: str, parts: int, entries: DataFrame, totals: pd.DataFrame):
        self.spark, self.folder, self.dtype, self.parts, self.entries, self.totals = spark, folder, dtype, parts, entries, totals

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``(doc_id, repeat, shard, first, n_tokens)`` for each row of ``keys(doc_id, repeat)`` that the index holds."""
        folder = self.folder

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            name, part = -1, None
            for rows in parts:
                for k, group in rows.groupby("part", sort=True):
                    if k != name:
                        name, part = k, Part(files.read_all(_part_name(folder, k)))
                    there, slot = part.get(keys_of(group["doc_id"].to_numpy(), group["repeat"].to_numpy()))
                    yield pd.DataFrame({
                        "doc_id": group["doc_id"].to_numpy(), "repeat": group["repeat"].to_numpy(),
                        "shard": slot["shard"].astype(np.int32), "first": slot["first"].astype(np.int64),
                        "n_tokens": slot["n"].astype(np.int64)})[there]

        rows = _with_part(keys.select("doc_id", "repeat").dropna(), self.parts)
        return rows.repartition("part").sortWithinPartitions("part").mapInPandas(run, ENTRY)

    def read(self, addresses: DataFrame, schema: str, make) -> DataFrame:
        """Rows ``make(address, start, ids)`` for each address, the shards read in order."""
        folder, dtype = self.folder, self.dtype
        starts = self.spark.sparkContext.broadcast(dict(zip(self.totals["shard"], self.totals["start"], strict=True)))  # a number per shard
        names = [c.split()[0] for c in schema.split(",")]
        width = np.dtype(dtype).itemsize

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            name, f = -1, None
            for rows in parts:
                out = []
                for r in rows.itertuples(index=False):
                    if r.shard != name:
                        store, path = files.locate(_shard_name(folder, r.shard))
                        name, f = r.shard, store.open_input_file(path)
                    ids = np.frombuffer(f.read_at(int(r.n_tokens) * width, int(r.first) * width), dtype)
                    out.append(make(r, int(starts.value[r.shard]) + int(r.first), ids))
                yield pd.DataFrame(out, columns=names)

        return addresses.repartition("shard").sortWithinPartitions("shard", "first").mapInPandas(run, schema)


def write(docs: DataFrame, vocabulary: str, folder: str | None = None) -> TokenFiles:
    """Encode all documents into a folder (by default a new one in the shared folder) and index it.

    Rows go in ascending doc_id order, null ids first, rows of one id in the
    order of their text's hash. A null text is an empty one, of which only the
    end id is written. Repeated ids are indexed by (doc_id, repeat number); null
    ids have no key and are reached by their address alone. Other columns are
    not read. Empty tables give a folder without documents.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or session.scratch(spark, "tokens")
    dtype = encoder(vocabulary).dtype
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    # the text's hash and the row's number split an id that many rows share
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "h", "row"]
    ranged = rows.repartitionByRange(max(1, -(-int(chars) // SHARD_CHARS)), *order).sortWithinPartitions(*order)
    ranged.select("doc_id", "text").mapInPandas(tidy(_shard_writer(folder, vocabulary)), ENTRY).write.parquet(f"{folder}/entries")
    entries = spark.read.schema(ENTRY).parquet(f"{folder}/entries")
    totals = _shard_totals(entries)
    again = [(int(r.shard), int(r.edge_id), int(r.before)) for r in totals.itertuples() if r.before and not pd.isna(r.edge_id)]
    if again:  # an id that continues from one shard to the next; a row per shard at most
        more = F.broadcast(spark.createDataFrame(again, "shard int, doc_id long, before long"))
        entries = entries.join(more, ["shard", "doc_id"], "left").select(
            "doc_id", (F.col("repeat") + F.coalesce("before", F.lit(0))).alias("repeat"), "shard", "first", "n_tokens")
    keyed = entries.dropna(subset=["doc_id"])
    parts = max(1, -(-keyed.count() // PART_KEYS))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        keys = keys_of(part["doc_id"].to_numpy(), part["repeat"].to_numpy())
        sink = files.Sink(_part_name(folder, int(part["part"].iloc[0])))
        sink.write(index_bytes(keys, part["shard"].to_numpy(), part["first"].to_numpy(), part["n_tokens"].to_numpy()))
        sink.close()
        return pd.DataFrame({"part": part["part"].iloc[:1], "n_keys": [len(part)]})

    # parts are cut by a hash of distinct keys, so each holds about PART_KEYS
    _with_part(keyed, parts).groupBy("part").applyInPandas(build, "part int, n_keys long").write.parquet(f"{folder}/parts")
    return TokenFiles(spark, folder, dtype, parts, entries, totals)


def _digest_row(r, start: int, ids: np.ndarray) -> tuple:
    return None if pd.isna(r.doc_id) else int(r.doc_id), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), int(r.repeat)


def digests(made: TokenFiles) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, repeat)`` of every document, read back through the index."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, repeat long"
    keyed = made.lookup(made.entries)
    unkeyed = made.entries.filter("doc_id is null")
    return made.read(keyed.unionByName(unkeyed), schema, _digest_row)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op2_token_files")
def op2_token_files(spark, sf):
    return digests(write(table(spark, sf, "documents"), public_vocabulary()))
