"""Token ids as raw binary shards, with a minimal perfect hash index from document keys to places in them.

A shard is a pair of files:

* `shard-NNNNN.bin`: the ids of its documents one after another, little-endian, 2 bytes each if the vocabulary allows,
  else 4.
* `shard-NNNNN.idx`: the index. Keys are hashed level by level into bit arrays of twice their number; a key that meets no
  other in a level is settled there, the others go on to the next. A key's slot is the rank of its bit, so n keys take
  the slots 0..n-1. Slots hold a 32-bit fingerprint of the key, the first record of the key and how many records it has;
  records hold the offset of their first id. A lookup reads a few bits, one rank, one fingerprint: constant time.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, mix, new_folder, slices, small_batches, stored

MAGIC = b"MPHIDX01"
#: Text bytes of a shard, about, and distinct words that a task keeps encoded at a time.
SHARD_BYTES, CACHED_WORDS = 16 << 20, 400_000
ENCODED_BYTES = 4 << 20
#: Stands for a null key; real keys may not take it.
NULL_KEY = -(1 << 63)


# --- minimal perfect hash ---------------------------------------------------------------------------------------------


def _level(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return mix(keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))) % np.uint64(bits)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of booleans
        self.ranks = []
        settled = 0
        for bits in levels:
            self.ranks.append(settled + np.cumsum(bits, dtype=np.int64) - bits)
            settled += int(bits.sum())
        self.n = settled

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys.astype(np.uint64, copy=False)
        while len(left):
            size = max(64, 2 * len(left))
            at = _level(left, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
            if len(levels) > 64:
                raise ValueError("keys repeat")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A key outside the set gets some slot or -1: fingerprints tell."""
        keys = keys.astype(np.uint64, copy=False)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = _level(keys[open_], i, len(bits))
            hit = bits[at]
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        return out


# --- files ------------------------------------------------------------------------------------------------------------


def index_bytes(keys: np.ndarray, counts: np.ndarray, dtype: str) -> bytes:
    """Index of a shard whose records, in order, have these keys (equal ones adjacent) and numbers of ids."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    distinct = keys[starts].view(np.uint64)
    runs = np.diff(np.concatenate([starts, [len(keys)]])).astype("<u4")
    perfect = PerfectHash.build(distinct)
    slots = perfect.slots(distinct)
    prints, first, times = np.zeros(len(starts), "<u4"), np.zeros(len(starts), "<u8"), np.zeros(len(starts), "<u4")
    prints[slots], first[slots], times[slots] = fingerprints(distinct), starts, runs
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    levels = [np.packbits(x) for x in perfect.levels]
    head = json.dumps({"dtype": dtype, "records": len(keys), "keys": len(starts), "levels": [len(x) for x in perfect.levels]}).encode()
    parts = [MAGIC, struct.pack("<I", len(head)), head, *[x.tobytes() for x in levels], prints.tobytes(), first.tobytes(), times.tobytes(), offsets.tobytes()]
    return b"".join(parts)


class ShardIndex:
    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not an index")
        size = struct.unpack("<I", raw[8:12])[0]
        head, at = json.loads(raw[12 : 12 + size]), 12 + size
        self.dtype, self.records, keys = head["dtype"], head["records"], head["keys"]
        levels = []
        for bits in head["levels"]:
            n = (bits + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, n, at), count=bits).astype(bool))
            at += n
        self.perfect = PerfectHash(levels)
        self.columns = []
        for kind, n in (("<u4", keys), ("<u8", keys), ("<u4", keys), ("<u8", self.records + 1)):
            self.columns.append(np.frombuffer(raw, kind, n, at))
            at += n * int(kind[-1])
        if at != len(raw):
            raise ValueError("the index has another length")
        self.prints, self.first, self.times, self.offsets = self.columns

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record of each key and number of its records; -1 and 0 where the fingerprint differs."""
        keys = keys.view(np.uint64)
        slots = self.perfect.slots(keys)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == fingerprints(keys[known])
        safe = np.where(known, slots, 0)
        if not len(self.first):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        return np.where(known, self.first[safe].astype(np.int64), -1), np.where(known, self.times[safe].astype(np.int64), 0)


def _put(folder: str, name: str, chunks) -> None:
    files, base = pafs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    temp = f"{base}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(temp) as out:
        for x in chunks:
            out.write(x)
    files.move(temp, f"{base}/{name}")


def _get(folder: str, name: str) -> bytes:
    files, base = pafs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{base}/{name}") as f:
        return f.read()


# --- encoding ---------------------------------------------------------------------------------------------------------


# Fixed value: the pre-tokenizer pattern under which a run of letters and a run of punctuation are tokens apart.
APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A stem: Latin letters in lower case.
STEM = re.compile("[a-zß-öø-ÿ]+")
#: Stems that go to the model in one text.
JOINED = 4096
SPACE, LETTER, MARK, OTHER = range(4)


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """What each byte is (of two bytes: OTHER), and the byte in lower case."""
    kinds, lower = np.full(256, OTHER, np.uint8), np.arange(256, dtype=np.uint8)
    for c in range(33, 127):
        if not chr(c).isdigit():
            kinds[c] = LETTER if chr(c).isalpha() else MARK
        lower[c] = ord(chr(c).lower())
    kinds[[0x0A, 0x20]] = SPACE
    return kinds, lower


KINDS, LOWER = _byte_tables()


def _latin(raw: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> None:
    """Put the letters À to ÿ of two bytes into kinds and lower."""
    lead = np.flatnonzero(raw == 0xC3)
    after = raw[lead + 1]
    letter = (after != 0x97) & (after != 0xB7)
    lead, after = lead[letter], after[letter]
    kinds[lead] = kinds[lead + 1] = LETTER
    lower[lead + 1] += np.where(after < 0x9F, 0x20, 0).astype(np.uint8)


class WordEncoder:
    """Encodes pieces of texts apart, each once, which gives the ids of whole texts for tokenizers that drop white space and
    let no token span it. Texts are cut at spaces and line feeds only, so other white space is left to the tokenizer.

    Where the tokenizer's own settings allow (byte-level pieces of APART, lower case, a suffix on a word's last token), a
    word of Latin letters and then ASCII punctuation is cut into a stem in lower case and its tail, which words share; stems
    go to the model many in a text. Any other word goes through the whole tokenizer as it is.
    """

    def __init__(self, path: str, end_id: int):
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.kind = "<u4" if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16 else "<u2"
        made = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.plain = steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and made["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": APART}
        suffix = made["model"].get("end_of_word_suffix")
        self.plain = self.plain and bool(suffix)
        if self.plain:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        self.clear()

    def clear(self):
        self.words = {}
        self.ids, self.ends = np.empty(1 << 20, "<u4"), np.zeros(1 << 16, np.int64)
        self.ids[0], self.ends[1] = self.end_id, 1  # slot 0 closes a text

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and the number of ids of each."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), "<u4", int(sizes.sum())), sizes

    def _stems(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        got = [np.array(x.ids, "<u4") for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(got)
        sizes = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        if len(sizes) != len(words) or sizes.sum() != len(ids):
            raise ValueError("a stem's last token has no suffix")
        return ids, sizes

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.words) + 1
        while n + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
        at = self.ends[n]
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), "<u4")])
        self.ends[n + 1 : n + 1 + len(words)] = at + np.cumsum(sizes)
        self.ids[at : at + len(ids)] = ids
        self.words.update(zip(words, range(n, n + len(words))))

    def _learn(self, words: list[str]) -> np.ndarray:
        """Slots of words that are new."""
        stem = np.fromiter((self.plain and STEM.fullmatch(w) is not None for w in words), bool, len(words))
        slots = np.empty(len(words), np.int64)
        for at, encode in ((np.flatnonzero(stem), self._stems), (np.flatnonzero(~stem), self._whole)):
            if own := [words[i] for i in at.tolist()]:
                slots[at] = len(self.words) + 1 + np.arange(len(own))
                self._add(own, *encode(own))
        return slots

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Stems, tails and other words of all texts, and the number of them in each text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, ends, data = texts.buffers()
        bounds = np.frombuffer(ends, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.empty(0, np.uint8)
        bounds = bounds - bounds[0]
        kinds, lower = KINDS[raw], LOWER[raw]
        _latin(raw, kinds, lower)
        if not self.plain:
            kinds[kinds > SPACE] = OTHER
        before = np.empty_like(kinds)
        before[1:] = kinds[:-1]
        before[bounds[:-1][bounds[:-1] < len(raw)]] = SPACE
        full = kinds != SPACE
        first = full & (before == SPACE)
        cut = first | ((before == LETTER) & (kinds == MARK))
        odd = (kinds == OTHER) | ((before == MARK) & (kinds == LETTER))
        if odd.any():  # in such a word nothing is cut or changed
            start = np.flatnonzero(first)
            odd = np.repeat(np.logical_or.reduceat(odd, start), np.diff(start, append=len(raw)))
            at = len(raw) - len(odd)
            cut[at:] &= first[at:] | ~odd
            np.copyto(lower[at:], raw[at:], where=odd)
        offsets = np.append(np.flatnonzero(cut[full]), np.count_nonzero(full)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(lower[full]))
        return pieces, np.diff(np.searchsorted(np.flatnonzero(cut), bounds))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by the end id, and the number of ids of each text."""
        if len(self.words) > CACHED_WORDS:
            self.clear()
        pieces, many = self._cut(texts)
        pieces = pieces.dictionary_encode()
        own = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        slot = np.fromiter(map(self.words.get, own, repeat(-1)), np.int64, len(own))
        if len(new := np.flatnonzero(slot < 0)):
            slot[new] = self._learn([own[i] for i in new.tolist()])
        close = np.cumsum(many + 1) - 1
        used = np.zeros(len(pieces) + len(texts), np.int64)
        inside = np.ones(len(used), bool)
        inside[close] = False
        used[inside] = slot[np.asarray(pieces.indices)]
        start = self.ends[used]
        sizes = self.ends[used + 1] - start
        total = np.cumsum(sizes)
        at = np.repeat(start - (total - sizes), sizes)
        at += np.arange(len(at))
        return self.ids[at], np.diff(total[close], prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> WordEncoder:
    """A worker's encoder, with the words that it knows by now; it outlives a task."""
    return WordEncoder(path, end_id)


def id_column(ids: np.ndarray, counts: np.ndarray, kind: str) -> pa.Array:
    """The bytes of each text's ids, as one column made at once."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * int(kind[-1])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype(kind))])


# --- over tables ------------------------------------------------------------------------------------------------------


class Plan:
    """Ranges of doc_ids by their upper bounds. A range is one shard, or several if a single doc_id outweighs a shard: its
    rows are then dealt over as many shards as it takes. A few numbers for each shard."""

    def __init__(self, bounds: list[int], heavy: dict[int, int]):
        self.bounds = np.array(bounds, np.int64)
        self.parts = np.ones(len(bounds) + 1, np.int64)
        for key, n in heavy.items():
            self.parts[np.searchsorted(self.bounds, key)] = n
        self.first = np.concatenate([[0], np.cumsum(self.parts)])

    def __len__(self) -> int:
        return int(self.first[-1])

    def shard_of(self, keys: np.ndarray, salt: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bounds, keys)
        return (self.first[at] + salt % self.parts[at]).astype(np.int32)

    def shards_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key with every shard that may have it."""
        at = np.searchsorted(self.bounds, keys)
        n = self.parts[at]
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(keys, n), (np.repeat(self.first[at], n) + part).astype(np.int32)


def plan_shards(rows: DataFrame) -> Plan:
    """rows: doc_id, text. Bounds follow bytes: a doc_id stands in the quantiles once for every UNIT of its text, a rest by
    hash."""
    size = bytes_of("text") + 1
    total = rows.agg(F.sum(size)).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    key = F.coalesce("doc_id", F.lit(NULL_KEY))
    by = rows.groupBy(key.alias("key")).agg(F.sum(size).alias("b")).where(F.col("b") > SHARD_BYTES)
    heavy = {r["key"]: -(-r["b"] // SHARD_BYTES) for r in by.collect()}  # fewer than shards
    cuts = [i / shards for i in range(1, shards)]
    unit = max(1, SHARD_BYTES // 4096)
    times = F.floor(size / unit) + (F.pmod(F.xxhash64("doc_id", F.lit("rest")), F.lit(unit)) < size % unit).cast("long")
    weighted = rows.where("doc_id is not null").select("doc_id", times.alias("times")).where("times > 0").select("doc_id", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))) if cuts else rows
    bounds = set(weighted.agg(F.percentile_approx("doc_id", cuts, 10 * shards + 1000)).first()[0] or []) if cuts else set()
    for k in heavy:
        bounds |= {k} if k == NULL_KEY else {k - 1, k}
    return Plan(sorted(bounds), heavy)


class Shards:
    """Shards in a folder, the plan of their doc_ids, and the manifest (shard, records, tokens)."""

    def __init__(self, folder: str, plan: Plan, manifest: DataFrame):
        self.folder, self.plan, self.manifest = folder, plan, manifest

    def bases(self) -> DataFrame:
        """Ids in all shards before each; one row per shard."""
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        return self.manifest.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))


def _keys(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(column, NULL_KEY), dtype=np.int64)


def write_shards(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> Shards:
    """Encode whole texts and write shards in ascending doc_id order (nulls first; equal ids adjacent, by text hash).

    Shards hold about SHARD_BYTES of text each, or one text that is longer; rows of a doc_id that outweighs a shard, null
    too, are dealt over several. An empty table gives no shard. A null text has the end id alone; repeated rows are records of
    their own; other columns are ignored, whatever their names.
    """
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plan = plan_shards(row)
    small_batches(spark)

    def encode(batches):
        coder = encoder(tokenizer, end_id)
        for batch in batches:
            keys, texts = _keys(batch.column("doc_id")), batch.column("text")
            for lo, hi in slices(texts, ENCODED_BYTES):
                ids, counts = coder.encode(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[lo:hi]),
                        pa.array(plan.shard_of(keys[lo:hi], np.asarray(batch.column("salt")[lo:hi], np.int64))),
                        batch.column("tie")[lo:hi],
                        id_column(ids, counts, coder.kind),
                    ],
                    ["key", "shard", "tie", "ids"],
                )

    def write(batches):
        kind = encoder(tokenizer, end_id).kind
        shard, keys, ids = None, [], []

        def close():
            counts = np.array([len(x) for x in ids], np.int64) // int(kind[-1])
            _put(folder, f"shard-{shard:05d}.bin", ids)
            _put(folder, f"shard-{shard:05d}.idx", [index_bytes(np.array(keys, np.int64), counts, kind)])
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "records": [len(keys)], "tokens": [int(counts.sum())]})

        for batch in batches:
            for key, at, raw in zip(*[batch.column(c).to_pylist() for c in ("key", "shard", "ids")]):
                if at != shard and keys:
                    yield close()
                    keys, ids = [], []
                shard = at
                keys.append(key)
                ids.append(raw)
        if keys:
            yield close()

    salted = row.withColumn("tie", F.xxhash64("text")).withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)))
    encoded = salted.mapInArrow(encode, "key long, shard int, tie long, ids binary")
    dealt = encoded.repartitionById(len(plan), F.col("shard")).sortWithinPartitions("shard", "key", "tie")
    written = dealt.select("key", "shard", "ids").mapInArrow(write, "shard int, records long, tokens long")
    return Shards(folder, plan, stored(written, "manifest"))


def look_up(shards: Shards, keys: DataFrame) -> DataFrame:
    """Read the records of the doc_ids in `keys` through the index.

    Returns a row per record: doc_id, shard, at (place of its first id in the shard), n_tokens, ids_crc32. An id that was
    never written is told by its fingerprint (but for one in 2**32) and gives no row.
    """
    folder, plan = shards.folder, shards.plan

    def place(batches):
        for batch in batches:
            k, at = plan.shards_of(_keys(batch.column("doc_id")))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at)], ["key", "shard"])

    def fetch(shard: int, wanted: list[int]):
        index = ShardIndex(_get(folder, f"shard-{shard:05d}.idx"))
        payload = _get(folder, f"shard-{shard:05d}.bin")
        keys = np.array(wanted, np.int64)
        first, times = index.find(keys)
        record = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        keys, wide = np.repeat(keys, times), np.frombuffer(payload, index.dtype).astype("<u4")
        lo, hi = index.offsets[record].astype(np.int64), index.offsets[record + 1].astype(np.int64)
        crc = [zlib.crc32(wide[a:b]) for a, b in zip(lo.tolist(), hi.tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64(), mask=keys == NULL_KEY), pa.array(np.full(len(keys), shard, np.int32)), pa.array(lo), pa.array(hi - lo), pa.array(crc, pa.int64())],
            ["doc_id", "shard", "at", "n_tokens", "ids_crc32"],
        )

    def read(batches):
        shard, wanted = None, []
        for batch in batches:
            for key, at in zip(batch.column("key").to_pylist(), batch.column("shard").to_pylist()):
                if at != shard and wanted:
                    yield fetch(shard, wanted)
                    wanted = []
                shard = at
                wanted.append(key)
        if wanted:
            yield fetch(shard, wanted)

    distinct = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(place, "key long, shard int")
    distinct = distinct.join(shards.manifest.select("shard"), "shard", "left_semi")
    dealt = distinct.repartitionById(len(plan), F.col("shard")).sortWithinPartitions("shard").select("key", "shard")
    return dealt.mapInArrow(read, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")


def token_table(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write all documents, then look all of them up: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = write_shards(spark, docs, folder or new_folder(spark, "tokens"), tokenizer)
    found = look_up(shards, docs)
    return found.join(shards.bases(), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
