"""Token ids as binary shards (op 7): every document a frame of its own, under one trained Zstandard dictionary.

A shard, little-endian: magic, dictionary SHA-256 (32 bytes), id width in bytes (u8); frames, one for a
document; the index, a frame of its own: doc_id i64[n], frame offset u64[n], tokens u64[n]; then index offset u64, n u64, magic.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import files, tokens

MAGIC = b"CQTOKEN1"
HEAD, TAIL = "<8s32sB", "<QQ8s"
NULL_ID = -(1 << 63)
#: The dictionary is trained on one slice of each of this many documents at most (those with the smallest hashes of id and text),
#: of at most so many characters, at a place that the hash chooses.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 16384, 32768
#: A shard is closed when it holds so many bytes.
SHARD_BYTES = 256 << 20
#: Texts are encoded in parts of about so many characters.
PART = 8 << 20
#: So many new words of letters are merged at once.
TOGETHER = 32
_WHITE = re.compile(r"\s")


def width_of(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A dictionary from serialized id arrays of a bounded sample of all documents. What the trainer refuses, as too little or too much alike, is a dictionary as it is."""
    import zstandard

    h = F.xxhash64("doc_id", "text")
    begin = F.pmod(h, F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    texts = C.texts_of(docs, id_col, text_col).where("text <> ''")
    rows = texts.select(h.alias("h"), F.substring(F.col("text"), begin.cast("int"), F.lit(SAMPLE_CHARS)).alias("slice")).orderBy("h", "slice").limit(SAMPLE_DOCS).collect()
    kind = f"<u{width_of(tokenizer_path)}"
    samples = [x.tobytes() for x in encode(tokenizer_path, [r["slice"] for r in rows], kind)] if rows else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        ends = np.full(8, end_id or 0, kind).tobytes()
        return (ends + b"".join(samples))[-DICTIONARY_BYTES:]


class Packed(tokens.Memo):
    """Ids as bytes, of many texts at a time: their words in one Arrow dictionary, so that each different word is looked up once for a call.

    A word stands behind a space or, its key then beginning with a line's end, behind that. Both are safe cuts, if no other
    white space is near; texts that have such white space go through sums."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        form = "H" if kind == "<u2" else "I"
        super().__init__(path, lambda ids: array(form, ids).tobytes())
        self.kind = kind
        self.plain = self.plain and not any(c.isspace() for t in self.library.get_added_tokens_decoder().values() for c in t.content)
        #: Merges what is given as one pre-token.
        self.merger = Tokenizer(self.model)
        space = self.letters[32]
        self.begins = np.zeros(max(self.library.get_vocab(True).values(), default=0) + 1, bool)
        self.begins[[i for t, i in self.library.get_vocab(False).items() if t.startswith(space)]] = True
        ends = {a for a, b in self.inner if b == 32}
        #: Letters that some token may hold together with a space behind them.
        self.sticky = {c for c in map(chr, range(ord(tokens._LATIN))) if c.isalpha() and c.encode()[-1] in ends}

    def pack(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not self.plain:
            return self.encode(texts)
        out: list[bytes] = [b""] * len(texts)
        for a, b in C.parts([len(t) for t in texts], PART):
            if b - a > 1 or len(texts[a]) <= PART:
                out[a:b] = self.pack_part(texts[a:b])
            else:
                out[a] = b"".join(x for c in _cut(texts[a]) for x in (self.pack_part([c]) if len(c) <= 2 * PART else self.sums([c])[0]))
        return out

    def pack_part(self, texts: list[str]) -> list[bytes]:
        # A line's end before each text makes its first word one like others; its id is left out below.
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(pa.array(texts, pa.string()), "\n", " \n"), ""), " ")
        ends = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        values, odd = self.values(words)
        at = coded.indices.to_numpy()
        bad = np.zeros(len(words), bool)
        bad[odd] = True
        bad = bad[at]
        for k in np.flatnonzero(pc.starts_with(coded.dictionary, "\n").to_numpy(zero_copy_only=False)).tolist():
            values[k] = self.line + values[k]
            if words[k] == "\n":
                bare = at == k
                bad[1:] |= bare[1:] & bare[:-1]  # more line's ends in a row may be one pre-token
        ids = pa.array(values, pa.binary()).take(coded.indices)
        starts, data = np.frombuffer(ids.buffers()[1], np.int32)[ends].tolist(), memoryview(ids.buffers()[2] or b"")
        skip = len(self.line)
        out = [bytes(data[a + skip : b]) for a, b in zip(starts, starts[1:], strict=False)]
        if bad.any():
            some = np.unique(np.searchsorted(ends, np.flatnonzero(bad), "right") - 1).tolist()
            for k, x in zip(some, self.sums([texts[k] for k in some]), strict=True):
                out[k] = b"".join(x)
        return out

    def learn(self, words: set[str]) -> dict[str, object]:
        """As Memo has it; words that hold white space are right between the cuts of sums alone and not remembered."""
        known = super().learn(words)
        self.passing += filter(_WHITE.search, words)
        return known

    def values(self, words: list[str]) -> tuple[list[bytes], list[int]]:
        """What is kept of different words, and at which places are none: empty ones, or such that hold white space."""
        for w in self.passing:
            self.new.pop(w, None)
        self.passing = []
        if len(self.new) > tokens.CACHE:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        values = list(map(new.get, words))
        letters, others, slow, odd = [], [], [], []
        for k in [k for k, v in enumerate(values) if v is None]:
            w = words[k]
            if (v := old.get(w)) is not None:
                new[w] = values[k] = v
            elif w.isalpha() and len(w) <= 100 and (w.isascii() or max(w) < tokens._LATIN) and w[-1] not in self.sticky:
                letters.append(k)
            else:
                others.append(k)
        for k, v in zip(letters, self.merged([words[k] for k in letters]), strict=True):
            new[words[k]] = values[k] = v
        for k in others:
            w = words[k]
            v = b"" if w == "\n" else self.letters_of("", w[1:]) if w[:1] == "\n" else self.letters_of(" ", w)
            if v is not None:
                new[w] = values[k] = v
                if len(w) > 100:
                    self.passing += [w, w.rstrip(tokens.TAIL)]
            elif not w or _WHITE.search(w, w[0] == "\n"):
                values[k] = b""
                odd.append(k)
            else:
                slow.append(k)
        for k, v in zip(slow, self.encode([w[1:] if w[0] == "\n" else " " + w for w in map(words.__getitem__, slow)]), strict=True):
            values[k] = v
            if len(words[k]) <= 100:
                new[words[k]] = v
        return values, odd

    def merged(self, words: list[str]) -> list[bytes]:
        """What is kept of words of letters, each behind a space. No token goes on over such a space, so that the library merges some words at once and parts of its ids begin where a space does."""
        text = [" " + " ".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
        text = [t.replace(" ", self.letters[32]) if t.isascii() else t.encode().decode("latin-1").translate(self.letters) for t in text]
        ids = np.array([i for e in self.merger.encode_batch_fast(text, add_special_tokens=False) for i in e.ids], self.kind)
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(words):
            return [self.one(" " + w) for w in words]
        data, size = ids.tobytes(), ids.itemsize
        ends = [*(starts * size).tolist(), len(data)]
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _cut(text: str) -> Iterator[str]:
    """A long text in parts that begin at safe cuts, about PART characters apart where there are such."""
    begin = 0
    while len(text) - begin > PART and (m := tokens.SAFE.search(text, begin + PART)):
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:]


def encode(path: str, texts: list[str], kind: str) -> list[np.ndarray]:
    if (path, kind) not in tokens._made:
        tokens._made[path, kind] = Packed(path, kind)
    return [np.frombuffer(x, kind) for x in tokens._made[path, kind].pack(texts)]


class Writer:
    """One shard under construction."""

    def __init__(self, folder: str, name: tuple[int, int, int], data: bytes, width: int):
        import zstandard

        self.out, self.name = files.Output(folder, "shard-{:06d}-{}-{:04d}.cqt".format(*name)), name
        self.pack = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=True, write_dict_id=False)
        self.index, self.total = [], 0
        self.out.write(struct.pack(HEAD, MAGIC, hashlib.sha256(data).digest(), width))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((NULL_ID if doc_id is None else doc_id, self.out.at, len(ids)))
        self.total += len(ids)
        self.out.write(self.pack.compress(ids.tobytes()))

    def close(self) -> tuple[int, int, int, int, int]:
        import zstandard

        at, table = self.out.at, np.array(self.index, np.int64).reshape(-1, 3)
        self.out.write(zstandard.ZstdCompressor(level=3, write_content_size=True).compress(np.ascontiguousarray(table.T).astype("<i8").tobytes()))
        self.out.write(struct.pack(TAIL, at, len(self.index), MAGIC))
        self.out.done()
        return (*self.name, len(self.index), self.total)


def shards_of(docs: Iterator[tuple[int | None, np.ndarray]], folder: str, attempt: tuple[int, int], data: bytes, width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Writes documents to shards of about SHARD_BYTES; yields what each holds."""
    writer, number = None, 0
    for doc_id, ids in docs:
        writer = writer or Writer(folder, (*attempt, number), data, width)
        writer.add(doc_id, ids)
        if writer.out.at >= SHARD_BYTES:
            yield writer.close()
            writer, number = None, number + 1
    if writer is not None:
        yield writer.close()


_WRITTEN = pa.schema([(x, pa.int64()) for x in ("shard", "attempt", "number", "n_docs", "n_tokens")])


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", dictionary: bytes | None = None) -> list[tuple[int, int, int, int, int]]:
    """Writes shards shard-PARTITION-ATTEMPT-NUMBER.cqt in ascending id order; returns (partition, attempt, number, documents, tokens) of each.

    Rows are dealt by ranges of ids, rows that share an id, or have none, by ranges of their first 64 characters and a hash of
    the text; they are sorted so and encoded where they are written, a new shard after each SHARD_BYTES. Null text: only the end id; null ids come first; repeated rows are each written; very long texts are encoded
    between safe cuts and are a frame of their own; an empty table writes nothing; further columns are ignored.
    """
    data = train_dictionary(docs, tokenizer_path, end_id, id_col, text_col) if dictionary is None else dictionary
    width = width_of(tokenizer_path)
    kind = f"<u{width}"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in C.parts([len(t) for t in texts], PART):
                for i, x in zip(ids[a:b], encode(tokenizer_path, texts[a:b], kind), strict=True):
                    yield i, x if end_id is None else np.append(x, np.array([end_id], kind))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.only(tokens._made)
        for done in shards_of(encoded(batches), folder, files.attempt(), data, width):
            yield C.table_rows(_WRITTEN, [done])

    rows = C.texts_of(docs, id_col, text_col)
    n = C.buckets(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    order = [F.col("doc_id"), F.substring("text", 1, 64), F.xxhash64("text")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    return sorted(map(tuple, dealt.mapInArrow(write, "shard long, attempt long, number long, n_docs long, n_tokens long").collect()))


class Shard:
    """A shard's documents, each read by itself through the index."""

    def __init__(self, content: bytes, dictionary: bytes):
        import zstandard

        magic, digest, self.width = struct.unpack_from(HEAD, content)
        at, n, end = struct.unpack_from(TAIL, content, len(content) - struct.calcsize(TAIL))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a token shard, or cut short")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        raw = zstandard.ZstdDecompressor().decompress(content[at : len(content) - struct.calcsize(TAIL)])
        self.doc_ids, self.offsets, self.n_tokens = np.frombuffer(raw, "<i8").reshape(3, n)
        self.ends = np.append(self.offsets[1:], at)
        self.content = content
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(self.content[self.offsets[k] : self.ends[k]]), f"<u{self.width}")


def read_tokens(spark, folder: str, shards: list[tuple[int, int, int, int, int]], dictionary: bytes, with_ids: bool = False) -> DataFrame:
    """Per document of the shards: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as u32), and ids if asked for.

    shards holds five numbers for each shard."""
    starts, total = {}, 0
    for shard, tried, number, _, n in shards:
        starts[shard, tried, number] = total
        total += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = starts.get((*files.wrote(path), files.number(path)))
                if start is None:
                    continue
                shard = Shard(content.as_py(), dictionary)
                rows = []
                for k, (i, n) in enumerate(zip(shard.doc_ids.tolist(), shard.n_tokens.tolist(), strict=True)):
                    x = shard.ids(k)
                    rows.append((None if i == NULL_ID else i, start, n, zlib.crc32(x.astype("<u4").tobytes()), *([x.tolist()] if with_ids else [])))
                    start += n
                fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
                yield C.table_rows(pa.schema(fields), rows)

    if not shards:
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.cqt").load(folder).select("path", "content").mapInArrow(read, schema)


def token_file(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the token shards of all texts to a folder (a new shared one, if none is given) and reads them back; see write_tokens and read_tokens."""
    spark = C.session(docs)
    folder = folder or C.shared(spark)
    dictionary = train_dictionary(docs, tokenizer_path, end_id, id_col, text_col)
    shards = write_tokens(docs, folder, tokenizer_path, end_id, id_col, text_col, dictionary)
    if shards:
        out = files.Output(folder, "dictionary.zdict")
        out.write(dictionary)
        out.done()
    return read_tokens(spark, folder, shards, dictionary)
