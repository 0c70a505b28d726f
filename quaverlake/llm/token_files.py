"""Token-ID output in directly addressable codes.

A file holds the ids of consecutive documents.  Each id is split into chunks of a
few bits, lowest first; level ``k`` holds the ``k``-th chunks of the ids that have
one, and a bitmap says which of them go on.  A rank directory counts the set bits
before each block of the bitmap, so that the place of an id's next chunk is a sum of
two numbers, and any token is read without decoding others.

File layout: the magic, a JSON header's length and the header, then its arrays in
order: document ids, their null flags, first token of each document, and for each
level the chunks, the bitmap and the rank directory.

Documents are range-partitioned and sorted by id; each task writes files of bounded
size to the shared folder, under a temporary name that is then renamed, so a task
that runs again replaces its files.  The offset of each file is a prefix sum over
the written files, one small row each.  Each document is read from its first token
on, through the rank directories, without decoding others.

Defined cases: null text is empty; every document ends with ``end_id``, so none has
zero tokens; documents with null ids come first and keep their null; repeated ids
stay separate documents, in order of their text's hash; very long texts are encoded
whole; extra columns take no part; an empty table writes no file.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Remembered, byte_characters, cut, new_folder, table

MAGIC = b"DACTOK01"
#: Bits of each chunk; the last level takes all that is left of 32.
CHUNKS = (8, 4, 4, 16)
RANK_BLOCK = 512
FILE_TOKENS = 1 << 22
#: Bytes of one generation of remembered pieces, in each Python worker.
CACHE_BYTES = 120 << 20


# --- the codes -------------------------------------------------------------


def encode_ids(ids: np.ndarray, chunks: tuple[int, ...] = CHUNKS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (chunks, bitmap bytes, rank directory)."""
    left, levels = ids.astype(np.uint32), []
    for bits in chunks:
        chunk = left & np.uint32((1 << bits) - 1) if bits < 32 else left
        rest = left >> np.uint32(bits)
        on = rest > 0
        packed = np.packbits(on, bitorder="little")
        counts = np.add.reduceat(on, np.arange(0, len(on), RANK_BLOCK), dtype=np.int64) if len(on) else np.zeros(0, dtype=np.int64)
        levels.append((pack(chunk, bits), packed, np.cumsum(counts) - counts))
        left = rest[on]
        if not len(left):
            break
    if len(left):
        raise ValueError("an id needs more bits than the chunks have")
    return levels


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    if bits == 4:
        padded = np.append(values, 0) if len(values) % 2 else values
        return (padded[::2] | padded[1::2] << np.uint32(4)).astype(np.uint8)
    return values.astype({8: np.uint8, 16: np.uint16}[bits])


def unpack(stored: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    if bits == 4:
        return stored[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & np.uint8(15)
    return stored[at]


def decode_at(levels, at: np.ndarray, chunks: tuple[int, ...] = CHUNKS) -> np.ndarray:
    """The ids at some places, each by its own chunks only."""
    out, which, shift = np.zeros(len(at), dtype=np.uint32), np.arange(len(at)), 0
    for bits, (stored, bitmap, ranks) in zip(chunks, levels, strict=False):
        out[which] |= unpack(stored, bits, at).astype(np.uint32) << np.uint32(shift)
        on = (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        which, at, shift = which[on], at[on], shift + bits
        if not len(at):
            break
        at = rank(bitmap, ranks, at)
    return out


def rank(bitmap: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits before each place: the directory's count, and those of its block."""
    block = at // RANK_BLOCK
    first = block * (RANK_BLOCK // 8)
    inside = np.minimum(first[:, None] + np.arange(RANK_BLOCK // 8), len(bitmap) - 1) if len(at) < 4096 else None
    if inside is None:  # many places: count once over the bitmap
        before = np.cumsum(np.bitwise_count(bitmap), dtype=np.int64) - np.bitwise_count(bitmap)
        return before[at >> 3] + np.bitwise_count(bitmap[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8))
    whole = np.where(inside < (at >> 3)[:, None], np.bitwise_count(bitmap[inside]), 0).sum(axis=1, dtype=np.int64)
    return ranks[block] + whole + np.bitwise_count(bitmap[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8))


def consecutive(stored: np.ndarray, bits: int, at: int, n: int) -> np.ndarray:
    """``unpack`` of ``n`` places from ``at`` on."""
    if bits == 4:
        pairs = stored[at >> 1 : (at + n + 1) >> 1]
        both = np.empty(2 * len(pairs), dtype=np.uint8)
        both[::2], both[1::2] = pairs & np.uint8(15), pairs >> np.uint8(4)
        return both[at & 1 : (at & 1) + n]
    return stored[at : at + n]


def rank_of(bitmap: np.ndarray, ranks: np.ndarray, at: int) -> int:
    """``rank`` of one place."""
    block = at // RANK_BLOCK
    inside = int.from_bytes(bitmap[block * (RANK_BLOCK // 8) : (at >> 3) + 1].tobytes(), "little")
    return int(ranks[block]) + (inside & ((1 << (at - block * RANK_BLOCK)) - 1)).bit_count()


def to_bytes(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    arrays = [np.array([d or 0 for d in doc_ids], dtype="<i8"), nulls, starts.astype("<i8")]
    levels = encode_ids(ids)
    for level in levels:
        arrays += level
    header = {"tokens": len(ids), "docs": len(doc_ids), "chunks": CHUNKS[: len(levels)], "arrays": [[a.dtype.str, len(a)] for a in arrays]}
    head = json.dumps(header).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays)


class TokenFile:
    """A file's content, for random access."""

    def __init__(self, content: bytes):
        if content[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        at = len(MAGIC) + 4
        size = int.from_bytes(content[at - 4 : at], "little")
        self.header, at, arrays = json.loads(content[at : at + size]), at + size, []
        for kind, n in self.header["arrays"]:
            arrays.append(np.frombuffer(content, dtype=kind, count=n, offset=at))
            at += arrays[-1].nbytes
        self.doc_ids, self.nulls, self.starts = arrays[:3]
        self.levels = [tuple(arrays[k : k + 3]) for k in range(3, len(arrays), 3)]
        self.tokens = self.header["tokens"]

    def token(self, at: int) -> int:
        return int(decode_at(self.levels, np.array([at]))[0])

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Consecutive ids: their chunks are consecutive in each level, from the first one's rank on."""
        out, which, shift, at, n = np.zeros(stop - start, dtype=np.uint32), None, 0, start, stop - start
        for bits, (stored, bitmap, ranks) in zip(self.header["chunks"], self.levels, strict=True):
            if not n:
                break
            chunk = consecutive(stored, bits, at, n).astype(np.uint32) << np.uint32(shift)
            if which is None:
                out |= chunk
            else:
                out[which] |= chunk
            on = np.unpackbits(bitmap[at >> 3 : (at + n + 7) >> 3], bitorder="little")[at & 7 : (at & 7) + n]
            going = np.flatnonzero(on)
            which, shift, n = going if which is None else which[going], shift + bits, len(going)
            if n:
                at = rank_of(bitmap, ranks, at)
        return out


# --- tokens of texts -------------------------------------------------------

#: White space of the byte-level pattern but for the space, as characters of a class.
OTHER_SPACE = "\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = " " + OTHER_SPACE
#: Pieces at whose borders the pattern always splits.
PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A word of Latin letters, which the pattern takes whole, and punctuation after it, which it takes apart.
WORD = re.compile("( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")
#: Each of the white space but for the space and the line end.
RARE_SPACE = [c for c in map(chr, range(0x3001)) if c != "\n" and re.match(f"[{OTHER_SPACE}]", c)]
SPACES = frozenset([" ", "\n", *RARE_SPACE])
#: Before a piece that follows no white space; others without any follow a space.
FIRST = "\t"


def is_odd(text: str) -> bool:
    """Whether white space is other than single spaces and line ends between words, or a line end before the first."""
    return text[:1] == " " or text[-1:] in (" ", "\n") or any(s in text for s in ("  ", "\n\n", " \n", "\n ", *RARE_SPACE))


class PieceCache(Remembered):
    """Token ids of the pieces of texts, as little-endian bytes, up to a bound of bytes.

    The library encodes each piece once; a text is then a join of its pieces.  Of a
    plain word the library's model is asked at once, as its pattern cannot split it.
    """

    def __init__(self, path: str):
        super().__init__(CACHE_BYTES)
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.tokenize = self.library.model.tokenize
        self.characters = dict(enumerate(byte_characters()))

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def fresh(self, key: str) -> bytes:
        if key[0] == FIRST and len(key) > 1 and key[1] not in SPACES:
            piece = key[1:]
        else:
            piece = key if key[0] in SPACES else " " + key
        word = WORD.fullmatch(piece)
        if word:
            if word[2]:
                return self[word[1][1:] if piece[0] == " " else FIRST + word[1]] + self[FIRST + word[2]]
            return array("I", [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.characters))]).tobytes()
        if piece[0] == "\n" and len(piece) > 1 and piece[1] not in SPACES:
            return self["\n"] + self[FIRST + piece[1:]]
        return self.whole(piece)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        if is_odd(text):
            return b"".join(map(self.__getitem__, [p if p[0] in SPACES else FIRST + p for p in PIECES.findall(text)]))
        # single spaces and line ends only: each space belongs to the word after it
        first, _, others = text.replace("\n", " \n").partition(" ")
        begin = self[FIRST + first] if first else b""
        return begin + b"".join(map(self.__getitem__, others.split(" "))) if others else begin


@functools.cache
def piece_cache(path: str) -> PieceCache:
    return PieceCache(path)


# --- files -----------------------------------------------------------------


def _write(path: str, content: bytes) -> None:
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    temporary = f"{name}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary) as out:
        out.write(content)
    store.move(temporary, name)


def _read(path: str) -> bytes:
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as source:
        return source.read()


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the files; one row each: ``part``, ``seq``, ``path``, ``docs``, ``tokens`` and ``offset``."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def flush(part: int, seq: int, doc_ids: list, texts: list[bytes]) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(texts), dtype="<u4")
        sizes = np.array([len(t) // 4 for t in texts])
        path = f"{folder}/part-{part:06d}-{seq:04d}.dac"
        _write(path, to_bytes(doc_ids, np.cumsum(sizes) - sizes, ids))
        return pd.DataFrame({"part": [part], "seq": [seq], "path": [path], "docs": [len(texts)], "tokens": [len(ids)]})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, held, doc_ids, texts = TaskContext.get().partitionId(), 0, 0, [], []
        cache = piece_cache(tokenizer_path)
        for batch in batches:
            ids = batch["id"].tolist()
            for doc, null, text in zip(ids, batch["null"], batch["text"], strict=True):
                texts.append(cache.encode(text) + end)
                doc_ids.append(None if null else int(doc))
                held += len(texts[-1]) // 4
                if held >= file_tokens:
                    yield flush(part, seq, doc_ids, texts)
                    seq, held, doc_ids, texts = seq + 1, 0, [], []
        if texts:
            yield flush(part, seq, doc_ids, texts)

    rows = docs.select(F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("id"), F.col(id_col).isNull().alias("null"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # rows of one id, or without, are many where a table has such: their texts' hashes deal them
    order = [F.desc("null"), F.asc("id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    # written once; the rows that name the files are kept
    files = cut(ordered.mapInPandas(write, "part int, seq int, path string, docs long, tokens long"))
    previous = (Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("tokens").alias("in_part"))
    # one row a task that wrote
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(*previous)), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*previous)), F.lit(0))
    return files.withColumn("inside", inside).join(parts, "part").withColumn("offset", F.col("ahead") + F.col("inside")).drop("inside", "ahead")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document of the files: ``doc_id``, ``start``, ``n_tokens`` and ``ids`` (int array)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for doc, start, ids in _documents(batches):
            yield pd.DataFrame({"doc_id": pd.array(doc, dtype="Int64"), "start": start, "n_tokens": [len(x) for x in ids], "ids": [x.astype(np.int32) for x in ids]})

    return _spread(files).mapInPandas(read, "doc_id long, start long, n_tokens long, ids array<int>")


def _spread(files: DataFrame) -> DataFrame:
    # by a stated number, or the few bytes of the paths would all be dealt to one task
    return files.select("path", "offset").repartition(max(1, min(files.count(), 10000)), F.col("path"))


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[int], list[np.ndarray]]]:
    for batch in batches:
        for path, offset in zip(batch["path"], batch["offset"], strict=True):
            file = TokenFile(_read(path))
            docs = [None if null else int(d) for d, null in zip(file.doc_ids, file.nulls, strict=True)]
            ends = [*file.starts[1:].tolist(), file.tokens]
            ids = [file.slice(a, b) for a, b in zip(file.starts.tolist(), ends, strict=True)]
            yield docs, [int(offset + s) for s in file.starts], ids


def digest_token_files(files: DataFrame) -> DataFrame:
    """As ``read_token_files``, with the CRC-32 of each document's ids instead of them."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for doc, start, ids in _documents(batches):
            sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield pd.DataFrame({"doc_id": pd.array(doc, dtype="Int64"), "start": start, "n_tokens": [len(x) for x in ids], "ids_crc32": sums})

    return _spread(files).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = write_token_files(docs, new_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return digest_token_files(files)
