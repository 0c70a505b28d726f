"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word starts as its symbols.  The leaves of a segment tree hold the merge rank of
each symbol with its right neighbour; an inner node holds the lesser of its children,
the left one on a tie, so the root is the leftmost pair of lowest rank.  Each merge
changes at most three leaves, each updated on its way to the root, until the root
holds no mergeable pair.

The words are those of the tokenizer file: text is cut at added tokens, normalised
(NFC, white space, lower case) and split by its pattern.  Words recur, so their tokens
are remembered up to a bound of bytes.  The file has no decoder;
decoding joins the tokens' strings with spaces, as the tokenizers library does.

Letters, numbers and lower case depend on a version of Unicode.  All tables agree on the
characters that Python's own table has; a text with any other one takes its normal form
and the classes of its pattern from the tokenizers library, so that no upgrade moves a
token.

Defined cases: null text is empty and has no tokens; added tokens in a text become
their ids; very long words take the same way; repeated rows are encoded alike; an
empty table gives an empty result; input columns named like a result column are
replaced by it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import Remembered, byte_characters, table

PLACE_BITS = 32
PLACE_MASK = (1 << PLACE_BITS) - 1
SYMBOL_BITS = 32
NO_PAIR = 1 << 60
#: Bytes of one generation of remembered words, in each Python worker; there are two, and Spark hands the worker on to other tasks with them.
CACHE_BYTES = 40 << 20
#: White space of the normaliser, as characters of a class.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: Planes of Unicode that have characters other than of private use.
PLANES = (0, 1, 2, 3, 14)


def plane_characters() -> Iterator[str]:
    for plane in PLANES:
        yield from (chr(c) for c in range(plane << 16, (plane + 1) << 16) if not 0xD800 <= c <= 0xDFFF)


@functools.cache
def unknown_characters() -> frozenset[str]:
    """Those that Python's table of Unicode does not have."""
    return frozenset(c for c in plane_characters() if unicodedata.category(c) == "Cn")


@functools.cache
def library_class(name: str) -> str:
    """The characters that the tokenizers library has in a class, as ranges within brackets."""
    every = "".join(plane_characters())
    outside = [span for _, span in pre_tokenizers.Split(Regex(name + "+"), "removed").pre_tokenize_str(every)]
    inside, at = [], 0
    for a, b in [*outside, (len(every), len(every))]:
        if at < a:
            inside.append((at, a - 1))
        at = b
    # a stretch of neighbours in ``every`` may cross from one plane to another, or over the surrogates
    ranges = []
    for a, b in inside:
        begin = a
        for k in range(a, b + 1):
            if k == b or ord(every[k + 1]) != ord(every[k]) + 1:
                ranges.append(f"\\U{ord(every[begin]):08x}-\\U{ord(every[k]):08x}")
                begin = k + 1
    return "".join(ranges)


@functools.cache
def library_normalizer() -> normalizers.Normalizer:
    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


class Pairs:
    """Mergeable pairs of symbols: ``leaves`` has the rank of each, above the bits for a place; ``merged`` what each rank makes."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        """``merges`` are (left, right, merged symbol) by rank."""
        self.leaves = {a << SYMBOL_BITS | b: rank << PLACE_BITS for rank, (a, b, _) in enumerate(merges)}
        self.merged = [m for _, _, m in merges]


def merge(symbols: list[int], pairs: Pairs) -> list[int]:
    """Merges the leftmost pair of lowest rank until none is left.

    A node of the tree holds rank and place in one number, so the lesser of two nodes
    is the one of lower rank, and of equal ranks the left one.
    """
    n, leaf, merged = len(symbols), pairs.leaves.get, pairs.merged
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    tree = [NO_PAIR] * size
    tree += [leaf(a << SYMBOL_BITS | b, NO_PAIR) | at for at, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
    tree += [NO_PAIR] * (2 * size - len(tree))
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] < NO_PAIR:
        i, rank = tree[1] & PLACE_MASK, tree[1] >> PLACE_BITS
        j = after[i]
        nxt = after[j]
        one = symbols[i] = merged[rank]
        symbols[j] = -1
        after[i] = nxt
        changed = [(i, NO_PAIR)]
        if nxt < n:
            before[nxt] = i
            changed = [(j, NO_PAIR), (i, leaf(one << SYMBOL_BITS | symbols[nxt], NO_PAIR) | i)]
        h = before[i]
        if h >= 0:
            changed.append((h, leaf(symbols[h] << SYMBOL_BITS | one, NO_PAIR) | h))
        for at, value in changed:
            node = size + at
            tree[node] = value
            while node > 1:
                node >>= 1
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    break
                tree[node] = least
    return [s for s in symbols if s >= 0]


class Words(Remembered):
    """Of each lower-cased word its token ids in decimal and their strings, both joined by a space."""

    def __init__(self, codec: Codec):
        super().__init__(CACHE_BYTES)
        self.codec = codec

    def fresh(self, word: str) -> tuple[str, str]:
        ids = self.codec.word(word)
        return " ".join(map(str, ids)), self.codec.decode(ids)

    def length(self, word: str, value: tuple[str, str]) -> int:
        return len(word) + len(value[0]) + len(value[1])


class Codec:
    """A tokenizer file of lower-cased words with byte-level symbols and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = dict(model["vocab"])
        end = model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocabulary | self.added).items()}
        self.pairs = Pairs([(self.vocabulary[a], self.vocabulary[b], self.vocabulary[a + b]) for a, b in model["merges"]])
        self.inner = [self.vocabulary[c] for c in byte_characters()]
        self.last = [self.vocabulary[c + end] for c in byte_characters()]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.source = pattern.replace(r"\s", SPACE)
        self.pattern = regex.compile(self.source)
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.words = Words(self)

    def word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "replace")
        return merge([*(self.inner[b] for b in data[:-1]), self.last[data[-1]]], self.pairs)

    def split(self, text: str) -> list[str]:
        """The lower-cased words of a text without added tokens."""
        if text.isascii():
            lowered = text.lower()
        elif not unknown_characters().isdisjoint(text):
            return self.exact_pattern.findall(library_normalizer().normalize_str(text))
        else:
            normal = unicodedata.normalize("NFC", text)
            # as a whole, a capital sigma that ends a word would become another letter
            lowered = normal.lower() if "\u03a3" not in normal else "".join(map(str.lower, normal))
        return self.pattern.findall(lowered)

    @functools.cached_property
    def exact_pattern(self) -> regex.Pattern:
        """The pattern with the classes of the library spelled out."""
        return regex.compile(self.source.replace(r"\p{L}", library_class(r"\p{L}")).replace(r"\p{N}", library_class(r"\p{N}")))

    def parts(self, text: str) -> list[tuple[str, str]]:
        """Ids in decimal and strings of each word and added token."""
        if "<|" not in text:
            return list(map(self.words.__getitem__, self.split(text)))
        out = []
        for k, part in enumerate(self.split_added.split(text)):
            out += [(str(self.added[part]), part)] if k % 2 else map(self.words.__getitem__, self.split(part))
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for written, _ in self.parts(text or "") for i in written.split(" ")]

    def decode(self, ids) -> str:
        return " ".join([self.tokens[i] for i in ids])

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the ids in decimal and of the decoded text."""
        parts = self.parts(text or "")
        written, decoded = " ".join([w for w, _ in parts]), " ".join([d for _, d in parts])
        count = written.count(" ") + 1 if written else 0
        return count, hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def encode(text: Column, path: str | None = None) -> Column:
    """Token ids of a text column."""
    path = path or default_path()

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(codec(path).encode, na_action=None)

    return encoded(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """Text of a column of token ids."""
    path = path or default_path()

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else codec(path).decode(x))

    return decoded(ids)


def round_trip(text: Column, path: str | None = None) -> Column:
    """A struct of ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encoded, then decoded."""
    path = path or default_path()

    @F.pandas_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def digested(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [codec(path).digests(t) for t in batch]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digested(text)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    return df.select(id_col, round_trip(F.col(text_col), path).alias("found")).select(id_col, "found.*")


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
