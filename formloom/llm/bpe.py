r"""BPE encoding and decoding by a dynamic program over prefixes.

Every prefix of a word has one BPE encoding, and that encoding's last token is unique. The
tokens that can end a prefix are its suffixes in the vocabulary, which a suffix-matching
automaton lists in one pass over the word. Token t ends prefix i exactly when the last token
of prefix i - len(t) may stand before t; a pair may stand side by side when no merge across
their border comes before the merges that made them. Following the stored last tokens back
from the end gives the ids, in time linear in the word and whatever its length.

Vocabulary: a tokenizers JSON file of a word BPE (byte-level symbols, an end-of-word suffix,
white space dropped, NFC and lower case). The file is read on the driver and sent to the
executors (its size is that of the vocabulary), so executors need no copy.

Caches are bounded in entries and in the length of what they hold, so a worker's memory does
not follow the corpus or its longest text. A vocabulary that lacks a byte is refused
(ValueError), as some words would have no encoding.

Defined results: null and empty texts have no tokens; white space alone has none; the strings
of special tokens in a text become those tokens; repeated rows each get their row; other
columns pass through untouched.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
import unicodedata
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.llm.common import map_texts

#: Fixed value: the pre-tokenizer's pattern; {L}, {N} and {S} stand for letters, numbers and White_Space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
#: Unicode's White_Space characters.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters at which str.split() separates though they are no White_Space.
SEPARATORS = "\x1c\x1d\x1e\x1f"

#: The tokenizer's tables where they differ from Python's (15.1). Its letters and
#: numbers are those of Unicode 16.0, which has these more,
LETTERS_16 = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
NUMBERS_16 = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: its lower case is that of 17.0 (from, to, code points in a row),
LOWER_17 = [(0x1C89, 0x1C8A, 1), (0xA7CB, 0x264, 1), (0xA7CC, 0xA7CD, 1), (0xA7CE, 0xA7CF, 1), (0xA7D2, 0xA7D3, 1), (0xA7D4, 0xA7D5, 1), (0xA7DA, 0xA7DB, 1), (0xA7DC, 0x19B, 1), (0x10D50, 0x10D70, 22), (0x16EA0, 0x16EBB, 25)]
#: and its NFC is older: these marks neither move nor join what stands before them.
NO_MARKS = ("7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 11938 1193D-1193E 11943 119E0 11A34 11A47 11A99 "
            "11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF")

#: Entries of a generation of cached chunks or pairs, and characters of a cached chunk at most.
#: Each worker keeps two generations of chunks; longer ones are encoded anew each time.
CACHE, CACHED_CHARS = 600_000, 64
#: Moves the last symbol of a word to code points of its own, as the suffix does in the vocabulary.
_END = 0x4000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return [chr(b) for _, b in sorted([*((b, b) for b in plain), *((b, 0x100 + k) for k, b in enumerate(rest))])]


def _ranges(listed: str) -> str:
    """Hexadecimal ranges as the inside of a character class."""
    return "".join("-".join(f"\\U{int(end, 16):08x}" for end in part.split("-")) for part in listed.split())


@functools.cache
def pieces():
    """The pre-tokenizer's pattern over Python's own Unicode categories and the code points of ``LETTERS_16`` and ``NUMBERS_16``."""

    def listed(category: str) -> str:
        inside = [unicodedata.category(chr(c))[0] == category for c in range(sys.maxunicode + 1)]
        edges = [c for c in range(len(inside) + 1) if (c < len(inside) and inside[c]) != (c > 0 and inside[c - 1])]
        return " ".join(f"{a:x}-{b - 1:x}" for a, b in zip(edges[::2], edges[1::2], strict=True))

    return re.compile(PIECES.replace("{S}", WHITE_SPACE).replace("{L}", _ranges(f"{listed('L')} {LETTERS_16}")).replace("{N}", _ranges(f"{listed('N')} {NUMBERS_16}")))


_no_marks = re.compile(f"([{_ranges(NO_MARKS)}])")
_lower = {a + k: b + k for a, b, n in LOWER_17 for k in range(n)}
_to_lower = re.compile(f"[{''.join(map(chr, _lower))}]")


def checked(spec: dict) -> dict:
    """spec, if its vocabulary holds every byte, also as a word's last symbol; else some words would have no tokens at all."""
    vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    lacking = [b for b, c in enumerate(byte_alphabet()) if c not in vocab or c + suffix not in vocab]
    if lacking:
        raise ValueError(f"the vocabulary has no symbol for the bytes {lacking}")
    return spec


class Bpe:
    """Encoder and decoder of one vocabulary; spec is the parsed tokenizers JSON."""

    def __init__(self, spec: dict):
        import ahocorasick

        model = checked(spec)["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.text_of = {i: str(i) for i in self.token}
        self._alphabet = str.maketrans({b: c for b, c in enumerate(byte_alphabet())})
        self._pieces = pieces().findall
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        ids = {i: i for i in vocab.values()}  # one int object for each id
        self._made: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        rank = -1
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = ids[vocab[a + b]]
            if whole <= rank or whole in self._parts:
                raise ValueError("merges must make new tokens in the order of their ids")
            rank = whole
            self._made[ids[vocab[a]], ids[vocab[b]]] = whole
            self._parts[whole] = (ids[vocab[a]], ids[vocab[b]])
        self._suffixes = ahocorasick.Automaton()
        for t, i in vocab.items():
            own = t[: -len(suffix)] if t.endswith(suffix) and len(t) > len(suffix) else None
            s = t if own is None else own[:-1] + chr(ord(own[-1]) + _END)
            self._suffixes.add_word(s, (ids[i], len(s)))
        self._suffixes.make_automaton()
        self._pair: dict[int, bool] = {}
        self._chunk: dict[str, tuple[int, ...]] = _Kept(self._of_chunk)

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves left and right side by side: undo their merges, latest first, and look for an earlier one across the border."""
        parts, made, before = self._parts, self._made, 1 << 62
        while True:
            across = made.get((left, right))
            if across is not None and across < before:
                return False
            if left > right:
                if left not in parts:
                    return True
                before, left = left, parts[left][1]
            else:
                if right not in parts:
                    return True
                # Of equal merges the leftmost goes first, and the one across lies to the left.
                before, right = right + 1, parts[right][0]

    def of_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        symbols = word.encode().decode("latin-1").translate(self._alphabet)
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + _END)
        pair, fits = self._pair.get, self.fits
        last: list[int] = [-1] * (len(symbols) + 1)
        size: list[int] = [0] * (len(symbols) + 1)
        done = 0
        for end, (token, n) in self._suffixes.iter(symbols):
            end += 1
            if end == done:
                continue
            if start := end - n:
                if (before := last[start]) < 0:
                    continue
                key = before << 32 | token
                if (ok := pair(key)) is None:
                    if len(self._pair) >= CACHE:
                        self._pair.clear()
                    ok = self._pair[key] = fits(before, token)
                if not ok:
                    continue
            last[end], size[end], done = token, n, end
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at -= size[at]
        return tuple(ids[::-1])

    def _of_chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a run of text without white space. A piece is a chunk that is its own only piece, so both share the cache."""
        found = self._pieces(chunk.lower() if chunk.isascii() else lowered(normal(chunk)))
        if len(found) == 1:
            piece = found[0]
            return self.of_word(piece) if piece == chunk else self._chunk[piece]
        return tuple(chain.from_iterable([self._chunk[p] for p in found]))

    def _plain(self, text: str) -> list[int]:
        # No piece spans white space and every White_Space run separates, so chunks can be encoded one by one.
        if any(c in text for c in SEPARATORS):
            chunks = white_space().split(text)
        else:
            chunks = text.split()
        return list(chain.from_iterable(map(self._chunk.__getitem__, chunks)))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        if self._special and "<|" in text or self._special and not all(s.startswith("<|") for s in self.special):
            out: list[int] = []
            for part in self._special(text):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    out += self._plain(part)
            return out
        return self._plain(text)

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts joined by a space, as a tokenizer without a decoder gives them; unknown ids are passed over."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])


class _Kept(dict):
    """Values made on first use; at CACHE entries they become the old generation, from which those still in use come back."""

    def __init__(self, make):
        self._make, self._old = make, {}

    def __missing__(self, key):
        if len(key) > CACHED_CHARS:
            return self._make(key)
        out = self._old.get(key)
        out = self._make(key) if out is None else out
        if len(self) >= CACHE:
            self._old = dict(self)
            self.clear()
        self[key] = out
        return out


@functools.cache
def white_space():
    """Runs of Unicode's White_Space characters."""
    return re.compile(f"[{WHITE_SPACE}]+")


def normal(text: str) -> str:
    """NFC by the tokenizer's tables; what stands between marks unknown to it is normalised part by part."""
    if _no_marks.search(text):
        return "".join(part if i % 2 else unicodedata.normalize("NFC", part) for i, part in enumerate(_no_marks.split(text)))
    return unicodedata.normalize("NFC", text)


def lowered(text: str) -> str:
    """Lower case of each character by itself: a final sigma has no form of its own."""
    if _to_lower.search(text):
        text = text.translate(_lower)
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


def vocabulary() -> str:
    """Path of the public vocabulary file, which lies outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _loaded(spark: SparkSession, path: str):
    """The vocabulary as a broadcast: its size is fixed by the file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    checked(json.loads(text))
    return spark.sparkContext.broadcast(text)


_workers: dict[int, Bpe] = {}


def _bpe(spec) -> Bpe:
    """One encoder for each Python worker, kept from task to task."""
    key = hash(spec.value)
    if key not in _workers:
        _workers.clear()
        _workers[key] = Bpe(json.loads(spec.value))
    return _workers[key]


def encode(df: DataFrame, vocabulary: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, n_tokens and ids (array of int) of each row's whole text."""
    spec = _loaded(df.sparkSession, vocabulary)

    def make():
        bpe = _bpe(spec)

        def each(texts):
            ids = [bpe.encode(t.decode(errors="replace")) for t in texts]
            return [pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))]

        return each

    return map_texts(df, text_col, keep, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the text that its ids stand for; null ids give an empty text."""
    spec = _loaded(df.sparkSession, vocabulary)

    @F.pandas_udf(T.StringType())
    def texts(ids: pd.Series) -> pd.Series:
        bpe = _bpe(spec)
        return ids.map(lambda x: "" if x is None else bpe.decode([int(i) for i in x]))

    return df.withColumn(to, texts(F.col(ids_col)))


def digests(df: DataFrame, vocabulary: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, n_tokens and the SHA-256 of the ids and of the text decoded from them, made where the ids are, so that no ids are moved."""
    spec = _loaded(df.sparkSession, vocabulary)

    def make():
        bpe = _bpe(spec)

        def each(texts):
            n, a, b = [], [], []
            name = bpe.text_of
            for t in texts:
                ids = bpe.encode(t.decode(errors="replace"))
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(name.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

        return each

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_texts(df, text_col, keep, fields, make)
