"""Exact BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over all tokens gives the longest token that begins at every position
of a word. The encoder takes the longest one that is compatible with the token before it, falls
back to shorter prefixes, and steps back where none fits. Two neighbours are compatible if the
merges would not have joined something across their border, which is looked up by undoing the
merges on both sides of it. Every position is given up once at most, so the work is linear in the
word. Decoding copies token texts out of one buffer with an offset per id.

Vocabulary files are those of the ``tokenizers`` library: byte-level BPE with an optional suffix
for ends of words, NFC, white-space and lower-case normalisers, and a pattern of parts to keep.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

# Words whose tokens a worker remembers, and as many older ones: when the memory is full, the words
# that have been met since it was last full stay.
REMEMBERED_WORDS = 200_000
# Pairs of neighbours whose compatibility a worker remembers.
REMEMBERED_PAIRS = 50_000
# Longer parts of a text are encoded without being remembered.
REMEMBERED_CHARS = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b not in hidden else chr(256 + hidden.index(b)) for b in range(256)]


@lru_cache(maxsize=1)
def _newer_characters() -> frozenset[str]:
    """Letters and digits that Python's Unicode tables lack; other tables may have them."""
    chars = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", chars) if unicodedata.category(c) == "Cn")


class Merges:
    """Token ids of single words under a merge list, by backtracking."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        alphabet = byte_alphabet()
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in merges]
        # Symbols are bytes, and bytes that end a word; each is one character of the automaton.
        self.symbol = [chr(b) for b in range(256)]
        self.final = [chr(256 + b) if suffix else chr(b) for b in range(256)]
        spelled = {alphabet[b]: self.symbol[b] for b in range(256)}
        if suffix:
            spelled |= {alphabet[b] + suffix: self.final[b] for b in range(256)}
        order = {token: i for i, token in enumerate(spelled)}
        self.split = [(i, i) for i in range(len(order))]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in pairs:
            rank = order.setdefault(a + b, len(order))
            left, right = order[a], order[b]
            self.joined.setdefault((left, right), rank)
            if rank == len(self.split):
                self.split.append((left, right))
                spelled[a + b] = spelled[a] + spelled[b]
        self.ids = [vocab[token] for token in order]
        self.length = [len(spelled[token]) for token in order]
        self.automaton = ahocorasick.Automaton()
        by_text = {}
        for token, rank in order.items():
            by_text.setdefault(spelled[token], rank)
        for text, rank in by_text.items():
            self.automaton.add_word(text, rank)
        self.automaton.make_automaton()
        self.shorter = [
            next((by_text[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in by_text), -1)
            for text in (spelled[token] for token in order)
        ]
        self.memory: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the border between two neighbouring tokens alone."""
        key = (left, right)
        known = self.memory.get(key)
        if known is None:
            if len(self.memory) >= REMEMBERED_PAIRS:
                self.memory.clear()
            known = self.memory[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        limit = len(self.split)
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            # Undo the later of the two merges; a single symbol cannot be undone.
            part_left, part_right = self.split[left][1], self.split[right][0]
            if part_left != left and (left > right or part_right == right):
                limit, left = left, part_left
            elif part_right != right:
                limit, right = right + 1, part_right
            else:
                return True

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word."""
        if not word:
            return []
        # The symbol of a byte is the character of its number.
        text = word[:-1].decode("latin-1") + self.final[word[-1]]
        length, longest = self.length, [-1] * len(text)
        for end, rank in self.automaton.iter(text):
            start = end + 1 - length[rank]
            if longest[start] < 0 or length[rank] > length[longest[start]]:
                longest[start] = rank
        found: list[int] = []
        open_end = bytearray(b"\1") * (len(text) + 1)
        at, token = 0, longest[0]
        while True:
            while token >= 0:
                end = at + length[token]
                if open_end[end] and (not found or self.compatible(found[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                found.append(token)
                at = end
                if at == len(text):
                    return [self.ids[t] for t in found]
                token = longest[at]
            else:
                open_end[at] = 0
                token = found.pop()
                at -= length[token]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        steps = spec["normalizer"]["normalizers"] if spec.get("normalizer") else []
        kinds = [s["type"] for s in steps]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        parts = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split")
        self.parts = regex.compile(pattern)
        # Texts with characters newer than Python's tables are normalised and cut by the library.
        self.newer = _newer_characters()
        self.rare = (
            normalizers.Sequence([normalizers.NFC()] * self.nfc + [normalizers.Lowercase()] * self.lower),
            pre_tokenizers.Split(Regex(pattern), "removed", invert=True),
        )
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        texts = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in special.items()}
        # Every token with a blank behind it; ids index the offsets.
        pieces = [(texts.get(i, "") + " ").encode() for i in range(max(texts) + 1)]
        self.buffer = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
        self.words: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower() if self.lower else text
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        # Lower-casing goes character by character, so a sigma at the end of a word stays one.
        return text.replace("Σ", "σ").lower() if self.lower else text

    def _split(self, text: str) -> list[str]:
        if text.isascii() or self.newer.isdisjoint(text):
            return self.parts.findall(self._normal(text))
        return [part for part, _ in self.rare[1].pre_tokenize_str(self.rare[0].normalize_str(text))]

    def _word(self, part: str) -> list[int]:
        ids = self.words.get(part) or self.older.get(part) or self.merges.encode(part.encode("utf-8", "replace"))
        if len(part) <= REMEMBERED_CHARS:
            if len(self.words) >= REMEMBERED_WORDS:
                self.words, self.older = {}, self.words
            self.words[part] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; special strings become their own ids. NULL counts as empty."""
        ids: list[int] = []
        known, word = self.words.get, self._word
        for piece in self.cut.split(text or "") if self.cut else [text or ""]:
            if piece in self.special:
                ids.append(self.special[piece])
                continue
            ids.extend(chain.from_iterable([known(part) or word(part) for part in self._split(piece)]))
        return np.array(ids, dtype=np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """Token texts joined by one blank, as the library does without a decoder."""
        if not len(ids):
            return ""
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        ends = np.cumsum(lengths)
        index = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
        return self.buffer[index].tobytes()[:-1].decode()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a file, read once per worker."""
    return Codec(path)


def id_text(ids: np.ndarray) -> str:
    return " ".join(map(str, ids.tolist()))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` plus ``n_tokens``, ``token_ids`` and ``decoded`` of the whole ``text`` of each row.

    A NULL or empty text has no tokens and decodes to an empty string. Every row is encoded by
    itself, so repeated rows and NULL ids need no rule; all other columns pass through, except
    that columns already called like a new one are replaced. The file must exist on the executors.
    """
    new = {"n_tokens", "token_ids", "decoded"}
    kept = [f for f in docs.schema.fields if f.name not in new]
    names = [f.name for f in kept]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = [coder.encode(t) for t in part.column(at).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([len(x) for x in ids], pa.int64()), lists,
                     pa.array([coder.decode(x) for x in ids], pa.string())],
                    [*names, "n_tokens", "token_ids", "decoded"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(
        run, f"{fields}, n_tokens long, token_ids array<int>, decoded string"
    )


def digests(encoded: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of ``encode_documents``."""
    ids = F.concat_ws(" ", F.col("token_ids").cast("array<string>"))
    return encoded.select(
        "doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
