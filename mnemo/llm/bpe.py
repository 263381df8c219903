"""BPE encoding and decoding with a public vocabulary file.

A word's symbols form a doubly linked list; every adjacent pair with a merge rule waits in a heap ordered by
(rank, position).  The lowest rank is merged first, and entries whose symbols have meanwhile changed are skipped when
they surface.  Ids decode by joining their vocabulary strings (the file names no decoder, so with one space between).

Rows: a null text is read as empty; an empty text has no tokens, the digest of the empty string, and decodes to "".
Repeated rows are encoded each on its own, so there are no ties.  Texts of any length are encoded whole.  An empty table
gives an empty result.  Other columns pass through, but for those named like an output.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import appended, column, slices

#: Fixed by the tokenizers library: white space as Unicode defines it, and the pre-tokenizer's pattern.
SPACE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")

#: Words whose encoding a worker remembers: a young and an old generation of this size each.  When the young one is
#: full it becomes the old one; words found there move on.
REMEMBERED = 100_000

OUTPUTS = {
    "token_ids": T.ArrayType(T.IntegerType()),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a ``tokenizers`` file: byte-level BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.inner = [vocab[c] for c in byte_symbols()]
        self.final = [vocab[c + suffix] for c in byte_symbols()]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        #: rank of a pair of ids (as one number), and the id that the rule of a rank makes
        self.ranks = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = tuple({s[:2] for s in self.special})  # every special string begins with one of these
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merge rules to a word's symbols."""
        rank_of, made, n = self.ranks.get, self.made, len(symbols)
        heap = []  # rank * n + position
        for i in range(n - 1):
            if (rank := rank_of(symbols[i] << 32 | symbols[i + 1])) is not None:
                heap.append(rank * n + i)
        if not heap:
            return symbols
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            rank, i = divmod(heappop(heap), n)
            j = after[i]
            if j == n or symbols[i] < 0 or rank_of(symbols[i] << 32 | symbols[j]) != rank:
                continue  # stale: one of the two has been merged since
            new = symbols[i] = made[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(new << 32 | symbols[k])) is not None:
                    heappush(heap, rank * n + i)
            h = before[i]
            if h >= 0 and (rank := rank_of(symbols[h] << 32 | new)) is not None:
                heappush(heap, rank * n + h)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> tuple[int, str, str]:
        """A word's number of tokens, ids as decimal text, and the text that they decode to."""
        found = self.old.pop(word, None)
        if found is None:
            raw = word.encode("utf-8")
            ids = self.merge([*map(self.inner.__getitem__, raw[:-1]), self.final[raw[-1]]])
            strings = self.strings
            found = len(ids), " ".join([str(i) for i in ids]), " ".join([strings[i] for i in ids])
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        self.young[word] = found
        return found

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        """What ``word`` gives for each piece of a text, in order."""
        found: list[tuple[int, str, str]] = []
        for piece in self.specials.split(text) if any(m in text for m in self.marks) else (text,):
            if piece in self.special:
                found.append((1, str(self.special[piece]), piece))
            elif piece:
                # per character lower case: the library knows no final sigma.  Its runs of white space need not become
                # single spaces here, since no piece holds any.
                plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                known, word = self.young.get, self.word
                found += [known(w) or word(w) for w in PIECES.findall(plain)]
        return found

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.parts(text or "") for i in ids.split()]

    def decode(self, ids) -> str:
        """Vocabulary strings of the ids, joined as the library joins them; unknown ids are left out."""
        return " ".join(s for i in ids if (s := self.strings.get(i)) is not None)


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The tokenizer of a file, read once per process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _outputs(bpe: WordBpe, text: str | None, wanted: tuple[str, ...]) -> list:
    parts = bpe.parts(text or "")
    row, digest = [], lambda k: hashlib.sha256(" ".join([p[k] for p in parts]).encode()).hexdigest()
    for name in wanted:
        if name == "token_ids":
            row.append([int(i) for p in parts for i in p[1].split()])
        elif name == "n_tokens":
            row.append(sum([p[0] for p in parts]))
        elif name == "decoded":
            row.append(" ".join([p[2] for p in parts]))
        else:
            row.append(digest(1 if name == "ids_sha256" else 2))
    return row


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", outputs: tuple[str, ...] = ("token_ids", "decoded"), keep_text: bool = True) -> DataFrame:
    """``docs`` with the ``outputs`` (names of OUTPUTS) of each text; one pass, no shuffle.  ``tokenizer`` is the path
    of the vocabulary file on every worker.  An output replaces an input column of its name."""
    kept = [c for c in docs.columns if c.lower() not in outputs and (keep_text or c != text_col)]
    read = docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text_col])])
    schema = T.StructType([f for f in read.schema if f.name in kept] + [T.StructField(n, OUTPUTS[n]) for n in outputs])

    def run(batches):
        bpe = load(tokenizer)
        for batch in slices(batches, text_col):
            rows = [_outputs(bpe, t, outputs) for t in column(batch, text_col)]
            types = {"token_ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
            more = {n: pa.array([r[k] for r in rows], types.get(n, pa.string())) for k, n in enumerate(outputs)}
            yield appended(batch.select(kept), more)

    return read.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of each row's ids in ``out_col``; null ids decode to null."""
    kept = [c for c in encoded.columns if c.lower() != out_col.lower()]
    schema = T.StructType([f for f in encoded.schema if f.name in kept] + [T.StructField(out_col, T.StringType())])

    def run(batches):
        bpe = load(tokenizer)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids) for ids in column(batch, ids_col)]
            yield appended(batch.select(kept), {out_col: pa.array(texts, pa.string())})

    return encoded.mapInArrow(run, schema)
