"""BPE encoding and decoding with a contiguous rank array.

A word is a list of parts; ``ranks[i]`` is the merge rank of parts i and i+1.
The smallest rank (leftmost on ties) is found by scanning that short contiguous
array, its boundary is deleted, and only the two neighbouring ranks are looked
up again.  Words of a batch lie in one matrix, so a scan serves all of them.  Words longer than ``SCAN_MOST`` parts take their minima from a heap
instead, so one enormous word costs n log n and gives the same merges.

Text is cut at white space; distinct chunks are encoded once and kept in a
bounded memo, so most of a corpus costs one dictionary lookup per chunk.
"""

from __future__ import annotations

import gc
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SCAN_MOST = 256
#: Distinct words, and distinct chunks of more than a word, that a worker remembers; a memo starts anew beyond it, results don't change.
MEMO_MOST = 80_000
#: Bytes of text that are encoded together.
TOGETHER = 3 << 20

#: The white space of the tokenizer's pattern, and its word pattern.
WHITE = "\t\n\x0b\x0c\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"
#: Characters at which str.split() cuts and the pattern doesn't.
NOT_WHITE = "\x1c\x1d\x1e\x1f"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(256 + i)
    return [out[b] for b in range(256)]


class PairTable:
    """Ranks of pairs of ids by open addressing, looked up for whole arrays."""

    def __init__(self, pairs: np.ndarray):
        bits = max(8, int(len(pairs) * 4).bit_length())
        self.shift, self.mask, self.none = np.uint64(64 - bits), (1 << bits) - 1, len(pairs)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.none, np.int64)
        self.most = 0
        for rank, (key, slot) in enumerate(zip(pairs.tolist(), self._slots(pairs).tolist(), strict=True)):
            probes = 0
            while self.keys[slot] != -1:
                slot, probes = (slot + 1) & self.mask, probes + 1
            self.keys[slot], self.ranks[slot], self.most = key, rank, max(self.most, probes)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rank of each pair; the number of ranks where there is none. A part of -1 is no part."""
        key = np.where(second < 0, -2, first << 32 | second)
        slot = self._slots(key)
        there = self.keys[slot]
        out = np.where(there == key, self.ranks[slot], self.none)
        for _ in range(self.most):
            open_ = (there != key) & (there != -1) & (key != -2)
            if not open_.any():
                break
            slot = (slot + open_) & self.mask
            there = self.keys[slot]
            out = np.where(there == key, self.ranks[slot], out)
        return out


class Codec:
    """Encodes and decodes by one vocabulary file in the ``tokenizers`` JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: Rank of a pair of ids (packed into one number), and the id that each rank makes.
        self.rank = {self.vocab[a] << 32 | self.vocab[b]: i for i, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.id_text = {i: str(i) for i in self.names}
        alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in alphabet]
        self.final = [self.vocab[c + self.end] for c in alphabet]
        self.word = regex.compile(WORD)
        self.white = regex.compile(f"[{WHITE}]+")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.pairs = PairTable(np.fromiter(self.rank, np.int64, len(self.rank)))
        self.made_by = np.array([*self.made, -1], np.int64)
        self.chunks: dict[str, tuple[int, str, str]] = {}
        self.words: dict[str, tuple[int, str, str]] = {}

    def _merged_block(self, rows: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        """Merge many short words at once: a row of ``rows`` holds a word's parts, padded with -1.

        ``ranks`` lies beside it.  Every round takes each row's smallest rank
        (the leftmost on ties), deletes that boundary, and looks up the two
        neighbouring ranks anew; rows without a pair to merge are done.
        """
        none = len(self.made)
        out: list[list[int]] = [[]] * len(rows)
        left = np.arange(len(rows))
        ranks = self.pairs.find(rows[:, :-1], rows[:, 1:])
        while len(left):
            width = rows.shape[1]
            least = ranks.argmin(axis=1) if width > 1 else np.zeros(len(left), np.int64)
            rank = ranks[np.arange(len(left)), least] if width > 1 else np.full(len(left), none)
            done = rank >= none
            if done.any():
                for i, ids, n in zip(left[done].tolist(), rows[done].tolist(), sizes[done].tolist(), strict=True):
                    out[i] = ids[:n]
                go = ~done
                left, rows, ranks, sizes, least, rank = left[go], rows[go], ranks[go], sizes[go], least[go], rank[go]
                if not len(left):
                    break
            each, column = np.arange(len(left)), np.arange(width - 1)
            rows[each, least] = self.made_by[rank]
            rows = np.take_along_axis(rows, column + (column > least[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, column[:-1] + (column[:-1] >= least[:, None]), axis=1)
            sizes = sizes - 1
            if width > 2:
                at = np.flatnonzero(least < width - 2)
                ranks[at, least[at]] = self.pairs.find(rows[at, least[at]], rows[at, least[at] + 1])
                at = np.flatnonzero(least > 0)
                ranks[at, least[at] - 1] = self.pairs.find(rows[at, least[at] - 1], rows[at, least[at]])
        return out

    def _merged_long(self, ids: list[int]) -> list[int]:
        look = self.rank.get
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := look(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or look(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = self.made[r], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := look(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := look(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def word_ids(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        raws = [w.encode("utf-8") for w in words]
        sizes = np.array([len(r) for r in raws], np.int64)
        out: list[list[int]] = [[]] * len(words)
        for i in np.flatnonzero(sizes > SCAN_MOST).tolist():
            out[i] = self._merged_long([*(self.inner[b] for b in raws[i][:-1]), self.final[raws[i][-1]]])
        inner, final = np.array(self.inner, np.int64), np.array(self.final, np.int64)
        width = 4
        while width <= SCAN_MOST:
            which = np.flatnonzero((sizes <= width) & ((sizes > width // 2) | (width == 4)))
            for at in range(0, len(which), 1 << 14):
                own = which[at : at + (1 << 14)]
                n = sizes[own]
                data = np.frombuffer(b"".join([raws[i].ljust(width) for i in own.tolist()]), np.uint8).reshape(-1, width)
                rows = np.where(np.arange(width) < n[:, None], inner[data], -1)
                each = np.arange(len(own))
                rows[each, n - 1] = final[data[each, n - 1]]
                for i, ids in zip(own.tolist(), self._merged_block(rows, n), strict=True):
                    out[i] = ids
            width *= 2
        return out

    def _words_of(self, chunk: str) -> list[str]:
        """The words of a chunk that has no white space."""
        if chunk.isascii():
            text = chunk.lower()
        else:
            text = unicodedata.normalize("NFC", chunk)
            # lower case goes character by character: a final sigma is not a case of its own
            text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        return [text] if text.isalpha() else self.word.findall(text)

    def _learn(self, chunks: set[str]) -> None:
        """Encode the chunks that aren't remembered."""
        if len(self.chunks) > MEMO_MOST:
            self.chunks.clear()
        if len(self.words) > MEMO_MOST:
            self.words.clear()
        known, words = self.chunks, self.words
        new = [(c, self._words_of(c)) for c in chunks if c not in known]
        fresh = list({w for _, ws in new for w in ws if w not in words})
        text, name = self.id_text, self.names
        for word, ids in zip(fresh, self.word_ids(fresh), strict=True):
            words[word] = len(ids), " ".join([text[i] for i in ids]), " ".join([name[i] for i in ids])
        for chunk, ws in new:
            if len(ws) == 1:
                known[chunk] = words[ws[0]]
            else:
                parts = [words[w] for w in ws]
                known[chunk] = sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
        for token, i in self.special.items():
            known[token] = 1, str(i), token

    def forget(self) -> None:
        """Drop what is remembered; the vocabulary stays."""
        self.chunks, self.words = {}, {}

    def _cut(self, text: str) -> list[str]:
        """The text's chunks: special tokens, and what lies between white space."""
        if "<|" in text and self.specials.search(text):
            found, at = [], 0
            for m in self.specials.finditer(text):
                found += [*self.white.split(text[at : m.start()]), m[0]]
                at = m.end()
            return [c for c in [*found, *self.white.split(text[at:])] if c]
        if any(c in text for c in NOT_WHITE):
            return [c for c in self.white.split(text) if c]
        return text.split()

    def encode_texts(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text the number of tokens, their ids joined by spaces, and the decoded text."""
        gc.disable()  # millions of small tuples and no cycles: collections would only look at them again and again
        try:
            return self._encoded(texts)
        finally:
            gc.enable()

    def _encoded(self, texts: list[str]) -> list[tuple[int, str, str]]:
        cut = [self._cut(t) for t in texts]
        need: set[str] = set()
        for chunks in cut:
            need.update(chunks)
        self._learn(need)
        get, out = self.chunks.__getitem__, []
        for chunks in cut:
            found = list(map(get, chunks))
            out.append((sum([f[0] for f in found]), " ".join([f[1] for f in found]), " ".join([f[2] for f in found])))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_texts([text])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, as the library does where the file names no decoder."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoded(df: DataFrame, text_col: str = "text", vocab: str | None = None, ids_as: str = "array") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids`` (array<int>, or text joined by spaces) and ``decoded``.

    A null text counts as empty: no tokens, an empty list, an empty string.  Rows
    keep their other columns; a new column gets underscores in front of its name
    while another has it.
    No shuffle.  ``vocab`` is a file that every executor can open; None ships the
    installed public vocabulary with the job.
    """
    common.small_batches(df.sparkSession)
    shipped = None
    if vocab is None:
        source = common.vocabulary_file("word_bpe_49k.json")
        df.sparkSession.sparkContext.addFile(source)
        shipped = source.rsplit("/", 1)[-1]
    names = [common.free(n, df.columns) for n in ("n_tokens", "ids", "decoded")]
    schema = T.StructType(list(df.schema.fields))
    for name, kind in zip(names, ("long", T.ArrayType(T.IntegerType()) if ids_as == "array" else "string", "string"), strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(SparkFiles.get(shipped) if shipped else vocab)
        try:
            yield from encode_batches(own, batches)
        finally:  # the worker may serve other operators next
            own.forget()

    def encode_batches(own: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            step = max(1, min(len(texts), int(TOGETHER * max(len(texts), 1) / max(texts.nbytes, 1))))
            for at in range(0, len(texts), step):
                part = batch.slice(at, step)
                got = own.encode_texts([t or "" for t in texts.slice(at, step).to_pylist()])
                ids: pa.Array
                if ids_as == "array":
                    sizes = np.cumsum([0, *(g[0] for g in got)]).astype(np.int32)
                    flat = np.array(" ".join(g[1] for g in got if g[1]).split(), dtype=np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))
                else:
                    ids = pa.array([g[1] for g in got], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[0] for g in got], pa.int64()), ids, pa.array([g[2] for g in got], pa.string())], names=[*part.schema.names, *names])

    return common.mapped(df, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document's token count and the digests of its ids and of their decoding."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encoded(docs, ids_as="text")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
