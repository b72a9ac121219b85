"""SentencePiece BPE encoding and decoding in vectorised merge rounds (operator 7)."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession, types as T

from sievemill.llm.common import documents, map_texts

SPACE = "▁"
NONE = np.iinfo(np.int32).max
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

#: Texts that show what a model's settings do to spaces, other blanks and forms of characters; loading compares them.
PROBES = ["", " ", "a", "  two  spaces ", "tab\tline\nend\n", "ﬁ Ａ ² e\u0301 é", f"{SPACE}x", "日本 \U0001f600 \x00"]


def _each_byte(e: UnicodeDecodeError) -> tuple[str, int]:
    """The library puts a replacement character for each byte that isn't part of a character."""
    return "\ufffd" * (e.end - e.start), e.end


class Bpe:
    """The pieces of a model file, as arrays.

    Symbols: 0 to n - 1 are the pieces; above come characters that occur inside pieces but aren't pieces;
    a character that occurs in none is -1 - its code point.
    """

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        n = len(sp)
        names = sp.id_to_piece(list(range(n)))
        normal = [k for k in range(n) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))]
        if any(sp.is_unused(k) for k in normal):
            raise ValueError("models with unused pieces aren't supported")
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        symbols = {names[k]: k for k in normal}
        for c in sorted({c for k in normal for c in names[k]} - symbols.keys()):
            symbols[c] = n + len(symbols) - len(normal)
        self.n = n
        scores = np.array([sp.get_score(k) for k in normal])
        _, order = np.unique(-scores, return_inverse=True)
        rank = dict(zip(normal, order.tolist(), strict=True))
        chars = sorted((ord(s), k) for s, k in symbols.items() if len(s) == 1)
        self.points = np.array([p for p, _ in chars], dtype=np.int64)
        self.point_symbols = np.array([k for _, k in chars], dtype=np.int64)
        self.size = n + len(symbols)
        pairs, bigrams = {}, set()
        for k in normal:
            s = names[k]
            bigrams.update(zip(s, s[1:], strict=False))
            for cut in range(1, len(s)):
                a, b = symbols.get(s[:cut]), symbols.get(s[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (k, rank[k])
        if any(b == SPACE != a for a, b in bigrams):
            raise ValueError("a piece goes on after a space")
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[x][0] for x in self.keys.tolist()], dtype=np.int64)
        self.ranks = np.array([pairs[x][1] for x in self.keys.tolist()], dtype=np.int32)
        self.pairs = pairs
        known = {s: k for s, k in symbols.items() if len(s) == 1}
        self.bigrams = np.array(sorted(known[a] * self.size + known[b] for a, b in bigrams), dtype=np.int64)
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        surface = [names[k].replace(SPACE, " ").encode() for k in range(n)]
        for k in (x for x in (self.bos, self.eos) if x >= 0):
            surface[k] = b""
        surface[self.unk] = b" \xe2\x81\x87 "
        for b, k in enumerate(self.bytes.tolist()):
            surface[k] = bytes([b])
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.surface_size = np.array([len(x) for x in surface], dtype=np.int64)
        self.surface_start = np.r_[0, np.cumsum(self.surface_size)]
        self.spaced = np.array([names[k].startswith(SPACE) for k in range(n)])
        for text, ids in zip(PROBES, self.encode(PROBES), strict=True):
            if ids.tolist() != [self.bos, *sp.encode(text), self.eos]:
                raise ValueError(f"the model's normaliser or settings aren't supported: {text!r} is encoded otherwise")

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and rank (NONE: no such piece) of the merged pairs."""
        key = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return self.merged[at], np.where(found, self.ranks[at], NONE)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        flat = "".join(words)
        points = np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words], dtype=np.int64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        symbols = np.where(self.points[at] == points, self.point_symbols[at], -1 - points)
        # No piece holds a pair of characters that isn't among the bigrams, so no merge goes over it.
        key = symbols[:-1] * self.size + symbols[1:]
        near = np.minimum(np.searchsorted(self.bigrams, key), len(self.bigrams) - 1)
        joined = (symbols[:-1] >= 0) & (symbols[1:] >= 0) & (self.bigrams[near] == key)
        first = np.cumsum(size)[:-1]
        joined[first[first > 0] - 1] = False
        segment = np.r_[0, np.cumsum(~joined)] if len(symbols) else np.zeros(0, dtype=np.int64)
        alive = np.ones(len(symbols), dtype=bool)
        self._merge(points, symbols, segment, alive)
        counts = np.diff(np.r_[0, np.cumsum(alive)][np.r_[0, np.cumsum(size)]]) if len(words) else size
        out = symbols[alive]
        lone = (out < 0) | (out >= self.n)  # characters without a piece: their bytes
        if not lone.any():
            return out, counts
        point = points[alive]
        width = np.where(lone, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), 1)
        start = np.cumsum(width) - width
        ids = np.zeros(int(width.sum()), dtype=np.int64)
        ids[start] = out
        for size in range(1, 5):  # the UTF-8 bytes of all characters of a size at once
            of = lone & (width == size)
            p, where = point[of], start[of]
            for j in range(size):
                low = p >> 6 * (size - 1 - j)
                octet = low | (0, 0, 0xC0, 0xE0, 0xF0)[size] if j == 0 else low & 0x3F | 0x80
                ids[where + j] = self.bytes[octet]
        owner = np.repeat(np.arange(len(words)), counts)
        return ids, np.bincount(owner, weights=width, minlength=len(words)).astype(np.int64)

    def _merge(self, points: np.ndarray, symbols: np.ndarray, segment: np.ndarray, alive: np.ndarray) -> None:
        """Merge rounds in place.  A round takes the least rank of each segment, merges all pairs of that rank at
        once (of overlapping ones those that come first, from the left), and drops the right symbols; segments in
        which no pair is left leave.  The library merges one pair at a time: that is the same unless a merge makes
        a pair of no higher rank, and a segment where one does is done again pair by pair."""
        at = np.flatnonzero(np.r_[False, segment[1:] == segment[:-1]] | np.r_[segment[1:] == segment[:-1], False]) if len(symbols) > 1 else np.zeros(0, np.int64)
        sym, seg = symbols[at], segment[at]
        redo: list[int] = []
        into, rank = self._pair(sym[:-1], sym[1:]) if len(sym) else (sym, sym)
        if len(sym):
            rank = np.r_[np.where(seg[1:] == seg[:-1], rank, NONE), NONE].astype(np.int32)
            into = np.r_[into, 0]
        while len(sym):
            start = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            sizes = np.diff(np.r_[start, len(seg)])
            least = np.minimum.reduceat(rank, start)
            busy = np.repeat(least != NONE, sizes)
            if not busy.all():
                symbols[at[~busy]] = sym[~busy]
                at, sym, seg, rank, into = (x[busy] for x in (at, sym, seg, rank, into))
                continue
            least = np.repeat(least, sizes)
            hit = np.flatnonzero(rank == least)
            run = np.maximum.accumulate(np.where(np.r_[True, hit[1:] != hit[:-1] + 1], np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            was = rank[hit]
            sym[hit] = into[hit]
            gone = np.zeros(len(sym), dtype=bool)
            gone[hit + 1] = True
            alive[at[gone]] = False
            keep = ~gone
            new = (np.cumsum(keep) - 1)[hit]
            at, sym, seg, rank, into = (x[keep] for x in (at, sym, seg, rank, into))
            bad = []
            for left, old in ((new, was), (new[new > 0] - 1, was[new > 0])):
                right = np.minimum(left + 1, len(sym) - 1)
                m, r = self._pair(sym[left], sym[right])
                r = np.where((right > left) & (seg[left] == seg[right]), r, NONE)
                rank[left], into[left] = r, m
                bad.append(seg[left[r <= old]])
            wrong = np.unique(np.concatenate(bad))
            if len(wrong):
                redo += wrong.tolist()
                stay = ~np.isin(seg, wrong)
                at, sym, seg, rank, into = (x[stay] for x in (at, sym, seg, rank, into))
        for s in redo:
            self._one_by_one(points, symbols, alive, int(np.searchsorted(segment, s)), int(np.searchsorted(segment, s, "right")))

    def _one_by_one(self, points: np.ndarray, symbols: np.ndarray, alive: np.ndarray, low: int, high: int) -> None:
        """The segment low to high, pair by pair: least rank first, then from the left."""
        sym = self.point_symbols[np.searchsorted(self.points, points[low:high])].tolist()
        nxt, prev = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(k: int) -> None:
            if 0 <= k and nxt[k] < len(sym) and sym[k] is not None:
                a, b = sym[k], sym[nxt[k]]
                if (got := self.pairs.get(a * self.size + b)) is not None:
                    heapq.heappush(heap, (got[1], k, a, b))

        for k in range(len(sym) - 1):
            push(k)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            if sym[k] != a or nxt[k] >= len(sym) or sym[nxt[k]] != b:
                continue
            gone = nxt[k]
            sym[k] = self.pairs[a * self.size + b][0]
            sym[gone] = None
            nxt[k] = nxt[gone]
            if nxt[k] < len(sym):
                prev[nxt[k]] = k
            push(prev[k])
            push(k)
        for k, x in enumerate(sym):
            alive[low + k] = x is not None
            if x is not None:
                symbols[low + k] = x

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with the begin and end ids."""
        parts = [_WORDS.findall(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts]
        distinct: dict[str, int] = {}
        codes = np.array([distinct.setdefault(w, len(distinct)) for p in parts for w in p], dtype=np.int64)
        ids, counts = self.words(list(distinct))
        start = np.cumsum(counts) - counts
        size = counts[codes]
        total = np.cumsum(size)
        every = ids[np.repeat(start[codes] - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]
        ends = np.r_[0, total][np.cumsum([len(p) for p in parts], dtype=np.int64)] if parts else []
        out, at = [], 0
        for end in ends:
            out.append(np.r_[self.bos, every[at:end], self.eos])
            at = end
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each row of ids: surfaces in a row, without the space that encoding put before."""
        if not ids:
            return []
        codecs.register_error("sievemill_bytes", _each_byte)
        flat = np.concatenate(ids).astype(np.int64)
        size = self.surface_size[flat]
        total = np.cumsum(size)
        data = self.surface[np.repeat(self.surface_start[flat] - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)].tobytes()
        ends = np.r_[0, total][np.cumsum([len(x) for x in ids])]
        out, at = [], 0
        for row, end in zip(ids, ends.tolist(), strict=True):
            lead = row[(row != self.bos) & (row != self.eos)][:1]
            skip = int(len(lead) > 0 and bool(self.spaced[lead[0]]))
            out.append(data[at + skip : end].decode("utf-8", "sievemill_bytes"))
            at = end
        return out


def load(model: bytes) -> Bpe:
    """The tables of a model, built once in each Python process.

    They are kept in sys, as the globals of this module travel with every task and so are new in each.
    """
    loaded = sys.__dict__.setdefault("_sievemill_models", {})
    key = hashlib.sha256(model).hexdigest()
    if key not in loaded:
        loaded[key] = Bpe(model)
    return loaded[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_and_decode(df: DataFrame, model: str | None = None, text: str = "text", keep: list[str] | None = None, rows: bool = True) -> DataFrame:
    """df with n_tokens, ids_sha256 (of little-endian 32-bit ids) and decoded_sha256, and if rows is set also
    token_ids (array) and decoded (the text that the ids give back).

    model: path of a SentencePiece BPE model; the driver reads it and it travels with the tasks.  A null or empty text has
    the begin and end ids only.  Texts are taken whole; equal texts give equal rows.
    """
    with open(model or default_model(), "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(texts: list[str]) -> dict[str, list]:
        bpe = load(shared.value)
        ids = bpe.encode(texts)
        decoded = bpe.decode(ids)
        out = {
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
        }
        return out | ({"token_ids": ids, "decoded": decoded} if rows else {})

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if rows:
        fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return map_texts(df, run, fields, text, keep)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"], rows=False)
