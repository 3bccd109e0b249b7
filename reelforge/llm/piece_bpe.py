"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

All distinct words of a batch lie in one flat symbol array.  Each round takes
the best pair of every word by a segmented minimum, merges its leftmost
non-overlapping occurrences in all words at once, and compacts the array; a
word without a pair leaves.  The result equals merging one pair at a time, best
score first and leftmost among equals: occurrences are merged together only if
no pair that such a merge can create scores as well or better ("calm" pieces);
of other pieces only the leftmost occurrence is merged in a round.

A long word (unspaced script, base64, minified code) would take a round for each
of its ranks.  There a round takes every pair that is best within as many symbols
on either side as the longest piece has characters: nothing outside that window
can grow a piece that reaches the pair before the pair itself is the best one.
Rounds then depend on the window, not on the word.

A word is a run of spaces with what follows it.  No piece of the model holds a
space after another character, so that no merge crosses a word's start; the
same holds for line feeds, which are in no piece.  Both are checked on loading.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

SPACE = "▁"
#: Symbols from which on the rounds of a word look at windows.
LONG = 256
#: Distinct words, and their characters, remembered from batch to batch.
CACHE, CACHE_CHARS = 400_000, 1 << 24
_NONE = np.iinfo(np.int32).max
_WORDS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")


class PieceModel:
    """Tables of a BPE model with byte fallback and identity normalisation."""

    def __init__(self, model: bytes):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) for i in range(size)]
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        if any(sp.is_unused(i) for i in range(size)):
            raise ValueError("unused pieces aren't supported")
        if sp.encode("a") != sp.encode("a ")[: len(sp.encode("a"))] or sp.decode(sp.encode("ﬁ  a ")) != "ﬁ  a ":
            raise ValueError("only models with identity normalisation are supported")
        normal = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal):
            raise ValueError("words can't be split before spaces and line feeds with this model")
        self.size, self.eos = size, sp.eos_id()
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        # Characters: those of the model, then further ones that only occur inside pieces.
        self.chars = dict(normal)
        inner = sorted({c for p in normal for c in p} - normal.keys())
        self.inner = inner
        symbol = normal | {c: size + k for k, c in enumerate(inner)}
        self.symbol_of = {c: i for c, i in symbol.items() if len(c) == 1}
        self.unknown_from = size + len(inner)
        scores = np.array([sp.get_score(i) for i in range(size)])
        levels = np.unique(-scores)
        rank = np.searchsorted(levels, -scores).astype(np.int32)
        self.base = self.unknown_from
        keys, merged = [], []
        calm = np.ones(size, dtype=bool)
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if left is None or right is None:
                    continue
                keys.append(left * self.base + right)
                merged.append(i)
                for part in (left, right):
                    if part < size and rank[i] <= rank[part]:
                        calm[part] = False
        self.rank, self.calm = rank, calm
        self.window = 1 << max(map(len, normal)).bit_length()
        self._hash(np.array(keys, dtype=np.uint64), np.array(merged, dtype=np.int32))
        # Bytes of each piece for decoding.
        raw = [b"" if special[i] else self.pieces[i].replace(SPACE, " ").encode() for i in range(size)]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        unknown = sp.unk_id()
        if unknown >= 0:
            raw[unknown] = sp.decode([unknown]).encode()
        self.raw_length = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def _hash(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """Open addressing; all keys are placed a probe step at a time."""
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.slot_piece = np.zeros(1 << bits, dtype=np.int32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.slot_key[at[left]] == np.iinfo(np.uint64).max
            order = left[free]
            _, first = np.unique(at[order], return_index=True)
            put = order[first]
            self.slot_key[at[put]] = keys[put]
            self.slot_piece[at[put]] = merged[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            left = left[rest[left]]
            taken = self.slot_key[at[left]] != keys[left]
            left = left[taken]  # the same pair twice gives the same piece
            at[left] = (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        out = np.full(len(left), -1, dtype=np.int32)
        ask = np.flatnonzero((left < self.base) & (right < self.base))
        keys = left[ask].astype(np.uint64) * np.uint64(self.base) + right[ask].astype(np.uint64)
        at = self._home(keys)
        while len(ask):
            found = self.slot_key[at]
            hit = found == keys
            out[ask[hit]] = self.slot_piece[at[hit]]
            go = ~hit & (found != np.iinfo(np.uint64).max)
            ask, keys, at = ask[go], keys[go], (at[go] + 1) & self.mask
        return out

    # -- encoding ---------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """Keys of the words: a leading space is left out, a line feed stays."""
        if not text:
            return []
        if SPACE not in text:
            flat = text.replace("\n", " \n") if "\n" in text else text
            if "  " not in flat and flat[0] != " " and flat[-1] != " ":
                return flat.split(" ")
        return [w[1:] if w[0] == SPACE else w for w in _WORDS.findall(SPACE + text.replace(" ", SPACE))]

    def encode_words(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each word) for keys of ``words``."""
        texts = [k if k[:1] == "\n" else SPACE + k for k in keys]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        sym = self._symbols(points)
        word = np.repeat(np.arange(len(texts)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        long = lengths[word] > LONG
        self._rounds(sym[~long], word[~long], done)
        if long.any():
            self._window_rounds(sym[long], word[long], done)
        if not done:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        word = np.concatenate([d[0] for d in done])
        sym = np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        return self._bytes(sym[order], word[order], len(texts))

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        found, back = np.unique(points, return_inverse=True)
        own = np.array([self.symbol_of.get(chr(p), self.unknown_from + p) for p in found.tolist()], dtype=np.int32)
        return own[back] if len(own) else np.zeros(0, dtype=np.int32)

    def _ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pairs that start at the given positions."""
        rank, piece = np.full(len(at), _NONE, dtype=np.int32), np.full(len(at), -1, dtype=np.int32)
        ok = np.flatnonzero(at + 1 < len(sym))
        ok = ok[word[at[ok]] == word[at[ok] + 1]]
        made = self.pair(sym[at[ok]], sym[at[ok] + 1])
        hit = made >= 0
        rank[ok[hit]], piece[ok[hit]] = self.rank[made[hit]], made[hit]
        return rank, piece

    def _rounds(self, sym: np.ndarray, word: np.ndarray, done: list) -> None:
        if not len(sym):
            return
        rank, piece = self._ranks(sym, word, np.arange(len(sym)))
        while len(sym):
            first = np.ones(len(sym), dtype=bool)
            first[1:] = word[1:] != word[:-1]
            start = np.flatnonzero(first)
            size = np.diff(np.append(start, len(sym)))
            best = np.minimum.reduceat(rank, start)
            over = best == _NONE
            if over.any():  # these words are finished
                gone = np.repeat(over, size)
                done.append((word[gone], sym[gone]))
                stay = ~gone
                sym, word, rank, piece, first = sym[stay], word[stay], rank[stay], piece[stay], first[stay]
                if not len(sym):
                    return
                best, size = best[~over], size[~over]
                start = np.flatnonzero(first)
            at = np.flatnonzero(rank == np.repeat(best, size))
            # Leftmost of each word; of calm pieces every second one in runs of neighbours.
            lead = np.ones(len(at), dtype=bool)
            lead[1:] = word[at[1:]] != word[at[:-1]]
            run = lead.copy()
            run[1:] |= at[1:] != at[:-1] + 1
            place = np.arange(len(at))
            since = place - np.maximum.accumulate(np.where(run, place, 0))
            word_of = np.cumsum(lead) - 1
            all_calm = np.logical_and.reduceat(self.calm[piece[at]], np.flatnonzero(lead))
            at = at[lead | (all_calm[word_of] & (since % 2 == 0))]
            sym, word, rank, piece = self._merged(at, sym, word, rank, piece)

    def _merged(self, at: np.ndarray, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, ...]:
        """The arrays after merging the pairs that start at the given positions."""
        sym[at] = piece[at]
        stay = np.ones(len(sym), dtype=bool)
        stay[at + 1] = False
        moved = np.cumsum(stay) - 1
        sym, word, rank, piece = sym[stay], word[stay], rank[stay], piece[stay]
        at = moved[at]
        touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
        rank[touched], piece[touched] = self._ranks(sym, word, touched)
        return sym, word, rank, piece

    def _window_rounds(self, sym: np.ndarray, word: np.ndarray, done: list) -> None:
        """The same result; each round merges all pairs that are best in their window.

        Among equal ranks side by side the leftmost counts: such a run is merged
        only if it is known from its first pair on, every second pair of it.
        """
        rank, piece = self._ranks(sym, word, np.arange(len(sym)))
        while len(sym) and (rank != _NONE).any():
            before, after = _lowest(rank, self.window), _lowest(rank[::-1], self.window)[::-1]
            best = (rank != _NONE) & (rank <= after) & ((rank < before) | ((rank == before) & self.calm[piece]))
            at = np.flatnonzero(best)
            run = np.ones(len(at), dtype=bool)
            run[1:] = at[1:] != at[:-1] + 1
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            known = (at[first] == 0) | (rank[at[first] - 1] != rank[at[first]])
            at = at[known & ((np.arange(len(at)) - first) % 2 == 0)]
            sym, word, rank, piece = self._merged(at, sym, word, rank, piece)
        done.append((word, sym))

    def _bytes(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece become the pieces of their UTF-8 bytes."""
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):
            texts = [self.inner[s - self.size] if s < self.unknown_from else chr(s - self.unknown_from) for s in sym[odd].tolist()]
            coded = [t.encode() for t in texts]
            repeat = np.ones(len(sym), dtype=np.int64)
            repeat[odd] = [len(c) for c in coded]
            start = np.cumsum(repeat) - repeat
            sym, word = np.repeat(sym, repeat), np.repeat(word, repeat)
            for i, c in zip(start[odd].tolist(), coded, strict=True):
                sym[i : i + len(c)] = self.byte_ids[list(c)]
        return sym.astype(np.int32), np.bincount(word, minlength=n)

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text with the end id."""
        keys = self.words(text or "")
        return [*self.encode_words(keys)[0].tolist(), self.eos]

    # -- decoding ---------------------------------------------------------

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of id lists that lie one behind the other.

        Pieces become their bytes, control ids nothing; one leading space, put
        there on encoding, goes; bytes that aren't UTF-8 become U+FFFD.
        """
        length = self.raw_length[ids]
        bound = np.concatenate([[0], np.cumsum(length)])
        where = np.repeat(self.raw_start[ids] - bound[:-1], length) + np.arange(bound[-1])
        data = self.raw[where].tobytes()
        stop = bound[np.cumsum(counts)]
        begin = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
        out = []
        for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
            out.append(data[a + (data[a : a + 1] == b" ") if a < b else a : b].decode(errors="replace"))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_flat(np.array(ids, dtype=np.int64), np.array([len(ids)]))[0]


def _lowest(rank: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` (a power of two) ranks before each position."""
    low, step = rank.copy(), 1
    while step < width:
        low[step:] = np.minimum(low[step:], low[:-step])
        step *= 2
    return np.concatenate([np.full(1, _NONE, dtype=rank.dtype), low[:-1]])


class WordCache:
    """Ids of words seen, bounded in number and characters; word k has flat[start[k] : start[k] + count[k]]."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.flat = np.zeros(0, dtype=np.int32)
        self.start = self.count = np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids with end ids, ids of each text)."""
        keys = [self.model.words(t or "") for t in texts]
        if len(self.place) > CACHE or self.chars > CACHE_CHARS:
            self.clear()
        fresh = list({k for ks in keys for k in ks if k not in self.place})
        if fresh:
            self.chars += sum(map(len, fresh))
            ids, counts = self.model.encode_words(fresh)
            known = len(self.place)
            self.place.update(zip(fresh, range(known, known + len(fresh)), strict=True))
            self.start = np.concatenate([self.start, np.cumsum(counts) - counts + len(self.flat)])
            self.count = np.concatenate([self.count, counts])
            self.flat = np.concatenate([self.flat, ids])
        place = self.place
        n_words = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
        at = np.fromiter((place[k] for ks in keys for k in ks), dtype=np.int64, count=int(n_words.sum()))
        size = self.count[at]
        bound = np.concatenate([[0], np.cumsum(size)])
        body = self.flat[np.repeat(self.start[at] - bound[:-1], size) + np.arange(bound[-1])]
        text_end = bound[np.cumsum(n_words)]
        counts = np.diff(np.concatenate([[0], text_end])) + 1
        out = np.full(len(body) + len(texts), self.model.eos, dtype=np.int32)
        keep = np.ones(len(out), dtype=bool)
        keep[np.cumsum(counts) - 1] = False
        out[keep] = body
        return out, counts


def _tokenise(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel(model)
        cache = WordCache(pieces)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at, chars, sizes = 0, 0, [len(t or "") for t in texts]
            for end in range(1, len(texts) + 1):  # batches of long texts are cut
                chars += sizes[end - 1]
                if chars >= 1 << 22 or end == len(texts):
                    ids, counts = cache.encode(texts[at:end])
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(at, end - at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(pieces.decode_flat(ids, counts), type=pa.string())],
                        names=["doc_id", "ids", "decoded"],
                    )
                    at, chars = end, 0

    return run


def tokenise(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids array<int> (with the end id), decoded string.

    The model file is read by the driver and sent to the tasks (its size, about
    half a megabyte, doesn't depend on the data).  A null text counts as empty:
    its ids are the end id alone.  Rows may repeat; other columns are ignored.
    """
    prepare(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_tokenise(model), "doc_id long, ids array<int>, decoded string")
