"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no piece can reach across: before each run of the space mark, and around characters that occur in
no piece of two or more characters. The words of a slice are merged together: one flat array of symbols, in each round
the best-ranked pair of every word, all its leftmost non-overlapping places at once, then compaction, until no pair is
left. Words seen before come from a bounded per-worker memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, ragged, slices

SPACE = "▁"
NONE = np.iinfo(np.int64).max
#: Words and code points of words that one worker remembers at most.
MEMORY_WORDS, MEMORY_CHARS = 150_000, 64


class PieceModel:
    """The pieces of a BPE model file and the pair table for merge rounds."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kind = model.normalizer_spec, pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only BPE models with identity normalisation and a dummy prefix")
        self.bos, self.eos = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces aren't supported")
        self.byte_ids = np.zeros(256, np.int64)
        self.bytes_of = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kind.NORMAL:
                self.bytes_of[i] = p.piece.replace(SPACE, " ").encode()
        self.normal, self.size = normal, len(model.pieces)
        # characters get symbols: a piece's id, or an id above them all (such a character isn't a piece itself)
        self.first = {p: i for p, i in normal.items() if len(p) == 1}
        inner = {c for p in normal if len(p) > 1 for c in p}
        for c in sorted(inner - self.first.keys()):
            self.first[c] = self.size + len(self.first)
        self.alone = "".join(sorted(c for c in self.first if c not in inner))
        names = normal | self.first
        order = sorted(normal, key=lambda p: -model.pieces[normal[p]].score)
        rank = {p: r for r, p in enumerate(order)}
        keys, made, ranks = [], [], []
        self.width = max(names.values()) + 1
        for p in normal:
            for cut in range(1, len(p)):
                if (a := names.get(p[:cut])) is not None and (b := names.get(p[cut:])) is not None:
                    keys.append(a * self.width + b)
                    made.append(normal[p])
                    ranks.append(rank[p])
        at = np.argsort(keys)
        self.keys, self.made, self.ranks = np.array(keys)[at], np.array(made)[at], np.array(ranks)[at]
        # no piece may hold a space mark after another character, else words couldn't be merged apart
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces that reach across words aren't supported")
        # "\n" and the like are in no longer piece; they are words of their own
        cuts = "".join(c for c in "\n\t\r" if c not in inner)
        self.words = re.compile(f"[{cuts}]| +[^ {cuts}]*|[^ {cuts}]+")
        lengths = np.array([len(b) for b in self.bytes_of])
        self.piece_bytes, self.piece_len = np.frombuffer(b"".join(self.bytes_of), np.uint8), lengths
        self.piece_at = np.cumsum(lengths) - lengths

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; NONE where the two don't merge. Negative symbols never merge."""
        key = np.where((a < 0) | (b < 0), -1, a * self.width + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.made[at], -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and each word's number of ids."""
        lengths = np.array([len(w) for w in words])
        chars = "".join(words).replace(" ", SPACE)
        codes = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        known, where = np.unique(codes, return_inverse=True)
        # a character outside all pieces is -1 - code: it never merges and becomes bytes
        sym = np.array([self.first.get(chr(c), -1 - int(c)) for c in known], np.int64)[where] if len(known) else codes
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        rank, made = np.full(len(sym), NONE), np.full(len(sym), -1)
        rank[:-1], made[:-1] = self.pairs(sym[:-1], sym[1:])
        rank[:-1][word[1:] != word[:-1]] = NONE
        while len(sym):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[begin, len(sym)])
            lowest = np.minimum.reduceat(rank, begin)
            best = np.repeat(lowest, size)
            if (lowest == NONE).any():
                live = best != NONE
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, made, best = sym[live], word[live], rank[live], made[live], best[live]
                if not len(sym):
                    break
            # of touching places, every second one from the left
            spot = np.flatnonzero(rank == best)
            near = (spot[1:] == spot[:-1] + 1) & (word[spot[1:]] == word[spot[:-1]])
            if near.any():
                head = np.flatnonzero(np.r_[True, ~near])
                spot = spot[(np.arange(len(spot)) - np.repeat(head, np.diff(np.r_[head, len(spot)]))) % 2 == 0]
            # pairs of the products with what then stands beside them; the left one may be a product of this round
            new, w = made[spot], word[spot]
            before = spot - 1
            left = np.where((spot > 0) & (word[before] == w), sym[before], -1)
            close = np.flatnonzero(np.r_[False, (spot[1:] == spot[:-1] + 2) & (w[1:] == w[:-1])])
            left[close], before[close] = new[close - 1], spot[close - 1]
            after = np.minimum(spot + 2, len(sym) - 1)
            right = np.where((spot + 2 < len(sym)) & (word[after] == w), sym[after], -1)
            left_rank, left_made = self.pairs(left, new)
            right_rank, right_made = self.pairs(new, right)
            # a merge whose product pairs up better than this rank ends the round for its word
            better = np.flatnonzero(np.minimum(left_rank, right_rank) < rank[spot])
            if len(better):
                first = better[np.r_[True, w[better[1:]] != w[better[:-1]]]]
                stop = np.full(int(w.max()) + 1, len(spot))
                stop[w[first]] = first
                keep = np.arange(len(spot)) <= stop[w]
                spot, new, before, left = spot[keep], new[keep], before[keep], left[keep]
                left_rank, left_made, right_rank, right_made = left_rank[keep], left_made[keep], right_rank[keep], right_made[keep]
            sym[spot], rank[spot], made[spot] = new, right_rank, right_made
            own = left != -1
            rank[before[own]], made[before[own]] = left_rank[own], left_made[own]
            gone = np.ones(len(sym), bool)
            gone[spot + 1] = False
            sym, word, rank, made = sym[gone], word[gone], rank[gone], made[gone]
        sym = np.concatenate(done_sym) if done_sym else sym
        word = np.concatenate(done_word) if done_word else word
        at = np.argsort(word, kind="stable")
        sym, word = sym[at], word[at]
        # what is no piece goes out as its UTF-8 bytes
        odd = (sym < 0) | (sym >= self.size)
        if odd.any():
            back = {v: k for k, v in self.first.items() if v >= self.size}
            raw = [(back[int(s)] if s >= 0 else chr(-1 - int(s))).encode("utf-8", "surrogatepass") for s in sym[odd]]
            n = np.ones(len(sym), np.int64)
            n[odd] = [len(r) for r in raw]
            wide, odd = np.repeat(sym, n), np.repeat(odd, n)
            wide[odd] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            sym, word = wide, np.repeat(word, n)
        return sym, np.bincount(word, minlength=len(words))


class PieceCodec:
    """Encodes and decodes texts of a slice; remembers the ids of short words, a bounded number of them."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat, self.at, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        ids, n = self.model.merge(words)
        self.seen.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.at = np.r_[self.at, len(self.flat) + np.cumsum(n) - n]
        self.n = np.r_[self.n, n]
        self.flat = np.r_[self.flat, ids.astype(np.int32)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with begin and end ids, one text after the other, and each text's number of ids."""
        cut = [self.model.words.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.seen) > MEMORY_WORDS:
            self.forget()
        new = sorted(set(chain.from_iterable(cut)).difference(self.seen))
        if new:
            self.learn(new)
        n_words = np.array([len(ws) for ws in cut], np.int64)
        index = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(cut)), np.int64, int(n_words.sum()))
        sizes = self.n[index]
        ends = np.r_[0, np.cumsum(sizes)]
        word_ends = np.cumsum(n_words)
        n = ends[word_ends] - ends[word_ends - n_words]
        out = np.empty(int(n.sum()) + 2 * len(texts), np.int32)
        body = np.ones(len(out), bool)
        stop = np.cumsum(n + 2)
        body[stop - 1] = body[stop - n - 2] = False
        out[stop - n - 2], out[stop - 1] = self.model.bos, self.model.eos
        out[body] = self.flat[ragged(self.at[index], sizes)]
        for w in [w for w in new if len(w) > MEMORY_CHARS]:  # long words aren't kept: their ids would never come again
            del self.seen[w]
        return out, n + 2

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; begin and end ids are nothing, and the space that encoding put in front goes."""
        m = self.model
        raw = m.piece_bytes[ragged(m.piece_at[ids], m.piece_len[ids])].tobytes()
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    return _CODECS.setdefault(path, None) or _CODECS.__setitem__(path, PieceCodec(path)) or _CODECS[path]


def encode_texts(docs: DataFrame, model: str, with_ids: bool = True, text: str = "text") -> DataFrame:
    """Each document's ids under a SentencePiece BPE model, and the text that they decode to.

    docs: doc_id and text; other columns are ignored. Returns doc_id, n_tokens, ids (array of int, with begin and end
    ids; left out without with_ids), ids_sha256 (of little-endian 32-bit ids), decoded, decoded_sha256. A null text
    counts as empty: begin and end ids, decoded "". Each row is handled alone: repeated rows, ties and null doc_id keep
    their rows, an empty table gives an empty one, and long texts have no limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch, texts in slices(batches):
            ids, n = c.encode(texts)
            at = np.r_[0, np.cumsum(n)]
            own = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            decoded = [c.decode(x) for x in own]
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64())}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            out["ids_sha256"] = pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own])
            if with_ids:
                out["decoded"] = pa.array(decoded)
            out["decoded_sha256"] = pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded])
            yield pa.RecordBatch.from_pydict(out)

    extra = ("ids array<int>, ", "decoded string, ") if with_ids else ("", "")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, {extra[0]}ids_sha256 string, {extra[1]}decoded_sha256 string")
