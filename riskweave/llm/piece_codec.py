"""Encoding and decoding with a SentencePiece vocabulary of merged pieces.

Words (a space mark and the characters up to the next one) of equal length
advance together through one numpy Viterbi: the hashes of all substrings
probe the sorted keys of the pieces, and for each end position a maximum
over the possible last pieces stores the backpointer. A path may only join
two pieces that the merge rules leave side by side; such a path is unique
for every prefix, so that the segmentation is the one that merging the best
pair again and again gives. Whether two pieces stay side by side follows
from their merge trees alone and is remembered per pair. Words already seen
by the process are looked up.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskweave.llm.frames import batch, text_pieces, with_fallback
from riskweave.llm.words import mix, powers

SPACE = "▁"
# Words that a process remembers; it forgets all when there are more.
WORDS = 400_000
# Slots for remembered pairs (a later pair takes the place of an earlier one),
# and for the leading bits of the pieces' keys.
PAIR_SLOTS, KEY_SLOTS = 1 << 20, 1 << 22
# Words of one Viterbi batch, times their length.
CELLS = 400_000

RESULT = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])


def merged(symbols: list[str], score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Merge the best adjacent pair (the leftmost of equals) until none is a
    piece: (symbols, last merge)."""
    last = None
    while len(symbols) > 1:
        best = max(((score[a + b], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in score), default=None)
        if best is None:
            break
        k = -best[1]
        last = (symbols[k], symbols[k + 1])
        symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2:]]
    return symbols, last


def hashed(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes (rows x length + 1) of rows of code points."""
    up, _ = powers(codes.shape[1])
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    np.cumsum((mix(codes.astype(np.uint64) + np.uint64(1)) * up[:codes.shape[1]]), axis=1, out=out[:, 1:])
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PieceCodec(dict):
    """Word (without its space mark) -> ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        import sentencepiece
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(k) for k in range(n)]
        self.score = {p: model.get_score(k) for k, p in enumerate(self.pieces)
                      if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))}
        number = {p: k for k, p in enumerate(self.pieces)}
        self.byte_id = np.array([number[f"<0x{b:02X}>"] for b in range(256)])
        self.space_id = number[SPACE]
        self.unknown = n  # a character that no piece spells; written as its bytes
        spaces = [p for p in self.score if not p.strip(SPACE) and len(p) > 1]
        others = [p for p in self.score if p.strip(SPACE) and len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) for p in others):
            raise ValueError("a piece spans words")
        if spaces and others and max(self.score[p] for p in spaces) >= min(self.score[p] for p in others):
            raise ValueError("pieces of space marks are not merged last")
        if len({self.score[p] for p in others}) < len(others):
            raise ValueError("two pieces are merged with the same priority")
        self.spaces = {p: self.score[p] for p in spaces}
        self.number = number

        # Merge trees of the pieces that merging really forms; rank: order of merges, -1 for one character.
        self.rank = np.full(n + 1, -1.0)
        self.left, self.right = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        formed = [number[p] for p in self.score if len(p) == 1]
        for p in others:
            symbols, last = merged(list(p), self.score)
            if len(symbols) == 1:
                k = number[p]
                self.rank[k], self.left[k], self.right[k] = -self.score[p], number[last[0]], number[last[1]]
                formed.append(k)
                if max(self.rank[self.left[k]], self.rank[self.right[k]]) >= self.rank[k]:
                    raise ValueError("a piece is merged before its parts")
        self.longest = max((len(self.pieces[k]) for k in formed), default=1)
        self.length = np.ones(n + 1, np.int64)
        self.hash = np.zeros(n + 1, np.uint64)
        for k in formed:
            self.length[k], self.hash[k] = len(self.pieces[k]), hashed(code_points(self.pieces[k])[None])[0, -1]
        order = np.argsort(self.hash[formed])
        self.key_id = np.array(formed)[order]
        self.keys = self.hash[self.key_id]
        self.key_slot = np.zeros(KEY_SLOTS, bool)
        self.key_slot[self.slot(self.keys)] = True
        self.pair_key, self.pair_ok = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)

        # Decoding: the bytes of every piece.
        spelled = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b in range(256):
            spelled[self.byte_id[b]] = bytes([b])
        for k in range(n):
            if model.is_control(k):
                spelled[k] = b""
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(42)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes; -1 where there is none. Only hashes
        whose leading bits some key has are searched in the sorted keys."""
        out = np.full(hashes.shape, -1, np.int64)
        some = self.key_slot[self.slot(hashes)]
        few = hashes[some]
        at = np.minimum(np.searchsorted(self.keys, few), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == few, self.key_id[at], -1)
        return out

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces a and b apart when b follows a.

        Goes back in time along the right edge of a's tree and the left edge
        of b's: while both symbols stood there, no merge of the two may have
        come before the merges that took them up (the leftmost of equals
        comes first)."""
        ok, rows = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.copy(), b.copy()
        end_a, end_b = np.full(len(a), np.inf), np.full(len(a), np.inf)
        up, _ = powers(1)
        while len(rows):
            cross = self.find(self.hash[a] + self.hash[b] * up[self.length[a]])
            time = np.where(cross >= 0, self.rank[cross], np.inf)
            fires = (cross >= 0) & (time < end_a) & (time <= end_b)
            ok[rows[fires]] = False
            back_a = self.rank[a] > self.rank[b]
            more = ~fires & ~((self.rank[a] < 0) & (self.rank[b] < 0))
            end_a, end_b = np.where(back_a, self.rank[a], end_a), np.where(back_a, end_b, self.rank[b])
            a, b = np.where(back_a, self.right[a], a), np.where(back_a, b, self.left[b])
            rows, a, b, end_a, end_b = rows[more], a[more], b[more], end_a[more], end_b[more]
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`side_by_side`, remembered per pair."""
        key = a * np.int64(1 << 20) + b
        slot = (mix(key) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        missing = np.flatnonzero(self.pair_key[slot] != key)
        out = self.pair_ok[slot]
        if len(missing):
            new, where = np.unique(key[missing], return_inverse=True)
            ok = self.side_by_side(new >> 20, new & ((1 << 20) - 1))
            out[missing] = ok[where]
            place = (mix(new) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
            # Of several pairs for one slot the last is stored: key and answer alike.
            _, kept = np.unique(place[::-1], return_index=True)
            kept = len(place) - 1 - kept
            self.pair_key[place[kept]], self.pair_ok[place[kept]] = new[kept], ok[kept]
        return out

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all words one after another, number of pieces of each)
        for words of one length (rows of code points)."""
        n, size = codes.shape
        _, down = powers(size)
        prefix = hashed(codes)
        widths = min(size, self.longest)
        last, back = np.full((n, size + 1), -1, np.int64), np.zeros((n, size + 1), np.int32)
        rows = np.arange(n)
        # Pieces are looked up for a window of ends at a time: a long word holds two numbers a character.
        window = max(1, CELLS // n)
        for lo in range(1, size + 1, window):
            hi = min(size + 1, lo + window)
            piece = np.full((widths + 1, n, hi - lo), -1, np.int64)  # [width, word, end - lo]
            for w in range(1, widths + 1):
                first = max(lo, w)
                if first < hi:
                    piece[w, :, first - lo:] = self.find((prefix[:, first:hi] - prefix[:, first - w:hi - w]) * down[first - w:hi - w])
            piece[1] = np.where(piece[1] < 0, self.unknown, piece[1])
            for end in range(lo, hi):
                m = min(end, widths)
                now = piece[1:m + 1, :, end - lo]                 # widths 1..m
                before = last[:, end - m:end][:, ::-1].T          # last piece of the prefix before each
                value = now >= 0
                test = value & (before >= 0) & (now != self.unknown) & (before != self.unknown)
                if test.any():
                    value[test] = self.compatible(before[test], now[test])
                width = (value * np.arange(1, m + 1)[:, None]).max(0)
                back[:, end], last[:, end] = width, now[width - 1, rows]
        if n == 1:
            return self.followed(last[0], back[0])
        at, steps = np.full(n, size), []
        while (at > 0).any():  # follow the backpointers of all words
            steps.append(np.where(at > 0, last[rows, at], -1))
            at = at - back[rows, at]
        tokens = np.stack(steps[::-1], 1)
        return tokens[tokens >= 0], (tokens >= 0).sum(1)

    @staticmethod
    def followed(last: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of one word by its backpointers, as ``viterbi`` returns them."""
        at, ends = len(last) - 1, array("i")
        while at > 0:
            ends.append(at)
            at -= int(back[at])
        tokens = last[np.array(ends, np.int64)[::-1]]
        return tokens, np.array([len(tokens)])

    def learn(self, words: list[str]) -> None:
        """Segment new words in batches of equal length and remember them."""
        if len(self) + len(words) > WORDS:
            self.clear()
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for size, same in by_length.items():
            step = max(1, CELLS // (size + 1))
            for k in range(0, len(same), step):
                part = same[k:k + step]
                codes = code_points("".join(SPACE + w for w in part)).reshape(len(part), size + 1)
                ids, counts = self.viterbi(codes)
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                self.update(zip(part, [data[4 * s:4 * e] for s, e in zip((ends - counts).tolist(), ends.tolist())]))
                strange = np.unique(np.searchsorted(ends, np.flatnonzero(ids == self.unknown), "right"))
                for r in strange.tolist():
                    self[part[r]] = self.with_bytes(codes[r], ids[ends[r] - counts[r]:ends[r]]).astype("<u4").tobytes()

    def with_bytes(self, row: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Characters that no piece spells as the ids of their UTF-8 bytes."""
        out, at = [], 0
        for k in ids.tolist():
            if k == self.unknown:
                out += self.byte_id[list(chr(row[at]).encode("utf-8", "surrogatepass"))].tolist()
            else:
                out.append(k)
            at += int(self.length[k])
        return np.array(out, np.int64)

    def run(self, n: int) -> bytes:
        """Ids of ``n`` space marks alone."""
        out: list[str] = []
        longest = max(map(len, self.spaces), default=1)
        while n >= 2 * longest:  # the leftmost marks are merged first, to the longest piece
            out.append(SPACE * longest)
            n -= longest
        out += merged([SPACE] * n, self.spaces)[0]
        return np.array([self.number[s] for s in out], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian 32-bit bytes."""
        split = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
        new: set[str] = set().union(*split)
        new.discard("")
        new -= dict.keys(self)
        if new:
            if len(self) + len(new) > WORDS:  # learn() forgets; learn all words of these texts again
                new = {w for words in split for w in words if w}
            self.learn(sorted(new))
        out = []
        for words in split:
            if "" not in words:
                out.append(b"".join(map(self.__getitem__, words)))
                continue
            ids, marks = [], 0
            for w in words:
                marks += 1
                if w:
                    own = self[w]
                    alone = int.from_bytes(own[:4], "little") == self.space_id
                    if marks > 1:
                        ids.append(self.run(marks if alone else marks - 1))
                        own = own[4:] if alone else own
                    ids.append(own)
                    marks = 0
            if marks:
                ids.append(self.run(marks))
            out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; broken UTF-8 becomes replacement characters."""
        k = np.frombuffer(ids, "<u4")
        first, size = self.spelled_at[k], self.spelled_at[k + 1] - self.spelled_at[k]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        data = self.spelled[np.repeat(first, size) + place].tobytes()
        return data.decode("utf-8", "replace").removeprefix(" ")


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec per path and Python process."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit) and decoded text per row.

    A null text counts as empty and has no ids. A text that holds the space
    mark itself comes back with spaces instead. Repeated rows give repeated
    results; an empty table gives none; other columns are not read.
    """
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in text_pieces(texts, 4 << 20):
                ids = c.encode(texts[i:j])
                yield batch(out, doc_id=b.column("doc_id").slice(i, j - i), ids=ids, decoded=[c.decode(x) for x in ids])

    return with_fallback(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, ids binary, decoded string")


def digest_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, round_trip per row, of the
    ids and the text decoded from them (see `encode_documents`)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in text_pieces(texts, 4 << 20):
                ids = c.encode(texts[i:j])
                decoded = [c.decode(x) for x in ids]
                yield batch(RESULT, doc_id=b.column("doc_id").slice(i, j - i), n_ids=[len(x) // 4 for x in ids], ids_crc32=[zlib.crc32(x) for x in ids],
                            decoded_sha256=[hashlib.sha256(d.encode()).hexdigest() for d in decoded], round_trip=[d == t for d, t in zip(decoded, texts[i:j])])

    return with_fallback(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean")
