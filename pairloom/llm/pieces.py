"""SentencePiece encoding and decoding by a forward pass over the trie of distinct marked words.

A text is marked (a leading space is added where the model asks for it, spaces become the mark) and cut where no piece can lie across: before each run of
marks, and around characters that no piece holds. The distinct marked words of a portion of texts are sorted, which is a depth-first walk of their
trie: the forward table of a word is kept up to the prefix that it shares with the next, and only the rest is computed.

Forward tables. Unigram models: the best score of each prefix and the length of its last piece (Viterbi). BPE models, such as the default one: scores
there are merge ranks, which add up to nothing meaningful, so the best-scoring path is not the library's result. There the table holds the one last piece that merging
leaves at each prefix: a sequence of pieces is what merging yields exactly if each two neighbours are what merging yields for those two alone,
so a piece may follow the last piece of a shorter prefix if the pair stands. Results are those of the library in both cases. Words with
runs of marks or over ``LONGEST`` characters are merged directly, as runs of marks tie.

Characters outside the vocabulary become byte pieces where the model has them, else the unknown piece. The model's bytes are read once by the driver
and travel with the tasks; a vocabulary over ``MAX_MODEL_BYTES`` is refused. Memory: one portion of texts, its distinct words, and at most ``MAX_WORDS`` words that are known from before.

Edge cases: null and empty texts have no pieces and decode to an empty text; a mark character in the text itself decodes to a space, as in the library; null
doc_id and repeated rows come back as they are; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.store import tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MAX_MODEL_BYTES, PORTION, LONGEST, MAX_PAIRS, MAX_WORDS, _ODD = 64 << 20, 2_000_000, 256, 400_000, 500_000, 1 << 24
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = raw[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = raw[i : i + n], i + n
        yield tag >> 3, value


class PieceModel:
    def __init__(self, raw: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type, self.dummy_prefix, self.trim = UNIGRAM, True, True
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                self.dummy_prefix, self.trim = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
        if self.type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER, UNUSED)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        known = {c for p in self.ids for c in p}
        self.longest = max(map(len, self.ids), default=1)
        # for each end of a piece, two characters at least, the lengths and ids of the pieces that it ends with, longest first
        ends = {p[k:] for p in self.ids for k in range(len(p) - 1)}
        self.tails = {t: tuple((len(t) - k, self.ids[t[k:]]) for k in range(len(t) - 1) if t[k:] in self.ids) for t in ends}
        self.single = {p: i for p, i in self.ids.items() if len(p) == 1}
        crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        inner = "".join(re.escape(c) for c in sorted(known - {MARK}))
        word = f"[{inner}]+" if inner else "(?!)"
        self.words = re.compile(f"[{inner}{MARK}]+|." if crossing else f"{MARK}*{word}|{MARK}+|.", re.DOTALL)
        self.special = {i for i, k in enumerate(self.kinds) if k in (UNKNOWN, CONTROL, BYTE)}
        self.is_special = np.isin(np.arange(len(self.pieces)), list(self.special))
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()  # known words that do not decode to themselves
        self.floor = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10

    def marked(self, text: str) -> str:
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        return (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)

    def merged(self, word: str) -> list[str]:
        """What merging leaves of a word: of all adjacent parts whose union is a piece, the best-scoring union first, the leftmost of equals."""
        parts = list(word)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, left: int, right: int) -> bool:
        """Whether merging leaves two symbols (ids, or ``_ODD`` plus a code point) as they are; kept in ``pairs``."""
        a, b = (self.pieces[i] if i < _ODD else chr(i - _ODD) for i in (left, right))
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return known

    def to_ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            if (k := self.ids.get(p)) is not None:
                out.append(k)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of distinct words, which share the forward tables of common prefixes."""
        out: dict[str, list[int]] = {}
        last, held = [0], [0]  # for each prefix the length of its last piece, and that piece (BPE) or the prefix's score (unigram)
        before, merging = "", self.type == BPE
        step = self._last_merged if merging else self._last_best
        for word in sorted(words):
            if merging and (len(word) > LONGEST or word.startswith(MARK * 2)):
                out[word] = self.to_ids(self._merge_fast(word))
                continue
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], held[shared + 1 :]
            step(word, shared + 1, last, held)
            ids, end = [], len(word)
            if merging:
                while end:
                    ids.append(held[end])
                    end -= last[end]
                ids.reverse()
            if not merging or max(ids) >= _ODD:
                parts, end = [], len(word)
                while end:
                    parts.append(word[end - last[end] : end])
                    end -= last[end]
                ids = self.to_ids(parts[::-1])
            out[word] = ids
            before = word
        return out

    def _last_merged(self, word: str, first: int, last: list[int], held: list[int]) -> None:
        """Extends ``last`` and ``held`` by the prefixes that end at ``first`` and after."""
        tails, pairs, single = self.tails, self.pairs, self.single
        for end in range(first, len(word) + 1):
            found: tuple[tuple[int, int], ...] = ()
            start = end - 2
            while start >= 0 and (longer := tails.get(word[start:end])) is not None:
                found = longer
                start -= 1
            for n, piece in found:
                if n < end:
                    left = held[end - n]
                    known = pairs.get(left << 32 | piece)
                    if known is None:
                        known = self.stands(left, piece)
                else:
                    known = self.merged_whole(piece)
                if known:
                    last.append(n)
                    held.append(piece)
                    break
            else:
                last.append(1)
                c = word[end - 1]
                held.append(single.get(c) or self.ids.get(c, _ODD + ord(c)))

    @lru_cache(maxsize=1 << 16)  # noqa: B019  one model lives in a worker
    def merged_whole(self, piece: int) -> bool:
        return self.merged(self.pieces[piece]) == [self.pieces[piece]]

    def _last_best(self, word: str, first: int, last: list[int], score: list[float]) -> None:
        for end in range(first, len(word) + 1):
            best, length = score[end - 1] + (self.scores[k] if (k := self.ids.get(word[end - 1])) is not None else self.floor), 1
            for n in range(2, min(self.longest, end) + 1):
                if (k := self.ids.get(word[end - n : end])) is not None and score[end - n] + self.scores[k] >= best:
                    best, length = score[end - n] + self.scores[k], n
            last.append(length)
            score.append(best)

    def _merge_fast(self, word: str) -> list[str]:
        """``merged`` for long words, with a heap of unions."""
        import heapq

        parts: list[str | None] = list(word)
        after, ahead = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(parts)
            if i >= 0 and j < len(parts) and (k := self.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[i] < len(parts):
                ahead[after[i]] = i
            offer(ahead[i])
            offer(i)
        return [p for p in parts if p is not None]

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bool]]:
        """The ids of each text as 32-bit little-endian numbers, and whether they decode to it. Words stay known to later calls, ``MAX_WORDS`` at most."""
        found = [self.words.findall(self.marked(t)) if t else [] for t in texts]
        distinct = set().union(*found)
        if len(self.known) + len(distinct) > MAX_WORDS:
            self.known = {w: self.known[w] for w in distinct if w in self.known}
            self.odd &= distinct
        known = self.known
        for word, ids in self.encode_words(list(distinct.difference(known))).items():
            known[word] = array("i", ids).tobytes()
            if self.text(ids) != word:
                self.odd.add(word)
        odd = self.odd
        return [b"".join(map(known.__getitem__, ws)) for ws in found], [not odd or odd.isdisjoint(ws) for ws in found]

    def forget(self) -> None:
        self.known, self.odd = {}, set()

    def text(self, ids: list[int]) -> str:
        """What ids stand for, marks included."""
        if self.special.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids])
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i is not None and self.kinds[i] != CONTROL:
                out.append(" ⁇ " if self.kinds[i] == UNKNOWN else self.pieces[i])
        return "".join(out)

    def decode(self, ids: np.ndarray) -> str:
        text = self.text(ids.tolist()) if self.is_special[ids].any() else "".join(map(self.pieces.__getitem__, ids.tolist()))
        return (text[1:] if self.dummy_prefix and text.startswith(MARK) else text).replace(MARK, " ")


@lru_cache(maxsize=2)
def _model(raw: bytes) -> PieceModel:
    return PieceModel(raw)


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_MODEL_BYTES + 1)
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError(f"the model is over {MAX_MODEL_BYTES} bytes")
    return raw


def _portions(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    first, texts, held = 0, [], 0
    for i, x in enumerate(column):
        texts.append(x.as_py())
        held += len(texts[-1] or "")
        if held >= PORTION:
            yield first, texts
            first, texts, held = i + 1, [], 0
    if texts:
        yield first, texts


def _encode(raw: bytes):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(raw)
        model.forget()  # what an earlier task left behind: workers outlive their tasks
        for batch in batches:
            for first, texts in _portions(batch.column(0)):
                ids, same = model.encode(texts)
                bounds = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=bounds[1:])
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                exact = [model.decode(np.frombuffer(x, "<i4")) == (t or "") for x, t in zip(ids, texts)]
                kept = [c.slice(first, len(texts)) for c in batch.columns[1:]]
                digests = [hashlib.sha256(x).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(digests), pa.array(same), pa.array(exact)], names=[*batch.schema.names[1:], "piece_ids", "pieces_sha256", "round_trip", "decodes"])
        model.forget()

    return tidy(encode)


def encode_texts(rows: DataFrame, keep: list[str], model: bytes | None = None) -> DataFrame:
    """Columns ``keep`` of ``rows`` with the ids of their column ``text`` (``piece_ids``), a digest of them, whether they hold all of the marked text
    (``round_trip``), and whether the decoder makes exactly the text of them (``decodes``; false for a text with marks of its own)."""
    kept = rows.select("text", *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    types = "".join(f"c{i} {t.dataType.simpleString()}, " for i, t in enumerate(rows.select(*keep).schema))
    out = kept.mapInArrow(_encode(model or read_model()), f"{types}piece_ids array<int>, pieces_sha256 string, round_trip boolean, decodes boolean")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "piece_ids", "pieces_sha256", "round_trip", "decodes")


def _decode(raw: bytes):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(raw)
        for batch in batches:
            texts = [model.decode(np.asarray(x.as_py() or [], np.int64)) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "text"])

    return decode


def decode_pieces(rows: DataFrame, keep: list[str], model: bytes | None = None) -> DataFrame:
    """Columns ``keep`` of ``rows`` with the ``text`` that their column ``piece_ids`` stands for."""
    kept = rows.select("piece_ids", *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    types = "".join(f"c{i} {t.dataType.simpleString()}, " for i, t in enumerate(rows.select(*keep).schema))
    return kept.mapInArrow(_decode(model or read_model()), f"{types}text string").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "text")
