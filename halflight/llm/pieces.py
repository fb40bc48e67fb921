"""Encoding into sentence pieces that keeps the place of every piece in its source, and decoding.

A text is normalised by the model's compiled character map: at each place the longest key of the map
is replaced, and every byte that comes out remembers the source byte where its key began. The pieces
of the normalised text are then projected back through that record to byte spans of the source.

The map and the pieces are those of the model file. Merging follows the scores of a BPE model. Where
no piece holds a space mark after another character, no merge crosses from such a character to a mark;
the text is cut there, and cuts that come again are looked up.

A null text is read as an empty one; an empty text has no pieces between the begin and end ids.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters of the cuts that are looked up, and how long a cut is merged pair by pair.
MEMO_CHARS, SHORT = 4_000_000, 64
#: Below every score.
NEVER = float("-inf")
_CUTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_CUTS_OF_PLAIN = re.compile(".+", re.S)


class CharacterMap:
    """The compiled map: a double array over the bytes of the keys, and the texts they turn into."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size:]

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes of the key) of the longest key at ``at``."""
        units, found = self.units, None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for end in range(at, len(raw)):
            node ^= raw[end]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != raw[end]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, end + 1 - at)
        if found is None:
            return None
        return self.texts[found[0]:self.texts.index(b"\0", found[0])], found[1]


class Normaliser:
    """Character map, spaces and their marks, with the source place of every byte."""

    def __init__(self, spec, mark_after: bool = False):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = MARK.encode() if spec.escape_whitespaces else b" "
        self.mark_after = mark_after

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, source byte of each of its bytes and, last, the source's end)."""
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, np.int64)
        if self.map.units or self.squeeze or self.mark_after:
            out, places = self._by_map(raw)
            return out.decode(), np.array(places, np.int64)
        width = len(self.space)
        wide = np.where(np.frombuffer(raw, np.uint8) == 32, width, 1)
        places = np.repeat(np.arange(len(raw)), wide)
        marked = text.replace(" ", self.space.decode())
        if self.prefix:
            marked, places = self.space.decode() + marked, np.append(np.zeros(width, np.int64), places)
        return marked, np.append(places, len(raw))

    def _steps(self, raw: bytes):
        """(what comes out, where its source begins and ends), key by key."""
        at = 0
        while at < len(raw):
            hit = self.map.longest(raw, at) if self.map.units else None
            if hit is None:  # no key: one character
                lead = raw[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = raw[at:at + size], size
            yield hit[0], at, at + hit[1]
            at += hit[1]

    def _by_map(self, raw: bytes) -> tuple[bytes, list[int]]:
        out, places, end = bytearray(), [], 0
        steps = list(self._steps(raw))
        if self.squeeze:
            first = next((i for i, s in enumerate(steps) if s[0] != b" "), len(steps))
            end = steps[first - 1][2] if first else 0
            steps = steps[first:]
        if not steps:
            return b"", [end]

        def add(piece: bytes, place: int) -> None:
            out.extend(piece)
            places.extend([place] * len(piece))

        if self.prefix and not self.mark_after:
            add(self.space, end)
        after_space = self.squeeze
        for made, place, stop in steps:
            if after_space:
                made = made.lstrip(b" ")
            if made:
                add(made.replace(b" ", self.space), place)
                after_space = self.squeeze and made.endswith(b" ")
            end = stop
        while self.squeeze and out.endswith(self.space):
            end = places[-len(self.space)]
            del out[-len(self.space):], places[-len(self.space):]
        if self.prefix and self.mark_after:
            add(self.space, end)
        return bytes(out), [*places, end]


class PieceModel:
    """A BPE model of sentence pieces: encodes with source spans, decodes ids."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        model = ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        trainer = model.trainer_spec
        if trainer.model_type != 2 or any(p.type in (USER_DEFINED, UNUSED) for p in model.pieces):
            raise ValueError("only BPE models without user-defined or unused pieces")
        self.normaliser = Normaliser(model.normalizer_spec, trainer.treat_whitespace_as_suffix)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.kinds = [p.type for p in model.pieces]
        self.names = [p.piece for p in model.pieces]
        self.sizes = [len(n.encode()) for n in self.names]
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = trainer.unk_surface
        self.begin, self.end = trainer.bos_id, trainer.eos_id
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.size_table = np.array(self.sizes)
        self.byte_table = np.full(len(self.names), -1)
        self.byte_table[list(self.byte_ids.values())] = list(self.byte_ids)
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        splits = MARK in self.ids and not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.cuts = _CUTS if splits else _CUTS_OF_PLAIN
        # what the library makes of a cut is what stands in it, if its normaliser only marks spaces
        plain = self.normaliser
        alike = splits and plain.prefix and not (plain.map.units or plain.squeeze or plain.mark_after)
        self.library = SentencePieceProcessor(model_file=path) if alike and self.byte_ids else None
        self.texts = [n.replace(MARK, " ") if k == NORMAL else "" if k == CONTROL else None
                      for n, k in zip(self.names, self.kinds, strict=True)]
        self.memo: dict[str, bytes] = {}
        self.sizes_of_cut: dict[str, bytes] = {}
        self.kept = 0

    def merged(self, text: str) -> list[str]:
        """Adjacent pieces merged by score, the leftmost of equal ones first."""
        return self._merged_short(text) if len(text) <= SHORT else self._merged_long(text)

    def _merged_short(self, text: str) -> list[str]:
        """All pairs looked at for every merge."""
        symbols, score = list(text), self.scores.get
        pairs = [score(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while pairs and (best := max(pairs)) > NEVER:
            at = pairs.index(best)
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(symbols[at - 1] + symbols[at], NEVER)
            if at < len(pairs):
                pairs[at] = score(symbols[at] + symbols[at + 1], NEVER)
        return symbols

    def _merged_long(self, text: str) -> list[str]:
        """Pairs in a heap: a text of n characters takes n log n steps."""
        symbols, scores = list(text), self.scores
        last = len(symbols) - 1
        before, after = list(range(-1, last)), [*range(1, last + 1), -1]
        agenda = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                score = scores.get(symbols[left] + symbols[right])
                if score is not None:
                    heapq.heappush(agenda, (-score, left, right, len(symbols[left]) + len(symbols[right])))

        for i in range(last):
            offer(i, i + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue  # one of the two has changed since
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s]

    def _pieces_of(self, cut: str) -> tuple[list[int], list[int]]:
        """Ids of one cut and how many normalised bytes each covers, by the scores."""
        ids, sizes = [], []
        for piece in self.merged(cut):
            known = self.ids.get(piece)
            if known is not None:
                ids.append(known)
                sizes.append(self.sizes[known])
                continue
            raw = piece.encode()
            if self.byte_ids:
                ids += [self.byte_ids[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]
            elif ids and ids[-1] == self.unknown:
                sizes[-1] += len(raw)
            else:
                ids.append(self.unknown)
                sizes.append(len(raw))
        return ids, sizes

    def _sizes_of(self, ids: np.ndarray) -> np.ndarray:
        """How many normalised bytes each id covers. Of the bytes of a character without a piece, the
        last covers it; the others cover nothing."""
        sizes, byte = self.size_table[ids], self.byte_table[ids]
        is_byte = byte >= 0
        if is_byte.any():
            follows = is_byte & (byte & 0xC0 == 0x80)
            at = np.arange(len(ids))
            first = np.maximum.accumulate(np.where(is_byte & ~follows, at, 0))
            last = is_byte & ~np.append(follows[1:], False)
            sizes = np.where(last, at - first + 1, np.where(is_byte, 0, sizes))
        return sizes

    def _learn(self, cuts: list[str]) -> None:
        """Pieces of the cuts, packed. The library merges those that begin with the mark that it puts
        there itself."""
        theirs = [] if self.library is None else [c for c in cuts if len(c) > 1 and c[0] == MARK]
        if theirs:
            found = self.library.encode([c[1:] for c in theirs], num_threads=1)
            ids = np.array(list(chain.from_iterable(found)), np.int32)
            raw, at = ids.tobytes(), 0
            for cut, row in zip(theirs, found, strict=True):
                to = at + 4 * len(row)
                self.memo[cut] = raw[at:to]
                at = to
        for cut in set(cuts).difference(theirs):
            row, sizes = self._pieces_of(cut)
            self.memo[cut] = np.array(row, np.int32).tobytes()
            if not self.byte_ids:
                self.sizes_of_cut[cut] = np.array(sizes, np.int32).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the source bytes where each begins and ends."""
        marked, places = self.normaliser(text)
        cuts = self.cuts.findall(marked)
        found = list(map(self.memo.get, cuts))
        if None in found:
            if self.kept > MEMO_CHARS:
                self.memo.clear()
                self.sizes_of_cut.clear()
                self.kept, found = 0, [None] * len(cuts)
            missing = {c for c, f in zip(cuts, found, strict=True) if f is None}
            self.kept += sum(map(len, missing))
            self._learn(list(missing))
            found = list(map(self.memo.__getitem__, cuts))
        ids = np.frombuffer(b"".join(found), np.int32)
        if self.byte_ids:
            sizes = self._sizes_of(ids)
        else:  # an unknown piece may be of any size
            sizes = np.frombuffer(b"".join([self.sizes_of_cut[c] for c in cuts]), np.int32).astype(np.int64)
        ends = np.cumsum(sizes)
        return ids, places[ends - sizes].astype(np.int32), places[ends].astype(np.int32)

    def decode(self, ids) -> str:
        """The text of any ids: begin and end ids say nothing, bytes that are no character become
        U+FFFD each, the mark at the beginning is dropped."""
        said = [self.texts[i] for i in ids]
        if None not in said:  # neither bytes nor unknown pieces
            text = "".join(said)
            first = next((i for i, t in zip(ids, said) if t), None)
            drops = self.normaliser.prefix and not self.normaliser.squeeze and first is not None
            if drops or first is None:
                return text[1:] if drops and self.names[first].startswith(MARK) else text
        out, pending = [], bytearray()
        at_start, seen, empty = True, False, True

        def flush() -> None:
            nonlocal empty
            if pending:
                out.append(_lenient(bytes(pending)))
                empty = False
                pending.clear()

        strip = self.normaliser.prefix or self.normaliser.squeeze
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                pending.append(self.byte_of[i])
                continue
            flush()
            if seen or not empty:
                at_start = False
            seen, text = False, ""
            if kind == UNKNOWN:
                text = self.unknown_text
            elif kind != CONTROL:
                text = self.names[i]
                if at_start and strip and text.startswith(MARK):
                    text, seen = text[1:], not self.normaliser.squeeze
                text = text.replace(MARK, " ")
            if text:
                out.append(text)
                empty = False
        flush()
        return "".join(out)


def _lenient(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[:e.start].decode() + "�" + _lenient_rest(raw, e.start + 1)


def _lenient_rest(raw: bytes, at: int) -> str:
    out = []
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + size].decode())
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    """The model of a file, read once in each process; every executor must have the file."""
    return PieceModel(path)


def encode_pieces(text: Column, path: str) -> Column:
    """``struct<ids, starts, ends>`` of a text: begin id, pieces, end id, each with the source bytes
    it comes from (end exclusive). The begin id stands at 0, the end id at the source's end."""

    @F.pandas_udf("ids array<int>, starts array<int>, ends array<int>")
    def encode(texts: pd.Series) -> pd.DataFrame:
        model, rows = piece_model(path), []
        for t in texts:
            t = t or ""
            ids, starts, ends = model.encode(t)
            size = len(t.encode())
            rows.append((np.concatenate(([model.begin], ids, [model.end])).astype(np.int32),
                         np.concatenate(([0], starts, [size])).astype(np.int32),
                         np.concatenate(([0], ends, [size])).astype(np.int32)))
        return pd.DataFrame(rows, columns=["ids", "starts", "ends"])

    return encode(text)


def decode_pieces(ids: Column, path: str) -> Column:
    """The text of an array of ids; null for a null array."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        model = piece_model(path)
        return rows.map(lambda ids: None if ids is None else model.decode(list(ids)))

    return decode(ids)


def piece_digest(encoded: Column, path: str) -> Column:
    """Number and digest of the ids, digest of what they decode to, digest of the spans (starts, then
    ends) and how many source bytes the spans cover."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string,"
                  " n_source_bytes long")
    def digest(rows: pd.DataFrame) -> pd.DataFrame:
        model, out = piece_model(path), []
        little = lambda a: np.asarray(a, "<u4").tobytes()
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for ids, starts, ends in zip(rows["ids"], rows["starts"], rows["ends"], strict=True):
            out.append((len(ids), sha(little(ids)), sha(model.decode(ids.tolist()).encode()),
                        sha(little(starts) + little(ends)),
                        int((np.asarray(ends, np.int64) - np.asarray(starts, np.int64)).sum())))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256",
                                          "n_source_bytes"])

    return digest(encoded)
