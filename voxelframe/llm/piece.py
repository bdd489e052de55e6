"""SentencePiece encoding and decoding by vectorised merge rounds.

A text becomes segments that no vocabulary piece can cross (a run of spaces and the word
after it, a newline, or a cut between two characters that meet in no piece). The distinct
segments of a slice of text are laid out as one flat array of symbols. A round looks up the
rank of every adjacent pair, takes the minimum of each segment, merges all its leftmost
occurrences at once and compacts the arrays; segments without a pair leave the arrays.

A segment may be of any length. In one of thousands of symbols many ranks are each the least once,
so it has rounds of its own whose places are kept by rank: a round takes the places of the least
rank, merges them at once, and files the pairs that this makes; it looks at no other symbol.

A merge is made at all its places at once only where that equals merging one place after
another: not for a piece that some better-ranked piece starts or ends with, or that shares its
score, of which only the leftmost place merges in a round.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import slices

NONE = np.int64(1 << 40)
#: Segments of more symbols than this have rounds by rank.
LONG_SEGMENT = 2000
#: Places of one rank that such a round looks at.
WINDOW = 256
#: Segments that a worker remembers, in two generations.
CACHE_ENTRIES = 250_000

_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = blob[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(blob):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            n, at = varint(at)
            value, at = blob[at : at + n], at + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, at = blob[at : at + n], at + n
        yield key >> 3, value


class PieceModel:
    """A BPE piece vocabulary with byte fallback, read from the bytes of a model file."""

    def __init__(self, blob: bytes):
        pieces: list[str] = []
        scores: list[float] = []
        kinds: list[int] = []
        self.dummy_prefix = True
        for field, value in _fields(blob):
            if field == 1:
                parts = dict(_fields(value))
                pieces.append(parts[1].decode())
                scores.append(struct.unpack("<f", parts.get(2, b"\0" * 4))[0])
                kinds.append(parts.get(3, _NORMAL))
            elif field == 3:
                spec = dict(_fields(value))
                self.dummy_prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models without a normalisation map, which keep all spaces, are supported")
        self.pieces, self.kinds = pieces, kinds
        self.vocab = {p: i for i, p in enumerate(pieces) if kinds[i] in (_NORMAL, _USER, _UNUSED)}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == _BYTE}
        if _USER in kinds or _UNUSED in kinds or len(self.byte_id) < 256:
            raise ValueError("only models with byte fallback and without user-defined or unused pieces are supported")
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.last_byte = max(self.byte_of)
        self.text_of = [p.replace("▁", " ") if k == _NORMAL else " ⁇ " if k == _UNKNOWN else "" for p, k in zip(pieces, kinds, strict=True)]
        # A pair of symbols merges if its text is a piece. A single character outside the vocabulary is a symbol too.
        symbols = dict(self.vocab)
        for p in self.vocab:
            for c in p:
                symbols.setdefault(c, len(pieces) + len(symbols))
        self.char_symbol = {c: i for c, i in symbols.items() if len(c) == 1}
        self.base = max(symbols.values(), default=0) + 2  # the last symbol stands for characters that are in no piece
        self.other = self.base - 1
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.vocab.values()}, reverse=True))}
        rank = {i: order[scores[i]] for i in self.vocab.values()}
        ties = {s for s, n in Counter(scores[i] for i in rank).items() if n > 1}
        pair: dict[int, int] = {}
        risky: set[int] = {i for i in rank if scores[i] in ties}
        self.met: set[str] = set()
        for p, i in self.vocab.items():
            self.met.update(p[k : k + 2] for k in range(len(p) - 1))
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pair[a * self.base + b] = i
                    risky.update(x for x in (a, b) if rank.get(x, -1) >= rank[i] and len(pieces) > x)
        self.rank = rank
        self.reach = 2 * max(map(len, self.vocab), default=1) + 2
        keys = np.array(sorted(pair), dtype=np.int64)
        self.keys, self.merged = keys, np.array([pair[k] for k in keys.tolist()], dtype=np.int64)
        self.ranks = np.array([rank[i] for i in self.merged.tolist()], dtype=np.int64)
        self.risky = np.zeros(self.base, dtype=bool)
        self.risky[list(risky)] = True
        # Open addressing in two arrays: a pair is found in one or two looks.
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full((1 << bits) + 64, -1, dtype=np.int64)
        self.slot_at = np.zeros((1 << bits) + 64, dtype=np.int64)
        self.probes = 1
        for at, s in enumerate(self._slot(keys).tolist()):
            n = 1
            while self.slot_key[s] >= 0:
                s, n = s + 1, n + 1
            self.slot_key[s], self.slot_at[s], self.probes = keys[at], at, max(self.probes, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The places of pairs in ``merged`` and ``ranks``; -1 where a pair merges to nothing."""
        slot = self._slot(keys)
        seen = self.slot_key[slot]
        found = np.where(seen == keys, self.slot_at[slot], -1)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        for step in range(1, self.probes):
            if not len(left):
                break
            at = slot[left] + step
            seen, want = self.slot_key[at], keys[left]
            hit = seen == want
            found[left[hit]] = self.slot_at[at[hit]]
            left = left[~hit & (seen >= 0)]
        return found

    # -- segments ---------------------------------------------------------------------------

    _SEGMENTS = re.compile(r"\n| *[^ \n]+| +")

    def segments(self, text: str) -> list[str]:
        """Parts of a text that no piece crosses; joined, they are the text with its dummy prefix."""
        if not text:
            return []
        text = text.replace("▁", " ")  # the model's own sign for a space
        return self._SEGMENTS.findall(" " + text if self.dummy_prefix else text)

    def cut(self, segment: str) -> list[str]:
        """A long segment, cut wherever two neighbours meet in no piece."""
        marked = segment.replace(" ", "▁")
        at = [k for k in range(1, len(marked)) if marked[k - 1 : k + 1] not in self.met]
        return [segment[a:b] for a, b in zip([0, *at], [*at, len(segment)], strict=True)]

    # -- encoding ---------------------------------------------------------------------------

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Piece ids of each segment."""
        parts, owner = [], []
        for k, s in enumerate(segments):
            for x in self.cut(s) if len(s) > 40 else (s,):
                parts.append(x)
                owner.append(k)
        coded: list[list[int] | None] = [None] * len(parts)
        short = []
        for k, x in enumerate(parts):
            if len(x) > LONG_SEGMENT:
                coded[k] = self._merge_long(x)
            else:
                short.append(k)
        for k, ids in zip(short, self._merge_rounds([parts[k] for k in short]), strict=True):
            coded[k] = ids
        out: list[list[int]] = [[] for _ in segments]
        for k, ids in zip(owner, coded, strict=True):
            out[k] += ids
        return out

    def _symbols(self, text: str) -> list[int]:
        get, other = self.char_symbol.get, self.other
        return [get(c, other) for c in text.replace(" ", "▁")]

    def _ids(self, symbols: list[int], text: str) -> list[int]:
        """Symbols as ids; a character outside the vocabulary becomes its bytes."""
        ids, at, n = [], 0, len(self.pieces)
        for s in symbols:
            if s < n:
                ids.append(s)
                at += len(self.pieces[s])
            else:
                ids += [self.byte_id[b] for b in text[at].encode("utf-8", "surrogatepass")]
                at += 1
        return ids

    def _merge_rounds(self, texts: list[str]) -> list[list[int]]:
        if not texts:
            return []
        count = np.array([len(t) for t in texts], dtype=np.int64)
        flat = np.array(self._symbols("".join(texts)), dtype=np.int64)
        word = np.repeat(np.arange(len(texts)), count)
        done_word, done_sym = [], []
        while len(flat):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            at = np.full(len(flat), -1, dtype=np.int64)
            at[:-1] = self.look_up(flat[:-1] * self.base + flat[1:])
            last = np.r_[begin[1:] - 1, len(flat) - 1]
            at[last] = -1
            rank = np.where(at >= 0, self.ranks[at], NONE)
            least = np.minimum.reduceat(rank, begin)
            size = np.diff(np.r_[begin, len(flat)])
            alive = np.repeat(least < NONE, size)
            done_word.append(word[~alive])
            done_sym.append(flat[~alive])
            hit = (rank == np.repeat(least, size)) & alive
            place = np.flatnonzero(hit)
            if len(place):
                made = self.merged[at[place]]
                # Leftmost places first: in a run of overlapping places every second one merges.
                joined = np.r_[False, (place[1:] == place[:-1] + 1)]
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(place))))
                take = (np.arange(len(place)) - start) % 2 == 0
                first = np.r_[True, word[place[1:]] != word[place[:-1]]]
                # A risky piece merges once in a round: at its segment's leftmost place.
                once = np.logical_or.reduceat(self.risky[made], np.flatnonzero(first))
                take &= first | ~np.repeat(once, np.diff(np.r_[np.flatnonzero(first), len(place)]))
                place, made = place[take], made[take]
                flat[place] = made
                alive[place + 1] = False
            flat, word = flat[alive], word[alive]
        words, symbols = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(words, kind="stable")
        symbols = symbols[order].tolist()
        ends = np.cumsum(np.bincount(words, minlength=len(texts))).tolist()
        plain = len(self.pieces)
        out, a = [], 0
        for text, b in zip(texts, ends, strict=True):
            part = symbols[a:b]
            out.append(part if max(part) < plain else self._ids(part, text))
            a = b
        return out

    def _merge_long(self, text: str) -> list[int]:
        """One long segment in rounds: all leftmost places of the least rank at once.

        A risky piece may start a better one, which comes before any further place. What that may
        take in is bounded by the longest piece, so of its places those merge at once that have
        no other so near on their left.
        """
        sym = np.array(self._symbols(text), dtype=np.int64)
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n: none comes after
        # By rank, new places and those known in order; pairs that are gone stay until they are met.
        new: dict[int, list[np.ndarray]] = {}
        known: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def file(at: np.ndarray) -> None:
            """Put pairs that begin at some places under their ranks."""
            at = at[after[at] < n]
            found = self.look_up(sym[at] * self.base + sym[after[at]])
            at, rank = at[found >= 0], self.ranks[found[found >= 0]]
            for r in np.unique(rank).tolist():
                if r not in new and r not in known:
                    heapq.heappush(ranks, r)
                new.setdefault(r, []).append(at[rank == r] if len(at) > 1 else at)

        def file_all(at: np.ndarray) -> None:
            """The same for many places of many ranks."""
            found = self.look_up(sym[at] * self.base + sym[after[at]])
            at, rank = at[found >= 0], self.ranks[found[found >= 0]]
            order = np.argsort(rank, kind="stable")
            own, first = np.unique(rank[order], return_index=True)
            for r, part in zip(own.tolist(), np.split(at[order], first[1:]) if len(own) else (), strict=True):
                new[r] = [part]
                heapq.heappush(ranks, r)

        file_all(np.arange(n - 1))
        while ranks:
            least = ranks[0]
            if least in new:
                known[least] = [np.unique(np.concatenate([*known.get(least, ()), *new.pop(least)]))]
            parts = known[least]
            at = parts.pop(0)
            if len(at) > WINDOW:
                parts.insert(0, at[WINDOW:])
                at = at[:WINDOW]
            if not parts:
                del known[least]
            at = at[(sym[at] >= 0) & (after[at] < n)]
            found = self.look_up(sym[at] * self.base + sym[after[at]]) if len(at) else at
            live = found >= 0
            live[live] = self.ranks[found[live]] == least
            at, made = at[live], self.merged[found[live]]
            if len(at):
                if self.risky[made].any():
                    alone = np.r_[True, np.diff(at) >= self.reach]
                    if len(at) > alone.sum():
                        known.setdefault(least, []).insert(0, at[~alone])
                    at, made = at[alone], made[alone]
                else:
                    # In a run of overlapping places every second one merges.
                    joined = np.r_[False, after[at[:-1]] == at[1:]]
                    start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                    take = (np.arange(len(at)) - start) % 2 == 0
                    at, made = at[take], made[take]
                gone = after[at]
                sym[at], sym[gone] = made, -1
                after[at] = after[gone]
                held = after[at] < n
                before[after[at[held]]] = at[held]
                touched = before[at]
                file(np.unique(np.concatenate([touched[touched >= 0], at])))
            if least not in known and least not in new:
                # Better ranks may have come before it.
                ranks.remove(least)
                heapq.heapify(ranks)
        return self._ids(sym[sym >= 0].tolist(), text)

    def encode(self, text: str) -> list[int]:
        parts = self.segments(text)
        coded = dict(zip(own := list(dict.fromkeys(parts)), self.encode_segments(own), strict=True))
        return [i for p in parts for i in coded[p]]

    # -- decoding ---------------------------------------------------------------------------

    def pieces_text(self, ids: list[int]) -> str:
        """Text of ids with the dummy prefix; runs of byte pieces are read as UTF-8."""
        if ids and min(ids) > self.last_byte:
            return "".join(map(self.text_of.__getitem__, ids))
        out, held = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            out.append(self.text_of[i])
        if held:
            out.append(_utf8(bytes(held)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_text(ids)
        return text[1:] if self.dummy_prefix and ids and self.pieces[ids[0]].startswith("▁") else text


def _utf8(data: bytes) -> str:
    """UTF-8 in which every byte that is part of no character becomes one replacement character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class _Coder:
    """A worker's model and the segments it has coded."""

    held: tuple[int, _Coder] | None = None

    def __init__(self, blob: bytes):
        self.model, self.known, self.older = PieceModel(blob), {}, {}

    @classmethod
    def of(cls, blob: bytes) -> _Coder:
        key = hash(blob)
        if cls.held is None or cls.held[0] != key:
            cls.held = (key, cls(blob))
        return cls.held[1]

    def parts(self, texts: list[str | None]) -> list[list[str]]:
        """Segments of each text, all of them known afterwards: count, ids as text, decoded text."""
        parts = [self.model.segments(t or "") for t in texts]
        if len(self.known) > CACHE_ENTRIES // 2:
            self.known, self.older = {}, self.known
        new = list({s for p in parts for s in p}.difference(self.known))
        if self.older:  # what comes again stays, what doesn't goes with its generation
            again = self.older.keys() & new
            self.known.update((s, self.older[s]) for s in again)
            new = [s for s in new if s not in again]
        for s, ids in zip(new, self.model.encode_segments(new), strict=True):
            self.known[s] = (len(ids), ",".join(map(str, ids)), self.model.pieces_text(ids))
        return parts


def encode(docs: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Encode and decode each text.

    Adds ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if ``ids``, the ids themselves
    (``token_ids``) and the decoded text (``decoded``). A null text counts as empty: no tokens,
    digests of the empty string. Rows are kept as they are, repeated or not; only the columns
    named in ``keep`` are carried along.
    """
    spark = docs.sparkSession
    blob = spark.sparkContext.broadcast(model)  # some hundred KB
    rows = docs.select(*keep, F.col(text).alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long, ids_sha256 string, decoded_sha256 string"
    if ids:
        schema += ", token_ids array<int>, decoded string"

    def run(batches):
        coder = _Coder.of(blob.value)
        prefix, sha = coder.model.dummy_prefix, hashlib.sha256
        for batch in batches:
            for part in slices(batch, "__text"):
                count, id_hash, text_hash, all_ids, texts = [], [], [], [], []
                parts = coder.parts(part.column("__text").to_pylist())
                known = coder.known
                for segments in parts:
                    if segments:
                        n, coded, plain = zip(*map(known.__getitem__, segments), strict=True)
                        coded, plain = ",".join(coded), "".join(plain)
                        plain = plain[1:] if prefix else plain
                        n = sum(n)
                    else:
                        n, coded, plain = 0, "", ""
                    count.append(n)
                    id_hash.append(sha(coded.encode()).hexdigest())
                    text_hash.append(sha(plain.encode()).hexdigest())
                    if ids:
                        all_ids.append(list(map(int, coded.split(","))) if coded else [])
                        texts.append(plain)
                columns = [part.column(f.name) for f in fields] + [pa.array(count, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = [f.name for f in fields] + ["n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["token_ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)
