"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

A text is cut where no piece of the vocabulary can reach across, which keeps the
lattice exact. For every distinct segment of a batch the forward pass sums the
weights exp(theta * score) of all ways to each position; the backward pass then
draws, at every position from the end, the piece that led there. The draw comes
from a hash of the row's key and the position, so a row's segmentation is the same
wherever and however often it is computed. Characters outside the vocabulary fall
back to their bytes, and a literal U+2581 always does, so that decoding gives back
every text.

Null text: null pieces, decoded to null. Empty text: no pieces. Null keys draw from
the key null. Repeated rows: equal segmentations. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calstack.llm.common import small_batches
from calstack.llm.wordhash import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THETA = 0.0005
SPACE, LITERAL = 0x2581, 0x110000
#: Ids from here on stand for a character written as its UTF-8 bytes.
SPELLED = 1 << 20
#: Characters of text in one vectorised pass; longest segment whose equals are sought.
CHUNK, LONGEST = 1 << 19, 40
#: Places (character and piece length) of a lattice, and positions looked up at once.
CELLS, BLOCK = 1 << 21, 1 << 15
#: Fills segments up to the longest of their lattice; no piece has it.
FILL = LITERAL + 1

U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
SHIFT, GROW = U(44), 0xD1342543DE82EF95


class Codec:
    """Tables of a SentencePiece model, built on the driver and broadcast."""

    def __init__(self, model: bytes, theta: float = THETA) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        named = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if sp.unk_id() in self.byte_ids:
            raise ValueError("the model has no byte fallback, so decoding would lose text")
        pieces = {sp.id_to_piece(i): i for i in named}
        self.spelling: list[bytes] = [b""] * size
        for b, i in enumerate(self.byte_ids.tolist()):
            self.spelling[i] = bytes([b])
        self.weight = np.full(size, -np.inf)
        for piece, i in pieces.items():
            self.spelling[i] = piece.replace("▁", " ").encode()
            self.weight[i] = theta * sp.get_score(i)
        self.unknown = float(self.weight[list(pieces.values())].clip(-1e4).min()) - 1.0
        self.reach = max(map(len, pieces))
        self.kinds, self.joins = self.classes(pieces)
        self.tables(pieces)

    @staticmethod
    def classes(pieces: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """A class for every character, and which classes stand side by side in a piece."""
        kinds, names = np.zeros(LITERAL + 1, np.uint8), {}
        for piece in pieces:
            for c in piece if len(piece) > 1 else "":
                kinds[ord(c)] = names.setdefault("_" if c == "▁" else unicodedata.category(c)[0], len(names) + 1)
        joins = np.zeros((len(names) + 1, len(names) + 1), bool)
        for piece in pieces:
            code = [kinds[ord(c)] for c in piece]
            joins[code[:-1], code[1:]] = True
        return kinds, joins

    def tables(self, pieces: dict[str, int]) -> None:
        """Pieces by the hash of their characters: a table of slots, and a short sorted
        list for those whose slot was taken."""
        keys = np.array([self.key(p) for p in pieces], np.uint64)
        ids = np.array(list(pieces.values()), np.int32)
        slot = (keys * STEP >> SHIFT).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        self.held, self.names = np.zeros(1 << 20, np.uint64), np.full(1 << 20, -1, np.int32)
        self.held[slot[first]], self.names[slot[first]] = keys[first], ids[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.more, self.more_names = np.append(keys[rest], ~U(0)), np.append(ids[rest], np.int32(-1))
        self.shared = np.zeros(1 << 20, bool)
        self.shared[slot[rest]] = True

    @staticmethod
    def values(characters: np.ndarray) -> np.ndarray:
        return mix(characters.astype(np.uint64) + STEP)

    def key(self, piece: str) -> int:
        h = 0
        for v in self.values(np.array([ord(c) for c in piece])).tolist():
            h = (h * GROW + v) % (1 << 64)
        return h

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashed characters, -1 where there is none."""
        slot = (h * STEP >> SHIFT).astype(np.int64)
        own = self.held[slot] == h
        found = np.where(own, self.names[slot], np.int32(-1))
        other = np.flatnonzero(self.shared[slot] & ~own)
        if len(other):
            at = np.searchsorted(self.more, h[other])
            found[other] = np.where(self.more[at] == h[other], self.more_names[at], -1)
        return found

    def lattice(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For segments of one length: the piece of each length that ends at each
        position, and the cumulated chance that the path comes by it."""
        n, length = chars.shape
        most = min(self.reach, length)
        ids = np.full((length + 1, most, n), -1, np.int32)
        value = np.ascontiguousarray(self.values(chars).T)
        for i in range(length):
            h = value[i]
            ids[i + 1, 0] = self.lookup(h)
            for m in range(2, min(most, length - i) + 1):
                h = h * U(GROW) + value[i + m - 1]
                ids[i + m, m - 1] = self.lookup(h)
        single = ids[np.arange(1, length + 1), 0]
        spelled = np.where(chars.T == LITERAL, SPACE, chars.T) + SPELLED
        weights = np.where(ids >= 0, self.weight[np.maximum(ids, 0)], -np.inf)
        weights[np.arange(1, length + 1), 0] = np.where(single >= 0, weights[np.arange(1, length + 1), 0], self.unknown)
        ids[np.arange(1, length + 1), 0] = np.where(single >= 0, single, spelled)
        forward, chance = np.zeros((length + 1, n)), np.ones((length + 1, most, n))
        for j in range(1, length + 1):
            k = min(most, j)
            ways = weights[j, :k] + forward[j - k : j][::-1]
            top = ways.max(axis=0)
            total = np.cumsum(np.exp(ways - top), axis=0)
            forward[j] = top + np.log(total[-1])
            chance[j, :k] = total / total[-1]
        return ids, chance

    @staticmethod
    def draw(seeds: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (mix(seeds ^ mix(place.astype(np.uint64) + STEP)) >> U(11)).astype(np.float64) * 2.0**-53

    def ways(self, chars: np.ndarray, forward: np.ndarray, j: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lengths, ids, weights of all that leads there) of the pieces that end at j;
        ids: the pieces of each length that do."""
        m = np.flatnonzero(ids >= 0) + 1
        piece, weight = ids[m - 1], self.weight[ids[m - 1]]
        if ids[0] < 0:
            c = int(chars[j - 1])
            m, piece, weight = np.append(1, m), np.append(SPELLED + (SPACE if c == LITERAL else c), piece), np.append(self.unknown, weight)
        return m, piece, weight + forward[j - m]

    def ends(self, chars: np.ndarray, first: int, stop: int) -> np.ndarray:
        """The piece of each length that ends at each position from `first` to `stop`."""
        ids = np.full((stop - first + 1, self.reach), -1, np.int32)
        begin = max(0, first - self.reach)
        value = self.values(chars[begin:stop])
        h = np.zeros(len(value), np.uint64)
        for m in range(1, min(self.reach, len(value)) + 1):
            h = h[: len(value) - m + 1] * U(GROW) + value[m - 1 :]
            end = begin + m + np.arange(len(h))
            own = end >= first
            ids[end[own] - first, m - 1] = self.lookup(h[own])
        return ids

    def long_segment(self, chars: np.ndarray, seed: int, first: int) -> list[tuple[int, int]]:
        """(start, id) of a sampled path through one segment of any length, of which only
        the forward weights are held."""
        n = len(chars)
        forward = np.zeros(n + 1)
        for begin in range(1, n + 1, BLOCK):
            stop = min(n, begin + BLOCK - 1)
            ids = self.ends(chars, begin, stop)
            for j in range(begin, stop + 1):
                _, _, weights = self.ways(chars, forward, j, ids[j - begin])
                top = weights.max()
                forward[j] = top + math.log(np.exp(weights - top).sum())
        path, at, low, ids = [], n, n + 1, None
        while at:
            if at < low:
                low = max(1, at - BLOCK + 1)
                ids = self.ends(chars, low, at)
            m, piece, weights = self.ways(chars, forward, at, ids[at - low])
            total = np.cumsum(np.exp(weights - weights.max()))
            chance = float(self.draw(np.array([seed], np.uint64), np.array([first + at]))[0])
            k = min(int(np.searchsorted(total / total[-1], chance, "right")), len(m) - 1)
            at -= int(m[k])
            path.append((at, int(piece[k])))
        return path

    def walk(self, found: np.ndarray, ids: np.ndarray, chance: np.ndarray, occ: np.ndarray, word: np.ndarray, here: np.ndarray, places: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Draws a path back from `here` for each segment `occ`, whose lattice is `word`."""
        starts, base, seed = places
        while len(occ):
            begin = starts[occ]
            r = self.draw(seed[occ], begin + here - base[occ])
            step = np.zeros(len(occ), np.int64)
            for m in range(chance.shape[1] - 1):
                step += chance[here, m, word] <= r
            found[begin + here - step - 1] = ids[here, step, word]
            here = here - step - 1
            more = here > 0
            occ, word, here = occ[more], word[more], here[more]

    def encode(self, texts: list[str | None], seeds: np.ndarray) -> list[np.ndarray | None]:
        """Sampled piece ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        part, held = [], 0
        for i, text in enumerate(texts):
            if text is not None:
                part.append(i)
                held += len(text) + 1
            if part and (held >= CHUNK or i == len(texts) - 1):
                for k, ids in zip(part, self.chunk([texts[k] for k in part], seeds[part]), strict=True):
                    out[k] = ids
                part, held = [], 0
        return out

    def chunk(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        sizes = np.array([len(t) + bool(t) for t in texts])
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        chars = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(chars):
            return [np.empty(0, np.int32) for _ in texts]
        chars = np.where(chars == 32, SPACE, np.where(chars == SPACE, LITERAL, chars))
        kind = self.kinds[chars]
        cut = np.ones(len(chars), bool)
        cut[1:] = ~self.joins[kind[:-1], kind[1:]]
        cut[offsets[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(chars)))
        doc = np.searchsorted(offsets, starts, "right") - 1
        base, seed = offsets[doc], seeds[doc]
        inside = np.arange(len(chars)) - np.repeat(starts, lengths)
        spread = mix((chars.astype(np.uint64) << U(24)) + inside.astype(np.uint64) + STEP)
        # segments in order of length, equal ones side by side
        name = mix(np.add.reduceat(spread, starts)) >> U(6) | np.minimum(lengths, 63).astype(np.uint64) << U(58)
        order = np.argsort(name, kind="stable")
        ranked = name[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        group = np.cumsum(new) - 1
        first, group_at = order[new], np.append(np.flatnonzero(new), len(order))
        found = np.full(len(chars), -1, np.int64)
        size = lengths[first]
        proof = np.add.reduceat(mix(spread), starts)
        apart = order[proof[order] != proof[first][group]]  # of equal name only
        at = 0
        while at < len(first) and size[at] <= LONGEST:
            length = int(size[at])
            end = min(int(np.searchsorted(size, length, "right")), at + max(1, (1 << 20) // (length * min(length, self.reach))))
            ids, chance = self.lattice(chars[starts[first[at:end]][:, None] + np.arange(length)])
            occ = order[group_at[at] : group_at[end]]
            self.walk(found, ids, chance, occ, group[group_at[at] : group_at[end]] - at, np.full(len(occ), length), (starts, base, seed))
            at = end
        rest = np.concatenate((apart, order[group_at[at] :]))
        rest = rest[np.argsort(lengths[rest], kind="stable")]
        at = 0
        while at < len(rest):  # segments of about one length share a lattice
            cells = np.arange(1, len(rest) - at + 1) * lengths[rest[at:]] * self.reach
            own = rest[at : at + max(1, int(np.searchsorted(cells, CELLS, "right")))]
            longest, at = int(lengths[own[-1]]), at + len(own)
            for k in own.tolist():
                found[starts[k] : starts[k] + lengths[k]] = -1
            if longest * self.reach > CELLS:
                (k,) = own.tolist()
                a, n = int(starts[k]), int(lengths[k])
                for start, piece in self.long_segment(chars[a : a + n], int(seed[k]), a - int(base[k])):
                    found[a + start] = piece
                continue
            inside = np.arange(longest)
            part = np.where(inside < lengths[own][:, None], chars[np.minimum(starts[own][:, None] + inside, len(chars) - 1)], FILL)
            ids, chance = self.lattice(part)
            self.walk(found, ids, chance, own, np.arange(len(own)), lengths[own], (starts, base, seed))
        place = np.flatnonzero(found >= 0)
        ids = found[place]
        bounds = np.searchsorted(place, offsets)
        spelled = np.flatnonzero(ids >= SPELLED)
        if len(spelled):
            spell = {c: [int(self.byte_ids[b]) for b in chr(c).encode()] for c in np.unique(ids[spelled] - SPELLED).tolist()}
            count = np.ones(len(ids), np.int64)
            code = (ids[spelled] - SPELLED).tolist()
            count[spelled] = [len(spell[c]) for c in code]
            ends = np.concatenate(([0], np.cumsum(count)))
            ids = np.repeat(ids, count)
            where = np.repeat(ends[spelled], count[spelled]) + np.concatenate([np.arange(len(spell[c])) for c in code])
            ids[where] = [b for c in code for b in spell[c]]
            bounds = ends[bounds]
        return [ids[a:b].astype(np.int32) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        spelling = self.spelling
        data = b"".join([spelling[i] for i in ids])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8")


def load(model_path: str, theta: float = THETA) -> Codec:
    """Read on the driver; the executors get the tables (a few tens of MB at most)."""
    with open(model_path, "rb") as f:
        return Codec(f.read(), theta)


def seeded(docs: DataFrame, id_col: str, text_col: str, seed: int, key_col: str | None = None) -> DataFrame:
    small_batches(docs.sparkSession)
    key = F.xxhash64(F.lit(seed), F.col(key_col or id_col).cast("string"))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), key.alias("key"))


def encode(docs: DataFrame, model_path: str = MODEL, theta: float = THETA, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pieces): the sampled piece ids of every whole text."""
    codec = docs.sparkSession.sparkContext.broadcast(load(model_path, theta))
    rows = seeded(docs, id_col, text_col, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ids = codec.value.encode(batch.column(1).to_pylist(), keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "pieces"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, pieces array<int>")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(id, text) of (id, pieces)."""
    codec = encoded.sparkSession.sparkContext.broadcast(load(model_path))
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else codec.value.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select("id", "pieces").mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model_path: str = MODEL, theta: float = THETA, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None, ids: bool = False) -> DataFrame:
    """(id, n_pieces, pieces_sha256, decoded, lossless), with `ids` also pieces:
    each text encoded and decoded again in one pass; the digest is over the ids as
    little-endian 32-bit numbers. `key_col` seeds the draws if it is not the id."""
    codec = docs.sparkSession.sparkContext.broadcast(load(model_path, theta))
    rows = seeded(docs, id_col, text_col, seed, key_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            texts = batch.column(1).to_pylist()
            coded = codec.value.encode(texts, keys)
            counts = [None if c is None else len(c) for c in coded]
            digests = [None if c is None else hashlib.sha256(c.astype("<i4").tobytes()).hexdigest() for c in coded]
            decoded = [None if c is None else codec.value.decode(c.tolist()) for c in coded]
            same = [None if t is None else t == d for t, d in zip(texts, decoded, strict=True)]
            more = [pa.array(coded, pa.list_(pa.int32()))] if ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_()), *more], ["id", "n_pieces", "pieces_sha256", "decoded", "lossless", *["pieces"] * ids])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_pieces long, pieces_sha256 string, decoded string, lossless boolean"
    return rows.mapInArrow(run, schema + ", pieces array<int>" * ids)
