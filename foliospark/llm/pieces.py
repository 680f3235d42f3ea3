"""SentencePiece encoding by sampling, and lossless decoding.

The lattice of a text has an edge for every piece of the vocabulary that stands in it; a character that is no piece has
an edge of its UTF-8 bytes. An edge weighs (RANK0 + merge rank) ** -alpha: the model file holds ranks only, and by
Zipf's law a piece's frequency is about in inverse proportion to its rank. Forward filtering sums the weights of all
ways to each position, scaled on the way, so texts may be of any length; backward sampling walks from the end and picks each edge in
proportion to its share of that sum (rounded to 2^-32). Segmentations are thus drawn in proportion to their weights.

Where no piece holds both characters next to a border, no edge crosses it, so the lattice of a text is the chain of those between such
borders, its chunks; nothing else is cut. Lattices of chunks are kept from batch to batch and forgotten as a
whole when they get many. Draws come from a counter hash of the row key, the chunk's place and the step, so a
row's pieces do not depend on partitions, batches or retries.

Decoding joins the bytes of the pieces; a literal U+2581 is always coded as bytes, so decoding gives the text back, byte
for byte. Null texts have null pieces, empty ones none. Equal rows (id and text) are drawn alike. Columns other than
doc_id and text are not read. Rows are coded one by one, so no key is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import small_batches
from foliospark.llm.shingles import mix

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)

RANK0 = 20.0
ALPHA = 1.0
#: Texts of a batch are coded in groups of about so many characters, chunks of a group in blocks of so many.
GROUP_CHARS = 500_000
BLOCK_CHUNKS = 200_000
#: Lattices are laid out for so many positions together (or one chunk), and kept until they have so many edges.
LAYOUT_POSITIONS = 100_000
#: After so many positions sums are scaled, to stay in the range of doubles.
RESCALE = 8
KEPT_EDGES = 6_000_000
#: Slots of the table that tells beginnings of pieces from other strings.
SLOTS = 1 << 21


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of all pairs, one after another."""
    at = np.repeat(start - np.cumsum(size) + size, size)
    at += np.arange(len(at))
    return flat[at]


class Vocabulary:
    """pieces: text of a piece, spaces in place of its markers -> (id, merge rank); of_byte: ids of the 256 bytes; raw: bytes by id."""

    def __init__(self, model: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.of_byte = [0] * 256
        self.raw: list[bytes] = []
        for i in range(p.get_piece_size()):
            text = p.id_to_piece(i)
            if p.is_byte(i):
                self.raw.append(bytes([int(text[3:5], 16)]))
                self.of_byte[int(text[3:5], 16)] = i
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                self.raw.append(b"")
            else:
                text = text.replace("▁", " ")
                self.raw.append(text.encode())
                self.pieces[text] = (i, -p.get_score(i))
        self.longest = max(map(len, self.pieces))
        self.digest = hashlib.sha256(repr((self.raw, self.of_byte, sorted(self.pieces.items()))).encode()).hexdigest()
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.size = np.array([len(x) for x in self.raw], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of many texts: counts ids each."""
        size = self.size[ids]
        data = gather(self.flat, self.start[ids], size)
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)].tolist()
        return [data[a:z].tobytes() for a, z in zip([0, *ends], ends, strict=False)]


class Sampler:
    """Draws segmentations of many texts at once. A chunk has a state for its start and one for each character; an edge
    belongs to the state where it ends. Edges of a state follow one another, the longest first, and carry the share of
    that state's edges up to them, less one, in 2^-32."""

    def __init__(self, vocabulary: Vocabulary, alpha: float):
        self.v = v = vocabulary
        texts = list(v.pieces)
        inner = sorted({ord(c) for t in texts if len(t) > 1 for c in t})
        self.kind = np.zeros(0x110000, np.uint32)
        self.kind[inner] = np.arange(1, len(inner) + 1)
        self.kinds = len(inner) + 1
        self.joined = np.zeros(self.kinds**2, bool)  # kinds of neighbours within a piece
        pairs = np.array([(ord(a), ord(b)) for a, b in {p for t in texts for p in zip(t, t[1:], strict=False)}], np.int64).reshape(-1, 2)
        self.joined[self.kind[pairs[:, 0]] * self.kinds + self.kind[pairs[:, 1]]] = True
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(t) for t in texts])
        self.slot = np.zeros(SLOTS, np.uint8)  # 1: may begin a piece, 2: may be one
        with np.errstate(over="ignore"):
            for n in range(v.longest, 0, -1):
                some = np.flatnonzero(lengths == n)
                if len(some):
                    points = _points("".join(texts[k] for k in some)).reshape(-1, n)
                    h = np.zeros(len(some), np.uint64)
                    for k in range(n):
                        h = h * _BASE + points[:, k] + np.uint64(1)
                        at = _slot(h)
                        self.slot[at] = np.maximum(self.slot[at], 1 + (k == n - 1))
                    order = np.argsort(h)
                    ids = np.array([v.pieces[texts[some[k]]][0] for k in order], np.int32)
                    rank = np.array([v.pieces[texts[some[k]]][1] for k in order])
                    self.by_length[n] = (h[order], ids, (RANK0 + rank) ** -alpha)
        self.byte_weight = (RANK0 + 40_000.0) ** -alpha
        # codes from len(raw) on: the byte pieces of a character; all codes' ids in one array
        self.code_of: dict[int, int] = {}
        self.ids = np.arange(len(v.raw), dtype=np.int32)
        self.ids_size = np.ones(len(v.raw), np.int64)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted, and the chunk of each
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # by chunk: the state of its start, its characters
        self.points = np.zeros(0, np.uint64)  # by state
        self.edge = np.zeros(0, np.int32)  # by state: its first edge
        self.share, self.code, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int8)  # by edge

    def byte_code(self, point: int) -> int:
        raw = chr(point).encode()
        if len(raw) == 1:
            return self.v.of_byte[raw[0]]
        if point not in self.code_of:
            self.code_of[point] = len(self.ids_size)
            self.ids = np.append(self.ids, np.array([self.v.of_byte[x] for x in raw], np.int32))
            self.ids_size = np.append(self.ids_size, len(raw))
        return self.code_of[point]

    def lay_out(self, points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Lattices of some chunks; their numbers."""
        base = len(self.points)
        first = np.cumsum(size + 1) - size - 1
        total = int((size + 1).sum())
        flat = gather(points, begin, size)
        offset = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        state = np.repeat(first + 1, size) + offset
        left = np.repeat(size, size) - offset
        longest = int(min(self.v.longest, size.max()))
        # columns: lengths, from the longest on
        weight = np.zeros((total, longest))
        code = np.full((total, longest), -1, np.int32)
        h, at = np.zeros(len(flat), np.uint64), np.arange(len(flat))
        for n in range(1, longest + 1):
            fit = left[at] >= n
            at, h = at[fit], h[fit]
            h = h * _BASE + flat[at + n - 1] + np.uint64(1)
            slot = self.slot[_slot(h)]
            at, h, slot = at[slot > 0], h[slot > 0], slot[slot > 0]
            if n in self.by_length:
                table, ids, weights = self.by_length[n]
                maybe = np.flatnonzero(slot == 2)
                found = np.minimum(np.searchsorted(table, h[maybe]), len(table) - 1)
                hit = table[found] == h[maybe]
                stop = state[at[maybe[hit]]] + n - 1
                weight[stop, longest - n] = weights[found[hit]]
                code[stop, longest - n] = ids[found[hit]]
        lone = np.flatnonzero(code[state, -1] < 0)
        some, inverse = np.unique(flat[lone], return_inverse=True)
        code[state[lone], -1] = np.array([self.byte_code(p) for p in some.tolist()], np.int32)[inverse]
        weight[state[lone], -1] = self.byte_weight
        # forward filtering, all chunks together, by the distance from the chunk's start
        order = np.argsort(offset, kind="stable")
        cuts = np.searchsorted(offset[order], np.arange(int(size.max()) + 1)).tolist()
        ways = np.zeros(total)
        ways[first] = 1.0
        for d, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            s = state[order[a:z]]
            near = min(longest, d + 1)
            back = s[:, None] - np.arange(near, 0, -1)
            sums = ways[back]
            sums *= weight[s, longest - near :]
            np.cumsum(sums, axis=1, out=sums)  # in order, so that shares do not depend on what is laid out together
            ways[s] = sums[:, -1]
            weight[s, longest - near :] = sums / sums[:, -1:]
            if d % RESCALE == RESCALE - 1:
                ways[back] /= sums[:, -1:]
                ways[s] = 1.0
        row, place = np.nonzero(code >= 0)
        share = np.maximum(weight[row, place] * 2.0**32, 1.0) - 1.0
        edges = np.bincount(row, minlength=total)
        padded = np.zeros(total, np.uint64)
        padded[state] = flat
        self.edge = np.append(self.edge, (np.cumsum(edges) - edges + len(self.code)).astype(np.int32))
        self.share, self.code = np.append(self.share, share.astype(np.uint32)), np.append(self.code, code[row, place])
        self.length = np.append(self.length, (longest - place).astype(np.int8))
        self.points = np.append(self.points, padded)
        self.first, self.size = np.append(self.first, first + base), np.append(self.size, size)
        return np.arange(len(self.first) - len(first), len(self.first))

    def add(self, points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Lays out any number of chunks, a bounded number of positions at a time, short ones first."""
        order = np.argsort(size, kind="stable")
        begin, size = begin[order], size[order]
        part = np.cumsum(size + 1) // LAYOUT_POSITIONS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
        numbers = np.zeros(len(size), np.int64)
        numbers[order] = np.concatenate([self.lay_out(points, begin[a:z], size[a:z]) for a, z in zip(edges, edges[1:], strict=False)])
        return numbers

    def chunks(self, points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The kept number of each chunk; those that are new get their lattice."""
        if len(self.code) > KEPT_EDGES:
            self.forget()
        h = _chunk_hash(points, begin, size)
        number = np.zeros(len(h), np.int64)
        lacks = np.ones(len(h), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            lacks, number = self.hashes[at] != h, self.numbers[at]
        if lacks.any():
            fresh, k, inverse = np.unique(h[lacks], return_index=True, return_inverse=True)
            numbers = self.add(points, begin[lacks][k], size[lacks][k])
            number[lacks] = numbers[inverse]
            both, named = np.append(self.hashes, fresh), np.append(self.numbers, numbers)
            order = np.argsort(both, kind="stable")
            self.hashes, self.numbers = both[order], named[order]
        # chunks of equal hash are compared; one that differs gets a lattice of its own
        same = self.size[number] == size
        sure = np.where(same, size, 0)
        differs = gather(points, begin, sure) != gather(self.points, self.first[number] + 1, sure)
        same[np.repeat(np.arange(len(size)), sure)[differs]] = False
        if not same.all():
            number[~same] = self.add(points, begin[~same], size[~same])
        return number

    def draw(self, points: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all chunks together, and how many each has."""
        n = len(begin)
        number = self.chunks(points, begin, size)
        first = self.first[number]
        state, who, steps = first + self.size[number], np.arange(n), []
        made = np.zeros(n, np.int64)
        while len(who):
            u = (mix(seed + np.uint64(len(steps)) * _STEP) >> np.uint64(32)).astype(np.uint32)
            edge = self.edge[state]
            on = np.flatnonzero(u > self.share[edge])
            while len(on):
                edge[on] += 1
                on = on[u[on] > self.share[edge[on]]]
            steps.append((who, self.code[edge]))
            made[who] += 1
            state = state - self.length[edge]
            go = state > first
            who, state, seed, first = who[go], state[go], seed[go], first[go]
        end = np.cumsum(made)
        out = np.zeros(int(end[-1]), np.int32)
        for k, (w, c) in enumerate(steps):
            out[end[w] - 1 - k] = c
        return out, made

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts together, and how many each has. seeds: uint64, one a text."""
        chars = np.array([len(t) for t in texts], np.int64)
        points = _points("".join(texts))
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        stops = np.cumsum(chars)
        kind = self.kind[points]
        border = np.ones(len(points), bool)
        border[1:] = ~self.joined[kind[:-1] * np.uint32(self.kinds) + kind[1:]]
        border[(stops - chars)[chars > 0]] = True
        begin = np.flatnonzero(border)
        del kind, border
        size = np.diff(np.append(begin, len(points)))
        count = np.diff(np.searchsorted(begin, np.append(0, stops)))
        text = np.repeat(np.arange(len(texts)), count)
        place = (np.arange(len(begin)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
        parts, per_text = [], np.zeros(len(texts), np.int64)
        with np.errstate(over="ignore"):
            seed = mix(seeds[text] + (place + np.uint64(1)) * _BASE)
            for a in range(0, len(begin), BLOCK_CHUNKS):
                z = a + BLOCK_CHUNKS
                codes, made = self.draw(points, begin[a:z], size[a:z], seed[a:z])
                wide = self.ids_size[codes]
                if (codes >= len(self.v.raw)).any():
                    each = np.add.reduceat(wide, np.cumsum(made) - made)
                    codes = gather(self.ids, (np.cumsum(self.ids_size) - self.ids_size)[codes], wide)
                else:
                    each = made
                per_text += np.bincount(text[a:z], each, len(texts)).astype(np.int64)
                parts.append(codes)
        return np.concatenate(parts), per_text


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(SLOTS - 1)).astype(np.int64)


def _chunk_hash(points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One hash for each of some chunks that follow one another."""
    some = points[begin[0] : begin[-1] + size[-1]]
    offset = (np.arange(len(some)) - np.repeat(begin - begin[0], size)).astype(np.uint64)
    return mix(np.add.reduceat(mix(some * _BASE + offset * _STEP), begin - begin[0]))


_kept: dict[tuple[str, float], Sampler] = {}


def _encoder(sent, alpha: float):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (sent.value.digest, alpha)
        sampler = _kept.get(key)
        if sampler is None:
            _kept.clear()
            sampler = _kept[key] = Sampler(sent.value, alpha)
        for b in batches:
            texts, seeds = b.column("text").to_pylist(), b.column("seed").to_numpy().view(np.uint64)
            at = 0
            while at < len(texts):
                z, chars = at, 0
                while z < len(texts) and (z == at or chars + len(texts[z] or "") <= GROUP_CHARS):
                    chars += len(texts[z] or "")
                    z += 1
                part = [t or "" for t in texts[at:z]]
                ids, counts = sampler.sample(part, seeds[at:z])
                lossless = [got == t.encode() for got, t in zip(sampler.v.decode(ids, counts), part, strict=True)]
                nulls = np.array([t is None for t in texts[at:z]])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(nulls, False))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, z - at), pa.array(np.where(nulls, 0, counts), pa.int64()), pa.array(lossless), pa.ListArray.from_arrays(offsets, pa.array(ids))],
                    names=["doc_id", "n_pieces", "lossless", "piece_ids"],
                )
                at = z

    return encode


def encode(docs: DataFrame, model: str | None = None, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, lossless (decoding gave the text back), piece_ids of every document.

    model: path of a SentencePiece file, read on the driver; its pieces (some hundred KB) go along with the tasks.
    alpha: 0 to 2; the larger, the more frequent pieces are preferred.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Vocabulary(model or default_model()))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", F.lit(seed)).alias("seed"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_pieces long, lossless boolean, piece_ids array<int>"
    return rows.mapInArrow(_encoder(sent, alpha), schema)


def decode(coded: DataFrame, model: str | None = None) -> DataFrame:
    """coded (with piece_ids) and its text; null ids give null."""
    sent = coded.sparkSession.sparkContext.broadcast(Vocabulary(model or default_model()))

    @F.pandas_udf("string")
    def text(ids):
        own = ids.map(lambda x: [] if x is None else x)
        flat = np.concatenate([np.asarray(x, np.int64) for x in own]) if len(own) else np.zeros(0, np.int64)
        made = sent.value.decode(flat, np.array([len(x) for x in own], np.int64))
        return ids.where(ids.isna(), [x.decode() for x in made])

    return coded.withColumn("text", text("piece_ids"))
