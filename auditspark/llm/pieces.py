"""Sampled SentencePiece segmentations and lossless decoding.

Every segmentation of a text into vocabulary pieces is a path through a lattice. Pieces weigh by
their rank in the vocabulary (Zipf's law), ``sharpness`` sharpens or flattens the weights, and a path
has the product of its weights. The forward pass sums the weights of all paths to each place, the
backward pass draws pieces from the end in proportion; so a text's segmentation is drawn exactly by
weight. The random numbers depend on a seed, the row's key and the place in the text only.

No piece reaches over the start of a new word (a blank after another character), so words are drawn
one by one, and equal words of a slice share their forward sums. Characters that no single piece
covers are spelled in byte pieces. A literal U+2581 is spelled that way too, since the pieces use it
for blanks; thus decoding gives back any text exactly.
"""

import os
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import SpanHash, Texts, eight_bytes, lean, list_array, map_slices, mix, ragged

MARK = "▁"
SHARPNESS = 1.0
SLICE, LATTICE = 1 << 18, 1 << 16
MODEL = "piece_bpe_32k.model"


@dataclass
class Vocabulary:
    """Pieces as bytes with blanks for marks; ``first_byte`` is the number of the piece for byte 0."""

    pieces: list[bytes]
    first_byte: int
    hashes: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    slots: np.ndarray
    filter: np.ndarray
    data: np.ndarray
    begins: np.ndarray
    body: np.ndarray
    places: np.ndarray


def default_model() -> str:
    """The place of the public model: ``TOKENIZER_DIR``, else the installed tokenizer folder."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), MODEL)


FILTER_SHIFT, SLOT_SHIFT = np.uint64(44), np.uint64(48)
_SPREAD = np.uint64(0x9FB21C651E98DF25)


def _span_values(hashes: SpanHash, at: np.ndarray | slice, size) -> np.ndarray:
    """Values by which spans are looked up; ``at`` may be a slice of all places for one size."""
    if isinstance(at, slice):
        raw = (hashes.sums[size:] - hashes.sums[:-size]) * hashes.down[:len(hashes.sums) - size]
    else:
        raw = (hashes.sums[at + size] - hashes.sums[at]) * hashes.down[at]
    return ((raw ^ (raw >> np.uint64(29))) + np.asarray(size).astype(np.uint64)) * _SPREAD


def _look_up(words: "Vocabulary", value: np.ndarray) -> np.ndarray:
    """Place of each value among the pieces' hashes, -1 where there is none."""
    bucket = (value >> SLOT_SHIFT).view(np.int64)
    slot, end = words.slots[bucket], words.slots[bucket + 1]
    out = np.full(len(value), -1)
    left = np.flatnonzero(slot < end)
    while len(left):
        hit = words.hashes[slot[left]] == value[left]
        out[left[hit]] = slot[left[hit]]
        left = left[~hit]
        slot[left] += 1
        left = left[slot[left] < end[left]]
    return out


@cache
def vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece model with byte pieces; it is kept in the worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ids, first_byte = [], [], model.piece_to_id("<0x00>")
    for number in range(model.get_piece_size()):
        special = model.is_control(number) or model.is_unknown(number) or model.is_byte(number)
        text = b"" if special else model.id_to_piece(number).replace(MARK, " ").encode()
        if b" " in text.lstrip(b" "):
            raise ValueError("a piece reaches over the start of a word")
        pieces.append(bytes([number - first_byte]) if model.is_byte(number) else text)
        if text:
            ids.append(number)
    ids = np.array(ids)
    data = np.frombuffer(b"".join(pieces[n] for n in ids), np.uint8)
    sizes = np.array([len(pieces[n]) for n in ids])
    ends = np.cumsum(sizes)
    hashes = _span_values(SpanHash(data), ends - sizes, sizes)
    order = np.argsort(hashes)
    known = np.zeros(1 << 20, bool)
    known[hashes >> FILTER_SHIFT] = True
    slots = np.searchsorted(hashes[order] >> SLOT_SHIFT, np.arange((1 << 16) + 1, dtype=np.uint64))
    weights = np.full(len(pieces), -np.log(float(len(pieces))))
    weights[ids] = -np.log(np.arange(len(ids)) + 2.0)
    # All pieces behind one another, and where each begins.
    body = np.frombuffer(b"".join(pieces), np.uint8)
    places = np.concatenate([[0], np.cumsum([len(piece) for piece in pieces])])
    return Vocabulary(
        pieces, first_byte, hashes[order], ids[order], np.unique(sizes), weights, slots, known, data, (ends - sizes)[order], body, places
    )


_LOW_BYTES = np.array([(1 << 8 * size) - 1 for size in range(8)] + [(1 << 64) - 1], np.uint64)


def _equal_spans(one: np.ndarray, at: np.ndarray, two: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of two byte arrays are equal, one flag per pair of spans."""
    if not len(at):
        return np.zeros(0, bool)
    differ = (eight_bytes(one)[at] ^ eight_bytes(two)[place]) & _LOW_BYTES[np.minimum(size, 8)]
    same = differ == 0
    long = np.flatnonzero(same & (size > 8))
    if len(long):
        at, place, rest = at[long] + 8, place[long] + 8, size[long] - 8
        equal = one[ragged(at, rest)] == two[ragged(place, rest)]
        same[long] = np.logical_and.reduceat(equal, np.cumsum(rest) - rest)
    return same


class Lattice:
    """The pieces that fit anywhere in the given words (spans of ``data``), and sums over all paths.

    Nodes are the places between bytes; node ``begin + word`` starts a word. Edges lie in the order
    of the node they lead to; ``low``/``high`` are the edges into a node, ``drawn`` running sums of
    their shares in the node's total.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, words: Vocabulary, sharpness: float):
        ends = np.cumsum(sizes)
        begins = ends - sizes
        word = np.repeat(np.arange(len(sizes)), sizes)
        left = ends[word] - np.arange(len(data))
        hashes = SpanHash(data)
        found = []
        for size in words.sizes.tolist():
            fits = left >= size
            places = int(np.count_nonzero(fits))
            if not places:
                break
            if 3 * places > len(data):
                value = _span_values(hashes, slice(None), size)
                at = np.flatnonzero(words.filter[(value >> FILTER_SHIFT).view(np.int64)] & fits[:len(value)])
                value = value[at]
            else:
                at = np.flatnonzero(fits)
                value = _span_values(hashes, at, size)
                maybe = words.filter[(value >> FILTER_SHIFT).view(np.int64)]
                at, value = at[maybe], value[maybe]
            slot = _look_up(words, value)
            hit = slot >= 0
            found.append((at[hit], np.full(int(hit.sum()), size), slot[hit]))
        at, size, slot = (np.concatenate([part[n] for part in found]) if found else np.zeros(0, np.int64) for n in range(3))
        same = _equal_spans(data, at, words.data, words.begins[slot], size)
        at, size, piece = at[same], size[same], words.ids[slot[same]]
        # Bytes of characters that have no piece of their own are spelled.
        first = (data & 0xC0) != 0x80
        heads = np.flatnonzero(first)
        chars = np.diff(np.r_[heads, len(data)])
        own = np.zeros(len(data), np.int64)
        own[heads] = chars
        covered = np.zeros(len(data), bool)
        covered[at[own[at] == size]] = True
        spelled = np.flatnonzero(~np.repeat(covered[heads], chars))
        at = np.concatenate([at, spelled])
        size = np.concatenate([size, np.ones(len(spelled), np.int64)])
        piece = np.concatenate([piece, words.first_byte + data[spelled].astype(np.int64)])
        source = at + word[at]
        target = source + size
        depth = at + size - begins[word[at]]
        # One number holds depth, target and size, the last below the largest size plus one.
        largest = int(words.sizes.max()) + 1
        order = np.argsort((depth * (len(data) + len(sizes)) + target) * largest + size)
        self.source, self.piece = source[order], piece[order]
        target, depth = target[order], depth[order]
        weight = sharpness * words.weights[self.piece]
        self.begin, self.end = begins + np.arange(len(sizes)), ends + np.arange(len(sizes))
        nodes = len(data) + len(sizes)
        total = np.zeros(nodes)
        share = np.zeros(len(weight))
        cuts = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1]]) if len(depth) else np.zeros(0, np.int64)
        for low, high in zip(cuts.tolist(), np.r_[cuts[1:], len(depth)].tolist()):
            value = total[self.source[low:high]] + weight[low:high]
            into = target[low:high]
            heads = np.flatnonzero(np.r_[True, into[1:] != into[:-1]])
            counts = np.diff(np.r_[heads, high - low])
            peak = np.maximum.reduceat(value, heads)
            scaled = np.exp(value - np.repeat(peak, counts))
            sums = np.add.reduceat(scaled, heads)
            total[into[heads]] = peak + np.log(sums)
            share[low:high] = scaled / np.repeat(sums, counts)
        heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
        self.low, self.high = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.low[target[heads]] = heads
        self.high[target[heads]] = np.r_[heads[1:], len(target)]
        running = np.cumsum(share)
        if len(heads):
            before = np.r_[0, running[heads[1:] - 1]]
            running -= np.repeat(before, np.diff(np.r_[heads, len(target)]))
        self.drawn = running

    def pick(self, node: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """The edge into each node that its chance (from 0 to 1) falls on."""
        edge, last = self.low[node], self.high[node] - 1
        moving = np.flatnonzero((edge < last) & (self.drawn[edge] <= chance))
        while len(moving):
            edge[moving] += 1
            moving = moving[(edge[moving] < last[moving]) & (self.drawn[edge[moving]] <= chance[moving])]
        return edge


def _with_blank(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts that have any, each after a blank, and the bounds of the texts in them."""
    sizes = texts.ends - texts.starts
    grown = sizes + (sizes > 0)
    ends = np.cumsum(grown)
    begins = ends - grown
    data = np.full(int(grown.sum()), 32, np.uint8)
    data[ragged(begins + 1, sizes)] = texts.data[ragged(texts.starts, sizes)]
    return data, begins, ends


def encode_batch(column: pa.Array, keys: np.ndarray, path: str, seed: int = 0, sharpness: float = SHARPNESS) -> pa.Array:
    """Drawn piece numbers of each text; ``keys`` are 64-bit row keys."""
    words = vocabulary(path)
    texts = Texts(column)
    data, text_begin, text_end = _with_blank(texts)
    if not len(data):
        return list_array(pa.array([], pa.int32()), np.zeros(texts.size, np.int64))
    head = np.zeros(len(data), bool)
    head[text_begin[text_end > text_begin]] = True
    blank = data == 32
    head[1:] |= blank[1:] & ~blank[:-1]
    begin = np.flatnonzero(head)
    size = np.diff(np.r_[begin, len(data)])
    # Equal words share their lattice; a hash brings them together and their bytes must agree.
    value = SpanHash(data).of(begin, begin + size)
    _, kept, shared = np.unique(value, return_index=True, return_inverse=True)
    if not (size[kept][shared] == size).all() or not _equal_spans(data, begin, data, begin[kept][shared], size).all():
        kept = shared = np.arange(len(begin))
    owner = np.searchsorted(text_end, begin, "right")
    stream = mix(keys.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed))
    number = np.full(len(data), -1, np.int32)
    # Lattices are built for some of the distinct words at a time, which keeps them in the cache.
    by_word = np.argsort(shared, kind="stable")
    loads = np.cumsum(size[kept])
    cuts = np.searchsorted(loads, np.arange(0, int(loads[-1]) + LATTICE, LATTICE))
    places = np.searchsorted(shared[by_word], cuts)
    for low, high, first, last in zip(cuts[:-1], cuts[1:], places[:-1], places[1:]):
        if low == high:
            continue
        some = kept[low:high]
        lattice = Lattice(data[ragged(begin[some], size[some])], size[some], words, sharpness)
        word = by_word[first:last]
        node, start = lattice.end[shared[word] - low], lattice.begin[shared[word] - low]
        place, text, left = begin[word], owner[word], text_begin[owner[word]]
        while len(word):
            inner = (place + node - start - left).astype(np.uint64)
            chance = (mix(stream[text] + inner * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53
            edge = lattice.pick(node, chance)
            node = lattice.source[edge]
            number[place + node - start] = lattice.piece[edge]
            more = node > start
            word, node, start, place, text, left = (value[more] for value in (word, node, start, place, text, left))
    at = np.flatnonzero(number >= 0)
    lengths = np.searchsorted(at, text_end) - np.searchsorted(at, text_begin)
    return list_array(pa.array(number[at]), lengths)


def decode_batch(ids: pa.ListArray, path: str) -> pa.Array:
    """Texts of piece numbers; null stays null. The blank before the first word is taken off."""
    words = vocabulary(path)
    flat = ids.flatten().to_numpy()
    sizes = words.places[flat + 1] - words.places[flat]
    data = words.body[ragged(words.places[flat], sizes)]
    counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
    begins = np.concatenate([[0], ends[:-1]])
    kept = np.ones(len(data), bool)
    kept[begins[ends > begins]] = False
    lengths = np.maximum(ends - begins - 1, 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[kept].tobytes()))
    return pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.large_string())).cast(pa.string())


def _encoded(docs: DataFrame, path: str | None, seed: int, sharpness: float, check: bool) -> DataFrame:
    path = path or default_model()
    names = ["doc_id", "ids", *(["lossless"] if check else [])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column("_key").to_numpy(zero_copy_only=False).view(np.uint64)
        ids = encode_batch(batch.column("text"), keys, path, seed, sharpness)
        missing = np.array(batch.column("text").is_null())
        if missing.any():
            ids = pa.ListArray.from_arrays(ids.offsets, ids.values, mask=pa.array(missing))
        columns = [batch.column("doc_id"), ids]
        if check:
            same = pc.equal(decode_batch(ids, path), batch.column("text"))
            columns.append(pc.if_else(pa.array(missing), True, same))
        return pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id").alias("_key"))
    shape = "doc_id long, ids array<int>" + (", lossless boolean" if check else "")
    encoded = map_slices(source, run, shape, limit=SLICE)
    number = F.greatest(F.coalesce(F.size("ids"), F.lit(0)), F.lit(0)).alias("n_tokens")
    return encoded.select("doc_id", "ids", number, *names[2:])


def encode(docs: DataFrame, path: str | None = None, seed: int = 0, sharpness: float = SHARPNESS) -> DataFrame:
    """``doc_id, ids, n_tokens`` for every row of ``docs``.

    A segmentation depends on the seed, ``doc_id`` and the text, not on the layout of the table.
    Null texts have null ``ids`` and no tokens, empty texts have empty ``ids``. Repeated rows get
    equal segmentations; rows without a number share one random stream. Other columns are ignored.
    """
    return _encoded(docs, path, seed, sharpness, check=False)


def round_trip(docs: DataFrame, path: str | None = None, seed: int = 0, sharpness: float = SHARPNESS) -> DataFrame:
    """What :func:`encode` returns, and ``lossless``: does decoding the pieces give the text again?

    A null text has no pieces to decode and counts as lossless.
    """
    return _encoded(docs, path, seed, sharpness, check=True)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids`` that :func:`encode` made with the same model."""
    path = path or default_model()

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = decode_batch(part.column("ids"), path)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")
