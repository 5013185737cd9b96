"""Packing token sequences: best fit, then swap-based local search."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pageflow.llm.scratch import stored

CAPACITY = 2048
BLOCK_TOKENS = 8_000_000
BLOCK_PIECES = 50_000
CACHE_WORDS = 400_000
TEXT_BYTES = 8_000_000
LATIN_WORD = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-/:-@\[-`{-~]*)$"
PIECES = "piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def gathered(values: np.ndarray, lengths: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` are runs of ``lengths``: those numbered ``runs`` one after another, and where each ends."""
    begins, stops = np.cumsum(lengths) - lengths, np.cumsum(lengths[runs])
    picked = np.empty(stops[-1] if len(stops) else 0, dtype=values.dtype)
    for at in range(0, len(runs), 1_000_000):
        run, stop = runs[at : at + 1_000_000], stops[at : at + 1_000_000]
        size = lengths[run]
        first = stop[0] - size[0]
        places = np.repeat(begins[run] - (stop - size), size)
        places += np.arange(first, stop[-1])
        picked[first : stop[-1]] = values[places]
    return picked, stops


class WordEncoder:
    """Token ids of whole texts, little-endian unsigned 32-bit, word by word.

    Made for BPE vocabularies that mark word ends and drop white space: ids never reach across
    it, so a text's ids are those of its blank-separated words in order. Each different word of a
    call is looked at once and the texts' ids are gathered by word number. All ids come from the
    tokenizer; those of parts seen lately are remembered in two generations of ``CACHE_WORDS``.
    Words of Latin letters and closing marks are parted before the marks and lower-cased as the
    vocabulary does; new parts are encoded in lines of many, and the ids are dealt back at their
    word ends; any line whose word ends do not match, and every other new word, is encoded word
    by word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Lower-case Latin-1 letters and ASCII marks are normal already: no normaliser for lines.
        self.lines = Tokenizer(self.tokenizer.model)
        self.lines.pre_tokenizer = self.tokenizer.pre_tokenizer
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.parts: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.other: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    @staticmethod
    def _recall(store: tuple[dict, dict], wanted: list[str], encode: Callable) -> tuple[tuple[dict, dict], list[bytes]]:
        """The store with every wanted word in it, and their ids."""
        young, old = store
        ids = [b"" if w == "" else young.get(w) for w in wanted]
        missing = [i for i, known in enumerate(ids) if known is None]
        for i in missing:
            ids[i] = old.get(wanted[i])
        unknown = [i for i in missing if ids[i] is None]
        for i, new in zip(unknown, encode([wanted[i] for i in unknown])):
            ids[i] = new
        if len(young) + len(missing) > CACHE_WORDS:
            young, old = {}, young
        young.update((wanted[i], ids[i]) for i in missing)
        return (young, old), ids

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _by_lines(self, parts: list[str]) -> list[bytes]:
        lines = [parts[i : i + 256] for i in range(0, len(parts), 256)]
        found: list[bytes] = []
        for line, e in zip(lines, self.lines.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(line):
                raw = ids.tobytes()
                found += [raw[at:stop] for at, stop in zip([0, *stops], stops)]
            else:
                found += self._one_by_one(line)
        return found

    def flat(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each followed by ``end``, and where each text
        begins among them (with the total last)."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = split.flatten().dictionary_encode()
        words, parted = coded.dictionary, pc.extract_regex(coded.dictionary, LATIN_WORD)
        # Two numbers a word: of its letters and of its marks; of itself and of nothing if it is another.
        letters, marks = pc.utf8_lower(pc.struct_field(parted, "letters")), pc.struct_field(parted, "marks")
        numbered = pa.concat_arrays([letters, marks]).dictionary_encode()
        as_list = lambda strings: strings.to_numpy(zero_copy_only=False).tolist()
        self.parts, ids = self._recall(self.parts, as_list(numbered.dictionary), self._by_lines)
        number = pc.fill_null(numbered.indices, -1).to_numpy().reshape(2, -1).copy()
        others = np.flatnonzero(number[0] < 0)
        self.other, more = self._recall(self.other, as_list(words.take(pa.array(others))), self._one_by_one)
        number[0, others], number[1, others] = len(ids) + np.arange(len(others)), len(ids) + len(others)
        ids += [*more, b"", end]
        number = np.hstack([number, [[len(ids) - 2], [len(ids) - 1]]])  # the end is a word of its own
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        word_ids, stops = gathered(np.frombuffer(b"".join(ids), dtype="<u4"), lengths, number.T.ravel())
        word = np.insert(coded.indices.to_numpy(), bounds[1:], len(words))
        text_ids, stops = gathered(word_ids, np.diff(stops[1::2], prepend=0), word)
        return text_ids, np.concatenate([[0], stops])[bounds + np.arange(len(bounds))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, bounds = self.flat(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def text_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of runs of texts; a run has less than ``limit`` bytes after its first text."""
    reached = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = np.flatnonzero(np.diff(reached // limit, prepend=-1)).tolist()
    yield from ((a, b - a) for a, b in zip(first, [*first[1:], len(texts)]))


def cut_pieces(files: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``file_id, piece, start, length, ids_crc32``: each file's ids and ``end_id``, cut only
    where they exceed ``capacity``. Null text is empty: one piece with the end alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = WordEncoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for first, rows in text_slices(batch.column("text"), TEXT_BYTES):
                part = batch.slice(first, rows)
                ids, bounds = encode.flat(pc.fill_null(part.column("text"), ""), end)
                total = np.diff(bounds)
                pieces = -(-total // capacity)
                owner = np.repeat(np.arange(rows), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(total[owner] - start, capacity)
                begin = bounds[:-1][owner] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("file_id").take(pa.array(owner)), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["file_id", "piece", "start", "length", "ids_crc32"],
                )

    columns = files.select("file_id", "text")
    return columns.mapInArrow(run, f"file_id {dict(columns.dtypes)['file_id']}, {PIECES}")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit of sizes in the given (decreasing) order: bins as lists of indexes.

    Bins are found by remaining room through a bit mask: the lowest set bit from the size on.
    """
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    mask = 0
    for i, size in enumerate(sizes):
        high = mask >> size
        if high:
            room = size + (high & -high).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= size
        by_room.setdefault(room, []).append(b)
        mask |= 1 << room
    return bins


class LocalSearch:
    """Exchanges between underfull bins that raise the sum of squared fills.

    The fullest underfull bin is served first. It receives the exchange that fills it most: one
    item moved in, one item for one of its own, two items of a bin for one, or one for two. An
    exchange of net size d from bin i to bin j is made when d > 0, it fits, and
    fill(j) + d > fill(i), which is when the sum of squares grows; it ends when a round makes
    none, and bins that ran empty are gone.
    """

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.sizes, self.bins, self.capacity = sizes, bins, capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.single: dict[int, dict[int, int]] = {}  # size -> bin -> item
        self.double: dict[int, dict[int, tuple[int, int]]] = {}  # sum -> bin -> two items
        self.masks = {1: 0, 2: 0}
        for b, fill in enumerate(self.fill):
            if fill < capacity:
                self._list(b, True)

    def _pairs(self, b: int) -> Iterator[tuple[int, int]]:
        # Two items stand for all of their size: a bin has few different sizes, as they add up to it.
        own: dict[int, list[int]] = {}
        for i in self.bins[b]:
            if len(same := own.setdefault(self.sizes[i], [])) < 2:
                same.append(i)
        yield from (tuple(same) for same in own.values() if len(same) == 2)
        yield from combinations([same[0] for same in own.values()], 2)

    def _list(self, b: int, there: bool) -> None:
        """Puts a bin's items into the index, or takes them out."""
        entries = [(1, self.single, self.sizes[i], i) for i in self.bins[b]]
        entries += [(2, self.double, self.sizes[x] + self.sizes[y], (x, y)) for x, y in self._pairs(b)]
        for kind, index, size, what in entries:
            at = index.setdefault(size, {})
            if there:
                at[b] = what
                self.masks[kind] |= 1 << size
            else:
                at.pop(b, None)
                if not at:
                    self.masks[kind] &= ~(1 << size)

    def _largest(self, kind: int, limit: int) -> int:
        return (self.masks[kind] & ((1 << (limit + 1)) - 1)).bit_length() - 1

    def _serve(self, j: int) -> bool:
        room = self.capacity - self.fill[j]
        self._list(j, False)
        sizes = self.sizes
        own = {sizes[i]: i for i in self.bins[j]}
        offers = [(0, ())] + [(s, (i,)) for s, i in own.items()]
        pairs = [(sizes[x] + sizes[y], (x, y)) for x, y in self._pairs(j)]
        best: tuple = (0,)
        for kind, given in ((1, offers + pairs), (2, offers)):
            for out, items in given:
                if best[0] == room:
                    break
                index = self.single if kind == 1 else self.double
                size = self._largest(kind, min(out + room, self.capacity))
                while (gain := size - out) > best[0]:
                    donor = next((d for d in index[size] if self.fill[d] < self.fill[j] + gain), None)
                    if donor is not None:
                        what = index[size][donor]
                        best = (gain, donor, (what,) if kind == 1 else what, items)
                        break
                    size = self._largest(kind, size - 1)
        if best[0] > 0:
            gain, donor, taken, given = best
            self._list(donor, False)
            self.bins[donor] = [i for i in self.bins[donor] if i not in taken] + list(given)
            self.bins[j] = [i for i in self.bins[j] if i not in given] + list(taken)
            self.fill[donor] -= gain
            self.fill[j] += gain
            if self.bins[donor]:
                self._list(donor, True)
        if self.fill[j] < self.capacity:
            self._list(j, True)
        return best[0] > 0

    def run(self) -> list[list[int]]:
        """Ends: every exchange raises a sum of whole squares that is bounded."""
        while True:
            open_bins = [b for b in range(len(self.bins)) if self.bins[b] and self.fill[b] < self.capacity]
            open_bins.sort(key=lambda b: (-self.fill[b], b))
            changed = False
            for b in open_bins:
                while self.bins[b] and self.fill[b] < self.capacity and self._serve(b):
                    changed = True
            if not changed:
                break
        return [b for b in self.bins if b]


def pack_block(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins (lists of positions in ``sizes``) of one block: best fit decreasing, then the search."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    ordered = [sizes[i] for i in order]
    bins = LocalSearch(ordered, best_fit(ordered, capacity), capacity).run()
    return [[order[i] for i in b] for b in bins]


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY,
                block_tokens: int = BLOCK_TOKENS, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``pieces`` (a stored table of ``file_id, piece, start, length, ids_crc32``) with
    ``sequence_id, offset``.

    Pieces are dealt by hash into blocks of about ``block_tokens`` tokens and at most about
    ``block_pieces`` pieces, each packed by one task on sizes alone. A block wastes at most one
    nearly empty sequence of its thousands. The hash covers the row's place in the stored table,
    so rows that repeat do not gather in one block, and a recomputed task deals alike.
    """
    total, count = pieces.agg(F.sum("length"), F.count("*")).first()
    blocks = int(max((total or 0) // block_tokens, count // block_pieces)) + 1
    key_type = dict(pieces.dtypes)["file_id"]

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["length", "ids_crc32", "start", "place"], ascending=False, kind="stable")
        sizes = block["length"].tolist()
        sequence, offset = np.zeros(len(block), dtype=np.int64), np.zeros(len(block), dtype=np.int64)
        first = int(block["block"].iloc[0]) << 32
        for n, items in enumerate(pack_block(sizes, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = first + n, at
                at += sizes[i]
        return block.drop(columns=["block", "place"]).assign(sequence_id=sequence, offset=offset)

    return (
        pieces.withColumn("place", F.monotonically_increasing_id())
        .withColumn("block", F.pmod(F.xxhash64("ids_crc32", "piece", "place"), F.lit(blocks)))
        .groupBy("block").applyInPandas(run, f"file_id {key_type}, {PACKED}")
    )


def pack_files(files: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Packs every file's tokens into as few sequences of ``capacity`` tokens as it can.

    ``files`` has ``file_id, text``; a file's tokens are its ids without special tokens, then
    ``end_id``. Only longer files are cut. Returns per piece ``file_id, piece, start, length,
    ids_crc32, sequence_id, offset``; the pieces of a sequence lie gapless from 0. Texts are
    tokenised once and only sizes are stored and packed.

    Null text is empty and gives one token; a null id stays null; repeated rows are packed one
    by one; an empty table gives an empty result; other columns are not read. Which of several
    equal sizes goes where is settled by checksum and place in the stored table.
    """
    return pack_pieces(stored(cut_pieces(files, tokenizer, capacity, end_id), "pieces"), capacity)
