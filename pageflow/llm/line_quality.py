"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageflow.llm.scratch import stored

TRAIN_FILES = 6000
TRAIN_LINES = 1_200_000
ACCEPT = 0.7
SLICE_CHARS = 4_000_000
SLICE_LINES = 20_000
CLASSES = 9  # other, lower, upper, digit, space, sentence mark, ! or ?, bar or slash, symbol
OWN = 14


def char_classes() -> np.ndarray:
    """Class of every code point of the basic plane."""
    table = np.zeros(1 << 16, dtype=np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        table[i] = 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 0
    for number, marks in ((5, ".,;:'\"()-"), (6, "!?"), (7, "|/\\"), (8, "#*$%&<>@=_~^+")):
        for c in marks:
            table[ord(c)] = number
    return table


def line_features(lines: list[str], table: np.ndarray) -> np.ndarray:
    """``OWN`` features of each line by itself (all nonempty), rows in order."""
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = table[np.minimum(codes, 65535)]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    counts = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(CLASSES)], axis=1)
    share = counts / lengths[:, None]
    words = [line.split() for line in lines]
    n_words = np.fromiter(map(len, words), dtype=np.int64, count=len(lines))
    distinct = np.fromiter((len(set(w)) for w in words), dtype=np.int64, count=len(lines))
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    solid = lengths - counts[:, 4]
    return np.stack([
        np.log1p(lengths) / 5, share[:, 0], counts[:, 2] / letters, share[:, 3], share[:, 4], share[:, 5] * 5,
        np.minimum(counts[:, 6] / np.maximum(n_words, 1), 2), np.minimum(counts[:, 7] / np.maximum(n_words, 1), 2),
        np.minimum(counts[:, 8] / np.maximum(n_words, 1), 3), np.minimum(solid / np.maximum(n_words, 1), 20) / 5,
        1 - distinct / np.maximum(n_words, 1), np.minimum(n_words, 5) / 5, lengths < 20,
        kinds[starts + lengths - 1] == 5,
    ], axis=1).astype(np.float64)


def repeated_marks(lines: list[str], owners: np.ndarray) -> np.ndarray:
    """1 for every line that its text holds earlier."""
    seen: set[tuple[int, str]] = set()
    repeated = np.zeros(len(lines))
    for i, key in enumerate(zip(owners.tolist(), lines)):
        if key in seen:
            repeated[i] = 1
        else:
            seen.add(key)
    return repeated


def chain_features(lines: list[str], owners: np.ndarray, table: np.ndarray, repeated: np.ndarray | None = None) -> np.ndarray:
    """Features of lines in their chains: constant, own, previous and next line's, first, last
    and repeated-line marks (made here unless given). ``owners`` numbers the text of each line,
    in order."""
    own = line_features(lines, table)
    same = owners[1:] == owners[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    first = np.concatenate(([True], ~same))
    last = np.concatenate((~same, [True]))
    repeated = repeated_marks(lines, owners) if repeated is None else repeated
    extra = np.stack([np.ones(len(lines)), first, last, repeated], axis=1)
    return np.concatenate([extra, own, before, after], axis=1)


WIDTH = 4 + 3 * OWN


def content_lines(text: str | None) -> list[str]:
    return [line for line in (text or "").split("\n") if line.strip()]


@dataclass
class Chain:
    """Weights of the field: a line's log-odds of being good, and rewards for neighbours that
    are both bad, bad then good, good then bad, both good."""

    weights: np.ndarray
    moves: np.ndarray  # 2 x 2

    def marginals(self, features: np.ndarray, owners: np.ndarray, pairs: bool = False):
        """P(good) of every line by forward-backward in its own text's chain.

        Texts advance together, longest first: step t handles the t-th line of every text that
        has one. With ``pairs``, also the expected counts of the four moves and each text's
        log partition sum.
        """
        starts = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(owners)])))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        score = features @ self.weights
        node = np.stack([np.ones_like(score), np.exp(np.clip(score, -30, 30))], axis=1)
        move = np.exp(np.clip(self.moves, -8, 8))
        alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts longer than t
        ahead, log_sum = np.zeros((len(owners), 2)), np.zeros(len(sizes))
        for t, n in enumerate(alive):
            at = starts[:n] + t
            a = node[at] if t == 0 else (ahead[at - 1] @ move) * node[at]
            total = a.sum(axis=1)
            ahead[at] = a / total[:, None]
            log_sum[:n] += np.log(total)
        behind = np.ones((len(owners), 2))
        expected = np.zeros((2, 2))
        for t in range(len(alive) - 1, 0, -1):
            at = starts[: alive[t]] + t
            right = node[at] * behind[at]
            if pairs:
                joint = ahead[at - 1][:, :, None] * move[None] * right[:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = right @ move.T
            behind[at - 1] = b / b.sum(axis=1, keepdims=True)
        both = ahead * behind
        good = both[:, 1] / both.sum(axis=1)
        return (good, expected, log_sum.sum()) if pairs else good


    def along(self, score: np.ndarray) -> np.ndarray:
        """P(good) of every line of one text of any length from its lines' log-odds: forward and
        backward number by number, four numbers a line."""
        (bb, bg), (gb, gg) = np.exp(np.clip(self.moves, -8, 8)).tolist()
        node = array("d", np.exp(np.clip(score, -30, 30)))
        ahead, good = array("d"), array("d", bytes(8 * len(node)))
        low, high = 1.0, 0.0
        for t, n in enumerate(node):
            low, high = (low * bb + high * gb, (low * bg + high * gg) * n) if t else (1.0, n)
            total = low + high
            low, high = low / total, high / total
            ahead.extend((low, high))
        low, high = 1.0, 1.0
        for t in range(len(node) - 1, -1, -1):
            a, b = ahead[2 * t] * low, ahead[2 * t + 1] * high
            good[t] = b / (a + b)
            high *= node[t]
            low, high = bb * low + bg * high, gb * low + gg * high
            total = low + high
            low, high = low / total, high / total
        return np.array(good)


def long_text_score(lines: list[str], chain: Chain, table: np.ndarray) -> float:
    """Score of one text of any number of lines. Features, the largest part, are made for
    ``SLICE_LINES`` lines at a time, with the lines beside them."""
    repeated = repeated_marks(lines, np.zeros(len(lines), dtype=np.int64))
    odds = np.zeros(len(lines))
    for begin in range(0, len(lines), SLICE_LINES):
        end = min(begin + SLICE_LINES, len(lines))
        low, high = max(begin - 1, 0), min(end + 1, len(lines))
        x = chain_features(lines[low:high], np.zeros(high - low, dtype=np.int64), table, repeated[low:high])
        odds[begin:end] = (x @ chain.weights)[begin - low : end - low]
    weight = np.fromiter(map(len, lines), dtype=np.float64, count=len(lines))
    return float(weight @ chain.along(odds) / weight.sum())


def fit_chain(features: np.ndarray, owners: np.ndarray, labels: np.ndarray, steps: int = 150,
              rate: float = 0.1, ridge: float = 1.0) -> Chain:
    """Maximum likelihood with a ridge, by Adam. ``labels`` holds 0 or 1 for every line: its
    text's label, so the chain also learns how seldom neighbours differ."""
    chain = Chain(np.zeros(features.shape[1]), np.zeros((2, 2)))
    same = owners[1:] == owners[:-1]
    observed_moves = np.zeros((2, 2))
    np.add.at(observed_moves, (labels[:-1][same], labels[1:][same]), 1)
    observed = features[labels == 1].sum(axis=0)
    params = np.zeros(features.shape[1] + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        good, expected, _ = chain.marginals(features, owners, pairs=True)
        gradient = np.concatenate([observed - features.T @ good, (observed_moves - expected).ravel()])
        gradient = (gradient - ridge * params) / len(owners)
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        params = params + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        chain = Chain(params[:-4], params[-4:].reshape(2, 2))
    return chain


def training_files(files: DataFrame, labels: DataFrame, sample: int = TRAIN_FILES) -> DataFrame:
    """At most ``sample`` labelled files, half of each label where there are enough: those whose
    ``file_id`` hashes smallest. A file labelled both ways is left out."""
    known = (
        labels.filter("file_id is not null and quality in (0, 1)").groupBy("file_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    )
    known = known.join(files.select("file_id").distinct(), "file_id", "left_semi")
    draw = F.xxhash64("file_id")
    sides = [known.filter(F.col("quality") == q).orderBy(draw, "file_id").limit(sample // 2) for q in (0, 1)]
    chosen = sides[0].unionByName(sides[1])
    return files.select("file_id", "text").join(chosen, "file_id").dropDuplicates(["file_id"])


def within_lines(sizes: list[tuple], max_lines: int) -> set:
    """Ids of ``(quality, draw, file_id, lines)`` in order of their draw, of each label until the
    next whole text would lead beyond half of ``max_lines``. A text longer than that half by
    itself is passed over."""
    taken: set = set()
    for side in (0, 1):
        left = max_lines // 2
        for _, _, file_id, lines in sorted(s for s in sizes if s[0] == side and s[3] <= max_lines // 2):
            if lines > left:
                break
            taken.add(file_id)
            left -= lines
    return taken


def train(files: DataFrame, labels: DataFrame, sample: int = TRAIN_FILES, max_lines: int = TRAIN_LINES) -> Chain:
    """Fits the field on a bounded sample of whole texts: at most ``sample`` files and
    ``max_lines`` lines together (:func:`within_lines`). ``labels`` has ``file_id, quality`` and only rows that may be learned from. Features
    are made in tasks; the driver receives ``WIDTH`` short floats a line (at most 220 MB with the
    default bounds, usually a tenth) and fits. Without usable labels every line is as likely good
    as bad."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(content_lines(text.as_py())) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_id"), batch.column("quality"), pa.array(sizes, pa.int64())],
                names=["file_id", "quality", "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = char_classes()
        for batch in batches:
            out = []
            for file_id, text, quality in zip(batch.column("file_id"), batch.column("text"), batch.column("quality")):
                lines = content_lines(text.as_py()) if file_id.as_py() in taken else []
                if lines:
                    x = chain_features(lines, np.zeros(len(lines), dtype=np.int64), table)
                    out.append((quality.as_py(), x.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([q for q, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())],
                names=["quality", "features"])

    chosen = training_files(files, labels, sample).select("file_id", "text", F.col("quality").cast("int").alias("quality"))
    # Stored, so that both readings see one text of an id that repeats.
    chosen = stored(chosen, "training")
    counted = chosen.mapInArrow(count, f"file_id {dict(chosen.dtypes)['file_id']}, quality int, lines long")
    sizes = counted.select("quality", F.xxhash64("file_id").alias("draw"), "file_id", "lines").collect()
    taken = within_lines([tuple(r) for r in sizes], max_lines)
    rows = sorted((r.quality, bytes(r.features)) for r in chosen.mapInArrow(run, "quality int, features binary").toLocalIterator())
    if len({q for q, _ in rows}) < 2:
        return Chain(np.zeros(WIDTH), np.zeros((2, 2)))
    parts = [np.frombuffer(x, dtype=np.float32).reshape(-1, WIDTH) for _, x in rows]
    sizes = [len(p) for p in parts]
    owners = np.repeat(np.arange(len(parts)), sizes)
    line_labels = np.repeat([q for q, _ in rows], sizes)
    return fit_chain(np.concatenate(parts).astype(np.float64), owners, line_labels)


def score_files(files: DataFrame, chain: Chain, accept: float = ACCEPT) -> DataFrame:
    """``score, predicted`` for every file, after its other columns.

    The score is the mean of the lines' P(good) weighted by their lengths, over the whole text;
    a text of any length is one chain, whose features are held for ``SLICE_LINES`` lines at once;
    ``predicted`` is 1 from ``accept`` on. A text without content scores 0. Scores use the text
    alone. Rows are scored one by one and keep all columns; input columns named ``score`` or
    ``predicted`` are replaced.
    """
    kept = files.drop("score", "predicted")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def scores_of(chains: list[list[str]]) -> list[float]:
        if len(chains) == 1 and len(chains[0]) > SLICE_LINES:
            return [min(max(long_text_score(chains[0], chain, table[0]), 0.0), 1.0)]
        lines = [line for c in chains for line in c]
        result = np.zeros(len(chains))
        if lines:
            owners = np.repeat(np.arange(len(chains)), [len(c) for c in chains])
            good = chain.marginals(chain_features(lines, owners, table[0]), owners)
            weight = np.fromiter(map(len, lines), dtype=np.float64, count=len(lines))
            total = np.bincount(owners, weight, len(chains))
            result = np.bincount(owners, weight * good, len(chains)) / np.maximum(total, 1)
        return np.clip(result, 0, 1).tolist()

    table: list[np.ndarray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not table:
            table.append(char_classes())
        for batch in batches:
            texts, scores, waiting = batch.column("text"), [], []
            chars = lines = 0
            for value in texts:
                text = value.as_py() or ""
                found = content_lines(text)
                if waiting and (chars + len(text) > SLICE_CHARS or lines + len(found) > SLICE_LINES or len(waiting) >= 1000):
                    scores += scores_of(waiting)
                    waiting, chars, lines = [], 0, 0
                waiting.append(found)
                chars += len(text)
                lines += len(found)
            if waiting:
                scores += scores_of(waiting)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= accept) for s in scores], pa.int32())],
                names=[*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, f"{fields}, score double, predicted int")


def held_out(file_id: str = "file_id"):
    """True for the quarter of ids whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(file_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def judge_quality(files: DataFrame, labels: DataFrame, sample: int = TRAIN_FILES, accept: float = ACCEPT) -> DataFrame:
    """Quality of every file from a field trained on the labels outside the held-out quarter.

    ``files`` has ``file_id, text``, ``labels`` has ``file_id, quality`` (0 or 1; other values
    and null ids are ignored). Returns the file columns but for ``held_out, score, predicted``,
    then those three. Null, empty and blank texts score 0; repeated rows score alike; an empty
    table gives an empty result.
    """
    usable = labels.select("file_id", "quality").filter(~held_out())
    chain = train(files, usable, sample)
    scored = score_files(files.drop("held_out"), chain, accept)
    rest = [F.col(f"`{c}`") for c in scored.columns if c not in ("score", "predicted")]
    return scored.select(*rest, held_out().alias("held_out"), "score", "predicted")
