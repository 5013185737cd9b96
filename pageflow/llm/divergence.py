"""Vocabulary divergence between the folders of a user, by row accumulation over a term-major index.

Every folder is a sparse row of smoothed term shares. Its distance to each other folder of the
user is found as a row of a sparse matrix product is: for each term the row holds, the term's
postings are scattered into one dense accumulator with a cell per peer. A share never is zero
(a term a folder lacks still has the folder's baseline), so the accumulator starts from what two
folders would differ by if they shared no term, and every shared term corrects that.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pageflow.llm.scratch import same_key, stored
from pageflow.operators.ranking import first_k

# Letters A-Z and everything beyond ASCII, on lower-cased UTF-8 bytes.
TERM = re.compile(rb"[a-z\x80-\xff]+")
BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")
MIN_FILES = 30
TOP_TERMS = 50
SCALE_STEPS = 3
PRIOR = 5
SLICE_BYTES = 1 << 22
HELD_TERMS = 400_000
BLOCK_POSTINGS = 250_000
SCATTER = 1 << 20


# ---- counting --------------------------------------------------------------------------

def _words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, of a long one slice by slice; slices end between terms."""
    begin = 0
    while begin < len(text):
        cut = BREAK.search(text, begin + SLICE_BYTES) if len(text) - begin > SLICE_BYTES else None
        end = cut.start() if cut else len(text)
        yield TERM.findall(text[begin:end].lower())
        begin = end


def _count(schema: T.StructType):
    """Counts per group and term, combined over a task's texts until ``HELD_TERMS`` are held."""

    def emit(held: dict, kinds: list) -> Iterator[pa.RecordBatch]:
        for (user, folder), (files, total) in held.items():
            terms = pa.array(list(total), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([user] * len(total), kinds[0]), pa.array([folder] * len(total), kinds[1]), terms,
                 pa.array([files[t] for t in total], pa.int64()), pa.array(list(total.values()), pa.int64())],
                names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kinds: list = []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in ("user", "folder")]
            texts = batch.column("text").cast(pa.binary())
            for user, folder, text in zip(batch.column("user").to_pylist(), batch.column("folder").to_pylist(), texts):
                files, total = held.setdefault((user, folder), (Counter(), Counter()))
                seen: set = set()
                for words in _words(text.as_py() or b""):
                    total.update(words)
                    seen.update(words)
                files.update(seen)
            if sum(len(total) for _, total in held.values()) > HELD_TERMS:
                yield from emit(held, kinds)
                held = {}
        yield from emit(held, kinds)

    return run


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exactly: long division by three digits at a time.

    Longs suffice for 9 * 10^15 terms. 0 where nothing is kept.
    """
    div = lambda a, b: F.call_function("div", a, b)
    whole = F.greatest(total + PRIOR * kept, F.lit(1))
    rest = count + PRIOR
    out = div(rest, whole)
    rest = rest % whole
    for _ in range(SCALE_STEPS):
        out = out * 1000 + div(rest * 1000, whole)
        rest = (rest * 1000) % whole
    return F.when(kept > 0, out + 1).otherwise(0).cast("long")


def term_index(files: DataFrame, user: str, folder: str, text: str, min_files: int) -> tuple[DataFrame, DataFrame]:
    """The term-major index ``user, block, term, slot, folder, p, q`` of kept terms and the groups
    ``user, folder, slot, kept, blocks, baseline``; ``slot`` is the folder's place among the user's,
    ``blocks`` the number of blocks that the user's terms are dealt into."""
    texts = files.select(F.col(f"`{user}`").alias("user"), F.col(f"`{folder}`").alias("folder"), F.col(f"`{text}`").alias("text"))
    keys = texts.schema.fields[:2]
    counted = T.StructType([*keys, T.StructField("term", T.StringType()), T.StructField("files", T.LongType()), T.StructField("n", T.LongType())])
    summed = texts.mapInArrow(_count(counted), counted).groupBy("user", "folder", "term").agg(
        F.sum("files").alias("files"), F.sum("n").alias("n"))
    summed = stored(summed, "terms")
    kept = summed.groupBy("user", "term").agg(F.sum("files").alias("files"), F.sum("n").alias("total")).filter(F.col("files") >= min_files)
    s, k = summed.alias("s"), kept.alias("k")
    postings = stored(
        s.join(k, same_key(F.col("s.user"), F.col("k.user")) & (F.col("s.term") == F.col("k.term")))
        .select("s.user", "s.folder", "s.term", "s.n", "k.total"), "postings")
    in_folder = postings.groupBy("user", "folder").agg(F.sum("n").alias("words"))
    in_user = postings.groupBy("user").agg(
        F.sum("n").alias("user_words"), F.count_distinct("term").alias("kept"), F.count("*").alias("postings"))
    g, w, u = texts.select("user", "folder").distinct().alias("g"), in_folder.alias("w"), in_user.alias("u")
    slot = F.row_number().over(Window.partitionBy("user").orderBy("folder")) - 1
    groups = stored(
        g.join(w, same_key(F.col("g.user"), F.col("w.user")) & same_key(F.col("g.folder"), F.col("w.folder")), "left")
        .join(u, same_key(F.col("g.user"), F.col("u.user")), "left")
        .select("g.user", "g.folder", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("words", "user_words", "kept", "postings")])
        .withColumns({"blocks": F.greatest(F.ceil(F.col("postings") / BLOCK_POSTINGS), F.lit(1)).cast("int"), "slot": slot.cast("long"), "baseline": share(F.lit(0), F.col("words"), F.col("kept"))}), "groups")
    p, g = postings.alias("p"), groups.alias("g")
    index = p.join(g, same_key(F.col("p.user"), F.col("g.user")) & same_key(F.col("p.folder"), F.col("g.folder"))).select(
        "p.user", F.pmod(F.xxhash64("p.term"), F.col("blocks")).cast("int").alias("block"), "p.term", "g.slot", "p.folder", share(F.col("p.n"), F.col("words"), F.col("kept")).alias("p"),
        share(F.col("p.total"), F.col("user_words"), F.col("kept")).alias("q"))
    return stored(index, "index"), groups


# ---- row accumulation ------------------------------------------------------------------

class Block:
    """A block of terms of one user's index, with the rows of all folders in it."""

    def __init__(self, baselines: np.ndarray, terms: np.ndarray, slots: np.ndarray, shares: np.ndarray):
        """``terms`` come sorted: the postings of one term stand together."""
        self.baselines, self.slots, self.shares = baselines, slots, shares
        change = np.flatnonzero(terms[1:] != terms[:-1]) + 1 if len(terms) else np.zeros(0, dtype=np.int64)
        self.begins = np.concatenate([[0], change, [len(terms)]]).astype(np.int64) if len(terms) else np.zeros(1, dtype=np.int64)
        term_of = np.repeat(np.arange(len(self.begins) - 1), np.diff(self.begins))
        by_row = np.lexsort((shares, slots))
        self.row_terms, self.row_shares = term_of[by_row], shares[by_row]
        peers = np.arange(len(baselines))
        self.rows = np.searchsorted(slots[by_row], np.arange(len(baselines) + 1))
        self.ranks = (slots[by_row] << 32) + self.row_shares
        self.sums = np.concatenate([[0], np.cumsum(self.row_shares)])
        self.peers = peers << 32

    def _apart(self, first: np.ndarray, last: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Sum of |share - value| over sorted shares first..last, of which those before ``at`` are below ``value``."""
        below, above = self.sums[at] - self.sums[first], self.sums[last] - self.sums[at]
        return value * (at - first) - below + above - value * (last - at)

    def row(self, own: int) -> np.ndarray:
        """For every peer, what the block's terms add to |V * difference of the baselines|."""
        b, base = self.baselines, self.baselines[own]
        gap = np.abs(b - base)
        first, last = self.rows[:-1], self.rows[1:]
        mine_first, mine_last = np.full(len(b), self.rows[own]), np.full(len(b), self.rows[own + 1])
        mine_at = mine_first + np.searchsorted(self.row_shares[self.rows[own]:self.rows[own + 1]], b)
        theirs_at = np.searchsorted(self.ranks, self.peers + base)
        # Own terms against the peer's baseline, the peer's terms against the own one.
        out = self._apart(mine_first, mine_last, mine_at, b) - (mine_last - mine_first) * gap
        out += self._apart(first, last, theirs_at, np.full(len(b), base)) - (last - first) * gap
        terms, shares = (x[self.rows[own]:self.rows[own + 1]] for x in (self.row_terms, self.row_shares))
        sizes = self.begins[terms + 1] - self.begins[terms]
        ends = np.cumsum(sizes)
        begin = 0
        while begin < len(terms):
            # Postings of some of the row's terms at a time; one term's are never cut.
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SCATTER, side="right")))
            n = sizes[begin:end]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(self.begins[terms[begin:end]], n) + inside
            mine = np.repeat(shares[begin:end], n)
            peer, theirs = self.slots[at], self.shares[at]
            # Held by both: their true difference in place of the two against a baseline.
            np.add.at(out, peer, np.abs(mine - theirs) - np.abs(mine - b[peer]) - np.abs(theirs - base) + gap[peer])
            begin = end
        return out


def _accumulate(kind: T.DataType):
    """Streams sorted blocks, each led by its header row, into partial distances of all its rows."""

    def finish(header: tuple, parts: list) -> Iterator[pa.RecordBatch]:
        user, number, kept, baselines = header
        column = lambda i, dtype: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=dtype)
        block = Block(baselines, column(0, object), column(1, np.int64), column(2, np.int64))
        peers = np.arange(len(baselines))
        for own in range(len(baselines)):
            value = block.row(own)
            if number == 0:
                value = value + kept * np.abs(baselines - baselines[own])
            others = peers != own
            count = len(peers) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([user[0]] * count, user[1]), pa.array(np.full(count, own)), pa.array(peers[others]), pa.array(value[others])],
                names=["user", "slot", "peer", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header, parts = None, []
        for batch in batches:
            heads = np.flatnonzero(np.asarray(batch.column("term").is_null())).tolist()
            bounds = [*heads, batch.num_rows] if heads and heads[0] == 0 else [0, *heads, batch.num_rows]
            for begin, end in zip(bounds, bounds[1:]):
                lead = begin in heads
                if lead:
                    if header:
                        yield from finish(header, parts)
                    user, number, kept, baselines = (batch.column(c)[begin].as_py() for c in ("user", "block", "kept", "baselines"))
                    header, parts = ((user, batch.schema.field("user").type), number, kept, np.array(baselines, dtype=np.int64)), []
                rows = batch.slice(begin + lead, end - begin - lead)
                if rows.num_rows:
                    parts.append([rows.column(c).to_numpy(zero_copy_only=False) for c in ("term", "slot", "p")])
        if header:
            yield from finish(header, parts)

    return run


def folder_distances(index: DataFrame, groups: DataFrame) -> DataFrame:
    """``user, slot, peer, value`` for every two folders of a user, both ways.

    A user's terms are dealt into blocks of about ``BLOCK_POSTINGS`` postings. A block's task adds
    up all its rows and sends one number a pair of folders, however many terms they share.
    """
    none = lambda kind: F.lit(None).cast(kind)
    users = groups.groupBy("user").agg(
        F.first("kept").alias("kept"), F.first("blocks").alias("blocks"),
        F.sort_array(F.collect_list(F.struct("slot", "baseline"))).alias("b"))
    heads = users.select(
        "user", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), none("string").alias("term"),
        none("long").alias("slot"), none("long").alias("p"), "kept", F.col("b.baseline").alias("baselines"))
    rows = index.select(
        "user", "block", "term", "slot", "p", none("long").alias("kept"), none("array<long>").alias("baselines"))
    kind = index.schema["user"].dataType
    schema = T.StructType([T.StructField("user", kind), *[T.StructField(c, T.LongType()) for c in ("slot", "peer", "value")]])
    order = ["user", "block"]
    parts = (
        heads.unionByName(rows).repartition(*order).sortWithinPartitions(*order, F.asc_nulls_first("term"), "slot")
        .mapInArrow(_accumulate(kind), schema)
    )
    return parts.groupBy("user", "slot", "peer").agg(F.sum("value").alias("value"))


def audit_folders(
    files: DataFrame, user: str = "user_id", folder: str = "folder_id", text: str = "text", min_files: int = MIN_FILES,
    top: int = TOP_TERMS,
) -> DataFrame:
    """How far the folders of each user differ in vocabulary, and by which terms: ``user, folder, part, item, value, rank``.

    ``files`` are library files with their text: ``user_id, folder_id, text``. Terms are runs of
    ASCII letters and characters beyond ASCII, A-Z lower-cased; a user keeps those in at least
    ``min_files`` of their files. A folder's share of a kept term is p = 1 + floor(10^9 (n + 5) / (N + 5 V)),
    for n occurrences among N of all V kept terms; q is the same over all of the user's files.
    Part ``pair`` lists each other folder of the user with the sum of |p - p'| over all kept terms;
    part ``term`` the ``top`` terms that the folder holds with p > q, by p - q. Ranks run per folder and
    part, greatest value first, ties by item. ``item`` is text.

    All numbers are whole and exact. A null text has no terms, a text of any length is counted
    whole; a user or folder of null is one like any other and listed with a null item; repeated
    rows count each; folders without terms keep their baseline; an empty table gives no rows;
    other columns are not read. The pairs are as many as the result lists: folders squared, per
    user. A task holds one block of a user's index and one number a folder.
    """
    index, groups = term_index(files, user, folder, text, min_files)
    a, b, d = groups.alias("a"), groups.alias("b"), folder_distances(index, groups).alias("d")
    pairs = (
        d.join(a, same_key(F.col("d.user"), F.col("a.user")) & (F.col("d.slot") == F.col("a.slot")))
        .join(b, same_key(F.col("d.user"), F.col("b.user")) & (F.col("d.peer") == F.col("b.slot")))
        .select("d.user", "a.folder", F.lit("pair").alias("part"), F.col("b.folder").cast("string").alias("item"), "d.value")
    )
    place = Window.partitionBy("user", "folder").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(place))
    over = index.filter(F.col("p") > F.col("q")).select(
        "user", "folder", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.unionByName(first_k(over, ["user", "folder"], [F.desc("value"), "item"], top))
