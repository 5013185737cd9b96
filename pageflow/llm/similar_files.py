"""N-gram Jaccard join of file texts by T-occurrence search with DivideSkip."""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pageflow.llm.components import components
from pageflow.llm.scratch import n_words, stored

WORDS = 5
SIMILARITY = 80  # per cent
EARLY = 20
BUCKETS = 1 << 18
LIST_COST = 0.0085  # fixed value of the method: cost of a probe in a long list against a merge step
PART_FILES = 512
PART_TOKENS = 300_000
PART_QUERIES = 512
ROWS = 256


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit codes of the distinct shingles of a text (A-Z lower-cased); of all its
    words where there are fewer than ``words``; none without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    known = {p: xxhash.xxh64_intdigest(p) for p in set(parts)}
    codes = np.fromiter(map(known.__getitem__, parts), dtype=np.uint64, count=len(parts))
    size = min(words, len(parts))
    mixed = np.full(len(parts) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        mixed = (mixed ^ codes[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed * np.uint64(0xBF58476D1CE4E5B9))


def required(n: int, similarity: int = SIMILARITY) -> int:
    """Shingles that a set of n shares with any set it links to, at least."""
    return -(-similarity * n // 100)


def early(n: int) -> int:
    """Common shingles that two linked sets have among their leading ones, at least (for the
    smaller of the two sizes)."""
    return max(1, n // EARLY)


def leading(n: int, similarity: int = SIMILARITY) -> int:
    """Length of a set's leading part, in code order. Of at least ``required(n)`` common
    shingles no more than n - leading(n) can lie behind it, so ``early(n)`` lie in it."""
    return n - required(n, similarity) + early(n)


def scan(files: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``file_id, digest, node, n, lead`` of all texts, in one pass over them.

    ``node`` is a 64-bit code of the whole set: files with equal sets are one node. ``lead`` holds
    the codes of the leading shingles.
    """

    def node_of(codes: np.ndarray) -> int:
        return int.from_bytes(hashlib.md5(codes.tobytes()).digest()[:8], "little", signed=True)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, lead = [], [], []
            for value in batch.column("text"):
                codes = shingles(value.as_py() or "")
                nodes.append(node_of(codes) if len(codes) else None)
                sizes.append(len(codes))
                lead.append(codes[: leading(len(codes), similarity)].tobytes() if len(codes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_id"), batch.column("digest"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(lead, pa.binary())],
                names=["file_id", "digest", "node", "n", "lead"])

    columns = files.select("file_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    kind = dict(columns.dtypes)["file_id"]
    return columns.mapInArrow(heads, f"file_id {kind}, digest string, node long, n long, lead binary")


def _listing(nodes: list[int], sizes: list[int], lead: list[np.ndarray]) -> pa.RecordBatch:
    """A row (``token, node, n``) for each code of each node."""
    counts = [len(x) for x in lead]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *lead]).view(np.int64)),
         pa.array(np.repeat(np.array(nodes, dtype=np.int64), counts)), pa.array(np.repeat(np.array(sizes, dtype=np.int32), counts))],
        names=["token", "node", "n"])


def leading_tokens(rows: DataFrame) -> DataFrame:
    """``token, node, n`` of the stored leading shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                lead = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in part.column("lead")]
                yield _listing(part.column("node").to_pylist(), part.column("n").to_pylist(), lead)

    return rows.filter("node is not null").select("node", "n", "lead").mapInArrow(run, "token long, node long, n int")


def divide_skip(lists: list[list[int]], need: int, least: int, stop: int, wanted=lambda i: True) -> Iterator[tuple[int, int]]:
    """T-occurrence search: (value, occurrences) of the values from ``least`` to before ``stop``
    that occur in at least ``need`` of the sorted ``lists``.

    The longest lists, need / (LIST_COST log2(longest) + 1) of them and fewer than ``need``, are
    long ones. The short lists are merged with a heap; a value seen there too seldom is left
    behind together with everything up to the next value that could still be seen often
    enough. Values seen often enough (and ``wanted``) are probed in the long lists by binary
    search.
    """
    if len(lists) < need:
        return
    lists = sorted(lists, key=len)
    n_long = min(need - 1, int(need / (LIST_COST * log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    seen_short = need - n_long
    heap = []
    for k, values in enumerate(short):
        at = bisect_left(values, least)
        if at < len(values):
            heap.append((values[at], k, at))
    heapq.heapify(heap)
    while len(heap) >= seen_short:
        value, popped = heap[0][0], []
        if value >= stop:
            return
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap))
        count = len(popped)
        if count >= seen_short:
            if wanted(value):
                left = len(long)
                for values in reversed(long):
                    if count + left < need:
                        break
                    left -= 1
                    at = bisect_left(values, value)
                    count += at < len(values) and values[at] == value
                if count >= need:
                    yield value, count
            target = value + 1
        else:
            while heap and len(popped) < seen_short - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            target = heap[0][0]
        for _, k, at in popped:
            at = bisect_left(short[k], target, at)
            if at < len(short[k]):
                heapq.heappush(heap, (short[k][at], k, at))


class Links:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def linked(common: int, a: int, b: int, similarity: int) -> bool:
    return 100 * common >= similarity * (a + b - common)


def search_part(sets: list[np.ndarray], groups: list, queries: list[np.ndarray] | None, query_groups: list | None,
                similarity: int = SIMILARITY) -> list[tuple[int, int]]:
    """Links that join groups: (query, member) positions, enough of them to connect whatever
    linked pairs connect. ``sets`` ascend in size. Without ``queries`` every set searches the
    sets before it; pairs already connected are not probed.
    """
    own = queries is None
    asked = sets if own else queries
    everything = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(everything, kind="stable")
    codes, owner = everything[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, dtype=np.int64)
    stops = np.concatenate((starts[1:], [len(codes)])).astype(np.int64)
    distinct = codes[starts]
    sizes = [len(s) for s in sets]
    links = Links(len(sets) + (0 if own else len(asked)))
    first: dict = {}
    for i, g in enumerate([*groups, *(query_groups or [])]):
        if g in first:
            links.join(first[g], i)
        else:
            first[g] = i
    memory: dict[int, list[int]] = {}
    found = []
    for q, tokens in enumerate(asked):
        me = q if own else len(sets) + q
        need = required(len(tokens), similarity)
        at = np.searchsorted(distinct, tokens)
        inside = at < len(distinct)
        present = at[inside][distinct[at[inside]] == tokens[inside]]
        if own:  # a list needs another owner than the query itself, and an earlier one
            present = present[owner[starts[present]] < q]
        if len(present) < need:
            continue
        lists = []
        for p in present.tolist():
            values = memory.get(p)
            if values is None:
                values = memory[p] = owner[starts[p] : stops[p]].tolist()
            lists.append(values)
        least = bisect_left(sizes, required(len(tokens), similarity))
        limit = q if own else bisect_left(sizes, len(tokens) * 100 // similarity + 1)
        wanted = lambda i: links.find(i) != links.find(me)
        for i, common in divide_skip(lists, need, least, limit, wanted):
            if linked(common, len(tokens), sizes[i], similarity) and links.join(i, me):
                found.append((q, i))
    return found


def _sets(files: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, codes``: the whole sets of some nodes, read again from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, codes = [], []
            for node, value in zip(batch.column("node").to_pylist(), batch.column("text")):
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    codes.append(shingles(value.as_py() or "").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(codes, pa.binary())], names=["node", "codes"])

    texts = rows.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.min("digest").alias("digest"))
    keyed = files.select(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    # Copies of a text meet in one task, which makes their set once.
    return keyed.join(texts, "digest").select("node", "text").mapInArrow(run, "node long, codes binary").dropDuplicates(["node"])


def _shared(tokens: DataFrame, similarity: int) -> DataFrame:
    """The rows (``token, node, n``) that more than one node has, of nodes that have enough of
    them to link at all. Least and greatest node per token are combined before the exchange."""
    held = tokens.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    lists = stored(tokens.join(held.select("token"), "token", "left_semi").distinct(), "lists")
    smallest = F.ceil(F.col("n") * similarity / 100)
    able = lists.groupBy("node", "n").agg(F.count("*").alias("met")).filter(
        F.col("met") >= F.greatest(F.floor(smallest / EARLY), F.lit(1)))
    return stored(lists.join(able.select("node"), "node", "left_semi"), "lists")


def frequency_levels(sets: DataFrame) -> np.ndarray:
    """A level per bucket of shingle codes: quarters of log2 of how often the bucket occurs in
    ``sets``. The driver receives at most ``BUCKETS`` sums, however many shingles there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in batch.column("codes").slice(begin, ROWS)]
                total += np.bincount(np.concatenate(part) % BUCKETS, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    levels = np.zeros(BUCKETS, dtype=np.uint8)
    sums = sets.select("codes").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in sums.toLocalIterator():
        levels[bucket] = min(255, int(4 * log2(n + 1)))
    return levels


def rare_tokens(sets: DataFrame, levels: np.ndarray, similarity: int) -> DataFrame:
    """Leading shingles (``token, node, n``) in the order of (level, code): seldom ones first, so
    that passages which many files quote come last and lead no set that has enough of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part, lead, sizes = batch.slice(begin, ROWS), [], []
                for value in part.column("codes"):
                    codes = np.frombuffer(value.as_py(), dtype=np.uint64)
                    # Codes come sorted, so a stable sort by level alone keeps them in order.
                    order = np.argsort(levels[codes % BUCKETS], kind="stable")[: leading(len(codes), similarity)]
                    lead.append(codes[order])
                    sizes.append(len(codes))
                yield _listing(part.column("node").to_pylist(), sizes, lead)

    return sets.select("node", "codes").mapInArrow(run, "token long, node long, n int")


def _size_class(n: Column) -> Column:
    """Sizes whose ratio is at most 1.25 lie in the same class or in neighbouring ones."""
    return F.floor(F.log(n) / F.log(F.lit(1.3))).cast("int")


def _parts(lists: DataFrame) -> DataFrame:
    """``node, home, part, parts``: nodes that share leading shingles, and are of one size class,
    mostly get one home (the least node met in their lists), dealt into parts of bounded size."""
    classed = lists.withColumn("size_class", _size_class(F.col("n")))
    lead = classed.groupBy("token", "size_class").agg(F.min("node").alias("lead"))
    homes = classed.join(lead, ["token", "size_class"]).groupBy("node", "n").agg(F.min("lead").alias("home"))
    sizes = homes.groupBy("home").agg(F.count("*").alias("files"), F.sum("n").alias("tokens")).select(
        "home", F.ceil(F.greatest(F.col("files") / PART_FILES, F.col("tokens") / PART_TOKENS)).cast("int").alias("parts"))
    return homes.join(sizes, "home").select(
        "node", "home", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int").alias("part"), "parts")


def _search_inside(placed: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links found inside each part."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        codes = [np.frombuffer(c, dtype=np.uint64) for c in part["codes"]]
        nodes = part["node"].tolist()
        order = sorted(range(len(codes)), key=lambda i: (len(codes[i]), nodes[i]))
        found = search_part([codes[i] for i in order], [nodes[i] for i in order], None, None, similarity)
        return pd.DataFrame([(nodes[order[a]], nodes[order[b]]) for a, b in found], columns=["a", "b"], dtype="int64")

    many = placed.groupBy("home", "part").count().filter("count > 1").select("home", "part")
    members = placed.join(many, ["home", "part"], "left_semi").join(sets, "node").select("home", "part", "node", "codes")
    return members.groupBy("home", "part").applyInPandas(run, "a long, b long")


def _search_across(lists: DataFrame, placed: DataFrame, labels: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links between parts, searched only where a node's shingles meet another component.

    A node is sent to a later part when enough of its leading shingles stand in lists of that
    part's nodes, which are of its size class or a neighbouring one, and not all of those are of
    its own component.
    """
    known = placed.join(labels, "node", "left").select("node", "home", "part", F.coalesce("label", "node").alias("label"))
    rows = lists.join(known, "node")
    mixed = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token")
    rows = rows.join(mixed, "token", "left_semi").withColumn("size_class", _size_class(F.col("n")))
    rows = stored(rows, "mixed")
    there = rows.groupBy("token", "size_class", "home", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    own = F.col("size_class")
    r, t = rows.withColumn("size_class", F.explode(F.array(own - 1, own, own + 1))).alias("r"), there.alias("t")
    later = (F.col("r.home") < F.col("t.home")) | ((F.col("r.home") == F.col("t.home")) & (F.col("r.part") < F.col("t.part")))
    other = (F.col("lo") != F.col("label")) | (F.col("hi") != F.col("label"))
    smallest = F.ceil(F.col("n") * similarity / 100)
    routes = (
        r.join(t, (F.col("r.token") == F.col("t.token")) & (F.col("r.size_class") == F.col("t.size_class")) & later & other)
        .groupBy("r.node", "r.label", "r.n", "t.home", "t.part").agg(F.count("*").alias("met"))
        .filter(F.col("met") >= F.greatest(F.floor(smallest / EARLY), F.lit(1)))
    )
    routes = stored(routes.select("node", "label", "home", "part"), "routes")
    chunks = routes.groupBy("home", "part").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("chunks"))
    members = known.join(chunks, ["home", "part"]).select(
        "home", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("asks"), "node", "label")
    asking = routes.join(chunks, ["home", "part"]).select(
        "home", "part", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("asks"), "node", "label")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        codes = [np.frombuffer(c, dtype=np.uint64) for c in part["codes"]]
        nodes, label, asks = part["node"].tolist(), part["label"].tolist(), part["asks"].tolist()
        order = sorted(range(len(codes)), key=lambda i: (len(codes[i]), nodes[i]))
        own, queries = [i for i in order if not asks[i]], [i for i in order if asks[i]]
        found = search_part([codes[i] for i in own], [label[i] for i in own],
                            [codes[i] for i in queries], [label[i] for i in queries], similarity)
        return pd.DataFrame([(nodes[queries[a]], nodes[own[b]]) for a, b in found], columns=["a", "b"], dtype="int64")

    both = members.unionByName(asking).join(sets, "node").select("home", "part", "chunk", "asks", "node", "label", "codes")
    return both.groupBy("home", "part", "chunk").applyInPandas(run, "a long, b long")


def find_links(files: DataFrame, similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Stored ``rows`` (``file_id, digest, node, n``) and ``links`` (``a, b``) between nodes that
    connect exactly what all links connect.

    1. Leading shingles: two linked sets share ``early`` of them, in any one order. In code order,
       tokens that only one node has and nodes with too few shared ones drop out. For the others
       the whole sets are read again and put into a seldom-first order, from which the lists are
       made: what many files quote is then in few lists.
    2. Nodes that share leading shingles meet in parts of bounded size, where DivideSkip
       searches. A home of several parts (a large group of near copies) is searched again with
       one node of each component found, until one part holds what is left.
    3. Nodes are sent to other parts only where their lists hold another component.
    """
    rows = stored(scan(files, similarity), "sets")
    suspects = _shared(leading_tokens(rows), similarity)
    rows = rows.drop("lead")
    sets = stored(_sets(files, rows, suspects.select("node").distinct()), "codes")
    lists = _shared(rare_tokens(sets, frequency_levels(sets), similarity), similarity)
    placed = stored(_parts(lists), "parts")
    links = stored(_search_inside(placed, sets, similarity), "links")
    labels = components(links)
    split = placed.filter("parts > 1")
    while split.limit(1).count():
        heads = split.join(labels, "node", "left").filter("label is null or label = node").select("node")
        again = stored(_parts(lists.join(heads, "node", "left_semi")), "parts")
        more = stored(_search_inside(again, sets, similarity), "links")
        if more.limit(1).count() == 0:
            break
        links = links.unionByName(more)
        labels = components(links)
        split = again.filter("parts > 1")
    across = stored(_search_across(lists, placed, labels, sets, similarity), "links")
    return rows, links.unionByName(across)


def group_similar(files: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Groups of files whose texts share their word 5-grams: ``file_id, n_shingles, component_id``.

    ``files`` has ``file_id, text``. Words are separated by ASCII white space, A-Z lower-cased.
    A text's set holds its distinct shingles of five words (all words as one where there are
    fewer). Two files link when 100 * common >= ``similarity`` * union; ``component_id`` is the
    least ``file_id`` reachable by links. Files without words have an empty set and link with
    none. Null text is empty. Rows are reported one by one; rows with the same set are always
    together, whatever their ids; null ids are never a component's id unless it has no other;
    an empty table gives an empty result; other columns are not read.

    See :func:`find_links` for the search. Sets are compared by 64-bit codes.
    """
    rows, links = find_links(files, similarity)
    labels = components(links)
    least = rows.filter("node is not null").groupBy("node").agg(F.min("file_id").alias("least"))
    known = least.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    of_label = known.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = known.join(of_label, "label").select("node", "component_id")
    joined = rows.join(of_node, "node", "left")
    return joined.select(
        "file_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("file_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(
    files: DataFrame, similarity: int = SIMILARITY, file_id: str = "file_id", text: str = "text"
) -> DataFrame:
    """One file of each group of similar ones: the one with the least id (null last, then the
    least text digest). Files without words belong to no group and all stay. All columns pass
    through unchanged, whatever their names."""
    rows, links = find_links(files.select(F.col(file_id).alias("file_id"), F.col(text).alias("text")), similarity)
    labels = components(links)
    named = rows.filter("node is not null").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = named.groupBy("label").agg(
        F.min(F.struct(F.col("file_id").isNull().alias("none"), F.col("file_id").alias("file_id"), F.col("digest").alias("digest"))).alias("f"))
    key = lambda name, digest: F.concat_ws(":", F.coalesce(name.cast("string"), F.lit("none")), digest)
    chosen = first.select(key(F.col("f.file_id"), F.col("f.digest")).alias("key"))
    keyed = files.select(
        F.struct(*[F.col(f"`{c}`") for c in files.columns]).alias("row"), (n_words(F.col(text)) == 0).alias("empty"),
        key(F.col(file_id), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("key"),
    )
    # Rows equal in id and text have one key; one of them stays.
    kept = keyed.filter("not empty").join(chosen, "key", "left_semi").dropDuplicates(["key"])
    return kept.select("row.*").unionByName(keyed.filter("empty").select("row.*"))
