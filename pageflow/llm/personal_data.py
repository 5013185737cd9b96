"""Personal data: pattern spans, and terms that disclose them by corpus co-occurrence."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pageflow.llm.scratch import WORD, stored

# The kinds in report order, and their patterns.
KINDS = ["email", "ip", "card", "phone", "term"]
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SPAN = "struct<start:long,end:long,kind:string>"
NEAR_WORDS = 10
NEAR_CHARS = 200
MIN_CONTEXTS = 2
DISCLOSURE = 0.95
CHANCE = 0.05
FILTER_BITS = 1 << 20
COUNTED_TERMS = 100_000
CONTEXTS_AT_ONCE = 200_000
STRIP = " \t\r\n\x0b\x0c.,;:!?\"'()[]{}<>|*#$%&"


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` with a domain back over its local part, never into the match before: the
    leftmost matches, without trying every start of a long run."""
    floor = 0
    for m in EMAIL_DOMAIN.finditer(text):
        start = at = m.start()
        while start > floor and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            floor = m.end()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost matches of each kind that hold (address parts to 255, Luhn, digit counts),
    as (start, end, kind) in code points, by start and then kind."""
    found = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def code(value: str) -> int:
    """A 64-bit code of a string, as a signed number."""
    raw = value.encode("utf-8", "surrogatepass")
    number = zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1] + b"/")
    return number - (1 << 64) if number >> 63 else number


def term_of(word: str) -> str | None:
    """A word's term: lower case without outer marks; None for short words, numbers and identifiers.

    Words of scripts without upper case are terms from two characters on, others from three.
    """
    term = word.strip(STRIP).lower()
    if "@" in term or not any(map(str.isalpha, term)):
        return None
    return term if len(term) >= (3 if term.upper() != term else 2) else None


def contexts(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, list[str]]]:
    """For each span the codes of its value and of the words around it, and the terms among the
    words nearest to it.

    A word between two mentions of one value is told of the first only: it is met once. Only the
    words that a later span can still reach are remembered."""
    told: dict[int, set[int]] = {}
    recent: deque[tuple[int, int]] = deque()
    for start, end, kind in spans:
        from_here = start - NEAR_CHARS
        while recent and recent[0][0] < from_here:
            past = recent.popleft()[1]
            told[past] = {at for at in told.get(past, ()) if at >= from_here}
            if not told[past]:
                del told[past]
        before, after = text[max(0, start - NEAR_CHARS) : start], text[end : end + NEAR_CHARS]
        left = [(start - len(before) + m.start(), m[0]) for m in re.finditer(WORD, before)]
        right = [(end + m.start(), m[0]) for m in re.finditer(WORD, after)]
        # A word cut by the window, or one that runs into the value, is not a word.
        if start > NEAR_CHARS and left:
            left = left[1:]
        if end + NEAR_CHARS < len(text) and right:
            right = right[:-1]
        near = left[-NEAR_WORDS:] + right[:NEAR_WORDS]
        entity, context = code(f"{kind}:{text[start:end].lower()}"), code(" ".join(w for _, w in near))
        seen = told.setdefault(entity, set())
        terms = {t for t in (term_of(w) for at, w in near if at not in seen) if t}
        seen.update(at for at, _ in near)
        recent.append((end + NEAR_CHARS, entity))
        yield entity, context, sorted(terms)


class Rows:
    """Lists of rows (number, number, string), one list after another, as flat columns; strings
    as codes. Some 24 bytes a row."""

    def __init__(self):
        self.columns, self.words, self.ends = [array("q") for _ in range(3)], {}, [0]

    def add(self, first: int, second: int, word: str) -> None:
        for column, value in zip(self.columns, (first, second, self.words.setdefault(word, len(self.words)))):
            column.append(value)

    def close(self) -> None:
        self.ends.append(len(self))

    def __len__(self) -> int:
        return len(self.columns[0])

    def take(self, names: list[str]) -> pa.ListArray:
        """The lists closed so far; the next ones begin anew."""
        *numbers, words = [pa.array(np.array(c, dtype=np.int64)) for c in self.columns]
        flat = [*numbers, pa.array(list(self.words), pa.string()).take(words)]
        lists = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays(flat, names))
        self.__init__()
        return lists


def scan_files(files: DataFrame) -> DataFrame:
    """``file_id, digest, spans, contexts`` of every whole text; equal texts have equal digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, found, near = 0, Rows(), Rows()

            def part(last: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [batch.column("file_id")[first:last], batch.column("digest")[first:last],
                     found.take(["start", "end", "kind"]), near.take(["entity", "context", "term"])],
                    names=["file_id", "digest", "spans", "contexts"])

            for at, value in enumerate(batch.column("text"), 1):
                text = value.as_py() or ""
                spans = base_spans(text)
                for span in spans:
                    found.add(*span)
                for entity, context, terms in contexts(text, spans):
                    for term in terms:
                        near.add(entity, context, term)
                found.close()
                near.close()
                if len(near) + len(found) > CONTEXTS_AT_ONCE:
                    yield part(at)
                    first = at
            if first < len(batch):
                yield part(len(batch))

    columns = files.select("file_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    return columns.mapInArrow(
        run, f"file_id {dict(columns.dtypes)['file_id']}, digest string, spans array<{SPAN}>, "
             "contexts array<struct<entity:long,context:long,term:string>>")


def _bit(term: Column) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(FILTER_BITS)).cast("int")


def term_filter(terms: DataFrame) -> np.ndarray | None:
    """A bit per hash of the terms, None where there are none: 128 KB however many terms."""
    bits = [r[0] for r in terms.select(_bit(F.col("term")).alias("b")).distinct().toLocalIterator()]
    if not bits:
        return None
    marks = np.zeros(FILTER_BITS, dtype=bool)
    marks[bits] = True
    return np.packbits(marks)


def _passes(packed: np.ndarray):
    marks = memoryview(np.unpackbits(packed).tobytes())

    def passes(term: str | None) -> bool:
        return term is not None and marks[zlib.crc32(term.encode("utf-8", "surrogatepass")) % FILTER_BITS] == 1

    return passes


def count_terms(files: DataFrame, packed: np.ndarray) -> DataFrame:
    """``term, n``: number of files holding each term that passes the filter, partly summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, passes = re.compile(WORD).findall, _passes(packed)
        counts: Counter = Counter()

        def summed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])

        for batch in batches:
            for value in batch.column("text"):
                counts.update({t for t in map(term_of, set(find(value.as_py() or ""))) if passes(t)})
            if len(counts) > COUNTED_TERMS:
                yield summed()
                counts.clear()
        yield summed()

    return files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(files: DataFrame, scanned: DataFrame, min_contexts: int = MIN_CONTEXTS,
                     disclosure: float = DISCLOSURE, chance: float = CHANCE) -> DataFrame | None:
    """``term, information``: terms that give an entity away, from statistics of all files.

    An entity is a personal value. For term t near entity c, with counts of files,
    PMI(c; t) = log2(n(c,t) N / (n(c) n(t))) is what t says about c of its information
    content IC(c) = log2(N / n(c)). A term discloses where PMI >= ``disclosure`` * IC for some
    entity and the meeting is no accident. A pair must be met in ``min_contexts`` different
    surroundings (copies of one passage are one, and one passage shows nothing), and in more than
    chance explains: were t independent of c, the s surroundings of c would show it
    s n(t) / N times, and the Chernoff bound of meeting it as often as it was, times the number
    of pairs looked at, must not exceed ``chance``. ``information`` is the largest PMI / IC. None
    where no pair can pass, so that nothing more need be read.
    """
    near = scanned.select(F.explode("contexts").alias("x")).select("x.*")
    pairs = near.groupBy("entity", "term").agg(F.count_distinct("context").alias("met"))
    # A value may stand in a file several times: files are counted, not mentions. All counts are
    # made before they are joined, so no value's mentions meet in one task.
    held = scanned.select(F.explode(F.array_distinct("contexts.entity")).alias("entity"))
    n_entity = held.groupBy("entity").agg(F.count("*").alias("n_entity"))
    shown = near.groupBy("entity").agg(F.count_distinct("context").alias("shown"))
    per_file = scanned.select(F.explode(F.array_distinct(F.transform(
        "contexts", lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term"))))).alias("p")).select("p.*")
    n_pair = per_file.groupBy("entity", "term").agg(F.count("*").alias("n_pair"))
    beside = scanned.select(F.explode(F.array_distinct("contexts.term")).alias("term"))
    n_beside = beside.groupBy("term").agg(F.count("*").alias("n_beside"))
    total, looked_at = scanned.agg(F.count("*"), F.sum(F.size("contexts"))).first()

    def information(n: Column) -> Column:
        """PMI / IC if the term stands in ``n`` files, null where chance would do. Falls with n."""
        content = F.log2(F.lit(float(total)) / F.col("n_entity"))
        pmi = F.log2(F.col("n_pair") * float(total) / (F.col("n_entity").cast("double") * n))
        expected = F.col("shown") * n / float(total)
        log_tail = F.col("met") * (F.log(expected / F.col("met")) + 1) - expected
        sure = (F.col("met") > expected) & (log_tail <= math.log(chance / max(looked_at or 0, 1)))
        # An entity in every file carries no information that could be disclosed.
        return F.when((content > 0) & sure, pmi / content)

    # A term stands in at least the files that hold it beside a value: what fails already with
    # that number fails with the whole one, and needs no second reading.
    open_pairs = stored(
        pairs.filter(F.col("met") >= min_contexts).join(n_pair, ["entity", "term"]).join(n_entity, "entity")
        .join(shown, "entity").join(n_beside, "term").filter(information(F.col("n_beside")) >= disclosure), "pairs")
    packed = term_filter(open_pairs)
    if packed is None:
        return None
    return (
        open_pairs.join(count_terms(files, packed), "term").withColumn("information", information(F.col("n")))
        .filter(F.col("information") >= disclosure).groupBy("term").agg(F.max("information").alias("information"))
    )


def term_spans(files: DataFrame, terms: DataFrame, packed: np.ndarray) -> DataFrame:
    """``digest, found``: where each different text holds disclosing terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, pattern = _passes(packed), re.compile(WORD)
        for batch in batches:
            rows = []
            for digest, value in zip(batch.column("digest").to_pylist(), batch.column("text")):
                text = value.as_py() or ""
                wanted = {w for w in set(pattern.findall(text)) if passes(term_of(w))}
                if wanted:
                    for m in pattern.finditer(text):
                        if m[0] in wanted:
                            start = m.start() + len(m[0]) - len(m[0].lstrip(STRIP))
                            rows.append((digest, term_of(m[0]), start, start + len(m[0].strip(STRIP))))
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()),
                 pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                names=["digest", "term", "start", "end"])

    columns = files.select(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    hits = columns.mapInArrow(run, "digest string, term string, start long, end long").distinct()
    return hits.join(terms, "term").groupBy("digest").agg(
        F.collect_list(F.struct("start", "end", F.lit("term").alias("kind"))).alias("found"))


def find_private_spans(files: DataFrame, min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """Spans of personal data in every file's whole text: ``file_id, digest, base, spans``.

    ``files`` has ``file_id, text``. ``base`` holds the pattern matches (email, ip, card,
    phone), ``spans`` those and the terms that disclose a personal value (:func:`disclosing_terms`)
    where they do not overlap a match; both are arrays of ``start, end, kind`` in code points,
    end exclusive, by start and then kind. The terms hold for every file, also one without the
    value itself.

    Texts are read once for matches and their surroundings; only pairs that can still pass lead to a
    second reading (counts of their terms, through a hash filter of fixed size) and a third
    (where the terms stand). Equal texts are joined by digest. Texts of any length are read whole,
    and what a task gathers is passed on after ``CONTEXTS_AT_ONCE`` rows, at the end of a text.
    Null text is empty; rows are
    reported one by one, repeated ids included; an empty table gives an empty result; other
    columns are not read.
    """
    scanned = stored(scan_files(files), "spans")
    terms = disclosing_terms(files, scanned, min_contexts, disclosure)
    packed = None
    if terms is not None:
        terms = stored(terms, "terms")
        packed = term_filter(terms)
    base = scanned.select("file_id", "digest", F.col("spans").alias("base"))
    if packed is None:
        return base.withColumn("spans", F.col("base"))
    joined = base.join(term_spans(files, terms, packed), "digest", "left")
    apart = F.filter(
        F.coalesce("found", F.array().cast(f"array<{SPAN}>")),
        lambda t: ~F.exists(F.col("base"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
    )
    order = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(
        F.array_position(F.lit(KINDS), a["kind"]).cast("int") - F.array_position(F.lit(KINDS), b["kind"]).cast("int"))
    return joined.select("file_id", "digest", "base", F.array_sort(F.concat("base", apart), order).alias("spans"))


def sanitise_files(files: DataFrame, spans: DataFrame) -> DataFrame:
    """``files`` with ``text`` sanitised: values are generalised to their kind (``[email]``),
    disclosing terms are removed. ``spans`` is the result of :func:`find_private_spans` on
    these files. All columns stay; null text stays null; of overlapping spans the first wins."""
    unique = spans.filter(F.size("spans") > 0).groupBy("digest").agg(F.first("spans").alias("spans"))
    row = F.struct(*[F.col(f"`{c}`") for c in files.columns])
    keyed = files.select(row.alias("row"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    joined = keyed.join(unique, "digest", "left").select(F.col("row.text").alias("text"), "spans", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, found in zip(batch.column("text"), batch.column("spans")):
                text, parts, at = value.as_py(), [], 0
                for span in found.as_py() or []:
                    if span["start"] >= at:
                        parts += [text[at : span["start"]], "" if span["kind"] == "term" else f"[{span['kind']}]"]
                        at = span["end"]
                texts.append(text if text is None else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("row")], names=["clean", "row"])

    done = joined.mapInArrow(run, f"clean string, row {keyed.schema['row'].dataType.simpleString()}")
    return done.select(*[F.col("clean").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in files.columns])
