"""Personal data, folder rules, token counts, repeated lines and quality on small tables."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pageflow.llm import host_rules, line_quality, personal_data, repeated_lines, token_counts
from pageflow.llm.queries import tokenizer_path
from pageflow.llm.scratch import scratch_path
from tests.llm.conftest import files

ODD = [(1, "a", None), (1, "a", None), (None, None, ""), (2, "a", " \n\t "), (3, None, "plain words here"), (3, None, "plain words here")]


# ---- personal data ---------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    """The patterns as they are stated."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [c for c in m[0] if c in "0123456789"]
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and personal_data.luhn("".join(digits)), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PLAIN).index(s[2])))


def test_spans_equal_the_stated_patterns(rnd):
    pieces = ["a.b@c.de", "x@y", "@", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
              "+1 (456) 555-2186", "+12", "+", " ", "\n", "é", "𝒳", "-", ".", "7", "12345678901234567890", "word"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 9)))
        assert personal_data.base_spans(text) == plain_spans(text), text


def test_long_runs_take_no_square_time():
    text = "a" * 400_000 + " " + "1" * 400_000 + " " + "1.2." * 100_000 + "@x.y"
    assert len(personal_data.base_spans(text)) >= 1


def test_terms_that_give_a_value_away(spark):
    mail = "ann.lee@example.org"
    told = [(i, "f", f"The {w} on paper. Ask Wintergreen about {w}s, write {mail} or wait {w}y today.")
            for i, w in enumerate("red blue green grey pink teal gold cyan lime navy plum rust sand jade".split())]
    other = [(100 + i, "f", f"The paper about item {i} is on the table, ask or write or wait today.") for i in range(60)]
    quiet = [(200, "f", "Only wintergreen, no address."), (201, "f", None)]
    table = files(spark, told + other + quiet)
    found = personal_data.find_private_spans(table).cache()
    spans = {r.file_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}
    assert [k for k, *_ in spans[0]] == ["term", "email"]
    assert spans[200] == [("term", 5, 16)] and spans[201] == [] and spans[100] == []
    clean = {r.file_id: r.text for r in personal_data.sanitise_files(table, found).collect()}
    assert clean[200] == "Only , no address." and clean[201] is None and "[email]" in clean[0] and "Wintergreen" not in clean[0]


def test_one_value_in_copies_of_a_text_gives_no_terms(spark):
    copies = [(i, "f", "Rare zorbik word, write ann@example.org now.") for i in range(40)]
    rows = personal_data.find_private_spans(files(spark, copies)).collect()
    assert all([s.kind for s in r.spans] == ["email"] for r in rows)


def test_two_surroundings_are_enough_where_chance_is_not(spark):
    told = [(1, "f", "Mornings the baker Wintergreen answers, write ann.lee@example.org before noon."),
            (2, "f", "Lost keys: Wintergreen has them; ann.lee@example.org is read every evening.")]
    # Two mentions beside one word are one meeting, and a word in many files says nothing.
    beside = [(3, "f", "Some table ann@example.net zorbik ann@example.net with chairs.")]
    often = [(4, "f", "Green paper of bob@example.net is here."), (5, "f", "Blue paper was bob@example.net there.")]
    other = [(100 + i, "f", f"The paper about item {i} is on the table, ask or write or wait today.") for i in range(400)]
    table = files(spark, told + beside + often + other)
    found = {r.file_id: [(s.kind, s.start, s.end) for s in r.spans] for r in personal_data.find_private_spans(table).collect()}
    assert found[1][0] == ("term", 19, 30) and [k for i in (1, 2) for k, *_ in found[i]] == ["term", "email"] * 2
    assert [k for i in (3, 4, 5) for k, *_ in found[i]] == ["email"] * 4 and found[100] == []


def test_personal_data_of_odd_rows(spark):
    rows = personal_data.find_private_spans(files(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(r.base == [] and r.spans == [] for r in rows)
    assert personal_data.find_private_spans(files(spark, ODD).limit(0)).count() == 0


# ---- folder rules ----------------------------------------------------------------------

def test_repeated_words_equal_counting(rnd):
    for _ in range(300):
        words = [rnd.choice("abc") for _ in range(rnd.randrange(0, 40))]
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 8)}
        assert host_rules.repeated_words(words) == len(covered)


def test_a_bad_folder_takes_its_good_files_along(spark):
    good = " ".join(f"word{i}" for i in range(40))
    bad = good.replace("1", "#$")
    rows = [(i, "bad", bad if i % 10 else good) for i in range(50)] + [(100 + i, "good", good) for i in range(50)]
    rows += [(200, "good", "too short"), (201, None, good)]
    got = {r.file_id: r for r in host_rules.judge_files(files(spark, rows)).collect()}
    assert not got[0].base_failed and not got[0].kept and got[100].kept and got[201].kept
    assert got[200].base_failed and not got[200].kept
    assert got[1].n_symbols == bad.count("#") + bad.count("$")
    # A folder of one text is drawn to what all folders show.
    rates = host_rules.folder_rates(host_rules.measure_texts(files(spark, rows)))
    one = rates.filter("folder is null and rule = 'symbols'").first()
    assert 0 < one.rate < 0.5


def test_chance_between_folders_is_no_difference(spark):
    """Folders of few texts vary by chance; alike ones share one rate, and one-text folders say nothing."""
    good, bad = " ".join(f"word{i}" for i in range(40)), "too short"
    rows = [(i, f"f{i // 4}", bad if i % 4 == 0 else good) for i in range(40)] + [(100 + i, f"one{i}", bad if i == 0 else good) for i in range(30)]
    rates = host_rules.folder_rates(host_rules.measure_texts(files(spark, rows))).filter("rule = 'short'").collect()
    assert {round(r.rate, 12) for r in rates} == {round(11 / 70, 12)}


def test_rules_of_odd_rows(spark):
    rows = host_rules.judge_files(files(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(r.base_failed and not r.kept for r in rows)
    assert sorted(r.n_words for r in rows) == [0, 0, 0, 0, 3, 3]
    assert host_rules.judge_files(files(spark, ODD).limit(0)).count() == 0


# ---- token counts ----------------------------------------------------------------------

@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_come_from_the_library_and_then_from_the_cache(spark, name, monkeypatch):
    path = tokenizer_path(name)
    texts = ["hello world", "", None, "hello world", "<s> </s> <|endoftext|>", "ünï cödé 𝒳\n\n  x", "long " * 3000]
    table = files(spark, [(i, "f", t) for i, t in enumerate(texts)] + [(None, "f", "hello world"), (1, "f", "again")])
    cache = scratch_path(spark, "cache")
    got = sorted(((r.file_id is None, r.file_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(table, path, cache, 1000).collect()), key=str)
    count = token_counts.load_tokenizer(path)
    want = [(t or "") for t in [*texts, "hello world", "again"]]
    ids = [*range(len(texts)), None, 1]
    assert got == sorted(((i is None, i, len(t.encode()), n, n > 1000) for i, t, n in zip(ids, want, count(want))), key=str)
    stored = token_counts.read_cache(spark, cache)
    assert stored.count() == len(set(want)) == stored.select("content").distinct().count()
    # A second run encodes only what is new; another tokenizer version shares nothing.
    more = table.unionByName(files(spark, [(50, "f", "something new")]))
    monkeypatch.setattr(token_counts, "load_tokenizer", lambda p: lambda x: [7 if t == "something new" else 1 / 0 for t in x])
    assert token_counts.count_tokens(more, path, cache).filter("file_id = 50").first().n_tokens == 7
    assert token_counts.read_cache(spark, cache).count() == len(set(want)) + 1
    assert token_counts.count_tokens(table.limit(0), path, cache).count() == 0


# ---- repeated lines --------------------------------------------------------------------

def plain_lines(rows, ratio, least):
    texts = {}
    for _, folder, text in rows:
        texts.setdefault(folder, []).append(text)
    keys = lambda t: {x.strip(" \t\r\x0b\x0c") for x in (t or "").split("\n")} - {""}
    bad = {f: {k for t in ts for k in keys(t) if len(ts) >= least and sum(k in keys(u) for u in ts) > ratio * len(ts)} for f, ts in texts.items()}
    out = []
    for i, folder, text in rows:
        kept = None if text is None else [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c") not in bad[folder]]
        out.append((i, None if kept is None else "\n".join(kept), 0 if kept is None else text.count("\n") + 1 - len(kept)))
    return sorted(out, key=str)


def test_site_lines_equal_counting(spark, rnd):
    rows = []
    for i in range(400):
        folder = rnd.choice(["a", "b", None])
        body = [f"line {rnd.randrange(10_000)}" for _ in range(rnd.randrange(0, 6))] + rnd.sample(["", " head ", "foot", "rare", "x"], rnd.randrange(0, 4))
        rnd.shuffle(body)
        rows.append((i, folder, None if i % 50 == 0 else "\n".join(body)))
    rows += rows[:20] + [(9000, "small", "head"), (9001, "small", "head")]
    got = repeated_lines.drop_site_lines(files(spark, rows), max_ratio=0.3, min_pages=5)
    assert got.columns == [*files(spark, rows).columns, "lines_dropped"]
    assert sorted(((r.file_id, r.text, r.lines_dropped) for r in got.collect()), key=str) == plain_lines(rows, 0.3, 5)
    assert repeated_lines.drop_site_lines(files(spark, rows).limit(0)).count() == 0


def test_a_small_folder_is_judged_at_the_defaults(spark):
    rows = [(i, "small", f"head\nbody {i}" + ("\ntwice" if i < 2 else "")) for i in range(10)]
    rows += [(20 + i, "tiny", "head\nown") for i in range(2)] + [(30, None, "head")]
    got = {r.file_id: (r.text, r.lines_dropped) for r in repeated_lines.drop_site_lines(files(spark, rows)).collect()}
    assert got == {i: (t if i >= 20 else t[5:], int(i < 20)) for i, _, t in rows}


def test_site_lines_run_no_python(spark):
    plan = repeated_lines.drop_site_lines(files(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# ---- quality ---------------------------------------------------------------------------

def test_marginals_equal_listing_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    x, owners = rng.normal(size=(9, 3)), np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    chain = line_quality.Chain(rng.normal(size=3), rng.normal(size=(2, 2)))
    good, moves, log_sum = chain.marginals(x, owners, pairs=True)
    want, want_moves, want_log = [], np.zeros((2, 2)), 0.0
    for o in range(3):
        part = x[owners == o]
        weights = {}
        for path in itertools.product((0, 1), repeat=len(part)):
            s = sum(p * (f @ chain.weights) for p, f in zip(path, part)) + sum(chain.moves[a, b] for a, b in zip(path, path[1:]))
            weights[path] = np.exp(s)
        total = sum(weights.values())
        want_log += np.log(total)
        want += [sum(w for p, w in weights.items() if p[i]) / total for i in range(len(part))]
        for p, w in weights.items():
            for a, b in zip(p, p[1:]):
                want_moves[a, b] += w / total
    assert np.allclose(good, want) and np.allclose(moves, want_moves) and np.isclose(log_sum, want_log)


def test_quality_is_learned_and_held_out(spark, rnd):
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    fine = lambda: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(rnd.randrange(1, 6)))
    junk = lambda: "\n".join("!! ".join(word().upper() for _ in range(12)) for _ in range(rnd.randrange(1, 6)))
    rows = [(i, "f", fine() if i % 3 else junk()) for i in range(300)]
    table = files(spark, rows + [(1000, "f", None), (1001, "f", "  \n"), (None, "f", fine()), (5, "f", junk())])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "z") for i in range(300)] + [(None, 1, "z"), (7, None, "z"), (8, 9, "z")], "file_id long, quality int, text string")
    got = line_quality.judge_quality(table, labels)
    assert got.columns == [*table.columns, "held_out", "score", "predicted"]
    judged = {r.file_id: r for r in got.collect() if r.n == 1 and r.file_id != 5}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in judged.items() if i is not None)
    held = [r for i, r in judged.items() if i is not None and i < 300 and r.held_out]
    assert sum(r.predicted == int(r.file_id % 3 > 0) for r in held) >= 0.95 * len(held) and len(held) > 40
    assert judged[1000].score == 0 and judged[1001].score == 0 and judged[None].predicted == 1
    none = spark.createDataFrame([], "file_id long, quality int")
    assert {r.score for r in line_quality.judge_quality(table.limit(3), none).collect()} == {0.5}
    assert line_quality.judge_quality(table.limit(0), labels).count() == 0


def test_training_takes_whole_texts(spark):
    import numpy as np

    # Only what stands after 250 equal lines tells good from bad.
    body = ["the same words stand on every line of it"] * 250
    rows = [(i, "f", "\n".join(body + (["ONE!! TWO!! THREE!!"] * 20 if i % 2 else ["A quiet ending, as it should be."] * 20))) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "file_id long, quality int")
    chain = line_quality.train(files(spark, rows), labels)
    score = {r.file_id: r.score for r in line_quality.score_files(files(spark, [(1, "f", "ONE!! TWO!! THREE!!"), (2, "f", "A quiet ending, as it should be.")]), chain).collect()}
    assert score[2] > score[1] + 0.3
    # The bound takes whole texts in order of their draw, and passes a text over that never fits.
    sizes = [(0, 3, "c", 1), (0, 1, "a", 4), (0, 2, "b", 3), (0, 0, "huge", 50), (1, 1, "d", 5), (1, 2, "e", 1)]
    assert line_quality.within_lines(sizes, 12) == {"a", "d", "e"}
    assert np.allclose(line_quality.train(files(spark, rows), labels, max_lines=100).weights, 0)


def test_scores_ignore_everything_but_the_text(spark):
    chain = line_quality.Chain(__import__("numpy").linspace(-1, 1, line_quality.WIDTH), __import__("numpy").zeros((2, 2)))
    rows = [(1, "a", "one text\nof two lines"), (99, None, "one text\nof two lines")]
    a, b = line_quality.score_files(files(spark, rows), chain).collect()
    assert a.score == b.score and 0 <= a.score <= 1


def test_digest_is_of_the_whole_span_list():
    text = ",".join(f"{k}:{s}:{e}" for s, e, k in personal_data.base_spans("a@b.cd 1.2.3.4"))
    assert text == "email:0:6,ip:7:14" and len(hashlib.sha256(text.encode()).hexdigest()) == 64


def test_terms_of_scripts_without_upper_case():
    from pageflow.llm.personal_data import term_of

    assert [term_of(w) for w in ("\u7530\u4e2d", "\uae40\ubbfc\uc218,", "\u0645\u062d\u0645\u062f", "Anna", "ab", "\u7530", "12-34", "007", "a@b.c", "NATO")] == [
        "\u7530\u4e2d", "\uae40\ubbfc\uc218", "\u0645\u062d\u0645\u062f", "anna", None, None, None, None, None, "nato"]


def test_small_folders_are_judged_at_the_defaults(spark):
    """The registered query's own settings, on folders of three to ten texts."""
    from pageflow.llm import repeated_lines

    rows = [(i, "a", f"Header\nown {i}") for i in range(3)] + [(10 + i, "b", f"Twice\nown {i}" if i < 2 else f"own {i}") for i in range(10)]
    got = {r.file_id: r.lines_dropped for r in repeated_lines.drop_site_lines(files(spark, rows)).collect()}
    assert [got[i] for i in range(3)] == [1, 1, 1] and all(got[10 + i] == 0 for i in range(10))
