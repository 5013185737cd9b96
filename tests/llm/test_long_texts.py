"""Very long texts: whole results in bounded memory."""

import random
import re
import tracemalloc

import numpy as np


from pageflow.llm import line_quality, personal_data
from pageflow.llm.scratch import WORD


def all_contexts(text, spans):
    """The contexts with every told word remembered for good."""
    told, out = {}, []
    for start, end, kind in spans:
        left = [(m.start(), m[0]) for m in re.finditer(WORD, text[:start])] if start else []
        window = max(0, start - personal_data.NEAR_CHARS)
        cut = [(max(at, window), w[max(0, window - at):]) for at, w in left if at + len(w) > window]
        cut = cut[1:] if start > personal_data.NEAR_CHARS else cut
        reach = text[end : end + personal_data.NEAR_CHARS]
        right = [(end + m.start(), m[0]) for m in re.finditer(WORD, reach)]
        right = right[:-1] if end + personal_data.NEAR_CHARS < len(text) else right
        near = cut[-personal_data.NEAR_WORDS :] + right[: personal_data.NEAR_WORDS]
        entity = personal_data.code(f"{kind}:{text[start:end].lower()}")
        seen = told.setdefault(entity, set())
        terms = sorted({t for t in (personal_data.term_of(w) for at, w in near if at not in seen) if t})
        seen.update(at for at, _ in near)
        out.append((entity, personal_data.code(" ".join(w for _, w in near)), terms))
    return out


def test_contexts_forget_only_what_no_later_value_reaches():
    rng = random.Random(4)
    words = ["ann@site.org", "bob@site.org", "10.0.0.1", "+44 20 7946 0958", "word", "other", "x" * 90, "Third,", "\n"]
    for _ in range(60):
        text = " ".join(rng.choices(words, k=rng.randrange(1, 120)))
        spans = personal_data.base_spans(text)
        assert list(personal_data.contexts(text, spans)) == all_contexts(text, spans)


def test_a_text_of_many_addresses_stays_small():
    text = " ".join(f"name{i % 997} user{i}@site{i % 50}.org" for i in range(20_000))
    spans = personal_data.base_spans(text)
    # The first array makes pyarrow import pandas, which is not to be counted.
    first = personal_data.Rows()
    first.close()
    first.take(["entity", "context", "term"])
    tracemalloc.start()
    rows = personal_data.Rows()
    for entity, context, terms in personal_data.contexts(text, spans):
        for term in terms:
            rows.add(entity, context, term)
    rows.close()
    held = rows.take(["entity", "context", "term"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(spans) == 20_000 and len(held) == 1 and len(held[0]) > 100_000
    assert peak < 20_000_000


def test_a_long_chain_in_slices_scores_like_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    table = line_quality.char_classes()
    chain = line_quality.Chain(rng.normal(size=line_quality.WIDTH), rng.normal(size=(2, 2)))
    lines = [["A quiet line, as it should be.", "BUY!! NOW | HERE", f"line {i}", "x"][i * i % 4] for i in range(1, 1500)]
    owners = np.zeros(len(lines), dtype=np.int64)
    features = line_quality.chain_features(lines, owners, table)
    good = chain.marginals(features, owners)
    assert np.allclose(chain.along(features @ chain.weights), good, atol=1e-12)
    weight = np.array([len(line) for line in lines])
    for size in (1, 7, 1499, 20_000):
        monkeypatch.setattr(line_quality, "SLICE_LINES", size)
        assert abs(line_quality.long_text_score(lines, chain, table) - weight @ good / weight.sum()) < 1e-12


def test_a_million_lines_are_scored_in_bounded_memory():
    import resource

    table = line_quality.char_classes()
    chain = line_quality.Chain(np.ones(line_quality.WIDTH) / 9, np.zeros((2, 2)))
    lines = ["a", "Some words here.", "b!"] * 333_334
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert 0 < line_quality.long_text_score(lines, chain, table) < 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # KB; whole features take 800 MB
