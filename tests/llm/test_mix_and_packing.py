import zlib
from collections import Counter

import numpy as np
import pytest

from lakeloom.llm import mix, packing
from lakeloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, source string, size string"  # size clashes with a column of the result


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def fair_targets(sizes, weights, most):
    """Shares by repeated resharing, source by source."""
    total, held, free = sum(sizes.values()), {}, set(sizes)
    while free:
        rest = total - sum(held.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return held | share
        held |= {s: most * sizes[s] for s in over}
        free -= over
    return held


def test_targets_and_budgets(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), [None, "a", "b", "c", "d"][i % 5 if i % 3 else 1], "x") for i in range(300)] + [(1, None, "b", "y"), (2, "", "c", None)]
    got = mix.mix_sources(spark, docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    order = sorted(s for s in sizes if s is not None) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = fair_targets(sizes, weights, 3)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mix.mix_sources(spark, docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty_and_wordless_corpora(spark):
    assert mix.mix_sources(spark, docs(spark, [])).count() == 0
    got = mix.mix_sources(spark, docs(spark, [(None, None, None, None), (1, " \n", "a", "")])).collect()
    assert [r["taken"] for r in got] == [0, 0] and [r["target"] for r in got] == [0.0, 0.0]


def test_the_mix_itself_repeats_and_cuts(spark):
    rows = [(i, f"a{i} b{i}  c{i}", "big" if i < 90 else "small", "k") for i in range(100)]
    out = mix.mixed_documents(spark, docs(spark, rows)).collect()
    by = Counter(r["source"] for r in out for _ in r["text"].split())
    counted = {r["source"]: r["target"] for r in mix.mix_sources(spark, docs(spark, rows)).collect()}
    for s in by:
        assert abs(by[s] - counted[s]) <= 1
    assert out[0].asDict().keys() == {"doc_id", "text", "source", "size"}


def test_plan_is_valid_and_tight():
    rng = np.random.default_rng(3)
    for capacity, n in ((10, 50), (64, 400), (4096, 3000)):
        lengths = rng.integers(1, capacity + 1, n)
        histogram = dict(Counter(lengths.tolist()))
        plan, bins = packing.plan_bins(histogram, capacity)
        used, placed = {}, Counter()
        for length, a, b, first, each, at in plan:
            for rank in range(a, b):
                sequence, offset = first + (rank - a) // each, at + (rank - a) % each * length
                used.setdefault(sequence, []).append((offset, length))
            placed[length] += b - a
        assert dict(placed) == histogram and len(used) == bins
        for parts in used.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= capacity
        assert bins <= 1.23 * -(-int(lengths.sum()) // capacity) + 1
        assert len(plan) <= 3 * capacity * 12
    assert packing.plan_bins({}, 10) == ([], 0)


def test_pieces_are_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    texts = ["Hello  World's\tfoo\x0bbar", None, "", "x" * 50_000, "eé ß İstanbul 123 don't <|endoftext|> a<|startoftext|>b \u00a0 \u2003 z\x1fq", "word " * 9000, "word " * 4095]
    got = packing.pack_documents(spark, docs(spark, [(i, t, "s", "z") for i, t in enumerate(texts)]), tokenizer_path()).collect()
    tokenizer, rows = Tokenizer.from_file(tokenizer_path()), {}
    for r in got:
        rows[r["doc_id"], r["piece"]] = r
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = [ids[j : j + 4096] for j in range(0, len(ids), 4096)]
        for p, part in enumerate(pieces):
            r = rows.pop((i, p))
            assert r["ids"] == part and r["length"] == len(part) and r["start"] == 4096 * p
            assert r["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())
    assert not rows
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096


def test_packing_repeated_rows_and_nothing(spark):
    rows = [(7, "same text", "s", "z")] * 40
    got = packing.pack_documents(spark, docs(spark, rows), tokenizer_path(), with_ids=False).collect()
    assert len(got) == 40 and len({(r["sequence_id"], r["offset"]) for r in got}) == 40
    assert packing.pack_documents(spark, docs(spark, []), tokenizer_path(), with_ids=False).count() == 0


def test_plan_equals_plain_best_fit_decreasing():
    rng = np.random.default_rng(9)
    for capacity, n in ((10, 80), (50, 300), (97, 500)):
        lengths = rng.integers(1, capacity + 1, n).tolist()
        bins = []
        for length in sorted(lengths, reverse=True):
            fit = [b for b in bins if sum(b) + length <= capacity]
            if fit:
                max(fit, key=sum).append(length)
            else:
                bins.append([length])
        plan, count = packing.plan_bins(dict(Counter(lengths)), capacity)
        got = [[] for _ in range(count)]
        for length, a, b, first, each, _ in plan:
            for rank in range(a, b):
                got[first + (rank - a) // each].append(length)
        assert sorted(map(sum, got)) == sorted(map(sum, bins))  # which of two bins with the same room is taken makes no difference


def test_ids_do_not_depend_on_the_cache(monkeypatch):
    from tokenizers import Tokenizer

    from lakeloom.llm.common import find_words

    monkeypatch.setattr(packing, "SLOTS", 8)
    monkeypatch.setattr(packing, "POOL_IDS", 50)
    words, plain = packing.WordTokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    rng = np.random.default_rng(2)
    for _ in range(30):
        text = " ".join(f"wörd{rng.integers(0, 40)}" for _ in range(rng.integers(0, 60))) + " " + "long" * int(rng.integers(0, 200))
        raw = np.frombuffer(text.encode() + b"\n", np.uint8)
        ids, begins = words.ids(raw, *find_words(raw))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids and begins[-1] == len(ids)
        assert words.used <= 50 + 800
