"""Operators 11 to 13 against brute force."""

import datetime as dt
import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from lakeloom.llm import bwtmerge, queries, timeparts, turns

SF = "/root/testdata/sf0.001"
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


# ---- 11


def cheapest(rows):
    """(initial, must go, truncated) of each row: the least cost, then the least audit, by a queue ordered by both."""
    queue, seen = [(0, "", 0, 0)], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if i == len(rows) and state in (0, 3):
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        follow = 3 if state == 2 else 2
        heapq.heappush(queue, (cost + 5, audit + "I", i, follow))
        if i < len(rows):
            initial, must_go, cut = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state))
            if not must_go:
                if initial == {2: "u", 3: "a"}[follow]:
                    heapq.heappush(queue, (cost + 5 * cut, audit + "K", i + 1, follow))
                if initial == "s" and state == 0:
                    heapq.heappush(queue, (cost + 5 * cut, audit + "K", i + 1, 1))
                heapq.heappush(queue, (cost + 1 + 5 * cut, audit + "R", i + 1, follow))


def repaired(table):
    convs, out = defaultdict(list), {}
    for conv, turn, role, text in table:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text, rows = " " if role is None else role, " " if text is None else text, convs[conv]
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        rows += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        at = [r[0] for r in rows if r[0] is not None]
        faults, seen, kinds = Counter(), set(), []
        for _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = cheapest(kinds)
        state, i, said = 0, 0, []
        for letter in audit:
            follow = 3 if state == 2 else 2
            name = "user" if follow == 2 else "assistant"
            if letter == "I":
                said.append(f"{name}:")
                state = follow
                continue
            if letter == "K":
                said.append(f"{rows[i][1]}:{rows[i][2]}")
                state = {"s": 1, "u": 2, "a": 3}[kinds[i][0]]
            elif letter == "R":
                said.append(f"{name}:{rows[i][2]}")
                state = follow
            i += 1
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
        out[conv] = (max(at) - min(at) + 1 - len(set(at)) if at else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def facts(frame):
    return {r.conv_id: tuple(r[c] for c in FACTS) for r in frame.collect()}


def test_repair_of_the_given_conversations(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    assert facts(queries.op11_conversation_repair(spark, SF)) == repaired(rows)


@pytest.mark.parametrize("bits", [17, 4])  # 4: conversations of many segments
def test_repair_of_odd_conversations(spark, tmp_path, monkeypatch, bits):
    rnd, rows = random.Random(5), []
    for conv in [None, *range(1, 30)]:
        for _ in range(900 if conv == 7 else rnd.choice([1, 3, 10, 60])):
            rows.append((conv, rnd.choice([None, *range(40)]), rnd.choice([None, "user", "assistant", "system", "tool", "", "assistant", "user"]), rnd.choice([None, "", " \t", "a.", "b", "c!", "word. ", "é?", f"x{rnd.random()}.", "long " * 5000])))
    rows += [(50, 1, "user", "same.")] * 300  # repeated rows
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as number", "2 as c", "3 as kind").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(turns, "SEGMENT_BITS", bits)
    assert facts(queries.op11_conversation_repair(spark, str(tmp_path))) == repaired(rows)


def test_repair_of_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_conversation_repair(spark, str(tmp_path)).count() == 0


def test_repaired_rows_are_well_formed(spark):
    from lakeloom.llm.common import Scratch

    damaged, _ = turns.damage(spark.read.parquet(f"{SF}/conversations.parquet"))
    by = defaultdict(list)
    for r in turns.repaired_rows(turns.repair_conversations(spark, damaged, Scratch(spark))).collect():
        by[r.conv_id].append((r.number, r.place, r.role))
    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(role[0] for *_, role in sorted(rows))) for rows in by.values())


# ---- 12


def test_merged_transforms_find_repeats():
    rnd = random.Random(1)
    for window in (2, 3, 5, 8, 13):
        for _ in range(40):
            runs = list(dict.fromkeys(bytes(rnd.choice(b"ab\x00\xff"[: rnd.choice([2, 4])]) for _ in range(rnd.randint(window, 3 * window))) for _ in range(rnd.randint(1, 9))))
            shards = rnd.randint(1, 4)
            groups = [g for k in range(shards) if (g := runs[k::shards])]
            made = [bwtmerge.transform(g) for g in groups]
            for g, (_, places, starts) in zip(groups, made, strict=True):
                rotations = [((x[i:] + x[:i]) * 40, at + i) for r, at in zip(g, starts.tolist(), strict=False) for x in [[c + 1 for c in r] + [0]] for i in range(len(x))]
                assert [p for _, p in sorted((r[:100], p) for r, p in rotations)] == places.tolist()
            counts = Counter(r[i : i + window] for r in runs for i in range(len(r) - window + 1))
            for g, marks in zip(groups, bwtmerge.repeated_windows([m[:2] for m in made], window), strict=True):
                assert marks.tolist() == [i + window <= len(r) and counts[r[i : i + window]] > 1 for r in g for i in range(len(r) + 1)]
            order, _, common = bwtmerge.merge([m[0] for m in made], window)
            suffixes = [r[i:] for g, (_, places, _) in zip(groups, made, strict=True) for rows in [[(r, i) for r in g for i in range(len(r) + 1)]] for r, i in [rows[p] for p in places.tolist()]]
            for before, at, seen in zip(order, order[1:], common[1:], strict=False):
                assert suffixes[before][:seen] == suffixes[at][:seen]


def cut(docs, window):
    starts = Counter(b[i : i + window] for _, t in docs for b in [(t or "").encode()] for i in range(len(b) - window + 1))
    out = Counter()
    for doc, text in docs:
        b = (text or "").encode()
        gone = {k for i in range(len(b) - window + 1) if starts[b[i : i + window]] > 1 for k in range(i, i + window)}
        out[doc, len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in gone)).hexdigest()] += 1
    return out


def test_byte_repeats_of_the_given_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert Counter(tuple(r) for r in queries.op12_suffix_array_dedup(spark, SF).collect()) == cut(docs, 200)


@pytest.mark.parametrize(("window", "gram", "limits"), [(20, 6, (2000, 1000)), (20, 6, (500, 1)), (33, 2, (3000, 60))])  # the latter two: every anchor's block is split
def test_byte_repeats_of_odd_documents(spark, window, gram, limits):
    rnd = random.Random(2)
    words = lambda n: " ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 4))) for _ in range(n))
    base = words(80)
    docs = [(None, None), (1, ""), (1, "x" * window), (2, "x" * (3 * window)), (3, "ab" * 50), (4, base), (4, base), (5, base[:60] + "!" + base[60:]), (6, words(20_000))]
    for i in range(50):
        a = rnd.randint(0, len(base) - 1)
        docs.append((10 + i, words(rnd.randint(0, 20)) + base[a : a + rnd.randint(0, 90)] + words(rnd.randint(0, 10))))
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h1", "2 as anchor", "3 as run").repartition(3)
    rows = bwtmerge.remove_repeats(spark, table, window, gram, limits=limits).collect()
    assert Counter(tuple(r)[:5] for r in rows) == cut(docs, window)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)


def test_byte_repeats_of_no_documents(spark):
    assert bwtmerge.remove_repeats(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_bucket_of_transforms_grows_with_their_number(spark, monkeypatch):
    from lakeloom.llm.common import Scratch

    rnd, saved, save = random.Random(3), {}, Scratch.save
    rows = [(b, 1000 * b + r, b, 1, bytearray(rnd.randbytes(rnd.choice([30, 90, 300])))) for b in range(400) for r in range(3)]
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, *options: saved.setdefault(name, save(self, df, name, *options)))
    runs = spark.createDataFrame(rows, "block long, run long, anchor long, copies long, data binary")
    bwtmerge._repeats(spark, runs, Scratch(spark), 20, 6, 1, (2000, 900)).collect()
    buckets, blocks = Counter(), Counter()
    for r in saved["transforms-1"].collect():
        buckets[r.bucket] += len(r.symbols) // 2 - len(r.run)
        blocks.update((b, r.bucket) for b in set(r.block))
    assert sum(buckets.values()) == sum(len(r[4]) for r in rows)  # nothing is left out
    assert max(buckets.values()) < 2900 and len({b for b, _ in blocks}) == len(blocks)  # a block is in one bucket


def test_pieces_of_split_runs_come_in_small_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bwtmerge, "PIECE", 4000)
    data = [random.Random(i).randbytes(60) for i in range(50)]
    numbers = pa.array(range(50), pa.int64())
    batch = pa.RecordBatch.from_pydict({"block": numbers, "run": numbers, "anchor": numbers, "data": pa.array(data, pa.binary())})
    made = list(bwtmerge._split(40, 6, 1)([batch]))
    sizes = [sum(len(x) for x in b.column("data").to_pylist()) for b in made]
    assert len(sizes) > 10 and max(sizes) < 4000 + 21 * 60
    whole = [(r["run"], r["at"] + i) for b in made for r in b.to_pylist() for i in range(len(r["data"]) - 39)]
    assert sorted(whole) == [(r, i) for r in range(50) for i in range(21)]


# ---- 13


def planned(rows, limit):
    """Rows (moment, arrival, id, ...) by leaf and part, from the top of the calendar down."""
    timed, out, names = sorted((r for r in rows if r[0] is not None), key=lambda r: r[:3]), {}, ("%Y", "%Y/%m", "%Y/%m/%d", "%Y/%m/%d/%H")

    def after(t, unit):
        if unit > 1:
            return t + dt.timedelta(hours=24 if unit == 2 else 1)
        return t.replace(year=t.year + 1) if unit == 0 else t.replace(year=t.year + t.month // 12, month=t.month % 12 + 1)

    def put(leaf, held):
        for i in range(0, len(held), limit):
            out[leaf, i // limit + 1] = held[i : i + limit]

    def visit(nodes, unit, held):
        run = None
        for a in [*nodes, None]:
            own = [r for r in held if a <= r[0] < after(a, unit)] if a else []
            if a and run and len(own) <= limit and len(run[2]) + len(own) <= limit:
                run = run[0], a, run[2] + own
                continue
            if run and run[2]:
                put(f"{run[0].strftime(names[unit])}-{run[1].strftime(names[unit]).split('/')[-1]}", run[2])
            run = (a, a, own) if a and (len(own) <= limit or unit == 3) else None
            if a and len(own) > limit:
                if unit == 3:
                    put(f"{a.strftime(names[3])}-{a:%H}", own)
                    run = None
                else:
                    children, t = [], a
                    while t < after(a, unit):
                        children.append(t)
                        t = after(t, unit + 1)
                    visit(children, unit + 1, own)

    if timed:
        visit([dt.datetime(y, 1, 1) for y in range(timed[0][0].year, timed[-1][0].year + 1)], 0, timed)
    put("null", sorted((r for r in rows if r[0] is None), key=lambda r: r[1:3]))
    return out


def moment(ts, click):
    k = zlib.crc32(str(click).encode()) % 128
    if ts is None or 16 <= k <= 111:
        return ts
    day = ts.replace(hour=0, minute=0, second=0, microsecond=0)
    return ts - dt.timedelta(days=(k + 6) ** 3) if k < 16 else day - dt.timedelta(days=day.weekday())


def test_time_layout_of_the_given_clicks(spark):
    got = queries.op13_adaptive_time_partitions(spark, SF).collect()
    table = pq.read_table(f"{SF}/clicks.parquet")
    rows = [(moment(r["ts"], r["click_id"]), r["arrived_at"], r["click_id"], tuple(r.values())) for r in table.to_pylist()]
    limit, early = 1 + len(rows) // 800, dt.datetime(2024, 4, 1)
    start, end = planned([r for r in rows if r[1] < early], limit), planned(rows, limit)
    stay = {k for k in end if k in start and Counter(r[3] for r in start[k]) == Counter(r[3] for r in end[k])}
    want = {k: (hashlib.sha256(",".join(str(r[2]) for r in held).encode()).hexdigest(), len(held), sum(r[1] >= early for r in held), k not in stay) for k, held in end.items()}
    assert {(r.leaf, r.part): (r.ids_sha256, r.n_rows, r.n_new, r.rewritten) for r in got} == want and 0 < len(stay) < len(want)
    assert {r["columns"] for r in got} == {",".join(table.column_names)}
    folder = Path(got[0].path.split("/leaf=")[0].removeprefix("file:"))
    assert {f"file:{p}" for p in folder.rglob("*.parquet")} == {r.path for r in got}
    for r in got[::100]:
        assert [x["click_id"] for x in pq.read_table(r.path.removeprefix("file:"), partitioning=None).to_pylist()] == [x[2] for x in end[r.leaf, r.part]]


def test_time_layout_with_clashing_names_repeats_and_no_rows(spark, tmp_path):
    rows = [(i, dt.datetime(2020 + i % 3, 1 + i % 12, 1 + i % 28, i % 24) if i % 5 else None, dt.datetime(2024, 1, 1), "x") for i in range(40)] + [(7, dt.datetime(2021, 5, 5, 5), None, None)] * 90
    table = spark.createDataFrame(rows, "id long, at timestamp_ntz, arrived timestamp_ntz, Leaf string").selectExpr("*", "1 as part", "2 as moment", "3 as tie", "4 as `odd name`").repartition(4)
    from pyspark.sql import functions as F

    layout = timeparts.TimeLayout(spark, f"file://{tmp_path}/layout", table.schema, F.col("at"), ("arrived", "id"), 8)
    for part in (table.limit(0), table.filter("id < 20"), table, table, table.filter("id > 5")):
        layout.lay_out(part)
        brute = planned([(r["at"], r["arrived"] or dt.datetime(1, 1, 1), r["id"]) for r in part.collect()], 8)
        assert {(r.leaf, r.part): r.ids_sha256 for r in layout.files("id", F.lit(True)).collect()} == {k: hashlib.sha256(",".join(str(r[2]) for r in held).encode()).hexdigest() for k, held in brute.items()}
    paths = {r.path for r in layout.files("id", F.lit(True)).collect()}
    layout.lay_out(table.filter("id > 5"))
    assert {r.path for r in layout.files("id", F.lit(True)).collect()} == paths  # nothing is written again


def test_a_merge_of_transforms_takes_few_bytes_a_suffix():
    import tracemalloc

    rng = np.random.default_rng(1)
    source = rng.integers(97, 101, 50_000, dtype=np.uint8).tobytes()
    made = [bwtmerge.transform([source[i : i + 350] for i in rng.integers(0, 49_000, 200)])[0] for _ in range(4)]
    tracemalloc.start()
    try:
        bwtmerge.merge(made, 200)
        assert tracemalloc.get_traced_memory()[1] < 64 * sum(map(len, made))  # 133 a suffix when its numbers took eight bytes each
    finally:
        tracemalloc.stop()
