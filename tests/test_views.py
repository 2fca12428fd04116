"""Views kept by deltas equal the batch query after every batch, also where members fall and after a crash."""

import random
from collections import Counter

from lakeloom.streaming import views


def best(counts, k):
    groups = {}
    for (g, i), n in counts.items():
        if n:
            groups.setdefault(g, []).append((-n, i))
    return sorted((g, r, i, -n) for g, x in groups.items() for r, (n, i) in enumerate(sorted(x)[:k], 1))


def test_top_items_after_each_batch(spark, tmp_path):
    rnd, counts = random.Random(3), Counter()
    root = f"file://{tmp_path}/v"
    for number in range(5):
        rows = [(rnd.randrange(3), rnd.randrange(12), rnd.choice([1, 1, -1]) * rnd.choice([1, 5])) for _ in range(40)] + [(None, 1, 1), (1, None, 1)]
        if number == 3:  # the leaders fall far, one group empties
            rows += [(g, i, -n - (g == 0)) for (g, i), n in counts.items() if g == 2 or n > 3]
        frame = spark.createDataFrame(rows, "group long, item long, n long")
        for g, i, n in rows:
            if g is not None and i is not None:
                counts[g, i] += n
        view = views.TopView(spark, root, 3, buckets=4)  # as after a restart
        if number == 2:  # stopped between the two tables: the batch runs again
            view.tops.merge = lambda *a, **b: None
            view.refresh(frame, number)
            view = views.TopView(spark, root, 3, buckets=4)
        view.refresh(frame, number)
        view.refresh(frame, number)  # a batch that runs again changes nothing
        assert sorted(map(tuple, view.read().collect())) == best(counts, 3), number
    told = {r.batch: r for r in view.refreshes().collect()}
    assert len(told) == 5 and told[0].repaired == 0 and told[3].repaired > 0 and all(r.repair_rows <= 36 for r in told.values())
