"""Posteriors of hosts and paths against a plain computation."""

import math
import random
from collections import Counter

from keylode.llm import quality


def test_site_posteriors_against_plain_sums(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        source = rng.choice([None, "a", "b/x", "b/y", "c/z", f"rare{i}/p"])
        rows.append((i, f"text {i}", source))
        if rng.random() < 0.7:
            labels.append((i, int(rng.random() < {"a": 0.9, "b/x": 0.2, "b/y": 0.6}.get(source, 0.5))))
    docs = spark.createDataFrame([*rows, (None, None, "a")], "doc_id long, text string, source string")
    model = quality.Model(None, 0.25)
    got = {r["doc_id"]: r for r in quality.classify(docs, model, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}

    mark = dict(labels)
    path = {i: s or "" for i, _, s in rows}
    host = {i: p.split("/")[0] for i, p in path.items()}
    n, g, hn, hg = Counter(), Counter(), Counter(), Counter()
    for i, y in mark.items():
        n[path[i]] += 1
        g[path[i]] += y
        hn[host[i]] += 1
        hg[host[i]] += y
    total, rate = len(mark), (sum(mark.values()) + 1) / (len(mark) + 2)

    def weight(spread, groups, parents, squares):
        between = (spread - (groups - parents) * rate * (1 - rate)) / (total - squares / total)
        return rate * (1 - rate) / between if between > 0 else quality.MOST

    of_host = weight(sum(hn[h] * (hg[h] / hn[h] - rate) ** 2 for h in hn), len(hn), 1, sum(x * x for x in hn.values()))
    of_path = weight(sum(n[p] * (g[p] / n[p] - hg[p.split("/")[0]] / hn[p.split("/")[0]]) ** 2 for p in n), len(n), len(hn), sum(x * x for x in n.values()))
    odds = lambda p: math.log(p / (1 - p))
    for i in path:
        one, y = int(i in mark), mark.get(i, 0)
        above = (hg[host[i]] - y + of_host * rate) / (hn[host[i]] - one + of_host)
        own = (g[path[i]] - y + of_path * above) / (n[path[i]] - one + of_path)
        assert abs(got[i]["host_mean"] - above) < 1e-9 and abs(got[i]["path_mean"] - own) < 1e-9
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-(odds(0.25) + odds(own) - odds(rate))))) < 1e-9
    assert got[None]["score"] > got[next(i for i, p in path.items() if p == "b/x" and i not in mark)]["score"]
    assert sum(abs(r["host_mean"] - rate) < 0.1 for i, r in got.items() if i is not None and path[i].startswith("rare")) > 0


def test_sites_that_say_nothing_change_nothing(spark):
    docs = spark.createDataFrame([(i, "x", f"s{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i // 4 % 2) for i in range(400)], "doc_id long, quality int")
    rows = quality.classify(docs, quality.Model(None, 0.4), labels).collect()
    assert all(abs(r["score"] - 0.4) < 0.01 for r in rows)
    empty = labels.limit(0)
    assert all(abs(r["score"] - 0.4) < 1e-9 for r in quality.classify(docs, quality.Model(None, 0.4), empty).collect())
    assert quality.classify(docs.limit(0), quality.Model(None, 0.4), labels).count() == 0
