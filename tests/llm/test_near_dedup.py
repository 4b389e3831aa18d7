import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import near_dedup as N


def shingles(t, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return Counter([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def similarity(a, b):
    both = a.keys() & b.keys()
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in both)


def groups(docs, least=0.8):
    sets, up = {k: shingles(t) for k, t in docs.items()}, {k: k for k in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and sets[a].keys() & sets[b].keys() and similarity(sets[a], sets[b]) >= least:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def copies(seed, n, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_similarity_is_exact():
    rng = random.Random(2)
    for _ in range(40):
        a, b = (" ".join(rng.choice("abcd") for _ in range(rng.randint(6, 60))) for _ in "ab")
        mine = N.jaccard(N._weights(a.encode(), 5), N._weights(b.encode(), 5))
        assert mine == pytest.approx(similarity(shingles(a), shingles(b)), abs=1e-9)


def test_registers_estimate_the_similarity():
    rng = random.Random(4)
    for edits in (2, 6, 12):
        a, b = copies(rng.random(), 2, edits)
        sets = [N._weights(t.encode(), 5) for t in (a, b)]
        row = np.r_[np.zeros(len(sets[0][0]), int), np.ones(len(sets[1][0]), int)]
        r = N.registers(row, np.r_[sets[0][0], sets[1][0]], np.r_[sets[0][1], sets[1][1]], 2, 2000)
        assert (r[0] == r[1]).mean() == pytest.approx(N.jaccard(*sets), abs=0.06)


def test_against_brute_force(spark, make_docs, texts):
    docs = {**{i: t for i, t in texts.items() if len(t) < 4000}, **{10_000 + i: t for i, t in enumerate(copies(1, 40, 9) + copies(2, 25, 3))}}
    got = {r.doc_id: r.class_id for r in N.near_groups(make_docs(list(docs.items()))).collect()}
    want = groups(docs)
    assert sum(got[k] != want[k] for k in want) == 0


def test_edges(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(60))
    docs = make_docs([(1, long), (2, long + " more"), (3, long), (3, long), (4, None), (5, ""), (6, " \t"), (7, "a b"), (8, "a  b"), (9, "a c"), (None, long), (10, "x " * 30_000)]).withColumn("key", F.lit(0)).withColumn("class_id", F.lit("c"))
    got = {}
    for r in N.near_groups(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.class_id, r.class_size, r.kept))
    assert got[1] == {(1, 5, True)} and got[2] == got[3] == got[None] == {(1, 5, False)}
    assert got[4] == {(4, 1, True)} and got[5] == {(5, 1, True)} and got[6] == {(6, 1, True)}
    assert got[7] == {(7, 2, True)} and got[8] == {(7, 2, False)} and got[9] == {(9, 1, True)}
    kept = N.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 9, 10]
    assert N.near_groups(make_docs([])).count() == 0 and N.keep_first(make_docs([])).count() == 0
    assert [r.doc_id for r in N.keep_first(make_docs([(3, long), (3, long)])).collect()] == [3]
    assert N.keep_first(make_docs([(2, long), (2, long + " x"), (2, "other words"), (2, None), (2, None)])).count() == 3


def test_cells_of_a_mixed_bucket_lose_no_link(spark, make_docs, monkeypatch):
    """Blocks of four members: links between groups across cells are the same as in one cell."""
    monkeypatch.setattr(N, "CELL", 4)
    docs = dict(enumerate(copies(5, 60, 14)))
    got = {r.doc_id: r.class_id for r in N.near_groups(make_docs(list(docs.items())), bands=4, band=1).collect()}
    assert got == groups(docs)


def true_pairs(texts, least=0.8):
    """All pairs of ids whose similarity is ``least`` or more, over one inverted index of all shingles; documents of
    equal shingles are compared once and linked in a row."""
    first, same, sets = {}, [], {}
    for i, t in texts.items():
        h, w = N._weights((t or "").encode(), 5)
        if len(h):
            key = (h.tobytes(), w.tobytes())
            if key in first:
                same.append((first[key], i))
            else:
                first[key], sets[i] = i, (h, w)
    ids = list(sets)
    owner = np.repeat(np.arange(len(ids)), [len(sets[i][0]) for i in ids])
    order = np.argsort(every := np.concatenate([sets[i][0] for i in ids]), kind="stable")
    every, owner = every[order], owner[order]
    share = np.concatenate([sets[i][1] / sets[i][1].sum() for i in ids])[order]
    out = []
    for x, i in enumerate(ids):
        h, w = sets[i]
        lo, hi = np.searchsorted(every, h, "left"), np.searchsorted(every, h, "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        bound = np.minimum(np.bincount(owner[at], np.repeat(w / w.sum(), n), len(ids)), np.bincount(owner[at], share[at], len(ids)))
        out += [(i, ids[y]) for y in np.flatnonzero(bound >= least - 1e-9) if y > x and N.jaccard(sets[i], sets[ids[y]]) >= least]
    return out + same


def test_recall_of_all_true_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pairs = true_pairs({r.doc_id: r.text for r in docs.collect()})
    group = {r.doc_id: r.class_id for r in N.near_groups(docs).collect()}
    assert len(pairs) > 50 and sum(group[a] == group[b] for a, b in pairs) / len(pairs) >= 0.99


def joined(spark, run):
    """Rows that the joins of ``run`` make."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    executions = lambda: [store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())]
    bus.waitUntilEmpty()
    seen = set(executions())
    run()
    bus.waitUntilEmpty()
    total = 0
    for e in set(executions()) - seen:
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = [node.metrics().apply(i) for i in range(node.metrics().size())] if "Join" in node.name() else []
            ids = [m.accumulatorId() for m in metrics if m.name() == "number of output rows"]
            total += sum(int(values.apply(i).replace(",", "")) for i in ids if values.contains(i))
    return total


def test_components_read_few_edges_again(spark):
    """Of dense groups, a later round reads only the edges between what the earlier ones joined."""
    rng = random.Random(8)
    names = [rng.randbytes(16) for _ in range(700)]
    dense = [(g + rng.randrange(100), g + rng.randrange(100)) for g in (0, 100, 200) for _ in range(2500)]
    path = [(i, i + 1) for i in range(300, 499)] + [(500, i) for i in range(501, 600)] + [(600, 600), (601, 602), (602, 601)]
    want = {x: x for x in names}

    def top(x):
        while want[x] != x:
            x = want[x]
        return x

    for a, b in [*dense, *path]:
        a, b = top(names[a]), top(names[b])
        want[max(a, b)] = min(a, b)
    for some in (dense, dense + path, []):
        edges = spark.createDataFrame([(bytearray(names[a]), bytearray(names[b])) for a, b in some], "a binary, b binary")
        got = {}
        rows = joined(spark, lambda: got.update({bytes(r.key): bytes(r.root) for r in N.components(edges).collect()}))
        linked = {names[x] for pair in some for x in pair}
        assert {x: got.get(x, x) for x in linked} == {x: top(x) for x in linked}
        n = len({(min(p), max(p)) for p in some if p[0] != p[1]})
        assert some is not dense or rows <= 3 * n
