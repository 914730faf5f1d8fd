import random
import re

import numpy as np
import pytest

from segspark.llm import ngram_join as N
from segspark.llm._components import connected_components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    ids = {}
    for (d, _), x in zip(rows, label):
        ids.setdefault(x, []).append(d)
    least = {x: min((d for d in ds if d is not None), default=None) for x, ds in ids.items()}
    return sorted(((d, len(s), least[x]) for (d, _), s, x in zip(rows, sets, label)), key=repr)


def corpus(seed=1):
    """Unrelated texts, near copies with few and many edits, a family that is not all alike,
    exact copies, and a passage that many share."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    text = lambda n: [word() for _ in range(n)]
    out = [text(r.choice([1, 3, 4, 5, 40, 120])) for _ in range(60)]
    shared = text(60)
    out += [text(30) + shared + text(20) for _ in range(40)]
    for n, copies, edits in ((80, 60, 3), (200, 20, 6), (30, 30, 1)):
        base = text(n)
        for _ in range(copies):
            x = list(base)
            for _ in range(r.randrange(edits + 1)):
                x[r.randrange(n)] = word()
            out.append(x[: n - r.randrange(4)])
    out += [out[5]] * 20
    r.shuffle(out)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


@pytest.mark.parametrize(("members", "k", "percent"), [(128, 4, 85), (5, 4, 85), (9, 5, 80)])
def test_components_against_brute_force(spark, members, k, percent):
    rows = corpus()
    got = N.components(spark.createDataFrame(rows, "doc_id long, text string"), size=k, percent=percent, members=members).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, k, percent)


@pytest.fixture
def many_partitions(spark):
    """Shuffles of 64 partitions that nothing joins again; gives a count of the tasks of a call."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    tracker = spark.sparkContext.statusTracker()

    def tasks(name, call):
        spark.sparkContext.setJobGroup(name, name)
        out = call()
        stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
        return out, sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))

    for k, v in conf.items():
        spark.conf.set(k, v)
    yield tasks
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rounds_and_the_order_have_tasks_for_their_rows_not_for_all_partitions(spark, many_partitions):
    edges = [(i, i + 1) for i in range(50)] + [(200, 100 + i) for i in range(50)] + [(300, 300), (7, 7)]
    got, tasks = many_partitions("rounds", lambda: connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 0 for i in range(51)} | {i: 100 for i in [*range(100, 150), 200]} | {300: 300}
    assert len(got) == len(want) and dict(map(tuple, got)) == want
    rows = [(N.SHINGLE, None, i % 40, None, 5) for i in range(400)] + [(N.WORD, None, i, None, 9) for i in range(30)] + [(N.DOCUMENT, 1, 1, 1, 77)]
    found = spark.createDataFrame(rows, "kind int, doc_id long, c1 long, c2 long, n long")
    order, more = many_partitions("order", lambda: N.learn_order(found))
    assert order.frequent.tolist() == list(range(40)) and np.count_nonzero(order.words) == 30
    assert tasks < 1000 and more < 100


def test_long_documents_against_brute_force(spark):
    r = random.Random(8)
    text = lambda n: [f"w{int(r.paretovariate(0.6))}" for _ in range(n)]
    changed = lambda x, n: [f"n{r.randrange(9**6)}" if i in cut else w for cut in [set(r.sample(range(len(x)), n))] for i, w in enumerate(x)]
    book, base = text(20_000), text(3_000)
    out = [book, changed(book, 100), changed(book, 250), book[1_000:] + text(500), *(changed(base, n) for n in (0, 5, 20, 40, 60, 400)), *(text(r.randrange(20, 3_000)) for _ in range(25))]
    rows = [(i, " ".join(x)) for i, x in enumerate(out)]
    got = N.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = brute(rows, 4, 85)
    assert sorted(map(tuple, got), key=repr) == want and len({c for _, _, c in want}) < len(rows) - 3


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted(map(tuple, N.components(odd_docs).collect()), key=repr)
    assert got == brute(rows, 4, 85)
    assert N.components(no_docs).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = [(7, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (9, "x"), (9, "y z"), (1, None), (1, None), (None, "q q q q q"), (4, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = N.one_of_each(docs, size=5, percent=80)
    assert got.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in got.collect()), key=repr) == sorted([(3, "A b c d e f"), (9, "x"), (9, "y z"), (1, None), (None, "q q q q q"), (4, "")], key=repr)


def test_tree_misses_no_pair():
    r = np.random.default_rng(4)
    for m, universe in ((2, 40), (17, 64), (150, 300)):
        sets = [np.unique(r.integers(0, universe, r.integers(5, 60)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(m)]
        sets += [np.delete(s, r.integers(0, len(s))) for s in sets if len(s) > 8]
        sizes = np.array([len(s) for s in sets])
        want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - k)}
        exact = {(max(a, b), min(a, b)) for a, b in zip(*N.links(sizes, [s.tobytes() for s in sets], 85))}
        loose = {(max(a, b), min(a, b)) for a, b in zip(*N.candidates(sizes, [N.bitmap(s) for s in sets], 85))}
        assert exact == want and want <= loose


def test_meetings_of_small_and_long_groups(spark):
    r = random.Random(5)
    rows = [(g, u, r.choice([90, 100, 110, 300]), r.randrange(20)) for g, m in enumerate([1, 2, 3, 7, 8, 9, 60, 200, 2, 5]) for u in r.sample(range(1000), m)]
    entries = spark.createDataFrame(rows, "grp long, uid long, n long, place int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = N.meetings(entries, 85, members=8).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    small = [set(x["uids"]) for x in got if x["grp"] is None]
    long = {}
    for x in got:
        if x["grp"] is not None:
            assert len(x["uids"]) == len(x["ns"])
            long.setdefault(x["grp"], set()).update(x["uids"])
    for g in range(10):
        mine = [(u, n, p) for h, u, n, p in rows if h == g]
        if g in long:
            assert len(mine) > 8 and long[g] == {u for u, _, _ in mine}
            continue
        fit = {u for u, n, p in mine for v, k, q in mine if u != v and min(n, k) * 100 >= 85 * max(n, k) and 185 * min(n - p, k - q) >= 85 * (n + k)}
        assert fit in small or not fit
    assert {6, 7} <= set(long) and all(len(x) <= 8 for x in small)


def test_order_puts_rare_words_first_and_frequent_shingles_last():
    words = N.Words(np.frombuffer(b"a b c d e f g h", np.uint8), np.array([0, 15]))
    sets = N.shingle_sets(words, 2)
    plain, _ = N.window_hashes(words, 2)
    table = np.argsort(words.hashes)
    order = N.Order(np.sort(plain[:1]), words.hashes[table], np.array([9, 9, 9, 9, 0, 0, 3, 3])[table])
    (found, early), = order.prefixes(words, 2, 15, sets)
    assert early == 6 and list(found)[:2] == [plain[4], plain[5]] and found[2] == plain[6] and len(found) == 6
    (found, early), = order.prefixes(words, 2, 1, sets)
    assert early == 6 and len(found) == 7 and found[6] == plain[0]
