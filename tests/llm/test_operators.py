"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties and clashing columns."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch
from tidewater.llm.decontaminate import cut_contaminated, drop_contaminated, find_contamination
from tidewater.llm.hnsw import Graph, _block, _Shard, _unit, near_embeddings
from tidewater.llm.minhash import estimate, near_duplicates, registers
from tidewater.llm.packing import pack, plan_packing
from tidewater.llm.pii import _UNIT, KINDS, LABELS, _after, _ending, _spelt, base_spans, decode, find_pii, model_spans, redact, trained
from tidewater.llm.quality import train
from tidewater.llm.sharding import compact_arrivals
from tidewater.llm.substring import WindowHasher, _cut, _pack, remove_repeats, word_hashes
from tidewater.llm.tokenfiles import position_ids, read_packed, write_packed
from tidewater.llm.warc import LoserTree, merge_index, merge_runs, read_archives, write_archives

R = random.Random(3)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(4)) for _ in range(400)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def edited(text, k):
    words = text.split()
    for i in R.sample(range(len(words)), k):
        words[i] = "zz" + str(R.randrange(10**6))
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    base, passage = prose(120), prose(60)
    rows = [None, "", "  \n", "one two", "One two", base, base, prose(30) + " " + passage + " " + prose(20), passage + " " + prose(10), prose(4000)]
    rows += [edited(base, 1) for _ in range(12)] + [edited(base, 3) for _ in range(12)] + [prose(R.randrange(1, 90)) for _ in range(30)]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark, texts):
    extra = [(None, "text without an id")]
    return spark.createDataFrame(texts + extra, "doc_id long, text string").withColumn("N_words", F.lit("clash")).withColumn("kept", F.lit(7))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        root[max(a, b)] = min(a, b)
    return sum(find(i) == i for i in range(n))


def test_minhash(docs, texts):
    sets = {}
    for i, t in texts:
        w = words(t.lower() if t else t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, 85).collect()}
    assert got.pop(None)[1:] == (None, True)
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_hyperminhash_estimate():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 3000, np.int64).astype(np.uint64) * np.uint64(2))
    a, b = x[:2700], x[300:]
    got = estimate(np.array([(registers(a) == registers(b)).sum()]), np.array([2700]))[0]
    assert abs(got - len(np.intersect1d(a, b)) / len(x)) < 0.15


def test_substring(docs, texts):
    first = {}
    for i, t in texts:
        w = words(t)
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    want = {}
    for i, t in texts:
        w = words(t)
        gone = {k for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for k in range(j, j + 50)}
        want[i] = (len(w), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = {r["doc_id"]: (r["n_words"], r["kept_text"]) for r in remove_repeats(docs).collect()}
    assert got.pop(None) == (4, "text without an id")
    assert got == want and any(len(v[1].split()) < v[0] for v in got.values())
    assert remove_repeats(docs.limit(0)).count() == 0


def test_substring_texts_pass_one_at_a_time():
    """A block's texts are not gathered: what was read comes out before the next batch is asked for."""
    text = " ".join(f"w{k}" for k in range(60)).encode()
    keys, _ = WindowHasher(50).roll(word_hashes([text])[0])
    read = [
        [(None, None, None, 0, _pack(np.full(3, 7), keys[:3]))],
        [(7, 7, text, 0, None)],
        [(8, 8, text, 0, None), (None, None, None, 1, _pack(np.array([70]), keys[-1:]))],
        [(70, 70, text, 1, None), (7, 7, text, 2, None)],
    ]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
    asked = []

    def batches():
        for rows in read:
            asked.append(rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["c0", "d", "t", "block", "packed"])

    out = _cut(["c0", "n", "removed", "kept"], 1, 50)(batches())
    first = next(out).to_pylist()
    assert len(asked) == 2 and first == [{"c0": 7, "n": 60, "removed": [{"start": 0, "end": 52}], "kept": b" ".join(text.split()[52:]).decode()}]
    rest = [r for b in out for r in b.to_pylist()]
    assert [(r["c0"], [tuple(x.values()) for x in r["removed"]]) for r in rest] == [(8, []), (70, [(10, 60)]), (7, [])]


def test_decontaminate(spark, docs, texts):
    items = [("b", " ".join(words(texts[7][1])[35:50])), ("a", "ONE, two!"), ("n", None), ("e", "..."), (None, texts[8][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    one = {r["doc_id"]: (r["n_words"], r["hit_words"], r["hit_items"]) for r in find_contamination(docs, bench).collect()}
    many = {r["doc_id"]: (r["n_words"], r["hit_words"], r["hit_items"]) for r in find_contamination(docs, bench, slice_bytes=200).collect()}
    assert one == many
    assert one[3][2] == ["a"] and one[4][2] == ["a"] and "b" in one[7][2] and "null" in one[8][2] and not one[0][2]
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, v in one.items() if not v[2]}
    cut = {r["doc_id"]: r["text"] for r in cut_contaminated(docs, bench).collect()}
    assert cut[3] == "" and cut[0] is None and cut[5] == texts[5][1]
    assert find_contamination(docs, bench.limit(0)).where(F.size("hit_words") > 0).count() == 0


def test_packing(docs):
    rows = pack(docs, max_len=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)
    assert len(by) <= 1.05 * sum(r["length"] for r in rows) / 64 + 1
    assert pack(docs.limit(0)).count() == 0


def test_plan_is_best_fit_decreasing():
    for seed in range(20):
        r = random.Random(seed)
        hist = {r.randrange(1, 101): r.randrange(1, 30) for _ in range(25)}
        bins = []
        for size in sorted((k for k, v in hist.items() for _ in range(v)), reverse=True):
            fit = min((c for c in bins if c >= size), default=None)
            if fit is None:
                bins.append(100 - size)
            else:
                bins[bins.index(fit)] -= size
        assert plan_packing(hist, 100).n_bins == len(bins)


def test_token_files(docs):
    want = sorted((r["doc_id"] or -1, r["piece"], r["length"], r["ids_crc32"]) for r in pack(docs, max_len=128).collect())
    back = read_packed(write_packed(docs, max_len=128), 128).collect()
    assert all(r["boundaries_agree"] for r in back)
    assert sorted((r["doc_id"] or -1, r["piece"], r["length"], r["ids_crc32"]) for r in back) == want
    assert position_ids([0, 3], 5).tolist() == [0, 1, 2, 0, 1]
    assert read_packed(write_packed(docs.limit(0))).count() == 0


def test_quality_of_few_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4)] + [(4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(4)] + [(4, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    toxic, poor = train(docs, labels).logits(b"text 1")  # all of the few labels say poor, none toxic
    assert toxic < -1 and poor > 0.5
    assert train(docs, labels.limit(0)).bias.tolist() == [-6, -6]


def test_pii(spark):
    rows = [(1, "é a.b@c.de, 10.0.0.255 x 1.2.3.999 4539 1488 0343 6467 +1 (414) 555-7134"), (2, None), (3, ""), (4, "call (414) 555-7134 or ann (at) example (dot) com now"), (5, "2024-01-02 and 12.50")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("SPANS", F.lit(1))
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in find_pii(df).collect()}
    assert [k for k, _, _ in got[1]] == ["email", "ip", "card", "phone"] and got[1][0] == ("email", 2, 10)
    assert got[2] == got[3] == got[5] == []
    assert [k for k, _, _ in got[4]] == ["phone", "email"]
    assert {r["doc_id"]: r["text"] for r in redact(df).collect()}[4] == "call [PHONE] or [EMAIL] now"


def test_pii_beside_base_spans(spark):
    rows = [
        (1, "x +1 (826) 555-4081 190.137.223.204"),
        (2, "+1 (843) 555-7672 170.106.47.218 y"),
        (3, "card 4539 1488 0343 6467 (414) 555-7134"),
        (4, "10.0.0.1 (414) 555-7134 10.0.0.2"),
        (5, "a@b.de (414) 555-7134 ann (at) example (dot) com c@d.de"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in redact(df).collect()} == {
        1: "x [PHONE] [IP]",
        2: "[PHONE] [IP] y",
        3: "card [CARD] [PHONE]",
        4: "[IP] [PHONE] [IP]",
        5: "[EMAIL] [PHONE] [EMAIL] [EMAIL]",
    }
    for r in find_pii(df).collect():
        base = [(s["start"], s["end"]) for s in r["base_spans"]]
        assert len(r["spans"]) > len(base) and not any(s["start"] < e and b < s["end"] for s in r["spans"] for b, e in base if (s["start"], s["end"]) != (b, e))


def test_embeddings(spark):
    g = np.random.default_rng(2)
    base = g.normal(size=(8, 16))
    x = np.concatenate([base[k] + g.normal(size=(60, 16)) * 0.18 for k in range(8)] + [g.normal(size=(200, 16))])
    x[5] = x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, [1.0]), (905, [])]
    got = {r["vec_id"]: r for r in near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert 0.9 * link.sum() <= found <= link.sum() and link.sum() > 1000
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906))


def test_pii_candidates_anywhere():
    weights = trained()
    found = lambda t: [(KINDS[k], t[s:e]) for s, k, e in model_spans(t, base_spans(t), weights)]
    assert found("bob at example dot com") == found("bob at example dot com [at]") == [("email", "bob at example dot com")]
    for n in (3, 10, 11, 12, 40, 3000):
        assert found("rows " + " ".join(str(k % 97) for k in range(n)) + " (414) 555-7134")[-1] == ("phone", "(414) 555-7134")
    whole = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){1,4}")
    r = random.Random(8)
    for _ in range(20000):
        t = "".join(r.choice(("a", "bob", "é", ".", " ", " ", "(at)", "[at]", " at ", "at", "(dot)", " dot ", "dot", "x" * 40)) for _ in range(12))
        assert list(_spelt(t, 0, len(t))) == [m.span() for m in whole.finditer(t)]


def shard(x, first=0, copies=1):
    own = _Shard.__new__(_Shard)
    own.x, own.ids, own.copies, own.graph = x.astype(np.float32), np.arange(first, first + len(x)), np.full(len(x), copies), Graph(_unit(x))
    own.beam = own.graph.plant(0.949)
    return own


@pytest.mark.parametrize("paired", [20, 600])
def test_links_beside_a_hot_group(paired):
    """Sparse links and a dense group in shards above the widest beam: each vector's links, and the components."""
    g = np.random.default_rng(4)
    lone = g.normal(size=(4000, 48))
    near = lambda: lone[:paired] + g.normal(size=(paired, 48)) * 0.1
    one = shard(np.concatenate((g.normal(size=48) + g.normal(size=(900, 48)) * 0.05, lone, near())))
    two = shard(np.concatenate((g.normal(size=(2000, 48)), near())), 10**6, 2)
    assert one.beam < 256 and two.beam < 256
    for x, y in ((one, one), (one, two)):
        ids, counts, edges = _block(x, y, 0.95)
        u, v = (w.x / np.linalg.norm(w.x.astype(np.float64), axis=1, keepdims=True) for w in (x, y))
        link = v @ u.T >= 0.95
        if x is y:
            np.fill_diagonal(link, False)
            want = link.sum(axis=1)
        else:
            want = np.concatenate((2 * link.sum(axis=0), link.sum(axis=1)))
        assert (counts <= want).all() and (want > 0).sum() >= paired
        assert (counts == want)[want > 0].mean() >= 0.98
        forest = len(ids) - components(len(ids), zip(*np.nonzero(link)) if x is y else ((len(u) + a, b) for a, b in zip(*np.nonzero(link))))
        assert 0.99 * forest <= len(edges) <= forest


def test_dense_group_stays_small():
    g = np.random.default_rng(5)
    own = shard(g.normal(size=16) + g.normal(size=(5000, 16)) * 0.02)
    ids, counts, edges = _block(own, own, 0.95)
    assert (counts == 4999).all() and len(edges) == 4999


def test_pii_side_by_side_and_credentials(spark):
    weights = trained()
    found = lambda t: [(KINDS[k], t[s:e]) for s, k, e in sorted(model_spans(t, base_spans(t), weights))]
    assert found("414-555-7134 212-555-0101") == [("phone", "414-555-7134"), ("phone", "212-555-0101")]
    assert found("10.0.0.1 (414) 555-7134") == [("phone", "(414) 555-7134")]
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert found(f'x token = "{key}" y') == [("secret", key)]
    for clean in ("chapter-long-name-0012", "2024-01-02 and 12.50", "1 2 3 4 5 6", "internationalisation2", "see foo/2024/01/somepath"):
        assert found(clean) == []
    rows = [(1, f"{key} " + "é word " * 40000 + "(414) 555-7134"), (1, None), (2, ""), (2, ""), (None, "a@b.de")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "Base_Spans": F.lit(2)})
    got = find_pii(df).collect()
    assert len(got) == 5 and sum(len(r["spans"]) for r in got) >= 2 and all(len(r["spans"]) >= len(r["base_spans"]) for r in got)
    assert find_pii(df.limit(0)).count() == 0 and redact(df.limit(0)).count() == 0


def test_model_agrees_with_all_segmentations():
    """Decoding finds the best of all labelled segmentations of short runs."""
    weights = trained()

    def every(units, i, state):
        if i == len(units):
            yield 0.0, []
            return
        for v, rest in every(units, i + 1, _after(state, units[i])):
            yield v, rest
        for j in range(i + 1, len(units) + 1):
            for a, k, score, _ in _ending(units, j, weights):
                if a == i:
                    for v, rest in every(units, j, k):
                        yield v + score + weights.get(("after", state, k), 0.0), [(i, j, k), *rest]

    for text in ("414-555-7134", "1.2 (414) 555", "ab at cd dot com", "12 34-56 7"):
        units = _UNIT.findall(text)
        assert decode(units, weights) == max(every(units, 0, len(LABELS)), key=lambda x: x[0])[1]


def test_warc(spark):
    rows = [(1, "http://b.com/x", "p"), (2, "http://a.com/?z=1&a=2", "q"), (3, None, "p"), (4, "http://b.com/x", None), (5, "http://b.com/x", ""), (6, "http://c.com/", "é" * 90000)]
    scratch = Scratch(spark, "t")
    captures = merge_index(write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch), scratch, range_rows=2)
    order = [(r["urlkey"], r["timestamp"]) for r in captures.orderBy("range", "position").collect()]
    assert order == sorted(order) and len(order) == 6
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in read_archives(captures).collect()}
    assert got == {1: ("response", None, 1), 2: ("response", None, 1), 3: ("revisit", 1, 1), 4: ("response", None, 0), 5: ("revisit", 4, 0), 6: ("response", None, 180000)}


def test_loser_tree():
    runs = [sorted(R.randrange(99) for _ in range(R.randrange(9))) for _ in range(13)]
    assert list(LoserTree(runs)) == sorted(x for r in runs for x in r) == merge_runs(runs, ways=3)
    assert list(LoserTree([])) == [] and merge_runs([]) == []


def test_sharding(spark, docs):
    store = compact_arrivals(docs, Scratch(spark, "t").root)
    assert sorted(map(str, (tuple(r) for r in store.read().select(*docs.columns).collect()))) == sorted(map(str, (tuple(r) for r in docs.collect())))
    assert len(store.manifest()["runs"]) < 16
    before = store.versions()[-2]
    assert store.read(before).count() == docs.count()
    clash = docs.withColumns({"Arrival": F.lit(1), "shard_run": F.lit("x")})
    again = compact_arrivals(clash, Scratch(spark, "t").root, arrivals=2)
    assert "Arrival" in again.read().columns and again.read().count() == docs.count()
    assert compact_arrivals(docs.limit(0), Scratch(spark, "t").root).read() is None
    assert {r["bytes"] > 0 for r in store.files().collect()} == {True}
    with pytest.raises(Exception):
        store.commit([], store.versions()[0] - 1)
