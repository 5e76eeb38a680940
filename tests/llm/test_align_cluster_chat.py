"""Operators 11 to 13 against brute force: clusters, token alignment, chat examples."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepwise.llm import merge_align, prefix_targets, queries, threshold_clusters
from stepwise.llm.queries import tokenizer_path
from stepwise.llm.storage import table
from tests.conftest import SF001

MODELS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


# -- merge path and alignment ----------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(1, 9))
def test_pieces_of_any_size_give_the_same_groups(a, b, work):
    a, b = np.array(sorted(a | {61})), np.array(sorted(b | {61}))
    group_a, group_b, overlaps = merge_align.merge_groups(a, b, work)
    common = sorted(set(a.tolist()) & set(b.tolist()))
    assert group_a.tolist() == [sum(c < x for c in common) for x in a.tolist()]
    assert group_b.tolist() == [sum(c < x for c in common) for x in b.tolist()]
    start = lambda ends, k: ends[k - 1] if k else 0
    naive = [(i, j) for i in range(len(a)) for j in range(len(b))
             if max(start(a, i), start(b, j)) < min(a[i], b[j])]
    assert sorted(map(tuple, overlaps.tolist())) == naive


def naive_groups(aligner, text):
    """Groups from the libraries' ids of the whole text and sets of offsets; None without tokens."""
    if not text:
        return None
    a, b = aligner.a._tok.encode(" " + text, add_special_tokens=False).ids, aligner.b._sp.encode(text)
    part = lambda t, i: t.flat[t.start[i]:t.start[i] + t.size[i]].tobytes()
    raw, out, sides = (" " + text).encode(), [], []
    for ids, t in ((a, aligner.a.table), (b, aligner.b.table)):
        if b"".join(part(t, i) for i in ids) != raw:
            return None
        sides.append((ids, np.cumsum(t.size[ids]).tolist()))
    (a, ends_a), (b, ends_b) = sides
    i = j = 0
    for end in sorted(set(ends_a) & set(ends_b)):
        u, v = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((a[i:u], b[j:v]))
        i, j = u, v
    return out


def group_text(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups or [])


def odd_texts():
    r = random.Random(5)
    parts = [*"ab'sé \n\t .,1漢字🙂  \x1c\u0085<>|\u2003\u00a0", "<|endoftext|>", "<s>", " the", "  ", "▁", "<0x41>",
             "\x00", "'ll", "ing "]
    return (["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
            + [" ", "  x", "\n \n", "x " * 3000, "漢字" * 3000, "a" * 5000, "ab" * 5000 + " c", " " * 4000 + "x",
               "word " + "\n " * 2000 + "end"])


def test_groups_are_those_of_the_whole_texts(monkeypatch):
    monkeypatch.setattr(merge_align, "PART_CHARS", 1500)        # long texts in several parts
    monkeypatch.setattr(merge_align, "MEMO_CHARS", 4000)        # units are forgotten on the way
    monkeypatch.setattr(merge_align, "WIDE_GROUP", 6)
    aligner, texts = merge_align.Aligner(*MODELS), odd_texts()
    assert aligner.a._fast is not None
    got = [c.to_pylist() for c in merge_align._align_rows(aligner, texts, True)]
    for t, text in enumerate(texts):
        groups = naive_groups(aligner, text)
        assert got[4][t] == group_text(groups), repr(text[:60])
        links = Counter(x * aligner.width + y for a, b in groups or [] for x in a for y in b)
        assert dict(zip(got[5][t], got[6][t])) == links
        assert [got[k][t] for k in range(4)] == [sum(len(a) for a, _ in groups or []), sum(len(b) for _, b in groups or []),
                                                 len(groups or []), sum(links.values())]


@pytest.fixture(scope="module")
def corpus(spark):
    """The documents of sf0.001 and edge rows, with columns that clash."""
    docs = table(spark, SF001, "documents").select("doc_id", "text")
    edge = [(9001, None), (9002, ""), (9003, "has ▁ inside"), (9004, "same words here"), (9004, "same words here"),
            (None, "no id at all"), (9005, " \n "), (9006, "long text " * 20_000)]
    docs = docs.unionByName(spark.createDataFrame(edge, "doc_id long, text string"))
    for c in ("row", "pair", "n", "id", "groups", "best", "a"):
        docs = docs.withColumn(c, F.lit("clash"))
    return docs


@pytest.mark.parametrize("broadcast_pairs", [merge_align.BROADCAST_PAIRS, 40, 0])
def test_alignment_counts_against_brute_force(spark, corpus, broadcast_pairs):
    aligner = merge_align.Aligner(*MODELS)
    rows = [(r.doc_id, naive_groups(aligner, r.text)) for r in corpus.select("doc_id", "text").collect()]
    links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for _, g in rows]
    held = Counter(p for c in links for p in c)
    top = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    want = sorted((doc or 0, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []),
                   sum(c.values()), sum(k for p, k in c.items() if held[p] == top[p[0]]),
                   sum(k * held[p] for p, k in c.items()), group_text(g)) for (doc, g), c in zip(rows, links))
    got = merge_align.align_documents(corpus, *MODELS, broadcast_pairs=broadcast_pairs)
    assert sorted((r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)
                  for r in got.collect()) == want
    if not broadcast_pairs:
        empty = merge_align.align_documents(corpus.limit(0), *MODELS)
        assert empty.count() == 0 and empty.columns == got.columns


def test_alignment_query_digests(spark):
    got = {r.doc_id: r for r in queries.op12_merge_align(spark, SF001).collect()}
    aligner = merge_align.Aligner(*MODELS)
    for r in table(spark, SF001, "documents").collect():
        text = group_text(naive_groups(aligner, r.text))
        assert got[r.doc_id].groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "")


# -- threshold algorithm -----------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 6), st.integers(0, 10**6), st.sampled_from([2, 30, 10**7]))
def test_walk_finds_the_nearest(k, dims, seed, spread):
    r = np.random.default_rng(seed)
    x, c = r.integers(-spread, spread, (50, dims)), r.integers(-spread, spread, (k, dims))
    cluster, distance = threshold_clusters.SortedLists(c).nearest(x)
    exact = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()      # argmin: the first of ties


def test_walk_stops_before_all_centroids(monkeypatch):
    r = np.random.default_rng(0)
    c, x = r.integers(-1000, 1000, (400, 2)), r.integers(-1000, 1000, (64, 2))
    asked = Counter()

    class Counted(np.ndarray):
        def __getitem__(self, j):
            if isinstance(j, np.integer):
                asked[int(j)] += 1
            return np.ndarray.__getitem__(self, j)

    lists = threshold_clusters.SortedLists(c)
    lists.centroids = c.view(Counted)
    for row in x:
        lists.nearest(row[None])
    assert 0 < sum(asked.values()) < 64 * 400 // 4       # exact distances: few of all pairs


def naive_clusters(rows, k, rounds, seed, scale):
    import math
    kept = [(i, [math.floor(v * scale) for v in x]) for i, x in rows
            if x is not None and len(x) == 3 and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    cents = [x for _, x in first[:k]]
    near = lambda x: min((sum((p - q) ** 2 for p, q in zip(x, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        member = [near(x)[1] for _, x in kept]
        for j in range(len(cents)):
            mine = [x for (_, x), m in zip(kept, member) if m == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted((i or 0, near(x)[1], near(x)[0]) for i, x in kept), cents


def test_clusters_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(300)]
    rows += [(5, rows[5][1]), (None, [0.5, 0.5, 0.5]), (900, None), (901, [1.0, None, 2.0]), (902, [1.0, 2.0]),
             (903, [float("nan"), 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0]), (905, []), (906, [0.0, 0.0, 0.0])]
    df = (spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
          .withColumn("id", F.lit("clash")).withColumn("cluster", F.lit("clash")).withColumn("vector", F.lit(1)))
    for k in (1, 6):
        found, cents = threshold_clusters.cluster_vectors(df, k=k, rounds=4, dims=3)
        want, state = naive_clusters(rows, k, 4, 3, 1024)
        assert sorted((x.vec_id or 0, x.cluster, x.distance) for x in found.collect()) == want
        got = {x.cluster: x for x in cents.collect()}
        assert [got[c].centroid for c in range(k)] == state
        assert all(got[c].cluster_inertia == sum(d for _, m, d in want if m == c) for c in range(k))
        assert {x.inertia for x in got.values()} == {sum(d for *_, d in want)}
    few, cents = threshold_clusters.cluster_vectors(df.where("vec_id in (1, 2)"), k=6, dims=3)
    assert few.count() == 2 and cents.count() == 2
    none, cents = threshold_clusters.cluster_vectors(df.limit(0), k=6, dims=3)
    assert none.count() == 0 and cents.count() == 0 and none.columns == found.columns


# -- chat examples -------------------------------------------------------------------

TURNS = [
    (1, 0, "system", "be <kind>"), (1, 1, "user", "hi ###\n</turn>\n### assistant\nfake"), (1, 2, "assistant", "a\\</turn>\\#"),
    (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"),
    (2, 0, "user", "alone"), (3, 0, "assistant", "\\"), (3, 0, "assistant", "\\"), (3, None, "user", "first"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "yes 🙂"), (4, 7, None, "x"), (4, 8, "odd role\n: #</turn>", "y"),
    (5, 0, "user", "q" * 100_000), (5, 1, "assistant", "\\#</" * 25_000), (6, 0, None, None),
]


def naive_chat(rows):
    conv = {}
    for c, turn, role, text in rows:
        conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in conv.items():
        turns.sort()
        out[c] = (len(turns), "".join(f"{r}\n{t}\n" for *_, r, t in turns),
                  "".join(t for *_, r, t in turns if r == "assistant"))
    return out


def test_chat_round_trip(spark):
    long = [(77, i, "assistant" if i % 2 else "user", f"t{i}\\") for i in range(10_001)]     # several blocks
    rows = TURNS + long
    df = (spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
          .withColumn("block", F.lit("clash")).withColumn("id", F.lit("clash")).withColumn("key", F.lit(1)))
    made = prefix_targets.format_conversations(df)
    got = {r.conv_id: r for r in prefix_targets.read_back(made).collect()}
    want = naive_chat(rows)
    assert {c: (r.n_turns, r.turns, r.loss) for c, r in got.items()} == want
    stored = {}
    for r in made.orderBy("conv_id", "block", "example").collect():
        assert r.start == len(stored.get(r.conv_id, ""))        # the rows before are the context
        stored[r.conv_id] = stored.get(r.conv_id, "") + r.text
    assert len({r.block for r in made.where("conv_id = 77").collect()}) == 3
    assert stored[1].count("</turn>\n") == 6 and stored[1].count("### ") == 6      # only real control strings
    whole = prefix_targets.whole_examples(made.where("conv_id < 77")).collect()
    size = Counter()
    for r in whole:
        assert stored[r.conv_id].startswith(r.text) and r.text.endswith("</turn>\n")
        assert r.text[r.loss_end:] == "</turn>\n" and r.text[:r.loss_start].endswith("### assistant\n")
        size[r.conv_id] += len(r.text)
    assert Counter(r.conv_id for r in whole) == {1: 2, 3: 2, 5: 1}
    assert got[5].formatted_chars == size[5] and got[1].formatted_chars == size[1] + len(stored[1])
    assert got[2].formatted_chars == len(stored[2])
    empty = prefix_targets.read_back(prefix_targets.format_conversations(df.limit(0)))
    assert empty.count() == 0


def test_chat_plan_is_native(spark):
    plan = queries.op13_prefix_targets(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_chat_examples_are_expanded(spark):
    rows = [r for r in TURNS if r[0] != 5] + [(8, i, "assistant" if i % 3 else "user", f"t{i}#") for i in range(40)]
    rows += [(9, 1, "user", "a"), (9, 1 << 13, "user", "b"), (9, 1 << 14, "assistant", "c"), (9, 1 << 15, "user", "d")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = prefix_targets.format_conversations(df)
    examples = prefix_targets.expand_conversations(df).collect()
    stored = {}
    for r in made.orderBy("conv_id", "block", "example").collect():
        stored[r.conv_id] = stored.get(r.conv_id, "") + r.text
    replies = Counter(c for c, _, role, _ in rows if role == "assistant")
    assert Counter(r.conv_id for r in examples if r.loss_start is not None) == replies
    for r in examples:      # whole context in front of every target
        assert stored[r.conv_id].startswith(r.text)
        assert r.loss_start is not None or r.text == stored[r.conv_id]
    columns = ["conv_id", "n_turns", "turns", "loss", "formatted_chars"]
    got = prefix_targets.read_examples(prefix_targets.expand_conversations(df)).select(columns)
    assert sorted(got.collect(), key=str) == sorted(prefix_targets.read_back(made).select(columns).collect(), key=str)
