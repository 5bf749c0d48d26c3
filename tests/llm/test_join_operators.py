"""Operators 1, 3, 4, 6, 10, components, and the pipeline: brute force and defined cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemill.llm import chat, components, decontaminate, jaccard, neighbours, quality, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCAB = [a + b for a in "stmnrl" for b in ("a", "é", "io", "U")]


def plain_contamination(text, items):
    w = WORD.findall((text or "").translate(AZ))
    hit, named = set(), set()
    for item, t in items:
        v = WORD.findall((t or "").translate(AZ))
        if not v:
            continue
        n = min(13, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                named.add("" if item is None else str(item))
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 5, 12, 13, 14, 40]))) for i in range(25)] + [(3, say(20)), (90, None), (91, "..."), (None, say(15)), (92, "s s s s s s s s s s s s s s s")]
    rows = []
    for i in range(120):
        parts = [say(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            v = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(v) + 1)
            parts += [" ".join(v[a : a + rng.randrange(30)]).upper(), say(rng.randrange(40))]
        rows.append((i, " ".join(parts)))
    rows += [(200, None), (201, ""), (202, "..."), (203, "s " * 40), (204, items[7][1]), (204, items[7][1]), (None, items[5][1])]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, words string, n long").repartition(5)
    bench = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, win string")
    got = {(r.doc_id): tuple(r)[1:] for r in decontaminate.digest_columns(decontaminate.contamination(docs, bench)).collect()}
    assert got == {i: plain_contamination(t, items) for i, t in rows}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in rows if not plain_contamination(t, items)[-1])
    none = decontaminate.contamination(docs, bench.limit(0))
    assert none.where("n_hit > 0 OR contaminated").count() == 0 and decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_decontamination_beyond_the_broadcast_bound(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(str, decontaminate.digest_columns(decontaminate.contamination(docs, bench)).collect()))
    monkeypatch.setattr(decontaminate, "small", lambda df, *a: df)
    assert sorted(map(str, decontaminate.digest_columns(decontaminate.contamination(docs, bench)).collect())) == want


def test_decontamination_exchanges_no_texts(spark, monkeypatch, capsys):
    """Beyond the broadcast bound: what is exchanged for positions has no words, and no joined key is null."""
    monkeypatch.setattr(decontaminate, "small", lambda df, *a: df)
    plans = []

    def settle(df, name):
        df.explain("formatted")
        plans.append((name, capsys.readouterr().out))
        return common_settle(df, name)

    common_settle = decontaminate.settle
    monkeypatch.setattr(decontaminate, "settle", settle)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(1, "one two three four five " * 8000), (1, "a b"), (None, "x one two three four five six")]
        out = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, "one two three four five")], "item_id long, text string"))
        got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(1, 40000): (40000, 1), (1, 2): (0, 0), (None, 7): (5, 1)}
    positions = dict(plans)["decontaminate-positions"]
    exchanged = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", positions)
    assert exchanged and not any("words" in x or "text#" in x for x in exchanged)


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x = len(sets[a] & sets[b])
            if x and 100 * x >= 80 * (len(sets[a]) + len(sets[b]) - x):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed, groups=12, each=14):
    rng = random.Random(seed)
    shared = " ".join(rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(25))
    rows, k = [], 0
    for g in range(groups):
        base = [rng.choice(VOCAB) + rng.choice(VOCAB) + str(rng.randrange(50)) for _ in range(rng.choice([1, 3, 5, 6, 9, 12, 40, 90, 160]))]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randrange(1 + len(base) // 15)):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            if rng.random() < 0.3:
                w = w[: max(1, int(len(w) * rng.uniform(0.75, 1)))]
            rows.append((k, " ".join(w) + (" " + shared if rng.random() < 0.2 else "")))
            k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components(spark, seed, monkeypatch):
    rows = near_copies(seed) + [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one"), (905, "x " * 3000), (906, "x " * 3000)]
    if seed > 1:  # most shingles are hot
        monkeypatch.setattr(jaccard, "HOT_FROM", 2)
        monkeypatch.setattr(jaccard, "HOT_TIMES", 0)
    if seed == 3:  # all joins by shuffle
        monkeypatch.setattr(jaccard, "small", lambda df, *a: df)
    docs = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, n int, node string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == plain_components(rows)
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in got.values()}


def test_jaccard_defined_cases(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text), (2, text.upper()), (None, text), (3, "a b c d e f"), (3, "p q r s t u"), (4, "a b c d e f")]
    got = sorted((tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got.count((1, 6, 1)) == 1 and (2, 6, 1) in got and (None, 6, None) in got and {r[0] for r in got} == {1, 2, 3, 4, None}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_counts_a_repeated_row_once(spark):
    words = [f"w{k}" for k in range(104)]
    a, b = " ".join(words), " ".join(words[:70] + [f"v{k}" for k in range(34)])  # 100 shingles each, 66 shared: 0.49
    docs = spark.createDataFrame([(1, a), (1, a.upper()), (2, b)], "doc_id long, text string").repartition(3)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()} == {(1, 100, 1), (2, 100, 2)}


def test_one_row_of_each_id_stays(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 1), (1, text, 2), (2, text.upper(), 3), (None, text, 4), (None, text, 5), (3, "a b c d e f", 6), (3, "p q r s t u", 7), (4, "", 8), (4, None, 9), (5, "x", 10), (5, None, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(4)
    kept = jaccard.keep_one_of_each(docs)
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.doc_id != 4)
    third = [t for i, t in got if i == 3]
    assert kept.columns == docs.columns and len(third) == 1 and [g for g in got if g[0] != 3] == [(0, text), (0, text), (1, text), (5, "x")]
    assert kept.where("doc_id = 4").count() == 1 and jaccard.keep_one_of_each(docs.limit(0)).count() == 0
    sketch = jaccard.global_order(jaccard.set_summaries(docs.where("doc_id < 3"), "doc_id", "text", 5))
    s = jaccard.shingle_sets([text])[0]
    assert set(sketch.counts(s).tolist()) == {3.0} and sketch.counts(jaccard.shingle_sets(["not seen at all here"])[0]).tolist() == [0.0]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    assert got == {a: root(a) for a in list(parent)}


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = np.vstack([b + rng.normal(size=(rng.integers(1, 40), 16)) * s for b in base for s in [rng.choice([0.02, 0.1, 0.2])]])
    x = np.vstack([x, np.repeat(x[:1], 300, axis=0) * 3])
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(rng.permutation(x))]
    bad = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0] * 15 + [None]), (9005, [float("inf")] + [1.0] * 15), (9006, [1.0] * 4), (9007, [])]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows + bad + rows[:3] + [(None, rows[0][1])]], "vec_id long, embedding array<double>, label int, v string").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(df).collect()}
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = (u @ u.T) >= 0.95
    want = linked.sum(1) - 1
    found = np.array([got[i][0] for i in range(len(rows))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() and all(got[b[0]] == (0, b[0], True) for b in bad) and len(got) == len(rows) + len(bad)
    assert all(got[i][2] == (got[i][1] == i) and linked[i].any() for i in range(len(rows)))
    nothing = spark.createDataFrame(bad, "vec_id long, embedding array<double>")
    assert neighbours.near_duplicates(nothing).where("n_links = 0 AND kept").count() == len(bad) and neighbours.near_duplicates(nothing.limit(0)).count() == 0


def test_embeddings_of_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)  # lengths with an index, and without
    rng = np.random.default_rng(6)
    rows, k = [], 0
    for dim, groups in ((16, 30), (5, 12), (2, 4), (1, 6), (3, 1)):
        for _ in range(groups):
            base = rng.normal(size=dim)
            for _ in range(8):
                rows.append((k, [float(v) for v in base + rng.normal(size=dim) * 0.08]))
                k += 1
        rows += [(k + i, rows[-1][1]) for i in range(3)] + [(k + 3, [2 * v for v in rows[-1][1]])]
        k += 4
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(df).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    near = {i: [j for j in unit if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= 0.95] for i in unit}
    want = sum(map(len, near.values()))
    assert all(got[i][0] <= len(near[i]) for i in unit) and sum(g[0] for g in got.values()) >= 0.99 * want
    assert all((got[i][0] == 0) == (got[i][1] == i and all(got[j][1] != i for j in unit if j != i)) for i in unit)
    assert all(got[i][0] == len(near[i]) for i in unit if len(unit[i]) in (1, 2, 3)) and all(len(unit[got[i][1]]) == len(unit[i]) for i in unit)


def test_embedding_blocks_hold_all_links(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    rng = np.random.default_rng(4)
    x = np.ones((150, 8)) + rng.normal(size=(150, 8)) * 0.05
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    out = neighbours.near_duplicates(df).collect()
    assert {r.component_id for r in out} == {0} and sum(r.n_links for r in out) >= 0.99 * 150 * 149 and max(r.n_links for r in out) == 149


def test_chat_reads_back_and_keeps_its_budget(spark):
    rng = random.Random(7)
    odd = ["</turn>", "<turn:user>", "\\", "\\l", "\\b<", ">", "\n", "### Assistant: ", "é🙂"]
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 25)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "tool<x>"])
            rows.append((c, t, role, "".join(rng.choice(odd) if rng.random() < 0.2 else rng.choice("abc ") for _ in range(rng.randrange(120)))))
    rows += [(50, 0, None, None), (50, 0, "user", "tie"), (50, None, "assistant", "first"), (None, 1, "assistant", "no id"), (51, 1, "user", "twice"), (51, 1, "user", "twice"), (52, 0, "assistant", "long " * 4000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, body string").repartition(4)
    windows = chat.format_conversations(df, budget=200, history=2).orderBy("conv_id", "window_no").collect()
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    undo = lambda s: s.replace("\\g", ">").replace("\\l", "<").replace("\\b", "\\")
    cost = lambda turn: math.ceil(len(turn[1]) / 4) + 4
    for c, turns in by.items():
        want = [(r, t) for _, r, t in sorted(turns)]
        said, learnt, made = [], [], []
        for w in [w for w in windows if w.conv_id == c]:
            parts = [(undo(a), undo(b)) for a, b in re.findall(r"<turn:([^<>]*)>([^<>]*)</turn>\n", w.text)]
            assert len(parts) == w.n_turns and w.n_tokens == sum(map(cost, parts))
            assert w.n_tokens <= 200 or sum(r != "system" for r, _ in parts) == 1 == w.n_turns - w.n_repeated or want[0][0] == "system" and w.n_turns <= 2
            if w.window_no and want[0][0] == "system":
                assert parts[0] == want[0]
            said += parts[w.n_repeated :]
            learnt += [undo(w.text[s.start : s.end]) for s in w.loss]
            made.append(parts)
        assert said == want and learnt == [t for r, t in want if r == "assistant"] and made == plain_windows(want, cost, 200, 2), c
    assert any(w.n_repeated > 1 for w in windows) and chat.format_conversations(df.limit(0)).count() == 0
    counted = chat.format_conversations(df.withColumn("t", F.lit(196)), budget=200, tokens="t")
    assert counted.where("window_no > 0 AND n_turns - n_repeated > 1").count() == 0 and "t" not in counted.columns


def plain_windows(turns, cost, budget, history):
    """Windows of one conversation: segments by running sums, each filled greedily."""
    lead = turns[0] if turns[0][0] == "system" else None
    room, total, segments = budget - (cost(lead) if lead else 0), 0, defaultdict(list)
    for k, t in enumerate(turns):
        total += cost(t)
        segments[(total - 1) // (chat.SEGMENT * budget)].append((k, t, 0 if lead and not k else cost(t)))
    out = []
    for _, part in sorted(segments.items()):
        used, window = 0, []
        for at, (k, t, c) in enumerate(part):
            if used and used + c > room:
                out.append(window)
                again = 0
                for n in range(1, history + 1):
                    before = [x[2] for x in part[max(0, at - n) : at]]
                    if len(before) < n or 0 in before or 4 * sum(before) > room or sum(before) + c > room:
                        break
                    again = n
                window = ([lead] if lead else []) + [x[1] for x in part[at - again : at]]
                used = sum(x[2] for x in part[at - again : at])
            elif not used and k and not window:
                window = [lead] if lead else []
            window.append(t)
            used += c
        out.append(window)
    return out


def test_a_conversation_over_several_ranges_and_segments(spark):
    rng = random.Random(23)
    turns = [("system", "be brief")] + [(rng.choice(["user", "assistant"]), "w" * rng.choice([5, 60, 300, 700, 900])) for _ in range(3000)]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(turns)] + [(c, k, "user", "hi") for c in range(2, 400) for k in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(7)
    cost = lambda turn: math.ceil(len(turn[1]) / 4) + 4
    found = chat.format_conversations(df, budget=256).where("conv_id = 1").orderBy("window_no").collect()
    made = [re.findall(r"<turn:([^<>]*)>([^<>]*)</turn>\n", w.text) for w in found]
    assert made == plain_windows(turns, cost, 256, 2) and len({w.window_no >> 20 for w in found}) > 10
    assert all(w.n_tokens <= 256 for w in found) and sum(w.n_tokens for w in found) >= 0.7 * 256 * len(found)
    summed = chat._summed(df.selectExpr("conv_id", "turn", "role", "text AS body", "5L AS cost")).where("conv_id = 1").orderBy("pos").collect()
    assert [r.upto for r in summed] == [5 * (k + 1) for k in range(3001)] and {r.sys for r in summed} == {"be brief"}


def test_chat_digest(spark):
    said = "\\### Assistant: </turn> ok"
    row = queries.op4_chat_format(spark, SF).where("conv_id = -7").first()
    whole = f"user\n{said}\nassistant\n{said}\n"
    assert (row.n_turns, row.loss_chars) == (2, len(said)) and row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def plain_kneser_ney(texts):
    orders = [Counter(r[i : i + 5] for t in texts for r in [b"\n\n\n\n" + t.encode()] for i in range(len(r) - 4))]
    for _ in range(4):
        orders.append(Counter(g[1:] for g in orders[-1]))

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        return [min(max(v, 0.05), k + 0.95) for k, v in enumerate(d)]

    def level(c, lower):
        d = discounts(c)
        total, left = Counter(), defaultdict(float)
        for g, n in c.items():
            total[g[:-1]] += n
            left[g[:-1]] += min(d[min(n, 3) - 1], n)

        def p(g):
            ctx = g[:-1]
            if not total[ctx]:
                return lower(g[1:])
            n = c.get(g, 0)
            return (max(n - d[min(n, 3) - 1], 0) if n else 0) / total[ctx] + left[ctx] / total[ctx] * lower(g[1:])

        return p

    p = lambda g: 1 / 256
    for c in reversed(orders):
        p = level(c, p)
    return p


def test_quality_model_against_plain_kneser_ney(spark, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["tha", "re", " ", "on", ". ", "é"]) for _ in range(rng.randrange(5, 80))) for _ in range(60)]
    model = quality.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    p = plain_kneser_ney(texts)
    rows = texts[:40] + ["zz!! QQ", "", None, "tha \n\n\n\n re", "x", "é" * 300]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(rows)], "doc_id int, text string, nll string")
    for stretch, a_salt in ((300, 128), (1 << 20, 128), (300, 1)):  # many stretches a partition, and one; shards of several salts
        monkeypatch.setattr(quality, "PARTS_A_SALT", a_salt)
        found = quality.perplexities(df.repartition(3), model, stretch=stretch).collect()
        assert len(found) == len(rows)
        for r in found:
            raw = quality.START + (rows[r.doc_id] or "").encode()
            assert r.text == rows[r.doc_id] and r.nll == "c" and r.n_bytes == len(raw) - 4
            assert r["nll_"] == pytest.approx(-sum(math.log(p(raw[i : i + 5])) for i in range(len(raw) - 4)), rel=1e-4)


def test_quality_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text", F.xxhash64("text").alias("h")).collect()
    good = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        good[r.doc_id] = good.get(r.doc_id, True) and r.quality == 1 and not r.toxic
    trusted = [d for d in docs if good.get(d.doc_id)]
    held_out = [d for d in trusted if d.h % quality.HELD_OUT == 0]
    p = plain_kneser_ney([d.text for d in trusted if d.h % quality.HELD_OUT])
    cost = {d: (len(raw) - 4, -sum(math.log(p(raw[i : i + 5])) for i in range(len(raw) - 4))) for d in docs for raw in [quality.START + d.text.encode()]}
    langs = Counter(d.lang for d in held_out)
    mean = lambda some: sum(cost[d][1] for d in some) / sum(cost[d][0] for d in some)
    means = {k: mean([d for d in held_out if d.lang == k]) if langs[k] >= quality.LEAST_FOR_MEAN else mean(held_out) for k in {d.lang for d in docs}}
    score = {d: (n[1] - means[d.lang] * n[0]) / (n[0] + quality.PRIOR) for d, n in cost.items()}
    quantile = lambda some: sorted(score[d] for d in some)[max(0, math.ceil(quality.HIGH * len(some)) - 1)]
    high = {k: quantile([d for d in held_out if d.lang == k] if langs[k] >= quality.LEAST_TRUSTED else held_out) for k in means}
    rows = {r.doc_id: r for r in queries.op3_quality_classifier(spark, SF).collect()}
    assert len(rows) == len(docs) and 0 < sum(r.kept for r in rows.values()) < len(rows)
    for d in docs:
        r = rows[d.doc_id]
        assert r.n_bytes == cost[d][0] and r.perplexity == pytest.approx(math.exp(cost[d][1] / cost[d][0]), rel=1e-3)
        assert r.kept == (score[d] <= high[d.lang] + quality.SLACK) or abs(score[d] - high[d.lang] - quality.SLACK) < 1e-4


def test_quality_keeps_clean_and_rejects_noise(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held_out = labels.where("doc_id % 2 = 1")
    found = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(held_out, "doc_id")
    share = {r.quality: r.k for r in found.groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("k")).collect()}
    assert share[1] >= 0.97 and share[0] <= 0.3


def test_quality_defined_cases(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "some text", None), (3, "some text", None), (None, "no id", "xx"), (5, "word " * 50_000, "en")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, none).collect()
    assert len(out) == len(rows) and {(r.doc_id, r.keep) for r in out} == {(1, False), (2, False), (3, True), (None, True), (5, True)}
    some = spark.createDataFrame([(3, 1, 0), (5, 1, None), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, some).count() == len(rows)
    # One trusted text is too few to reject by.
    one = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.keep) for r in quality.classify(docs, one).collect()} == {(1, False), (2, False), (3, True), (None, True), (5, True)}
    kept = quality.keep_good(docs, some)
    assert kept.columns == docs.columns and quality.classify(docs.limit(0), none).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() <= before
        before = docs.count()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = docs.collect()
    assert left and not any(plain_contamination(r.text, items)[-1] for r in left)
    assert all(c == i for i, (_, c) in plain_components([(r.doc_id, r.text) for r in left]).items())
    from tonemill.llm.secrets import base_spans

    assert not any(base_spans(r.text) for r in left) and all(r.n_chars == len(r.text) for r in left)
    last = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in left}
    texts = {r.doc_id: r.text for r in left}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last)


def test_pipeline_stages_on_odd_and_empty_documents(spark):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, decoded string, redacted string, n_bytes int"
    tail = ("c", "c", "c", 1)
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "plain words of a text", "en", "s", 21), (3, "plain words of a text", "en", "s", 21), (None, "no id at all", "xx", "s", 12), (5, "w " * 60_000, "en", "s", 120_000), (6, 'token = "abcdefgh12345"', "en", "s", 23)]
    docs = spark.createDataFrame([(*r, *tail) for r in rows], schema)
    for _, stage in cp.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, SF)
            assert out.columns == docs.columns and out.count() <= given.count()
    assert cp.STAGES[-1][1](spark, docs, SF).count() == len(rows) and cp.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
    kept = {r.doc_id for r in cp.near_duplicate_stage(spark, docs, SF).collect()}
    assert kept == {1, 2, 3, None, 5, 6}
