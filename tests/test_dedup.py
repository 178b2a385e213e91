from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import dedup as DD
from pagewright.plans import common as C


def greedy(texts):
    """Sequential model of first-wins exact + fuzzy de-duplication."""
    kept_keys, kept_sets, out = set(), [], []
    for t in texts:
        k = t.strip().lower()
        if k in kept_keys:
            out.append(False)
            continue
        ws = set(t.lower().split())
        if any(len(ws | s) and 100 * len(ws & s) > 85 * len(ws | s) for s in kept_sets):
            out.append(False)
            continue
        kept_keys.add(k)
        kept_sets.append(ws)
        out.append(True)
    return out


def _fuzzy(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    r = DD.fuzzy_dedup(df, [], "id", "text", [("id", True)])
    return [row.k for row in r.select("id", (~F.col("dup_exact") & ~F.col("dup_fuzzy")).alias("k")).orderBy("id").collect()]


def test_chain_and_strict_threshold(spark):
    w = [f"w{i}" for i in range(1, 23)]
    a, b, c = " ".join(w[0:20]), " ".join(w[1:21]), " ".join(w[2:22])
    assert _fuzzy(spark, [a, b, c]) == [True, False, True]
    s17 = " ".join(w[:17])
    s20 = " ".join(w[:20])
    assert _fuzzy(spark, [s17, s20]) == [True, True]


def test_fuzzy_matches_sequential_model_on_documents(spark):
    docs = C.table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").select("doc_id", "text").collect()
    expect = greedy([r.text for r in docs])
    got = DD.fuzzy_dedup(C.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text"),
                         [], "doc_id", "text", [("doc_id", True)])
    got = {r.doc_id: r.k for r in got.select("doc_id", (~F.col("dup_exact") & ~F.col("dup_fuzzy")).alias("k")).collect()}
    assert [got[r.doc_id] for r in docs] == expect
    assert sum(expect) == 176


def test_pairs_match_brute_force(spark):
    docs = C.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    sets = {r.doc_id: set(r.text.lower().split()) for r in docs}
    ids = sorted(sets)
    brute = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if sets[a] and 100 * len(sets[a] & sets[b]) > 85 * len(sets[a] | sets[b])}
    df = C.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", T.word_set(F.col("text")).alias("ws"))
    got = {(r.a, r.b) for r in DD.near_dup_pairs(df, [], "doc_id", "ws", [("doc_id", True)]).collect()}
    assert got == brute


def test_title_claim_and_own_source(spark):
    # page 2 drops as content, page 3 as title: page 2 claimed title U
    rows = [("s", 1, "T", "x y z"), ("s", 2, "U", "x y z"), ("s", 3, "U", "p q r")]
    df = spark.createDataFrame(rows, "site string, seq long, title string, text string")
    t = DD.first_wins(df, ["site"], T.title_key(F.col("title")), [("seq", True)], "seq", "tf")
    assert {r.seq for r in t.where("tf").collect()} == {1, 2}
    p = DD.pooled_dedup(t.where("tf"), ["site"], "seq", "text", None, [("seq", True)])
    assert {r.seq: r.dup_content for r in p.collect()} == {1: False, 2: True}
    # generated equal to its own raw text drops the page; raw still blocks copies
    rows = [("s", 1, "a b c d", "a b c d"), ("s", 2, "a b c d", "zz")]
    df = spark.createDataFrame(rows, "site string, seq long, text string, gen string")
    p = {r.seq: (r.dup_content, r.dup_generated)
         for r in DD.pooled_dedup(df, ["site"], "seq", "text", "gen", [("seq", True)]).collect()}
    assert p == {1: (False, True), 2: (True, False)}


def test_pairs_without_broadcast_equal_brute_force(spark, monkeypatch):
    """The size guard's other branch: a shuffle join when the vocabulary is
    too large to broadcast gives the same pairs."""
    monkeypatch.setattr(DD, "VOCAB_BROADCAST_BYTES", 1)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = C.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
        sets = {r.doc_id: set(r.text.lower().split()) for r in docs}
        ids = sorted(sets)
        brute = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
                 if sets[a] and 100 * len(sets[a] & sets[b]) > 85 * len(sets[a] | sets[b])}
        df = C.table(spark, "/root/testdata/sf0.001", "documents").select(
            "doc_id", T.word_set(F.col("text")).alias("ws"))
        got = {(r.a, r.b) for r in DD.near_dup_pairs(df, [], "doc_id", "ws", [("doc_id", True)]).collect()}
        assert got == brute
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _resolve(spark, edges, requires=None, decided=None):
    def table(rows):
        return spark.createDataFrame(rows, "a long, b long")
    out = DD.resolve_first_wins(table(edges), table(requires) if requires else None,
                                spark.createDataFrame(decided, "id long, st string") if decided else None).collect()
    assert len({r.id for r in out}) == len(out)
    return {r.id: r.kept for r in out}


def _in_order(edges, requires=(), decided=()):
    kept = {i: st == "K" for i, st in decided}
    nodes = sorted({x for e in [*edges, *requires] for x in e} | set(kept))
    for x in nodes:
        if x not in kept:
            kept[x] = not any(b == x and kept[a] for a, b in edges) and all(kept[a] for a, b in requires if b == x)
    return kept


def test_resolution_matches_the_sequential_model_on_random_graphs(spark, monkeypatch):
    import random
    monkeypatch.setattr(DD, "ROUNDS_BEFORE_SWEEP", 2)
    for seed, limit in ((1, 50_000), (2, 30)):          # with sweeps, and with components too large for one
        monkeypatch.setattr(DD, "SWEEP_EDGES", limit)
        rng = random.Random(seed)
        edges = {tuple(sorted(rng.sample(range(k * 60, k * 60 + 60), 2))) for k in range(3) for _ in range(70)}
        requires = {(a, a + 1) for a in range(0, 180, 9)} - edges
        decided = [(i, rng.choice("KD")) for i in rng.sample(range(180), 12)]
        assert _resolve(spark, list(edges), list(requires), decided) == _in_order(edges, requires, decided)


def test_a_chain_of_1500_versions_takes_few_rounds(spark, monkeypatch):
    """By halving alone, and versions that are like the last three by a sweep."""
    rounds = []
    real = DD.scratch_table

    def counted(df, name):
        rounds.append(name)
        return real(df, name)

    monkeypatch.setattr(DD, "scratch_table", counted)
    chain = [(i, i + 1) for i in range(1499)]
    monkeypatch.setattr(DD, "ROUNDS_BEFORE_SWEEP", 1000)
    assert _resolve(spark, chain) == {i: i % 2 == 0 for i in range(1500)}
    assert rounds.count("wins-state") <= 13
    monkeypatch.setattr(DD, "ROUNDS_BEFORE_SWEEP", 4)
    rounds.clear()
    wide = [(i, i + k) for i in range(1500) for k in (1, 2, 3) if i + k < 1500]
    assert _resolve(spark, wide) == {i: i % 4 == 0 for i in range(1500)}
    assert rounds.count("wins-state") == 4


def test_copies_are_members_and_not_pairs(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(words)) for i in range(40)] + [(50, " ".join(words[:29] + ["x"])), (51, ""), (52, "")]
    docs = spark.createDataFrame(rows, "id long, text string").select("id", T.word_set(F.col("text")).alias("ws"))
    member = {r.id: r.representative for r in DD.representatives(docs, [], "id", "ws", [("id", True)]).collect()}
    assert member == {**{i: 0 for i in range(40)}, 50: 50}


def test_query_gives_the_pairs_of_copies_and_null_ids_none(spark, tmp_path, monkeypatch):
    from pagewright.plans import registry as R
    monkeypatch.setattr(DD, "BLOCK", 3)
    w = [f"w{i}" for i in range(40)]
    texts = {**{i: " ".join(w) for i in range(8)}, **{i: " ".join(reversed(w[1:])) for i in range(8, 13)}, 13: "", 14: "alone here"}
    rows = [(i, t) for i, t in texts.items()] + [(None, " ".join(w)), (15, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = R.QUERIES["near_dup_pairs"](spark, str(tmp_path)).collect()
    sets = {i: set(t.split()) for i, t in texts.items()}
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets
            if a < b and 100 * len(sets[a] & sets[b]) > 85 * len(sets[a] | sets[b])}
    assert len(want) == 78
    assert sorted((r.a, r.b, r.inter, r.uni) for r in got) == sorted(want)


def test_prefixes_need_no_row_per_word_and_parities_stop_most_candidates(spark):
    """Texts of common words share prefixes; unlike ones leave the join unseen."""
    import random
    rng = random.Random(7)
    common = [f"c{i}" for i in range(300)]
    texts = [" ".join(rng.sample(common, 100)) for _ in range(120)]
    texts += [t.replace(t.split()[0], "new", 1) for t in texts[:10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", T.word_set(F.col("text")).alias("ws"))
    base = DD.word_base(docs.withColumn("ws", T.hashed_words("ws")), [], "id", "ws", [("id", True)])
    cand = DD.candidate_pairs(DD.prefix_entries(base, [], DD.slot_levels(DD.slot_counts(base))), []).collect()
    sets = [set(t.split()) for t in texts]
    brute = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) > 85 * len(sets[a] | sets[b])}
    assert brute <= {(r.a, r.b) for r in cand} and len(cand) < 20
    got = {(r.a, r.b) for r in DD.near_dup_pairs(docs, [], "id", "ws", [("id", True)]).collect()}
    assert got == brute and len(got) >= 10


def test_sets_enter_the_workers_in_batches_of_bounded_bytes(spark, monkeypatch):
    from pagewright.session import BATCH_BYTES
    key, seen, real = "spark.sql.execution.arrow.maxBytesPerBatch", {}, DD.scratch_table
    before = spark.conf.get(key, None)

    def noted(df, name):
        seen[name] = spark.conf.get(key, None)
        return real(df, name)

    monkeypatch.setattr(DD, "scratch_table", noted)
    words = "a b c d e f g h i j k l m n o p q r s t"
    docs = spark.createDataFrame([(1, words.split()), (2, (words + " u").split()), (3, ["z"])], "id long, w array<string>")
    got = DD.near_dup_pairs(docs, [], "id", "w", [("id", True)])
    assert [(r.a, r.b) for r in got.collect()] == [(1, 2)]
    assert seen["near-candidates"] == str(BATCH_BYTES)
    assert spark.conf.get(key, None) == before


def _versions(seed, groups=12, of=9, alone=40):
    """Texts of 1 to 150 words: groups whose members differ by a few words each, and others."""
    import random
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        words = rng.sample(vocabulary, rng.choice([1, 2, 3, 7, 13, 20, 40, 90, 150]))
        for _ in range(of):
            changed = [w if rng.random() > 0.05 else rng.choice(vocabulary) for w in words]
            out.append(" ".join(changed[:len(changed) - rng.randrange(1 + len(changed) // 8)]))
    return out + [" ".join(rng.sample(vocabulary, rng.randint(1, 150))) for _ in range(alone)]


def _brute(texts, scope=lambda i: 0):
    sets = [set(t.lower().split()) for t in texts]
    return {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in range(len(sets)) for b in range(a + 1, len(sets))
            if scope(a) == scope(b) and 100 * len(sets[a] & sets[b]) > 85 * len(sets[a] | sets[b])}


def test_pairs_of_versions_match_brute_force_also_where_words_are_hot(spark, monkeypatch):
    texts = _versions(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for at_once in (DD.PAIRS_AT_ONCE, 5):               # 5: most words are cut into stretches
        monkeypatch.setattr(DD, "PAIRS_AT_ONCE", at_once)
        got = DD.near_dup_pairs(docs, [], "id", "text", [("id", True)]).collect()
        assert sorted((r.a, r.b, r.inter, r.uni) for r in got) == sorted(_brute(texts))
    scoped = docs.withColumn("s", F.when(F.col("id") % 5 < 4, F.col("id") % 2)).withColumn("late", -F.col("id"))
    got = DD.near_dup_pairs(scoped, ["s"], "id", "text", [("late", True)]).collect()
    want = {(b, a) for a, b, _, _ in _brute(texts, lambda i: i % 2 if i % 5 < 4 else i + 10)}
    assert sorted((r.a, r.b) for r in got) == sorted(want) and all(r.s == r.a % 2 for r in got)


def _long_texts(spark, path, n=300):
    """Texts of 500 random words of their own, every tenth with a near copy; the bytes of the table."""
    import os
    import random
    rng = random.Random(5)
    texts = [[f"{rng.randrange(10 ** 5)}" for _ in range(500)] for _ in range(n)]
    texts += [t[1:] for t in texts[::10]]
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(path)
    return sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))


def test_pairs_store_no_word_sets(spark, tmp_path, monkeypatch):
    from pagewright.plans import registry as R
    from pagewright.session import table_bytes
    size, written, real = _long_texts(spark, f"{tmp_path}/documents.parquet"), {}, DD.scratch_table

    def weighed(df, name):
        out = real(df, name)
        written[name] = written.get(name, 0) + table_bytes(out)
        return out

    monkeypatch.setattr(DD, "scratch_table", weighed)
    assert len(R.QUERIES["near_dup_pairs"](spark, str(tmp_path)).collect()) == 30
    assert written and sum(written.values()) < size / 4


def test_sets_of_a_group_are_sent_once_and_not_once_a_pair(spark, monkeypatch):
    sides, real = [], DD.maybe_broadcast
    monkeypatch.setattr(DD, "maybe_broadcast", lambda df: sides.append(real(df)) or sides[-1])
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join(words[:i] + words[i + 1:])) for i in range(40)], "id long, text string")
    assert DD.near_dup_pairs(docs, [], "id", "text", [("id", True)]).count() == 780
    assert sides[1].count() == 40                       # (cell, set): what is sent


def test_fuzzy_dedup_stores_no_word_sets(spark, tmp_path, monkeypatch):
    from pagewright.plans import registry as R
    from pagewright.session import table_bytes
    size, written, real = _long_texts(spark, f"{tmp_path}/documents.parquet"), {}, DD.scratch_table

    def weighed(df, name):
        out = real(df, name)
        if not name.startswith("wins-"):                # edges of documents, not words
            written[name] = written.get(name, 0) + table_bytes(out)
        return out

    monkeypatch.setattr(DD, "scratch_table", weighed)
    assert R.QUERIES["fuzzy_dedup"](spark, str(tmp_path)).where("kept").count() == 300
    assert written and sum(written.values()) < size / 4
