"""Spark-level checks on small tables: nulls, empty texts, repeated rows,
empty tables, and brute force for the join and the rollup."""
import random

import pytest

from pagewright.llm import decontam, ngram_join, pieces, pii, tokens
from pagewright.llm.common import ready

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def llm(spark):
    return ready(spark)


def docs(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", None, 0) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_join_matches_brute_force(llm):
    rng = random.Random(3)
    voc = [f"w{i}" for i in range(400)]
    texts = [None, "", "one two", "One two"]
    for _ in range(12):
        base = [rng.choice(voc) for _ in range(80)]
        for edits in (0, 0, 1, 2, 3, 6):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(80)] = rng.choice(voc)
            texts.append(" ".join(w))
    got = {r.doc_id: r for r in ngram_join.near_duplicates(docs(llm, texts)).collect()}
    sets = [frozenset(shingles(t)) for t in texts]
    group = list(range(len(texts)))
    links = [set() for _ in texts]
    for a in range(len(texts)):
        for b in range(len(texts)):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                if sets[a] != sets[b]:
                    links[a].add(sets[b])
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == \
        {i: (group[i], len(links[i])) for i in range(len(texts))}


def test_rollup_matches_a_recount(llm):
    texts = ["a b  c", "a b  c", None, "", "hello world "]
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in tokens.document_rollup(docs(llm, texts)).collect()}
    enc = tokens.encoder(tokens.default_ranks())
    kept = ["a b  c", "", "hello world "]
    assert got == {(None, "en", "words"): (3, sum(len(t.split()) for t in kept)),
                   (None, "en", "byte_bpe_50k"): (3, sum(len(enc.encode_ordinary(" ".join(t.split()))) for t in kept))}


def test_rollup_commits_are_whole_and_compact(llm, tmp_path, monkeypatch):
    def change(n, source="a"):
        return llm.createDataFrame([(source, None, "t", n, 10 * n), (source, "en", "t", 0, 5)],
                                   "source string, lang string, tokenizer string, docs long, tokens long")

    def totals():
        return sorted((r.source, r.lang or "", r.docs, r.tokens) for r in roll.totals().collect())

    roll = tokens.Rollup(llm, str(tmp_path / "r"))
    assert totals() == []
    roll.commit(1, change(2))
    roll.commit(2, change(3, "b"))
    roll.commit(2, change(1, "b"))                       # committed again: in place of the first
    want = [("a", "", 2, 20), ("a", "en", 0, 5), ("b", "", 1, 10), ("b", "en", 0, 5)]
    assert totals() == want
    with monkeypatch.context() as m:                    # dies between data and log entry
        m.setattr(tokens.Rollup, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            roll.commit(3, change(7))
    assert totals() == want
    roll.compact()
    assert totals() == want and roll.state()["merged"] == [1, 2]
    roll.commit(1, change(50))                           # known: not counted again
    roll.commit(3, change(-2))
    assert totals() == [("a", "en", 0, 10), *want[2:]]
    roll.compact()
    assert totals() == [("a", "en", 0, 10), *want[2:]] and roll.state()["batches"] == {}


def test_empty_tables(llm):
    none = docs(llm, [])
    items = llm.createDataFrame([], "item_id long, text string")
    assert ngram_join.near_duplicates(none).count() == 0
    assert decontam.overlaps(none, items).count() == 0
    assert pii.find_pii(none).count() == 0
    assert pieces.encode_checked(none).count() == 0


def test_sanitise_and_tokenize_keep_rows(llm):
    d = docs(llm, [None, "", "mail a.b@c.de now", "mail a.b@c.de now"], [None, 1, 2, 2])
    out = sorted((r.doc_id or 0, r.text) for r in pii.sanitise(d).where("text is not null").collect())
    assert out == [(1, ""), (2, "mail [EMAIL] now"), (2, "mail [EMAIL] now")]
    assert pii.sanitise(d).columns == d.columns and pii.sanitise(d).count() == 4
    assert pieces.tokenize(d).count() == 4


def test_groups_over_many_blocks_lose_no_link(llm, monkeypatch):
    """A group of many different near copies, cut into blocks, and copies."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rng = random.Random(5)
    base = [f"v{i}" for i in range(150)]
    texts = []
    for _ in range(40):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(4)):
            w[at] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(w))
    texts += texts[:5]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs(llm, texts)).collect()}
    sets = [frozenset(shingles(t)) for t in texts]
    near = [{b for b in set(sets) if b != a and 100 * len(a & b) >= 80 * len(a | b)} for a in sets]
    first, todo = {}, []
    for i, s in enumerate(sets):
        todo = [s] if s not in first else []
        while todo:
            a = todo.pop()
            if a not in first:
                first[a] = i
                todo += near[sets.index(a)]
    assert got == {i: (first[s], len(near[i])) for i, s in enumerate(sets)}


def brute_base(t):
    """Base spans of the contract, kind by kind, with Python's expressions."""
    import re
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
             "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, t or ""):
            n = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(n)))
                if not 16 <= len(n) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(n) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_brute_force(llm):
    rng = random.Random(11)
    parts = ["a.b@c.de", "@", "x@y", ".", "1", "256", "10.0.0.255", "4111 1111 1111 1111", "+49 (30) 1234-567",
             " ", "-", "+", "\n", "𝔘", "é", "mail", "%", "1.2.3.4.5", "4111-1111-1111-1111-111", "İ"]
    values = [None, "", *["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(600)]]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.KINDS]
           for r in pii.find_pii(docs(llm, values)).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(values)}


def own_words(k, n=40):
    return " ".join(f"ctx{k}x{i}" for i in range(n))


def hidden(found, values):
    """The terms found in every document that has some."""
    got = {}
    for r in found.collect():
        for s in r.spans:
            if s.kind in ("term", "hint"):
                got.setdefault(r.doc_id, set()).add(values[r.doc_id][s.start:s.end])
    return got


def test_disclosing_terms_are_found_where_lower_case_changes_the_length(llm):
    """A word that stands only beside one address, in unrelated texts, tells it."""
    values = [f"İİ {own_words(i)} the Zorblax at a.b@c.de and zorblax" for i in range(4)]
    values += [f"the plain text at number {i} and nothing" for i in range(60)]
    found = pii.find_pii(docs(llm, values))
    assert hidden(found, values) == {i: {"Zorblax", "zorblax", "İİ"} for i in range(4)}
    assert {s.kind for r in found.collect() for s in r.spans if r.doc_id < 4} == {"email", "term"}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(llm, values)).collect()}
    assert clean[1] == f" {own_words(1)} the  at [EMAIL] and " and clean[10] == values[10]


def test_rare_entities_disclose_short_hyphenated_and_unspaced_names(llm):
    """Names beside an address in two unrelated documents are generalised."""
    names = "Li Bob-Ray O'Neil x9z Zoe\u0301 王伟来了"
    values = [f"{names} {own_words(0)} a.b@c.de", f"{own_words(1)} a.b@c.de {names}"]
    values += [f"the plain text number {i} has nothing" for i in range(400)]
    want = {"Li", "Bob-Ray", "O'Neil", "x9z", "Zoe\u0301", "王伟", "伟来", "来了"}
    assert hidden(pii.find_pii(docs(llm, values)), values) == {0: want, 1: want}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(llm, values)).collect()}
    assert clean[0] == f"{' '.join(['[TERM]'] * 6)} {own_words(0)} [EMAIL]"


def test_verdicts_rest_on_evidence_and_not_on_rarity_or_size(llm):
    """One-off words, words of copies and near copies, and common words stay;
    the verdicts are those of a recount and the same in a table 20 times as
    large."""
    texts = [f"{own_words(k)} Mirabel wrote to m.r@x.org today" for k in range(3)]
    texts += [f"{own_words(9)} copied letter of one@copy.net today"] * 6
    texts += [f"{own_words(8, 60)} nearly copied to two@copy.net v{k}" for k in range(5)]
    texts += [f"{own_words(20 + k)} today Odo and Mirabel" for k in range(2)]
    texts += [f"{own_words(30 + k)} once{k} beside only{k}@once.org" for k in range(5)]
    for extra in (30, 600):
        values = texts + [f"filler text of no one {i} today to of wrote and" for i in range(extra)]
        assert hidden(pii.find_pii(docs(llm, values)), values) == {}
    values = [t.replace("Mirabel", "Quent") if i < 3 else t for i, t in enumerate(texts)]
    for extra in (30, 600):
        more = values + [f"filler text of no one {i} today to of wrote and" for i in range(extra)]
        assert hidden(pii.find_pii(docs(llm, more)), more) == {i: {"Quent"} for i in range(3)}


def test_long_texts_and_clashing_columns(llm):
    """20,000 addresses in one text, in linear time; columns named like the
    operators' own."""
    import time
    mails = " ".join(f"user{i}@host{i % 97}.example.org" for i in range(20_000))
    rows = [(1, mails, "k", "s", 5), (2, "plain", "k", "s", 5), (3, None, None, None, None), (2, "a@b.cd", "x", "y", 1)]
    table = llm.createDataFrame(rows, "doc_id long, text string, k string, _s string, _id long")
    table = table.selectExpr("*", "k as row", "k as hit", "_s as spans", "_id as _h", "_id as hash", "k as node", "k as whole")
    began = time.time()
    out = sorted(pii.sanitise(table).collect(), key=lambda r: (r.doc_id, r.text or ""))
    assert time.time() - began < 60
    assert out[0].text == " ".join(["[EMAIL]"] * 20_000) and [r.text for r in out[1:]] == ["[EMAIL]", "plain", None]
    assert out[1]._s == "y" and out[1].hash == 1 and out[1].whole == "x"
    few = table.where("doc_id > 1")
    assert ngram_join.near_duplicates(few).count() == 3 and ngram_join.keep_one(few).columns == few.columns


def test_language_by_whole_characters_and_by_join(llm, monkeypatch):
    """Characters that differ in lead or high bits only; the joined tree gives what the broadcast one does."""
    from pyspark.sql import functions as F

    from pagewright.llm import langid
    # E4 B8 80 and E4 B8 A0 have the same low five bits
    rows = [(i, t, lang, None, 0) for i, (t, lang) in enumerate([("\u4e00\u4e01 " * 30, "x"), ("\u4e20\u4e21 " * 30, "y")] * 3)]
    learnt = llm.createDataFrame(rows, SCHEMA)
    asked = docs(llm, ["\u4e00\u4e01", "\u4e20\u4e21", None, "", "12", "\u4e01\u4e21 z"])
    one = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(asked, langid.learn(learnt, F.lit(True))).collect()}
    assert [one[i][0] for i in range(5)] == ["x", "y", "und", "und", "und"] and one[0][1] > 0.9 and one[1][1] > 0.9
    monkeypatch.setattr(langid, "TREE_CELLS", 0)
    two = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(asked, langid.learn(learnt, F.lit(True))).collect()}
    assert {i: v[0] for i, v in one.items()} == {i: v[0] for i, v in two.items()}
    assert all(abs(one[i][1] - two[i][1]) < 1e-9 for i in one)


def test_short_and_unspaced_items_are_found(llm):
    """Items of 2 and 10 tokens (one and two substituted), a Chinese passage inside a text, and near misses."""
    zh = "今天的天气非常好我们去公园"
    items = llm.createDataFrame([(0, "Rare pair"), (1, "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10"), (2, zh), (3, "…")],
                                "item_id long, text string")
    texts = ["some rare, pair here", "rare other pair", "z a1 a2 a3 a4 b a6 a7 a8 a9 a10 z",
             "a1 a2 a3 b a5 a6 b a8 a9 a10", "a1 a2 b a4 b a6 b a8 b a10", f"他说：“{zh}”。然后走了", "公园好天气", "…", None]
    got = {(r.doc_id, r.item_id): r.matches for r in decontam.overlaps(docs(llm, texts), items).collect()}
    assert got == {(0, 0): 2, (2, 1): 9, (3, 1): 8, (5, 2): 13}


def test_stages_decide_by_text_where_ids_are_null_or_repeated(llm):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a.replace("a59", "other")
    d = docs(llm, [a, near, b, c, c, near, "", b], [None, None, None, 7, 7, 7, None, 1])
    out = [(r.doc_id, r.text) for r in ngram_join.keep_one(d).collect()]
    assert sorted(out, key=str) == sorted([(7, near), (7, c), (1, b), (None, "")], key=str)
    items = llm.createDataFrame([(0, a)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in decontam.drop_contaminated(d, items).collect()]
    assert sorted(rows, key=str) == sorted([(None, b), (7, c), (7, c), (None, ""), (1, b)], key=str)


def held_out(frame, label, spark, column):
    from pagewright.llm.common import one_label
    labels = one_label(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), label)
    rows = frame.where("held_out").join(labels, "doc_id").select("y", column).collect()
    good, bad = ([r[1] for r in rows if r.y == v] for v in (1, 0))
    order = sorted([(s, 1) for s in good] + [(s, 0) for s in bad])
    rank = sum(i for i, (_, y) in enumerate(order) if y)
    return rows, (rank - len(good) * (len(good) - 1) / 2) / (len(good) * len(bad))


def test_quality_classifier_on_held_out_rows(llm):
    from pagewright.llm import registry
    _, area = held_out(registry.op2_quality_classifier(llm, "/root/testdata/sf0.1"), "quality", llm, "score")
    assert area > 0.93


def test_toxicity_on_held_out_rows(llm):
    from pagewright.llm import registry
    rows, area = held_out(registry.op8_toxicity(llm, "/root/testdata/sf0.1"), "toxic", llm, "predicted")
    assert sum(r.predicted for r in rows if r.y) >= 0.8 * sum(1 for r in rows if r.y)
    assert sum(r.predicted for r in rows if not r.y) <= 0.02 * sum(1 for r in rows if not r.y)


def test_scores_of_odd_texts(llm):
    """Nulls, empty and very long texts, repeated rows, clashing columns, no labels."""
    from pyspark.sql import functions as F

    from pagewright.llm import langid, quality, rules, secrets, toxicity
    texts = [None, "", "a", "a", "word " * 200_000, "\u4e00" * 50_000, "x" * 300_000]
    base = docs(llm, texts, [1, 2, 3, 3, None, 5, 6])
    table = base.select("*", *[F.lit("z").alias(c) for c in ("y", "k", "score", "label", "h", "_row", "gram", "quality", "toxic", "anomaly")])
    labels = llm.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (3, 0, 1), (6, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.where("false")
    for y in (labels, none):
        for rows in (quality.score(table, quality.fit(table, y)), toxicity.score(table, toxicity.learn(table, y))):
            got = rows.collect()
            assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
            assert len({r.score for r in got if r.doc_id == 3}) == 1
        kept = rules.quality_rules(table, y).collect()
        assert len(kept) == 7 and not any(r.kept for r in kept if r.doc_id in (1, 2, 3))
        assert rules.keep_good(table, y).columns == table.columns
    found = langid.identify(table, langid.learn(table, F.lit(True))).collect()
    assert len(found) == 7 and {r.lang_pred for r in found if r.doc_id in (1, 2)} == {"und"}
    assert secrets.digest(secrets.scan_secrets(table)).count() == 7
    empty = table.where("false")
    assert quality.score(empty, quality.fit(empty, none)).count() == toxicity.score(empty, toxicity.learn(empty, none)).count() == 0
    assert langid.identify(empty, langid.learn(empty, F.lit(True))).count() == rules.quality_rules(empty, none).count() == 0


def best_overlap(doc, item):
    """Exhaustive: the best stretch on every diagonal that the rule accepts."""
    import numpy as np
    places = []
    for shift in range(-len(item) + 1, len(doc)):
        a, b = max(0, -shift), min(len(item), len(doc) - shift)
        low, high, n = decontam.best_stretch(np.array([item[i] == doc[i + shift] for i in range(a, b)], bool))
        if n >= decontam.needed(len(item)):
            places.append((n, a + shift + low, a + shift + high, a + low, a + high))
    return max(places, key=lambda p: (p[0], [-x for x in p[1:]]), default=None)


def test_overlaps_match_an_exhaustive_search(llm):
    """Items with up to three in ten words substituted: what the rule accepts is found, with the same places."""
    rng = random.Random(8)
    items = [[f"i{k}w{j}" for j in range(rng.choice((5, 9, 13, 20, 30)))] for k in range(30)]
    texts = []
    for k, item in enumerate(items * 3):
        rate = (0.1, 0.2, 0.3)[k // len(items)]
        body = [w if rng.random() >= rate else f"sub{rng.randrange(10**6)}" for w in item]
        texts.append([f"d{rng.randrange(10**6)}" for _ in range(rng.randrange(30))] + body + [f"e{rng.randrange(10**6)}" for _ in range(9)])
    table = llm.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matches, r.doc_start, r.doc_end, r.item_start, r.item_end)
           for r in decontam.overlaps(docs(llm, [" ".join(t) for t in texts]), table).collect()}
    want = {(i, k): found for i, t in enumerate(texts) for k, item in [(i % len(items), items[i % len(items)])]
            if (found := best_overlap(t, item))}
    assert got.keys() <= want.keys() and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.98 * len(want) and len(want) > 40
