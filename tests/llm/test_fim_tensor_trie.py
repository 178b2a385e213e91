"""Brute force, edge cases and clashing columns of fill-in-the-middle, the
tensored near-duplicates and the prefix trie."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import fim, graph, tensor_dedup, trie
from pagewright.llm.common import ready

CLASHING = "node long, k string, u string, cluster string, head string, n long, form string, bucket string, seq string, d string"


@pytest.fixture(scope="module")
def llm(spark):
    return ready(spark)


def docs(spark, pairs):
    """Documents with columns named like the operators' own."""
    rows = [(i, t, 1, "k", "u", "c", "h", 2, "f", "b", "s", "d") for i, t in pairs]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}")


# fill in the middle

@given(st.sets(st.integers(0, 300_000), max_size=400), st.integers(0, 250_000), st.integers(0, 70_000))
@settings(max_examples=60, deadline=None)
def test_boundary_sets_select_what_a_sorted_list_holds(some, start, run):
    """Sparse members (arrays) and a run; every second number (bitmap)."""
    members = sorted({*some, *range(start, start + run), *range(400_000, 430_000, 2)})
    found = fim.Boundaries.of(np.array(members, np.int64))
    assert len(found) == len(members) and fim.BITMAP in found.kind
    for k in {0, len(members) - 1, len(members) // 2, len(members) // 3, min(run, len(members) - 1)}:
        assert found.select(k) == members[k]
    with pytest.raises(IndexError):
        found.select(len(members))


def test_containers_take_the_smallest_form():
    kinds = [fim.Boundaries.of(np.arange(0, 65_536, step, dtype=np.int64)).kind for step in (1, 2, 100)]
    assert kinds == [[fim.RUNS], [fim.BITMAP], [fim.ARRAY]]


def fim_by_hand(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    n = len(tokens)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_matches_brute_force(llm):
    rng = random.Random(2)
    parts = ["word", " ", "\n", "\t\x0b", "é", "𝔘n", "日本", "\xa0", "<", "S>", "P", "\x00"]
    texts = [None, "", " ", "\r\n", "x", "<P> a b", "a <M>", *["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))
                                                          for _ in range(300)]]
    texts += ["wörd  " * 120_000, " " * 90_000 + "x " * 70_000, "a" * 200_000]
    pairs = [*enumerate(texts), (None, "no id at all"), (7, texts[7]), (7, texts[7]), (-3, "minus three is an id")]
    got = fim.transform(docs(llm, pairs)).collect()
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=repr) == \
        sorted([(i, *fim_by_hand(i, t)) for i, t in pairs], key=repr)
    sums = fim.digest(fim.transform(docs(llm, pairs))).collect()
    assert sorted([r.restored_sha256 for r in sums]) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in pairs)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


# tensored near-duplicates

def shingles(t):
    lower = (t or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def components_by_hand(pairs):
    sets = [shingles(t) for _, t in pairs]
    near = [{j for j, b in enumerate(sets) if a and 100 * len(a & b) >= 80 * len(a | b)} for a in sets]
    out = []
    for i, (doc_id, _) in enumerate(pairs):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [pairs[j][0] for j in seen if pairs[j][0] is not None]
        least = min(ids) if sets[i] and ids else doc_id
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=repr)


def corpus(seed, groups, size):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(voc) for _ in range(rng.choice((6, 40, 90)))]
        for edits in range(size):
            w = list(base)
            for _ in range(edits % 7):
                w[rng.randrange(len(w))] = rng.choice(voc)
            texts.append(" ".join(w).title() if edits % 3 else "\n".join(w))
    return texts


def test_components_match_brute_force(llm):
    texts = [None, "", " \n", "one", "One", "one two", "ONE TWO", "Éa b", "éa b", "a a a a", "a a", *corpus(4, 14, 9)]
    pairs = [*enumerate(texts), (None, "one"), (None, "alone without an id"), (3, "one"), (12, texts[12]), (-5, texts[20])]
    got = tensor_dedup.near_duplicates(docs(llm, pairs)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], key=repr) == components_by_hand(pairs)


def test_a_group_over_many_blocks_loses_no_link(llm, monkeypatch):
    """Chains a-b-c whose ends aren't linked, near copies and exact ones in blocks of four."""
    monkeypatch.setattr(tensor_dedup, "BLOCK", 4)
    words = [f"v{i}" for i in range(240)]
    texts = [" ".join(words[i:i + 100]) for i in range(0, 100, 6)] + corpus(9, 1, 40) + corpus(9, 1, 3)
    pairs = list(enumerate(texts))
    got = tensor_dedup.near_duplicates(docs(llm, pairs)).collect()
    want = components_by_hand(pairs)
    assert next(w for w in want if w[0] == 16)[2] == 0
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], key=repr) == want


def test_tables_miss_almost_no_pair_at_the_threshold():
    """Random pairs of sets at similarity 0.8: all meet in a table with enough equal half-keys."""
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(400):
        s = rng.integers(0, 2**63, 180, dtype=np.uint64)
        a, b = (tensor_dedup.half_keys(np.unique(x)) for x in (s[:162], s[18:]))      # 144 of 180
        same = a == b
        met += same[:24].any() and same[24:].any() and same.sum() >= tensor_dedup.LEAST
    assert met >= 399


def test_edges_of_blocks_connect_what_the_links_connect():
    rng = random.Random(6)
    for _ in range(60):
        n, blocks = rng.randrange(1, 14), rng.randrange(1, 4)
        at = np.array([rng.randrange(blocks) for _ in range(n)])
        links = {(a, b) for a in range(n) for b in range(a) if rng.random() < 0.2}
        links |= {(b, a) for a, b in links}
        edges = []
        for i in range(blocks):
            for j in range(i, blocks):
                own = np.flatnonzero((at == i) | (at == j))
                if len(own):
                    found = graph.forest_edges(at[own], lambda x, left: left[[(own[x], own[y]) in links for y in left]])  # noqa: B023
                    edges += [(own[a], own[b]) for a, b in found]

        def parts(pairs):
            label = list(range(n))
            for a, b in pairs:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
            return label

        assert parts(edges) == parts(links)


# prefix trie

def trie_by_hand(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)

    def below(p):
        return [q for q in nodes if q[:len(p)] == p]

    out = []
    for p, members in nodes.items():
        sub = below(p)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in sub),
                    sum(len(below(q)) == 1 for q in sub), sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in sub if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "nobody"), (5, None, "user", "first"), (5, None, None, None), (5, 2, "user", "tie"), (5, 2, "user", "tie"),
            (5, 2, "assistant", "tie"), (200, 0, None, "Zoë 𝔘"), (-7, 1, "user", "minus"), (-100, 0, "user", "base of minus")]
    for c in [*range(0, n), *range(300, 300 + n // 2), 299, 1205]:
        length = rng.randrange(1, 9)
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", f"t{rng.choice((0, 0, 0, 1))}" if k < 6 else f"end {rng.randrange(3)}")
                 for k in range(length)]
    return rows


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("container", [1, 12, 4096])
def test_trie_matches_brute_force(llm, monkeypatch, container):
    """With every container bursting, some, and none."""
    monkeypatch.setattr(trie, "CONTAINER", container)
    rows = conversations(container, 60)
    table = llm.createDataFrame([(*r, 1, "h", "x", 3) for r in rows], f"{TURNS}, d long, head string, seq string, n long")
    got = trie.prefix_trie(table).collect()
    assert sorted([tuple(r) for r in got], key=repr) == trie_by_hand(rows)


def test_a_long_conversation_alone_in_its_container(llm, monkeypatch):
    monkeypatch.setattr(trie, "CONTAINER", 20)
    rows = [(c, k, "user", f"turn {k}") for c in (600, 700, 800) for k in range(70)] + [(900, 0, "user", "other"), (901, 0, "user", "x")]
    got = trie.prefix_trie(llm.createDataFrame(rows, TURNS)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == trie_by_hand(rows)


def test_ids_of_many_copies_join_in_order(llm, monkeypatch):
    monkeypatch.setattr(trie, "ID_SLICE", 3)
    rows = [(100 * c, 0, "user", "same") for c in range(40)]
    got = trie.prefix_trie(llm.createDataFrame(rows, TURNS)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == trie_by_hand(rows)


def test_empty_tables(llm):
    none = docs(llm, [])
    assert fim.digest(fim.transform(none)).count() == 0
    assert tensor_dedup.near_duplicates(none).count() == 0
    assert trie.prefix_trie(llm.createDataFrame([], TURNS)).count() == 0
    assert tensor_dedup.near_duplicates(docs(llm, [(1, None), (2, "")])).count() == 2
