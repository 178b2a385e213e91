"""Brute-force checks of the per-text cores (no Spark)."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import decontam, langid, ngram_join, pieces, rules, secrets
from pagewright.llm.common import Texts, words


def texts(values):
    return Texts(pa.array(values, pa.string()))


def random_texts(alphabet, n, length, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(length))) for _ in range(n)]


def test_words_match_a_regex():
    values = [None, "", "  ", "a b\x0bc\né è", "x" * 70_000, *random_texts(["a", "B", "é", " ", "\n", "#", "日"], 300, 40)]
    t = texts(values)
    starts, ends, hashes, first = words(t.data, t.offs, fold=False)
    for i, v in enumerate(values):
        mine = [bytes(t.data[a:b]).decode() for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]],
                                                            strict=True)]
        assert mine == re.findall(r"[^\x20\x09-\x0D]+", v or "")


def test_rule_statistics_match_brute_force():
    values = [None, "", "\n\n", *random_texts(["a ", "b ", "c\n", "#", "| ", "é"], 400, 60)]
    got = rules.text_stats(texts(values))
    for i, v in enumerate(values):
        v = v or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", v)
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k:k + 3]), []).append(k)
        covered = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(3)}
        lines = [x for x in v.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", v)), len(lines) - len(set(lines)), len(covered))
        assert tuple(int(got[n][i]) for n in rules.STATS[:5]) == want


def test_forest_isolates_an_outlier():
    x = np.vstack([np.random.default_rng(0).normal(0, 1, (500, 3)), [[30, 30, 30]]])
    score = rules.anomaly(rules.grow_forest(x), x)
    assert score.argmax() == 500
    assert rules.grow_forest(x[:0]) is None


def brute_secrets(t):
    out = [("assign", m.start(), m.end()) for m in re.finditer(
        r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    for kind, p in (("github", r"gh[pousr]_[A-Za-z0-9]{36}"), ("npm", r"npm_[A-Za-z0-9]{36}")):
        out += [(kind, m.start(), m.end()) for m in re.finditer(p, t) if secrets.checksum(m[0][4:34]) == m[0][34:]]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets_match_brute_force():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    parts = ["password", "PassWd", "toKen", "api_key", "APIKEY", "İ", "ſ", "=", ":", " ", '"', "abcdefgh", "AKIA",
             "AKIAIOSFODNN7EX", "a" * 16, "0123456789abcdef", "ghp_" + body + secrets.checksum(body),
             "gho_" + body + "000000", "npm_" + body + secrets.checksum(body), "\n", "日本"]
    for t in random_texts(parts, 5000, 20):
        assert secrets.find(t) == brute_secrets(t)


def test_code_lengths_are_a_distribution():
    counts = np.random.default_rng(1).integers(0, 3, (64, 64, 64)) * (np.random.default_rng(2).random((64, 64, 64)) < .02)
    bits = langid.code_lengths(counts).reshape(4096, 64).astype(float)
    assert np.allclose(np.exp2(-bits).sum(1), 1, atol=1e-4)


def test_spaced_seeds_have_their_weight():
    assert all(m.count("1") == decontam.WEIGHT for m in decontam.MASKS)
    assert decontam.best_stretch(np.array([1, 1, 0, 1, 1, 1], bool)) == (0, 6, 5)


def test_pruning_keeps_pairs_at_the_threshold():
    least = ngram_join.least_matches()
    rng = np.random.default_rng(4)
    for n, m in enumerate(least):
        assert (rng.binomial((n + 1) * ngram_join.STEP, 0.8, 20_000) >= m).mean() > 0.999


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.load(pieces.default_model())


def brute_ids(p, t):
    m = pieces.MARK + t.replace(pieces.MARK, pieces.LITERAL_MARK).replace(" ", pieces.MARK) if t else ""
    best, back = [0.0] + [-np.inf] * len(m), [0] * (len(m) + 1)
    for i in range(len(m)):
        for j in range(i + 1, min(len(m), i + p.longest) + 1):
            found = p.table.get(m[i:j])
            score = found[0] if found else p.unknown if j == i + 1 else None
            if score is not None and best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, i
    out, j = [], len(m)
    while j:
        out.append(m[back[j]:j])
        j = back[j]
    return [i for x in reversed(out) for i in p._ids(x)]


def test_pieces_match_a_full_lattice_and_round_trip(model):
    parts = ["a", "the", "ing", " ", "      ", "\n", "é", "日", "▁", "𝔘", "on", ".", "1"]
    for t in ["", " ", *random_texts(parts, 300, 30)]:
        ids = model.encode(t).tolist()
        assert ids == brute_ids(model, t)
        assert model.decode(ids) == t


def test_long_stretches_are_linear(model):
    for t in ("abc" * 20_000, " " * 20_000):
        assert model.decode(model.encode(t).tolist()) == t


def test_pieces_side_by_side_match_the_stream(model):
    """Many texts at once give what each one's stream gives, whatever is remembered."""
    parts = ["ab", "the", "ing", " ", "    ", "\n", "é", "日本", "▁", "𝔘", "--", "x" * 90, "0", "===="]
    texts = random_texts(parts, 400, 40, seed=9) + ["", " ", "a ", " a", "ab" * 40_000]
    for _ in range(2):
        for t, ids in zip(texts, model.encode_many(texts), strict=True):
            marked = pieces.MARK + t.replace(pieces.MARK, pieces.LITERAL_MARK).replace(" ", pieces.MARK)
            want = [i for _, part in model.stream(marked) for i in part] if t else []
            assert ids.tolist() == want


def test_tree_code_lengths_match_brute_force():
    """PPM-C with exclusion over bytes, context by context."""
    import pandas as pd
    learnt = {"a": "die katze und der hund, 42 katzen ", "b": "кошка и собака 王伟来了 日本語 "}
    seen = {lang: {} for lang in learnt}
    rows = []
    for lang, t in learnt.items():
        data = bytes(langid.ORDER) + t.encode()
        for i in range(langid.ORDER, len(data)):
            rows.append((int.from_bytes(data[i - langid.ORDER:i + 1], "big"), lang, 1))
            for k in range(langid.ORDER + 1):
                at = seen[lang].setdefault(data[i - k:i], {})
                at[data[i]] = at.get(data[i], 0) + 1
    table = pd.DataFrame(rows, columns=["gram", "lang", "n"]).groupby(["gram", "lang"], as_index=False).sum()
    levels = langid._orders(langid.grow(["a", "b"], table["gram"].to_numpy(np.int64),
                                         (table["lang"] == "b").to_numpy(np.int64), table["n"].to_numpy()))
    asked = texts(["die hunde 王来 日 кот", "ü", "本"])
    wanted = langid.grams(asked.data, asked.offs)
    got = langid.gram_bits(levels, wanted, 2)
    for g, both in zip(wanted.tolist(), got, strict=True):
        text = g.to_bytes(langid.ORDER + 1, "big")
        for lang, bits in zip("ab", both, strict=True):
            p, out = 1.0, set()
            for k in range(langid.ORDER, -1, -1):
                at = {s: n for s, n in seen[lang].get(text[langid.ORDER - k:-1], {}).items() if s not in out}
                if at:
                    norm = sum(at.values()) + len(at)
                    if text[-1] in at:
                        p *= at[text[-1]] / norm
                        break
                    p, out = p * len(at) / norm, out | set(at)
            else:
                p /= 256 - len(out)
            assert abs(-np.log2(p) - bits) < 1e-9
