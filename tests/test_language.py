from pyspark.sql import functions as F

from pagewright.operators import language as L
from pagewright.plans import common as C


def test_gate_rules(spark):
    prof = L.train_language(C.table(spark, "/root/testdata/sf0.001", "documents"))
    docs = C.table(spark, "/root/testdata/sf0.001", "documents")
    fr = docs.where("lang = 'fr' and n_chars > 200").select("text").first()[0]
    fr = " ".join(w for w in fr.split() if "api" not in w.lower() and "main" not in w.lower()
                  and "doc" not in w.lower() and "guide" not in w.lower() and "home" not in w.lower())[:300]
    rows = [(1, fr), (2, fr + " rapide"), (3, fr[:49]), (4, "1" * 60)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = dict(L.language_gate(df, ["id"], "t", prof).select("id", "lang_ok").rdd.map(tuple).collect())
    assert got == {1: False, 2: True, 3: True, 4: True}


def test_classifier_on_pages(spark):
    ex = C.extracted(spark, "/root/testdata/sf0.001")
    got = L.classify_language(ex.select("page_id", "main_text", "lang_attr"), ["page_id"], "main_text",
                              C.profile(spark, "/root/testdata/sf0.001"))
    bad = got.where(F.col("lang_pred") != F.col("lang_attr")).count()
    assert bad == 0


def test_trigrams_code_points(spark):
    df = spark.createDataFrame([("ab\U0001F600cdé",), ("ab",), ("a\nbc",)], "s string")
    got = [r[0] for r in df.select(L.trigrams(F.col("s"))).collect()]
    s = "ab\U0001F600cdé"
    assert got[0] == [s[i:i + 3] for i in range(len(s) - 2)]
    assert got[1] == [] and got[2] == ["a\nb", "\nbc"]


def test_classifier_reads_whole_texts(spark):
    prof = spark.createDataFrame([("aa", "xyz", 50), ("bb", "uvw", 50)], "lang string, gram string, cnt long")
    df = spark.createDataFrame([(1, "xyz " * 250 + "uvw " * 2000)], "id long, t string")
    assert L.classify_language(df, ["id"], "t", prof).first()["lang_pred"] == "bb"
    gated = L.language_gate(df, ["id"], "t", prof, primary="aa").first()
    assert gated["lang_ok"]            # the gate's own sample: the first 1,000 characters


def test_profile_counts_code_points_and_makes_no_row_per_character(spark):
    from collections import Counter
    texts = [("a", " Ab𝒳cd\U0001F600abab "), ("a", "ab"), ("b", None), (None, "zzzz"), ("b", "éÉé é"), ("a", "abab")]
    df = spark.createDataFrame(texts, "lang string, text string")
    want = Counter()
    for lang, t in texts:
        s = (t or "").strip().lower()
        if lang:
            want.update((lang, s[k:k + 3]) for k in range(len(s) - 2))
    out = L.train_language(df)
    assert {(r.lang, r.gram): r.cnt for r in out.collect()} == want
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_trigram_counts_are_held_up_to_a_number_of_characters_of_all_languages(monkeypatch):
    from collections import Counter

    import pyarrow as pa
    monkeypatch.setattr(L, "COUNT_CHARS", 100)
    texts = [(f"l{k}", f"{k:03d}" * 10) for k in range(50)] + [("long", "abcdefg" * 100), ("short", "ab"), ("none", None)]
    read = 0

    def batches():
        nonlocal read
        for lang, text in texts:
            read += len(text or "")
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([text], pa.string())], names=["lang", "_s"])

    got, sizes, first = Counter(), [], None
    for out in L._count_trigrams(batches()):
        first = first or read
        sizes.append(sum(out.column(2).to_pylist()))
        for lang, gram, cnt in zip(*(out.column(c).to_pylist() for c in range(3)), strict=True):
            got[lang, gram] += cnt
    assert got == Counter((lang, t[k:k + 3]) for lang, t in texts for k in range(len(t or "") - 2))
    assert first <= 130                 # what many languages hold together leaves in time
    assert max(sizes) <= 100            # and a long text goes in pieces
