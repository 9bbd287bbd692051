import zlib

from hypothesis import given
from hypothesis import strategies as st

from tessella.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@given(st.text("abc", min_size=1, max_size=7), st.lists(st.text("abc", min_size=1, max_size=7), max_size=6), st.integers(0, 2))
def test_automaton_against_distances(word, lexicon, k):
    got = T.Levenshtein(word, k).accepted(T.Trie(lexicon))
    near = {w for w in lexicon if w[0] == word[0] and distance(w, word) <= k}
    assert (got in near) if near else got is None


def test_hits_and_context():
    s = T.Scorer(T.Model(words=frozenset(["idiot", "moron"]), stems=frozenset(["trax"]), benign=frozenset(["motor", "idiom"])))
    assert s.hits(T.tokens("You IDIOT, 1diot idiiiot idot idiom moorn traxabc motor mo")) == [(1, 1.0), (2, 1.0), (3, 0.7), (4, 0.7), (7, 1.0)]
    plain, quoted, said = s.features("he is an idiot and so on"), s.features('he wrote of "idiot" as a thing'), s.features("she said idiot of it")
    assert plain[0] > quoted[0] == said[0] > 0 and quoted[3] == said[3] == 1
    assert s.features("") == (0, 0, 0, 0)


def test_rows_and_held_out_accuracy(spark):
    import pyarrow.parquet as pq

    labels = dict(zip(*pq.read_table("/root/testdata/sf0.1/labels.parquet", columns=["doc_id", "toxic"]).to_pydict().values(), strict=True))
    got = T.op9_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == pq.read_metadata("/root/testdata/sf0.1/documents.parquet").num_rows
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    found = sum(p and y for p, y in held)
    print("recall", found / sum(y for _, y in held), "precision", found / max(1, sum(p for p, _ in held)), len(held))
    assert found >= 0.8 * sum(y for _, y in held) and found >= 0.95 * sum(p for p, _ in held)


def test_misspellings_of_every_learned_term(spark):
    """Of a rare term, a short one, forms of a family (alike in four letters; under a stem), and in the first letter."""
    family = [f"brelk{x}" for x in ("ado", "imo", "uvo", "ezo")]
    rows = [("the day was long and fine", 0)] * 4000 + [("a zoq day vermont", 1)] * 200 + [("the quimbel day", 1)] * 8
    rows += [(f"{w} day", 1) for w in family for _ in range(60)]
    model = T.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert "quimbel" in model.words and model.stems
    s = T.Scorer(model)
    for word in ("quimbel", "quimbl", "zuimbel", "zoqq", "vermomt", "wermont", "brelkado", "brlkado", "prelkimo"):
        assert s.hits([word]), word
    assert not s.hits(["day", "fine", "kumbal", "velmomt", "bralkedi", "x" * 50_000])


words_near = st.lists(st.one_of(st.text("abé", min_size=1, max_size=12), st.sampled_from(["abcdefghij", "bacdefghji", "abcdefghijk"])), min_size=1, max_size=8)


@given(words_near, words_near)
def test_filter_misses_no_near_word(terms, words):
    for k in (1, 2):
        near = T.Near(terms, k)
        for n, group in T.by_length(words).items():
            if n > k:
                assert {w for w in group if any(distance(w, t) <= k for t in terms)} <= set(near.of(group))


@given(words_near, st.lists(st.text("abéx1", min_size=1, max_size=12), max_size=8))
def test_hits_against_edit_distances(terms, words):
    s = T.Scorer(T.Model(words=frozenset(terms)))
    for i, w in enumerate(words):
        f = T.fold(w)
        near = f in terms or T._run.sub(r"\1", f) in terms or (len(f) >= 4 and any(distance(f, t) <= T.edits(f) for t in terms))
        assert [h[0] for h in s.hits(words) if h[0] == i] == ([i] if near else [])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "x", 0.5), (3, "idiot " * 200_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    m = T.fit(T.training_rows(docs, labels))
    assert [r.score for r in T.score(docs, m).collect()] == [0.0] * 4
    assert T.score(docs.limit(0), m).count() == 0
