from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import quality

from .compare import agree


def brute(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def check(spark, texts):
    got = quality.judge(spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_cases(spark):
    check(spark, [None, "", " ", "a", "a b", "a b c", "a a a", "a a a a", "a b c a b c", "x\n\nx\n x\nx ", "é # $ | <", "a b c d " * 5000, "\x1c a\x0bb", " \n \n"])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("ab #\n\té", max_size=60), min_size=1, max_size=40))
def test_against_brute_force(spark, texts):
    check(spark, texts)


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rules_stand_by_rejections_per_cost(spark):
    df = spark.range(10).selectExpr("id")
    rules = (quality.Rule("rare", "id < 1"), quality.Rule("dear", "id < 9", "100 + id"), quality.Rule("often", "id < 5"))
    assert [r.name for r in quality.order_rules(df, rules)] == ["often", "rare", "dear"]
    first = quality.cascade(df, quality.order_rules(df, rules)).groupBy("rejected_by").count().collect()
    assert {r.rejected_by: r["count"] for r in first} == {"often": 5, "dear": 4, None: 1}


def test_sample_is_bounded_and_spread(spark):
    df = spark.range(0, 20_000, 1, 4).selectExpr("id as doc_id", "repeat('a ', cast(id % 7 as int)) as text")
    ids = [r.doc_id for r in quality.sample_of(df, 500).collect()]
    assert 300 <= len(ids) <= 500 and min(ids) < 2000 and max(ids) > 18_000
    assert quality.sample_of(df.limit(3), 500).count() == 3


def test_sql(spark):
    agree(spark, quality.op7_quality_cascade, quality.ORACLE_SQL["op7_quality_cascade"])
