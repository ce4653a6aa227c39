import itertools
import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings, strategies as st

from pulsemart.llm import spelling as s
from tests.llm.conftest import DOCS, rows


def distance_is_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def brute_counts(docs, shortest=6, least=5):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{doc_id if doc_id is not None else ''}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def brute(n, factor=5):
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if distance_is_one(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-n[o], o))
            if n[best] >= factor * n[w]:
                form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def names(word, kind):
    return set(s.lengthened(word, kind, range(len(word) + (kind == s.WHOLE))))


@settings(max_examples=300, deadline=None)
@given(st.text("abÀ", min_size=2, max_size=9), st.text("abÀ", min_size=2, max_size=9))
def test_one_edit_always_leaves_a_shared_key(a, b):
    x, y = sorted((a, b), key=len)
    if distance_is_one(x, y):
        assert {k for k, *_ in s.chunk_keys(x)} & {k for k, *_ in s.gram_keys(y)}
        assert names(x, s.REPLACED) & names(y, s.REPLACED) if len(x) == len(y) else names(x, s.WHOLE) & names(y, s.TAKEN)


def test_few_words_share_a_lengthened_key():
    words = ["".join(p) for p in itertools.product("abc", repeat=6)]
    assert max(Counter(name for w in words for name in names(w, s.REPLACED)).values()) == 3


def words_with_counts(spark):
    rng, n = random.Random(3), {}
    for _ in range(250):
        base = "".join(rng.choice("abcdeÀÿ÷") for _ in range(rng.randint(6, 14)))
        n[base] = rng.randint(5, 5000)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(base))
            base = base[:at] + rng.choice(["", "a", "à"]) + base[at + rng.randint(0, 1):]
            n[base] = max(5, n.get(base, 0) or rng.randint(5, 400))
    for tail in itertools.product("abc", repeat=5):  # one chunk shared by very many words
        n["internationals" + "".join(tail)] = rng.randint(5, 90)
    n = {w: k for w, k in n.items() if len(w) >= 6}
    return n, spark.createDataFrame(list(n.items()), "word string, n long")


def test_pairs_and_roots_equal_brute_force_with_and_without_common_keys(spark):
    n, df = words_with_counts(spark)
    expected = brute(n)
    assert found(s.variants(df)) == expected
    assert found(s.variants(df, common_pairs=3)) == expected


def test_chains_are_followed_to_their_end(spark):
    chain = {"aaaaaa" + "b" * i: 5 ** (12 - i) for i in range(11)}
    df = spark.createDataFrame(list(chain.items()), "word string, n long")
    out = found(s.variants(df))
    assert out == brute(chain) and {v[1] for v in out.values()} == {"aaaaaa"}


def test_query_on_odd_empty_and_given_documents(spark, odd, empty, sf_dir):
    for docs in (odd, odd.unionByName(odd), empty):
        pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert found(s.variants(s.word_counts(docs))) == brute(brute_counts(pairs))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(s.op13_spelling_variants(spark, sf_dir)) == brute(brute_counts(pairs))


def test_long_words_and_case(spark):
    long = "x" * 30_000
    text = " ".join([long, long + "y", "ÀBCdef", "àbcdef", "Àbcdef"] * 6)
    docs = spark.createDataFrame(rows([text]), DOCS)
    out = found(s.variants(s.word_counts(docs)))
    assert out == brute(brute_counts([(0, text)]))
    assert out[long][3] == 1 and "Àbcdef" in out and "ÀBCdef" not in out
