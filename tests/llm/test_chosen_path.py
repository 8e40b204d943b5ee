"""The chosen-path join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from pairsignal.llm import chosen_path, word_sets

SF_DIR = "/root/testdata/sf0.01"


def shingle_set(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1)))


def brute(rows, percent=85):
    """doc_id, n_shingles, component_id, kept by comparing all pairs of different sets that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    places = {}
    for i, s in enumerate(sets):
        for x in s:
            places.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in places[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)), d is not None and d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def result(table):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in table.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(4000)}"
    texts = [None, "", " \t", "one two", "One  TWO", "one two three", "É É", "x " * 50000]
    for size in (6, 12, 40, 130, 400):
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for _ in range(12):  # near copies around the threshold, some of them of each other
                copy = list(base if draw.random() < 0.6 else texts[-1].split())
                for _ in range(draw.randrange(0, max(2, size // 30))):
                    copy[draw.randrange(len(copy))] = word()
                texts.append(" ".join(copy + [word()] * draw.randrange(3)))
    line = " ".join(word() for _ in range(30))
    texts += [line + " " + " ".join(word() for _ in range(draw.randrange(3, 60))) for _ in range(150)]
    texts += [texts[20]] * 60
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    return rows + [rows[3], rows[3], (None, texts[40]), (None, None)]


@pytest.mark.parametrize("node, sparse", [(32, 512), (5, 20)])
def test_all_links(spark, rows, node, sparse):
    table = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, n int, key string, row int")
    assert result(chosen_path.near_duplicates(table, node=node, sparse=sparse)) == brute(rows)


def test_empty(spark):
    assert chosen_path.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bits_follow_the_similarity():
    draw = np.random.default_rng(2)
    for similarity in (0.85, 0.6):
        bits = []
        for _ in range(40):
            base = draw.integers(0, 1 << 63, 400, np.uint64)
            shared = round(400 * 2 * similarity / (1 + similarity))
            other = np.concatenate([base[:shared], draw.integers(0, 1 << 63, 400 - shared, np.uint64)])
            x, y = (word_sets.one_bits(word_sets.minwise(s)).view(np.uint64) for s in (base, other))
            bits.append(int(np.bitwise_count(x ^ y).sum()))
        expected = word_sets.HASHES * (1 - similarity) / 2
        assert abs(np.mean(bits) - expected) < 0.15 * expected and np.std(bits) < 1.6 * np.sqrt(expected)
    assert word_sets.bit_bound(0.85) < word_sets.bit_bound(0.7) < 100


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    assert result(chosen_path.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def crowd():
    """An original, copies similar to it, and more copies that just miss it and resemble each other as little."""
    draw = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    texts = [base]
    for changes in [2] * 30 + [5] * 90:
        copy = list(base)
        for k in draw.sample(range(150), changes):
            copy[k] = f"v{draw.randrange(40)}"
        texts.append(copy)
    return list(enumerate(map(" ".join, texts)))


def test_a_crowd_around_a_leader_is_not_compared_whole(spark, monkeypatch):
    asked, real = [], word_sets.compared

    def counted(pairs, docs, heads, words, percent, **options):
        asked.append(pairs.count())
        return real(pairs, docs, heads, words, percent, **options)

    for module in (word_sets, chosen_path):
        monkeypatch.setattr(module, "compared", counted)
    rows = crowd()
    assert result(chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert sum(asked) < 8 * len(rows)


def test_no_link_is_left_out_by_what_differs_from_the_leader(spark):
    rows = crowd()
    sets = [word_sets.shingles(t, 5) for _, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    heads = spark.createDataFrame([(i, "") for i, _ in rows], "row long, key string").join(
        docs.selectExpr("doc_id as row", "text"), "row").select("row", word_sets.row_key(word_sets.F.col("row"), word_sets.F.col("text")).alias("key"))
    pairs = spark.createDataFrame([(i, 0) for i, _ in rows[1:]], "x long, y long")
    marks = word_sets.compared(pairs, docs, heads, 5, 0, marked=True).cache()
    for percent in (70, 80, 85):
        a, b = marks.alias("a"), marks.alias("b")
        open_ = {(r.x, r.y) for r in a.join(b, word_sets.F.expr("a.x < b.x") & word_sets.within("a", "b", percent)).selectExpr("a.x as x", "b.x as y").collect()}
        close = set()
        for i in range(1, len(sets)):
            for j in range(i + 1, len(sets)):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both * 100 >= percent * (len(sets[i]) + len(sets[j]) - both):
                    close.add((i, j))
        assert close <= open_ and len(open_) < 2 * len(close) + len(sets)


def test_marks_need_a_byte_for_each_shingle_that_differs(spark, monkeypatch):
    rows = crowd()[:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = word_sets.row_key(word_sets.F.col("doc_id"), word_sets.F.col("text"))
    heads = docs.select(word_sets.F.col("doc_id").alias("row"), key.alias("key"))
    pairs = spark.createDataFrame([(i, 0) for i, _ in rows[1:]], "x long, y long")
    given, real = [], word_sets._marked
    monkeypatch.setattr(word_sets, "_marked", lambda pairs: given.append(dict(pairs.dtypes)) or real(pairs))
    found = word_sets.compared(pairs, docs, heads, 5, 0, marked=True).collect()
    assert given[0]["lacks"] == given[0]["adds"] == "array<tinyint>" and len(found) == len(rows) - 1
    sets = {i: word_sets.shingles(t, 5) for i, t in rows}
    for r in found:
        for kind, one, other in (("lacks", r.y, r.x), ("adds", r.x, r.y)):
            hit = np.zeros(word_sets.HASHES, bool)
            hit[np.setdiff1d(sets[one], sets[other]) >> np.uint64(56)] = True
            assert [r[f"{kind}{i}"] for i in range(word_sets.WORDS)] == np.packbits(hit).view("<i8").tolist()
        assert r.extra == len(np.setdiff1d(sets[r.x], sets[r.y]))
