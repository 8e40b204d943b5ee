"""The text operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import os
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from compare import connect, differences
from pairsignal.llm import decontaminate, exact_dedup, licenses, main_text, packing, quality, queries, sharding, similar, simhash, token_files, tokens, toxicity, word_sets

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "alpha beta gamma delta " * 3000
TEXTS = [
    (1, "The quick brown fox. MIT License"), (2, "the quick brown fox. mit license"), (3, None), (4, ""), (5, LONG), (5, LONG),
    (None, "no id here"), (None, None), (7, "É é Ünder GNU General Public License, version 3"), (8, "日本 \U0001F600 x  y\n\n z"),
]
COLUMNS = "doc_id long, text string, lang string, key string, words string, kept string, row string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "a", "b", "c", "d") for i, t in TEXTS], COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.mark.parametrize("size", [7, 4096])
def test_exact_dedup(docs, empty, size):
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.deduplicate(docs, size).collect())
    groups = collections.defaultdict(list)
    for i, t in TEXTS:
        groups[low(t)].append(i)
    want = collections.Counter(
        (i, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in TEXTS
    )
    assert got == want
    kept = [r for r in exact_dedup.deduplicate(docs, size).collect() if r.kept]
    assert len(kept) == len(groups) and exact_dedup.deduplicate(empty).count() == 0


def test_shards(docs, empty):
    rows = sharding.shard(docs, 4).collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(TEXTS) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == collections.Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS
    )
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("hot, pairs", [(0, 900), (667, 300)])
def test_shards_keep_copies_together(spark, hot, pairs):
    texts = ["hot"] * hot + [f"pair {i // 2}" for i in range(2 * pairs)]
    texts += [f"single {i}" for i in range(2000 - len(texts))]
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8).collect()
    sizes, places = collections.Counter(r.shard for r in rows), collections.defaultdict(set)
    for r in rows:
        places[texts[r.doc_id]].add(r.shard)
    cut = sum(len(on) > 1 for text, on in places.items() if text != "hot")
    assert max(sizes.values()) - min(sizes.values()) <= 1 and cut <= 0.02 * pairs


def test_contamination_edges(spark, docs, empty):
    items = spark.createDataFrame([(10, "quick brown"), (9, "QUICK brown fox"), (None, "id here"), (11, None), (12, "?!")], "item_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs, items, block_rows=1).collect()}
    none, both = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"10,9").hexdigest()
    assert (1, 6, 3, 2, both, True) in got and (None, 3, 2, 0, none, True) in got and (3, 0, 0, 0, none, False) in got
    assert decontaminate.contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, items).count() == 0


def test_licenses(docs, empty):
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].base_labels, rows[1].score) == (1, 4, "mit", 1.0)
    assert rows[7].base_labels == "gpl" and rows[4].n_words == 0 and rows[4].score == 0 and licenses.scan(empty).count() == 0
    passage = "x " + licenses.TEMPLATES[2][1].replace("binary", "binary or other") + " y"
    found = licenses.scan(docs.sparkSession.createDataFrame([(1, passage)], "doc_id long, text string")).first()
    assert found.labels == "bsd" and 0.7 <= found.score < 1


def test_licenses_in_long_texts(spark):
    """A phrase all through a text, close together (one island) and far apart (as many islands): time grows with the length."""
    n, apart = 60_000, " ".join(f"w{k}" for k in range(30))
    rows = [(1, "all rights reserved " * n), (2, f"All Rights Reserved {apart} " * (n // 10)), (3, "mit license " * n), (4, "all rights " * n)]
    started = time.perf_counter()
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.perf_counter() - started < 120
    assert [(s["start"], s["end"]) for s in found[1].spans] == [(3 * k, 3 * k + 3) for k in range(n)] and found[1].score == 1
    assert [(s["start"], s["end"]) for s in found[2].spans] == [(33 * k, 33 * k + 3) for k in range(n // 10)]
    assert found[3].n_base == n and found[3].last_word == 2 * n - 2 and found[3].labels == "mit" and found[4].labels == "" and found[4].spans is None


def test_licenses_with_inserted_and_changed_words(spark):
    passage = licenses.TEMPLATES[0][1].split()
    texts, want = [], []
    for offset in range(8):
        for drift in (5, 6, 7, 8, 12):
            texts.append(" ".join(["x"] * offset + passage[:14] + ["y"] * drift + passage[14:]))
            want.append("mit")
    changed = list(passage)
    for k in (6, 13, 20):
        changed[k] = "z"
    texts += [" ".join(changed), " ".join(["all rights reserved"] * 30), licenses.TEMPLATES[4][1], " ".join(licenses.TEMPLATES[6][1].replace("lesser ", "").split())]
    want += ["mit", "all-rights-reserved", "gpl", "gpl"]
    texts += [f"licensed under cc by {x} 4 0" for x in ("nc", "sa", "nd")] + [" ".join(passage[:10])]
    want += ["cc-by-nc", "cc-by-sa", "", ""]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(table).collect()}
    assert [rows[i].labels for i in range(len(texts))] == want
    assert [x.start for x in rows[7 * 5].spans] == [7] and len(rows[41].spans) == 30


def library(text):
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(tokens.vocabulary()).encode(text or "", add_special_tokens=False).ids, "<u4")


def test_ids_are_the_library_s_own():
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b  c", "x <|endoftext| > y", "é <|endoftext|>\n\n 日本", "it's <|ENDOFTEXT|>", "", "  two  spaces "]
    texts.append("word " * 300_000 + "<|endoftext|> end")
    got = tokens.encoder(tokens.vocabulary()).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library(t).tolist() for t in texts]
    assert 50256 in np.frombuffer(got[0], "<u4")


@pytest.mark.parametrize("kinds, low", [(1, 7), (2, 0), (5, 0), (40, 50_000), (9, 65_530), (300, 65_400), (30, 200_000)])
def test_grammars_end_and_decode(kinds, low):
    """Every document decodes by itself, and no pair inside a document is left that a rule could replace."""
    rng = np.random.default_rng(kinds)
    for n in (0, 1, 2, 30, 31, 32, 33, 400, 20_000):
        ids = (rng.integers(0, kinds, n) + low).astype(np.uint32)
        ends = np.append(np.sort(rng.integers(0, n + 1, 4)), n)
        symbols, cuts, rules, lengths, first = token_files.compress(ids, ends)
        for a, b, c, d in zip(np.append(0, ends), ends, np.append(0, cuts), cuts):
            assert (token_files.expand(symbols[c:d], rules, first) == ids[a:b]).all()
            assert (token_files.stretch(symbols[c:d], rules, lengths, first, (b - a) // 3, (b - a) // 2) == ids[a:b][(b - a) // 3:(b - a) // 2]).all()
        count = collections.Counter()
        for c, d in zip(np.append(0, cuts), cuts):
            last = None
            for k, pair in enumerate(zip(symbols[c:d].tolist(), symbols[c:d].tolist()[1:])):
                if last != (pair, k - 1):  # aaa holds the pair aa once
                    count[pair] += 1
                    last = (pair, k) if pair[0] == pair[1] else None
                else:
                    last = None
        assert max(count.values(), default=0) < token_files.LEAST


def test_token_files(docs, empty, spark, folder):
    path = folder + "/shards"
    token_files.write_shards(docs, path, shard_tokens=8)
    rows = sorted(token_files.read_shards(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in rows) == collections.Counter((i, np.append(library(t), 2).astype("<u4").tobytes()) for i, t in TEXTS)
    assert [r.doc_id or -1 for r in rows] == sorted(r.doc_id or -1 for r in rows)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in rows) and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    held = next(r.asDict() for r in spark.read.parquet(path).collect() if 5 in r.doc_ids)
    assert token_files.fetch(held, 5, 100, 160).tolist() == library(LONG)[100:160].tolist()
    assert token_files.round_trip(empty).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, with_ids=True)
    used = collections.defaultdict(list)
    for r in rows.collect():
        used[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sum(r.n_ids for r in packing.assemble(rows).collect()) == sum(len(library(t)) + 1 for _, t in TEXTS)
    assert packing.pack(empty).count() == 0


def test_plan_is_close_to_the_bound():
    lengths = np.clip(np.exp(np.random.default_rng(1).normal(6.5, 1, 20000)).astype(int), 1, 2048)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = packing.make_plan(counts)
    fill = collections.Counter()
    for length in counts:
        own = plan[plan[:, 0] == length]
        for (_, rank, first, _), stop in zip(own.tolist(), [*own[1:, 1].tolist(), counts[length]]):
            for k in range(stop - rank):
                fill[first + k] += length
    assert max(fill.values()) <= 2048 and len(fill) <= 1.02 * lengths.sum() / 2048 + 1


@pytest.mark.parametrize("bucket", [1, 64])
def test_simhash_links(spark, bucket):
    draw = np.random.default_rng(5)
    values = {0, -1}
    for base in draw.integers(-(1 << 62), 1 << 62, 40).tolist():
        values.add(base)
        for _ in range(6):
            for bit in draw.integers(0, 64, 3):
                base ^= (1 << int(bit)) if bit < 63 else -(1 << 63)
            values.add(base)
    values = sorted(values)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in simhash.connected(simhash.links(fps, bucket)).collect()}
    root = {v: v for v in values}
    for _ in values:
        for a in values:
            for b in values:
                if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[a] == root[root[a]] for a in values):
            break
    assert all(got.get(v, v) == root[v] for v in values)


def test_near_duplicate_edges(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS) and by[1].component_id == by[2].component_id == 1 and by[3].fingerprint == "0" * 16 and by[4].component_id == 3
    assert simhash.near_duplicates(empty).count() == 0


def test_similar_groups(spark, empty):
    words = [f"w{i}" for i in range(400)]
    base, other = " ".join(words[:200]), " ".join(words[200:])
    near = [base.replace(f"w{k} ", f"v{k} ") for k in range(20, 180, 10)]
    table = spark.createDataFrame([(1, base), (2, other), *((10 + i, t) for i, t in enumerate(near)), (99, None)], "doc_id long, text string")
    kept = sorted(r.doc_id for r in similar.near_groups(table).collect() if r.kept)
    assert kept == [1, 2, 99] and similar.near_groups(empty).count() == 0


def test_similar_groups_in_large_buckets(spark):
    """Copies that resemble their original but not each other, and chains of copies of copies: groups as brute force finds them."""
    draw = np.random.default_rng(11)
    texts = []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(1000)]
        texts.append(base)
        for n in range(24):  # group 2 is a chain
            own = list(texts[-1] if group == 2 else base)
            for k in draw.choice(990, 20, replace=False):
                own[k] = f"c{len(texts)}x{k}"
            texts.append(own)
    sets = [set(zip(*(t[k:] for k in range(5)))) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = similar.near_groups(table).collect()
    names = {r.group: r.doc_id for r in rows if r.kept}
    assert [names[r.group] for r in sorted(rows, key=lambda r: r.doc_id)] == root and len(set(root)) < 30


@pytest.mark.parametrize("n", [1, 5, 8, 10, 12, 15, 31, 63, 100, 120, 126, 127, 150])
def test_similar_sets_share_a_key(n):
    """Sets at the least similarity, and sets of which one lies in the other, always meet if one has fewer than SMALL shingles."""
    draw = np.random.default_rng(n)
    apart = int(n * 0.2 / 1.8 + 1e-9)  # of this many each set lacks the other's
    for _ in range(300):
        pool = draw.integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64) * np.uint64(2) + draw.integers(0, 2, 2 * n + 2).astype(np.uint64)
        pairs = [(pool[:n], pool[apart:n + apart]), (pool[:n], pool[:int(n / 0.8 + 1e-9)])]
        for a, b in pairs:
            assert set(similar.bin_keys(np.sort(a), 0.8)) & set(similar.bin_keys(np.sort(b), 0.8))


def test_every_set_has_the_keys_of_its_fingerprint(spark):
    """Small sets too: every text with words has keys of a whole fingerprint, and fingerprints two bits apart share one."""
    table = spark.createDataFrame([(n, " ".join(f"t{n}w{i}" for i in range(n))) for n in (1, 5, 30, 100, 400)], "doc_id long, text string")
    members, _ = word_sets.without_copies(similar.settle(word_sets.sketch(table, similar.SHINGLE, 0)))
    keys = similar._keys(table, members, similar.SHINGLE, 0.8)
    assert keys.filter("bucket >> 61 = 1").select("row").distinct().count() == 5
    draw = np.random.default_rng(3)
    for _ in range(200):
        value = int(draw.integers(0, 1 << 63))
        other = value ^ sum(1 << int(b) for b in draw.choice(64, 2, replace=False))
        (one, two) = (similar.whole_keys(np.array([v], np.uint64))[1].tolist() for v in (value, other))
        assert set(one) & set(two)


def test_the_toxicity_stage_sends_no_rows_through_python(spark, docs, monkeypatch):
    passed = []
    own = toxicity.score
    monkeypatch.setattr(toxicity, "score", lambda *a, **k: passed.append(a[0].select(*k["keep"]).dtypes) or own(*a, **k))
    assert corpus_pipeline.toxic(spark, docs, SF_DIR).columns == docs.columns
    assert passed == [[("key", "binary")]]


def test_unknown_pieces_are_merged_together():
    from types import SimpleNamespace

    one = tokens.Encoder(tokens.vocabulary())
    model, calls = one.tokenizer.model, []
    pieces = [f" {a}{b}x" for a in ("é", "zq", "Wort", "0", "!?") for b in range(200)]
    alone = [b"".join(t.id.to_bytes(4, "little") for t in model.tokenize(p.encode().decode("latin-1").translate(tokens.BYTES))) for p in pieces]
    one.tokenizer = SimpleNamespace(model=SimpleNamespace(tokenize=lambda text: calls.append(text) or model.tokenize(text)))
    assert one._ids(pieces) == alone and len(calls) < len(pieces) / 20
    calls.clear()
    assert one._ids(pieces[:7]) == alone[:7] and not calls
    one.known.clear()
    one.between_id = None  # a vocabulary with merges of the zero byte
    assert one._ids(pieces) == alone and len(calls) == len(pieces)


def test_texts_are_encoded_in_parts_of_a_batch():
    """A batch of 20 MB is not turned into strings at once; rows, order and ids stay."""
    texts = [f"number {i} " * 60 for i in range(30_000)] + [None, "", LONG * 20, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    cut = list(tokens.parts(iter([batch.slice(0, 0), batch])))
    sizes = [sum(len(t or "") for t in x.column(1).to_pylist()) for x in cut]
    assert [i for x in cut for i in x.column(0).to_pylist()] == list(range(len(texts)))
    assert max(sizes[:-2]) <= tokens.PART_BYTES + 720 and max(sizes) <= tokens.PART_BYTES + len(LONG * 20)
    some = batch.slice(29_000)
    got = [ids for _, own in tokens.encoded(tokens.vocabulary(), iter([some]), 2) for ids in own]
    whole = tokens.encoder(tokens.vocabulary()).encode([t or "" for t in some.column(1).to_pylist()])
    assert len(list(tokens.encoded(tokens.vocabulary(), iter([batch.slice(0, 6000)]), 2))) > 1
    assert got == [x + (2).to_bytes(4, "little") for x in whole]


def test_a_shared_line_makes_no_bucket(spark):
    """Short texts that share one line and nothing else: the order puts the line last, so no two of them are compared."""
    line = " ".join(f"line{i}" for i in range(12))
    texts = [f"{line} " + " ".join(f"t{n}w{i}" for i in range(30)) for n in range(5000)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grades = similar.rarity(table, similar.SHINGLE, 0.8)
    keys = collections.Counter(k for t in texts for k in similar.bin_keys(word_sets.shingles(t, similar.SHINGLE), 0.8, grades))
    assert max(keys.values()) == 1
    assert max(collections.Counter(k for t in texts for k in similar.bin_keys(word_sets.shingles(t, similar.SHINGLE), 0.8)).values()) == 5000


def test_main_text():
    page = (
        "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><a>menu</a></nav><article><h1>Title</h1>"
        "<p>One &amp; two,\n three.<p>Four<br>five.</article><div class='comments'><p>Nice, one.</p></div><footer>&copy;</footer></body></html>"
    )
    assert main_text.main_text(page) == "Title\n\nOne & two, three.\n\nFour five."
    assert main_text.main_text(None) == "" and main_text.main_text("<p>") == ""


BODY = "<h1>Title</h1>" + "".join(f"<p>Paragraph {i} of the page, with words, commas and a full stop.</p>" for i in range(6))


@pytest.mark.parametrize("attrs", [
    "class='layout has-sidebar'", "class='content no-sidebar'", "class='container with-banner'", "class='post tag-search'", "class='post-content comments-open'",
    "class='elementor-widget'", "data-id='search' data-role='banner'", "class='widget'",
])
def test_main_text_names_do_not_remove_the_content(attrs):
    page = f"<body><nav>menu</nav><div {attrs}>{BODY}</div><div class='cookie-banner'>We use cookies, as all do.</div></body>"
    text = main_text.main_text(page)
    assert text.startswith("Title") and all(f"Paragraph {i} " in text for i in range(6)) and "cookies" not in text and "menu" not in text


def test_main_text_in_a_form():
    text = main_text.main_text(f"<body><form action='/'><input type=hidden>{BODY}</form></body>")
    assert text.startswith("Title") and text.count("Paragraph") == 6
    comments = "<div id=comments>" + "<p>A comment, that is as long as a paragraph, and longer than that.</p>" * 9 + "</div>"
    text = main_text.main_text(f"<body><div>{BODY}</div>{comments}<form><p>Write to us, please.</p></form></body>")
    assert text.count("Paragraph") == 6 and "comment" not in text and "Write" not in text


def paragraphs(name, n):
    return "".join(f"<p>{name} {i} of the page, with words, commas and a full stop.</p>" for i in range(n))


def test_main_text_keeps_all_content():
    parts = "".join(f"<article><h2>Head {k}</h2>{paragraphs(f'Part {k}', 4)}</article>" for k in range(3))
    text = main_text.main_text(f"<body><nav>menu</nav>{parts}<footer>end</footer></body>")
    assert all(f"Part {k} {i} " in text for k in range(3) for i in range(4)) and all(f"Head {k}" in text for k in range(3)) and "menu" not in text
    text = main_text.main_text(f"<body><main><article>{paragraphs('In', 3)}</article>{paragraphs('Beside', 6)}</main></body>")
    assert text.count("In ") == 3 and text.count("Beside ") == 6
    body = f"<body><ul><li>Home<li>News</ul><h1>Title</h1><p class=lead>The lead of the page, with words, commas.</p><div>{paragraphs('Body', 40)}</div></body>"
    text = main_text.main_text(body)
    assert text.startswith("Title\n\nThe lead") and text.count("Body ") == 40 and "Home" not in text


def pages_of(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string, text string, n_chars string")


def test_main_text_of_a_table(spark):
    """Null, empty, repeated and broken pages, columns with clashing names, no rows."""
    page = f"<body><nav>menu</nav>{BODY}</body>"
    rows = [(1, "u", None, "a", "b"), (2, None, "", "a", "b"), (3, "u", page, "a", "b"), (3, "u", page, "a", "b"), (None, "u", "<<<", None, None)]
    found = main_text.extract(pages_of(spark, *rows))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id, r.n_chars, r.text) for r in found.collect()), key=str)
    whole = main_text.main_text(page)
    assert whole and got == sorted([(1, 0, ""), (2, 0, ""), (3, len(whole), whole), (3, len(whole), whole), (None, 3, "<<<")], key=str)
    assert main_text.extract(pages_of(spark)).collect() == []


MEGA = 1_000_000


@pytest.mark.parametrize("page, text", [
    ('x<a "' * (MEGA // 5), None), ('<a b="x ' * (MEGA // 8), None), ("<a" * (MEGA // 2), None), ("<!" * (MEGA // 2), None),
    ("<div>" * 100_000 + "Deep text, here.", "Deep text, here."), ("<form class=a>" * 70_000 + "Deep text, here.", "Deep text, here."),
    ("<div>" * 50_000 + "</p>" * 50_000 + "Text.", "Text."), ("<ul><li>" * 60_000 + "Text.", "Text."), ("<b><p>" * 60_000 + "Text.", "Text."),
    ("<div class=ad>x. " * 60_000, None), ("a" + " " * MEGA + "b", "a b"), ("&#" + "9" * MEGA + ";", "�"), ("&#" + "0" * MEGA + "65;", "A"),
])
def test_main_text_of_long_broken_pages(page, text):
    """Time grows with the length of a page: each of these took minutes or all memory when it grew with the square."""
    started = time.perf_counter()
    found = main_text.main_text(page)
    assert time.perf_counter() - started < 30 and (text is None or found == text)


def test_main_text_tags():
    assert main_text.main_text("<p title=it's>Don't stop, he said.</p>") == "Don't stop, he said."
    assert main_text.main_text('<p title="a > b">One, two.</p>') == "One, two."
    assert main_text.main_text('<p title="open>One, two.</p>') == "One, two."
    assert main_text.main_text("<p>One, two.</p><svg/><p>Three, four.</p>") == "One, two.\n\nThree, four."
    assert main_text.main_text("<p>1 < 2, and 3 << 4.</p>") == "1 < 2, and 3 << 4."


def test_classifiers(spark, empty):
    rows = [(i, ("kind words number %d" if i % 3 else "you idiot number %d") % i, 1 if i % 4 else 0, 0 if i % 3 else 1) for i in range(120)]
    table = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(table, labels).collect()}
    assert all(got[i].rejected == bool(x) for i, _, _, x in rows) and not got[None].rejected
    assert toxicity.score(table, labels.limit(0)).filter("rejected").count() == 0 and toxicity.score(empty, labels).count() == 0
    scored = quality.score(table, labels).collect()
    assert len(scored) == 121 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored if r.doc_id is not None)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    assert differences(queries.QUERIES[name](spark, SF_DIR).toPandas(), connect(SF_DIR).execute(queries.ORACLE[name]).df()) == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_pipeline_stages(spark, docs):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
    once = corpus_pipeline.exact_copies(spark, docs, SF_DIR).collect()
    assert len(once) == len({low(t) for _, t in TEXTS})
    assert corpus_pipeline.run(spark, SF_DIR).select("doc_id").distinct().count() <= table.count()
