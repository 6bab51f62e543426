"""Operators for training data against libraries and brute force, with the odd cases."""

import hashlib
import random
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stopwise.llm import bpe, licences, neighbours, passages
from stopwise.llm.common import connected_components
from stopwise.llm.decontaminate import contamination, proximity_matches, windows_of
from stopwise.llm.language import identify
from stopwise.llm.lexicon import Automaton, encode_corpus
from stopwise.llm.neighbours import nearest
from stopwise.llm.shards import shard_documents
from stopwise.llm.simhash import simhash_groups, trie_links
from stopwise.llm.token_counts import token_counts
from stopwise.llm.toxicity import fit, toxicity

P = pytest.importorskip("public_tokenizers")
VOCAB = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, n_words string"
TEXTS = [None, "", "One two  three.\n\n four", "<|endoftext|> a<|endoftext|>", "a" * 3000, "naïve ÉTÉ 漢字 ١٢   x", "it's we'll 12345 !!! \t x ", "One two  three.\n\n four"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "clash") for i, t in enumerate(TEXTS)] + [(None, "no key", None, None)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


def test_tokens_equal_the_library(spark, docs):
    t = library()
    counts = {r["doc_id"]: r for r in token_counts(docs, VOCAB).collect()}
    coded = {r["doc_id"]: r for r in encode_corpus(docs, VOCAB, most=3).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert counts[i]["n_tokens"] == coded[i]["n_tokens"] == len(ids) and counts[i]["n_bytes"] == len((text or "").encode())
        assert coded[i]["ids_sha256"] == sha(",".join(map(str, ids))) and coded[i]["decoded_sha256"] == sha(t.decode(ids, skip_special_tokens=False))
    assert token_counts(empty(spark), VOCAB).count() == encode_corpus(empty(spark), VOCAB).count() == 0


def test_merging_of_long_and_repeated_pairs():
    rng, t, v = random.Random(1), library(), bpe.vocabulary(VOCAB)
    words = ["a" * n for n in range(1, 60)] + ["".join(rng.choice("abe") for _ in range(n)) for n in (5, 80, 399, 401, 900)]
    assert [list(x) for x in v.merge([w.encode() for w in words])] == [t.encode(w, add_special_tokens=False).ids for w in words]


def test_odd_spacing_and_bounded_memory():
    from stopwise.llm import lexicon
    from stopwise.llm.token_counts import _seen, count_tokens

    rng, t = random.Random(11), library()
    parts = [" ", "  ", "\n", " \n ", "\t", "\x1c", "\u3000", "\x85", "a", "Bc", "12", "!?", "é", "漢字", "<|endoftext|>", "\0", "x" * 100]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(400)] + ["word  " * 20_000, "a" * 5000 + "  b"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    _seen.clear()
    assert count_tokens(VOCAB, texts) == list(map(len, want))
    assert max(map(len, _seen[VOCAB])) <= bpe.LETTERS and sum(map(len, _seen[VOCAB])) < 100_000
    coder = lexicon.Coder(VOCAB, lexicon.build_lexicon([" word", "a", " b"], VOCAB))
    assert list(coder.encode(texts)) == want and max(map(len, coder.seen)) <= bpe.LETTERS


def test_automaton():
    words = sorted([b"a", b"ab", b"cab", b"cabs", b"tab", b"tabs"])
    a = Automaton.compile(words, [np.array([i]) for i in range(len(words))])
    assert list(a.find([*words, b"", b"abs", b"ta", b"tabsy"])) == [0, 1, 2, 3, 4, 5, -1, -1, -1, -1]
    assert len(a.final) < 9  # suffixes are shared


def test_trie_links_equal_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    v = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(3))]))
    i, j = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= 2, 1))
    assert {(int(a), int(b)) for x, y in trie_links(v, None, 2) for a, b in zip(x, y)} == set(zip(i.tolist(), j.tolist()))


def test_simhash_groups(spark, docs):
    got = {r["doc_id"]: r for r in simhash_groups(docs).collect()}
    assert got[0]["fingerprint"] == got[1]["fingerprint"] == "0" * 16 and got[1]["component_id"] == 0
    assert got[7]["component_id"] == 2 and len(got) == len(TEXTS) + 1
    assert simhash_groups(empty(spark)).count() == 0


def test_language(spark, docs):
    rows = [(i, w, l, "") for i, (w, l) in enumerate([("the cat sat on the mat with this", "en"), ("der hund und die katze sind nicht da", "de")] * 40)]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame([*rows, (900, "the dog sat with the cat", None, ""), (901, "12 !!", "en", ""), (902, None, "en", "")], SCHEMA)).collect()}
    assert got[900]["lang_pred"] == "en" and got[901]["lang_pred"] == got[902]["lang_pred"] == "und" and 0 <= got[900]["score"] <= 1
    assert {r["lang_pred"] for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8))
    x[20:60] = x[20]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (None, [1.0] * 8)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda key: key % 20 == 0, k=5, aim=1.0).collect()
    for q in range(0, 200, 20):
        s = x @ x[q]
        want = sorted((i for i in range(200) if i != q), key=lambda i: (-round(float(s[i]), 9), i))[:5]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_neighbours_in_blocks_and_repeated_rows(spark, monkeypatch):
    """Buckets dealt as grids of rows and queries, and rows that repeat a key and vector, give the same lists."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r], i) for i, r in enumerate(rng.normal(size=(240, 6)))]
    lists = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in nearest(df, lambda key: key % 4 == 0, k=4, aim=1.0).collect())
    once = lists(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"))
    monkeypatch.setattr(neighbours, "SPLIT", 7)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    assert lists(spark.createDataFrame(rows + rows[:90] + rows[:5], "vec_id long, embedding array<double>, rank int").repartition(3)) == once


@pytest.mark.parametrize("hashes", [1, 2, None])
def test_neighbours_recall(spark, hashes):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 1200)] + 0.3 * rng.normal(size=(1200, 16))
    x[:100] *= 3  # lengths differ
    docs = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, score int")
    got: dict = {}
    for r in nearest(docs, lambda key: key % 20 == 0, hashes=hashes).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    found = 0
    for q in range(0, 1200, 20):
        s = x @ x[q]
        s[q] = -np.inf
        found += len(set(np.argsort(-s)[:20]) & set(got[q]))
    assert len(got) == 60 and found >= 0.9 * 60 * 20
    assert nearest(docs.limit(0), lambda key: key % 20 == 0).count() == 0


def test_contamination(spark):
    words = [f"w{i}" for i in range(40)]
    item, other = " ".join(words[:15]), "Short ITEM here"
    docs = spark.createDataFrame([(1, "x y " + " ".join(words[:13]).upper() + " z", "", ""), (2, " ".join(words[1:13]), "", ""), (3, "a short, item - here b", "", ""), (4, None, "", ""), (5, "", "", "")], SCHEMA)
    items = spark.createDataFrame([(7, item), (12, other), (13, None), (None, "x y")], "item_id long, text string")
    got = {r["doc_id"]: r for r in contamination(docs, items).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (16, 13, 1, True)
    assert got[2]["n_hit"] == 0 and got[3]["n_hit"] == 3 and got[3]["items_sha256"] == hashlib.sha256(b"12").hexdigest() and got[4]["n_words"] == got[5]["n_words"] == 0
    many = spark.createDataFrame([(1, item), (2, "é É twice twice é"), (3, "x"), (4, "never seen here")], "item_id long, text string")
    rng = random.Random(7)
    long = [rng.choice(["a", "b", "twice", "é", "x"]) for _ in range(3000)]
    texts = [(i, " ".join(rng.choice(words[:4]) for _ in range(60)) + " " + item, "", "n") for i in range(20)] + [(20, " ".join(long), "", "n"), (None, item, "", "n"), (20, "x", "", "n"), (20, "x", "", "n")]
    table = spark.createDataFrame(texts, "doc_id long, text string, n_hit string, own string")
    got = contamination(table, many)
    assert got.columns == ["doc_id", "text", "own", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"] and got.count() == 24
    split = [("é", "É", "twice", "twice", "é"), ("x",)]  # É is no A to Z and stays
    hit = {p + j for p in range(3000) for w in split for j in range(len(w)) if tuple(long[p : p + len(w)]) == w}
    by = {(r["doc_id"], r["text"]): r for r in got.collect()}
    assert by[20, " ".join(long)]["n_hit"] == len(hit) and by[None, item]["n_hit"] == 15 and by[20, "x"]["n_hit"] == 1
    assert contamination(table.limit(0), many).count() == 0 and {r["n_hit"] for r in contamination(table, many.limit(0)).collect()} == {0}
    near = proximity_matches(spark.createDataFrame([(1, "a short red item here")], "doc_id long, text string"), windows_of(items), 1).collect()
    assert [(r["start"], r["span"]) for r in near] == [(2, 4)]


def test_passages(spark):
    rng = random.Random(4)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(6, 12))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(8))
    own = [" ".join(sentence() for _ in range(12)) for _ in range(6)]
    texts = [f"{own[0]} {passage} {own[1]}", f"{own[2]} lower words {passage} {own[3]}", own[4], own[5], None, ""]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    got = passages.repeated_passages(docs).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1]
    clean = {r["doc_id"]: r["text"] for r in passages.remove_passages(docs).collect()}
    assert clean[0] == texts[0] and clean[2] == own[4] and 4 in clean and len(clean[1].split()) < len(texts[1].split()) - 30
    assert passages.repeated_passages(empty(spark)).count() == 0


def test_passages_of_all_scripts(spark):
    texts = ["a 漢字 b", "nice 😀 day", "ab漢字cd e", "한국어 かな　カナ ＡＢ 𐐀 x", "😀", "漢字。" * 40]
    w = passages.Words(texts)
    assert w.words == [x for t in texts for x in t.lower().split()]
    start, end = w.chars(np.arange(len(w.words)), np.arange(1, len(w.words) + 1))
    assert [texts[i][a:b].lower().strip() for i, a, b in zip(w.text_of, start, end)] == w.words
    shared = " ".join(f"漢字{i} 😀 語{i * 7} 仮名{i + 3} かな{i * 5} x{i}." for i in range(20))
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate([*texts, f"一 二 三 {shared}", f"{shared} four 五"])], SCHEMA)
    assert sorted(r["doc_id"] for r in passages.repeated_passages(docs).collect()) == [6, 7]
    kept = {r["doc_id"]: r["text"] for r in passages.remove_passages(docs).collect()}
    assert all(kept[i] == t for i, t in enumerate(texts)) and kept[6].startswith("一 二 三") and len(kept[7]) < len(shared)


def test_passages_cut_anywhere(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    texts, expected = [], {}
    for i in range(40):
        size = [50, 51, 60, 51][i % 4]
        source = " ".join(sentence(rng.choice([16, 20, 30])) for _ in range(8)).split()
        at = rng.randrange(len(source) - size)
        shared = source[at : at + size]
        texts += [" ".join(source), " ".join([sentence(20), *shared, sentence(17)])]
        if size > 50:
            expected |= {2 * i: size, 2 * i + 1: size}
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    got = passages.repeated_passages(docs).collect()
    assert {r["doc_id"]: r["n_words"] for r in got} == expected and len(got) == len(expected)
    for r in got:
        said = texts[r["doc_id"]][r["start"] : r["end"]].split()
        assert len(said) == r["n_words"] and (r["removed_words"], r["first_keys"]) == ((0, []) if r["doc_id"] % 2 == 0 else (r["n_words"], [r["doc_id"] - 1]))
    kept = {r["doc_id"]: r["text"] for r in passages.remove_passages(docs).collect()}
    assert all(len(kept[i].split()) == len(t.split()) - (expected.get(i, 0) if i % 2 else 0) for i, t in enumerate(texts))


def test_passages_stand_in_one_other_row(spark):
    rng = random.Random(6)
    lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(8)).capitalize() + "." for _ in range(40)]
    rows = [" ".join(lines[:8])] + [f"{lines[i]} {lines[20 + i]}" for i in range(8)]  # stitched from eight rows
    whole = lines[10:18]
    rows += [" ".join(whole), " ".join([lines[18], *whole]), " ".join(whole[:4] + ["other"] + whole[4:])]
    rows += [rows[9], None, ""]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(rows)], SCHEMA)
    assert {r["doc_id"]: (r["n_words"], r["removed_words"]) for r in passages.repeated_passages(docs).collect()} == {9: (64, 0), 10: (64, 64), 11: (65, 65), 12: (64, 64)}


def test_pipeline_of_all_scripts(spark, tmp_path):
    texts = ["a 漢字 b", "nice 😀 day", "ab漢字cd e", "plain words of the day", "noch ein paar Worte", "한국어 😀 かな　カナ"]
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "what is the answer to a question that nobody asked before")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == list(range(len(texts)))


def test_passages_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcd") for _ in range(4))
    pool = [[word() for _ in range(rng.choice([40, 51, 70, 120]))] for _ in range(6)]
    texts = [" ".join(w for _ in range(3) for w in (rng.choice(pool) if rng.random() < 0.5 else [word() for _ in range(30)])) for _ in range(40)]
    texts += [texts[0], None, "", texts[1].upper().replace(" ", " \n ")]
    windows: dict = {}
    split = [(t or "").lower().split() for t in texts]
    for i, w in enumerate(split):
        for p in range(len(w) - 50):
            windows.setdefault(tuple(w[p : p + 51]), set()).add(i)
    want = {(i, p + j) for i, w in enumerate(split) for p in range(len(w) - 50) if len(windows[tuple(w[p : p + 51])]) > 1 for j in range(51)}
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    spans = passages.repeated_spans(docs, threshold=1.01).collect()
    assert {(r["key"], p) for r in spans for p in range(r["pos"], r["pos"] + r["n"] + 50)} == want
    # what stays holds every passage once, and nothing else is lost
    kept = {r["doc_id"]: (r["text"] or "").lower().split() for r in passages.remove_passages(docs, threshold=1.01).collect()}
    left = {tuple(w[p : p + 51]) for w in kept.values() for p in range(len(w) - 50)}
    assert all(split[i] == kept[i] for i in range(len(texts)) if not any(d == i for d, _ in want))
    assert 0 not in kept or 40 not in kept  # one of two equal texts goes
    assert sum(map(len, kept.values())) < sum(map(len, split)) and left


def test_alike_paragraphs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for _ in range(60):
        said = [word() for _ in range(60)]
        other = list(said)
        other[rng.randrange(60)] = word()
        rows += [" ".join(said), " ".join(other)]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(rows)], SCHEMA)
    blocks = passages.cut(passages._blocks(docs, "doc_id", "text", 51))
    held: dict = {}
    for r in blocks.collect():
        held[r["block"]] = rows[r["key"]].split()[r["pos"] : r["pos"] + r["n"] + 50]
    sets = {b: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for b, w in held.items()}
    by_row: dict = {}
    for r in blocks.collect():
        by_row.setdefault(r["key"], []).append(r["block"])
    links = {frozenset((r["block"], r["rep"])) for df in passages.alike(docs, blocks) for r in df.collect()}
    assert links and all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in map(tuple, links))
    true = {frozenset((a, b)) for i in range(0, 120, 2) for a in by_row[i] for b in by_row[i + 1] if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    groups = spark.createDataFrame([tuple(x) for x in links], "src long, dst long")
    root = {r["node"]: r["component"] for r in connected_components(groups).collect()}
    met = sum(a in root and root[a] == root.get(b) for a, b in map(tuple, true))
    assert true and met >= 0.9 * len(true)


def test_toxicity_sees_gaps(spark):
    rng = random.Random(2)
    known = ["".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(3)) for _ in range(300)]
    word = lambda: rng.choice(known)
    clean = [" ".join(word() for _ in range(30)) for _ in range(150)]
    toxic = [" ".join([*(word() for _ in range(20)), rng.choice(["blockhead", "dimwit"])]) for _ in range(60)]
    model = fit(toxic, clean)
    texts = ["you block-head " + clean[0], "you b*lockhe.ad " + clean[1], clean[2], "", None]
    got = {r["doc_id"]: r for r in toxicity(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA), model).collect()}
    assert got[0]["predicted"] == got[1]["predicted"] == 1 and got[2]["predicted"] == got[3]["predicted"] == got[4]["predicted"] == 0


def test_toxicity_of_all_scripts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("漢字仮名交文한국어") for _ in range(3))
    clean, bad = [" ".join(word() for _ in range(20)) for _ in range(120)], "悪口雑言"
    toxic = [" ".join([*(word() for _ in range(12)), bad]) for _ in range(60)]
    model = fit(toxic, clean)
    docs = spark.createDataFrame([(1, f"{word()} {bad} {word()}", "", ""), (2, clean[0], "", ""), (3, "😀 𐐀", "", ""), (3, "😀 𐐀", "", "")], SCHEMA)
    got = toxicity(docs, model).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 4 and score[1] > score[2] and score[1] > score[3] and toxicity(empty(spark), model).count() == 0


def test_licences(spark):
    full = " ".join(licences.SENTENCES[1:4])
    docs = spark.createDataFrame([(1, "Hello. Released under the  MIT license.", "", ""), (2, full, "", ""), (3, None, "", ""), (4, "", "", "")], SCHEMA)
    got = {r["doc_id"]: r for r in licences.licence_scan(docs).collect()}
    assert got[1]["rules"] == "mit-notice" and got[2]["rules"] == "mit-text" and got[2]["licences"] == "MIT" and got[3]["rules"] == got[4]["rules"] == ""


def test_licences_wrapped(spark):
    texts, names, whole = [], [], {"break_long_words": False, "break_on_hyphens": False}
    for name, _, ids in licences.RULES:
        said = [licences.SENTENCES[n - 1].replace("{}", "the Example Project and its Authors") for n in ids]
        texts.append("\n".join(said))
        for width in (40, 72, 79):
            texts.append("Copyright 2020 A\n\n" + "\n".join(textwrap.fill(s, width, **whole) for s in said) + "\n\nMore text.")
            texts.append("/*\n" + "\n *\n".join(textwrap.fill(s, width, initial_indent=" * ", subsequent_indent=" * ", **whole) for s in said) + "\n */")
        texts.append("\n".join(said).replace(" at http", " at\n\n    http"))
        names += [name] * (len(texts) - len(names))
    cut = licences.SENTENCES[5].replace("2.0 (", "2.0\n(")  # its first line is sentence 5
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate([*texts, cut])], SCHEMA)
    got = {r["doc_id"]: r for r in licences.licence_scan(docs).collect()}
    assert {(names[i], got[i]["rules"]) for i in range(len(texts)) if got[i]["rules"] != names[i]} == set()
    assert got[len(texts)]["sentence_ids"] == "<6>"


def test_shards(spark, docs):
    many = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i % 80}", "", "") for i in range(400)], SCHEMA).union(docs)
    got = shard_documents(many, shards=8).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = sorted(map(len, by.values()))
    assert len(got) == 409 and len(by) == 8 and sizes[-1] - sizes[0] <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shard_documents(empty(spark)).count() == 0


def test_shards_cut_no_group_that_fits(spark):
    rng = random.Random(12)
    texts = [f"g{i}" for i in range(90) for _ in range(rng.randint(2, 9))] + ["giant"] * 130 + [f"one {i}" for i in range(60)] + [None] * 5
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i % 600, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, shard string, g string")
    got = shard_documents(docs, shards=10).collect()
    share = -(-len(texts) // 10)
    sizes, homes = {}, {}
    by_crc = {zlib.crc32((t or "").encode()): t for t in texts}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r["slot"])
        if by_crc[r["text_crc32"]]:
            homes.setdefault(by_crc[r["text_crc32"]], set()).add(r["shard"])
    assert sorted(map(len, sizes.values()))[-1] - min(map(len, sizes.values())) <= 1 and all(sorted(v) == list(range(len(v))) for v in sizes.values())
    assert len(homes.pop("giant")) <= -(-130 // (share - 1)) + 1
    assert all(len(s) == 1 for s in homes.values())
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i % 600, len((t or "").encode()) + 16) for i, t in enumerate(texts))


def test_links_of_a_bucket_equal_brute_force():
    rng = np.random.default_rng(4)
    for m in (2, 5, 40):
        base = rng.integers(0, 1 << 31, 60, dtype=np.int64).astype(np.int32)
        sets = []
        for _ in range(m):
            x = base.copy()
            at = rng.integers(0, 55)
            x[at : at + rng.integers(0, 9)] = rng.integers(0, 1 << 31)
            sets.append(x[: rng.integers(48, 61)])
        row, pos = rng.integers(0, m, m), rng.integers(0, 90, m)
        to = pos + np.array([len(x) for x in sets]) + 4
        links, low, high = passages.linked(sets, row, pos, to, 0.8)
        apart = lambda i, j: row[i] != row[j] or pos[j] >= to[i] or pos[i] >= to[j]  # noqa: E731, B023
        near = lambda i, j: len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))  # noqa: E731, B023
        true = [(i, j) for i in range(m) for j in range(i + 1, m) if apart(i, j) and near(i, j)]

        def groups(pairs, n=m):
            up = list(range(n))
            for i, j in pairs:
                a, b = up[i], up[j]
                up = [a if u == b else u for u in up]
            return up

        assert set(links) <= set(true) and groups(links) == groups(true) and len(links) <= m - 1
        few = passages.linked_few([x.tolist() for x in sets], row.tolist(), pos.tolist(), to.tolist(), 0.8)
        assert groups(few[0]) == groups(true) and set(few[0]) <= set(true) and (few[1], few[2]) == (low.tolist(), high.tolist())
        for i in range(m):
            held = [k for a, b in true if i in (a, b) for k, x in enumerate(sets[i]) if x in set(sets[a + b - i])]
            assert (low[i], high[i]) == ((min(held), max(held)) if held else (1 << 30, -1))


def test_large_buckets_are_split(spark, monkeypatch):
    """A paragraph in hundreds of variants: with room for a few in a bucket, links stay and no task holds more."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    said = [word() for _ in range(60)]
    rows = [f"{word()} {' '.join(said)}" for _ in range(4)] + [" ".join(said[:i] + [word()] + said[i + 1 :]) for i in range(2, 58) for _ in range(3)]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(rows)], SCHEMA)
    blocks = passages.cut(passages._blocks(docs, "doc_id", "text", 51))
    monkeypatch.setattr(passages, "MOST", 24)
    monkeypatch.setattr(passages, "LEADERS", 8)
    nodes = blocks.groupBy("block").agg(F.min(F.struct("row", "pos", "n", "sig")).alias("one"), F.count("*").alias("places")).select("block", "one.*", "places")
    members = passages._members(passages.cut(nodes))
    sizes = {r["bucket"]: r["count"] for r in members.groupBy("bucket").count().collect()}
    assert sizes and max(sizes.values()) <= 48  # about 24, as parts are dealt by a hash
    links = {frozenset((r["block"], r["rep"])) for df in passages.alike(docs, blocks) for r in df.collect()}
    root = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([tuple(x) for x in links], "src long, dst long")).collect()}
    held = {r["block"]: rows[r["key"]].split()[r["pos"] : r["pos"] + r["n"] + 50] for r in blocks.collect()}
    sets = {b: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for b, w in held.items()}
    origins = {b for b, w in held.items() if " ".join(w) in " ".join(said)}
    true = [(o, b) for o in origins for b in sets if b != o and len(sets[o] & sets[b]) >= 0.8 * len(sets[o] | sets[b])]
    assert len(true) > 100 and sum(o in root and root[o] == root.get(b) for o, b in true) >= 0.9 * len(true)


def test_all_pairs_of_a_large_bucket_meet(spark, monkeypatch):
    """Paragraphs that agree in every MinHash, so that nothing but dealing can part them: each two share a bucket, and none holds many."""
    monkeypatch.setattr(passages, "MOST", 24)
    monkeypatch.setattr(passages, "LEADERS", 8)
    sig = list(range(passages.BANDS * passages.ROWS))
    nodes = spark.createDataFrame([(i * 7919, i, 0, 1, sig, 1) for i in range(120)], "block long, row long, pos int, n int, sig array<int>, places long")
    buckets: dict = {}
    for r in passages._members(passages.cut(nodes)).collect():
        buckets.setdefault(r["bucket"], set()).add(r["block"] // 7919)
    met = {(a, b) for held in buckets.values() for a in held for b in held if a < b}
    assert len(met) == 120 * 119 // 2 and max(map(len, buckets.values())) <= 48


def test_members_and_places_are_read_once(spark, monkeypatch, capsys):
    """Buckets are made once, however many large ones there are, and places of alike paragraphs are neither gathered nor unpacked."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    said = [word() for _ in range(70)]
    rows = [" ".join(said[:i] + [word()] + said[i + 1 :]) for i in range(2, 68, 2)]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(rows)], SCHEMA)
    monkeypatch.setattr(passages, "MOST", 8)
    monkeypatch.setattr(passages, "LEADERS", 4)
    blocks = passages.cut(passages._blocks(docs, "doc_id", "text", 51))
    nodes = blocks.groupBy("block").agg(F.min(F.struct("row", "pos", "n", "sig")).alias("one"), F.count("*").alias("places")).select("block", "one.*", "places")
    members = passages._members(passages.cut(nodes))
    spans = passages.repeated_spans(docs)
    capsys.readouterr()
    for made in (members, spans):
        made.explain()
    assert "explode(array(xxhash64" not in (plans := capsys.readouterr().out) and "explode(spans" not in plans
    found = spans.collect()
    assert {r["key"] for r in found if r["is_first"] and r["first_key"] == 0} == {0}
    assert len({r["key"] for r in found if not r["is_first"] and r["first_key"] == 0}) > len(rows) // 2


def test_buckets_met_twice(spark, monkeypatch):
    rng = random.Random(3)
    rows = [([rng.randrange(-40, 40), rng.randrange(3)], [rng.randrange(-(10**9), 10**9) * 2**30 if rng.random() < 0.5 else rng.randrange(200) for _ in range(rng.randrange(5))]) for _ in range(900)]
    marks: dict = {}
    for m, buckets in rows:
        for b in buckets:
            marks.setdefault(b, []).append(m)
    df = spark.createDataFrame(rows, "marks array<int>, buckets array<long>").repartition(3)
    for sent in (1 << 20, 50):
        monkeypatch.setattr(passages, "SENT", sent)
        found = [r["bucket"] for r in passages.met_twice(df, 2, 10**8).collect()]
        assert sorted(found) == sorted(b for b, m in marks.items() if all(len({x[k] for x in m}) > 1 for k in range(2)))
    assert passages.met_twice(df.limit(0), 2, 0).count() == 0
