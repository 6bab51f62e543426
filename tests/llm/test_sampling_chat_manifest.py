"""Resampling, reply trees and the manifest against brute force, with the odd cases."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stopwise.llm import manifest as mf
from stopwise.llm import queries, resampling
from stopwise.llm.replies import CONTROLS, branches, conversations, digest, escaped, read_back, reply_trees, unescaped

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
ODD = ["", None, "One two  three.\n\n four", "ÀÉ İstanbul ǅ words WORDS", "漢字 ab漢字cd e\x00f", "x" * 200_000 + " y", " ".join(f"w{i}" for i in range(40_000)), "12 a_b c-d e f", "!!! ..."]


# importance resampling


def test_splitter_cuts_every_letter_like_the_pattern():
    pattern = re.compile(resampling.WORD)
    s = resampling.Splitter()
    every = "".join(chr(c) for c in range(0x500)) + " ".join(chr(c) for c in range(0x1F00, 0x3100)) + "😀\U0010ffff"
    for text in [*(t or "" for t in ODD), every, "é" * resampling.PART + " z", "a b " * resampling.PART]:
        low = text.encode().lower().decode()
        assert [(w, (m.start(), m.end())) for m in pattern.finditer(low) for w in [m.group()]] == list(s.words(text))


def brute_resampling(docs, items, percent=25, least=20, buckets=10_000):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(t):
        w = pattern.findall((t or "").encode().lower().decode())
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in features(text)[1]:
            s[b] += 1
    for text in items:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    rows = []
    for key, text in docs:
        n, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(SHA(f"7:{'' if key is None else key}")[:8], 16)
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("percent", [0, 25, 100])
def test_resampling_equals_brute_force(spark, percent):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(words[: 30 + i]) for _ in range(rng.choice([5, 19, 20, 60])))) for i in range(120)]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [docs[0], docs[0], (None, docs[3][1]), (77, docs[4][1])]
    items = [" ".join(rng.choice(words[:50]) for _ in range(40)) for _ in range(9)] + [None, ""]
    df = spark.createDataFrame([(k, t, 1, "clash") for k, t in docs], "doc_id long, text string, score int, bucket string").repartition(5)
    target = spark.createDataFrame([(t,) for t in items], "text string")
    got = sorted((tuple(r) for r in resampling.resample(df, target, percent).collect()), key=str)
    assert got == brute_resampling(docs, items, percent)


def test_resampling_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(df, df).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in resampling.resample(one, df).collect()] == [(1, 3, math.floor(1000 * math.log(10_003 / 20_000)))]


# reply trees


def test_escapes_are_reversible(spark):
    rng = random.Random(3)
    bits = ["\\", "<", "|", ">", "[", "]", "/", "s", " ", "\n", "ä", *CONTROLS, *(c[1:] for c in CONTROLS), *(c[:1] + "\\" for c in CONTROLS)]
    texts = [""] + CONTROLS + ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] for r in rows)
    assert not any(c in r["e"] for r in rows for c in CONTROLS)


def test_conversations_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(30), None]:
        for t in range(rng.choice([1, 2, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "a\n<|im_sep|>b"]), rng.choice([None, "", "plain\ntext ", " <|im_end|>\n<|im_start|>user", "\\<s>\\\\[INST]", "é漢字😀"]), "extra"))
    rows += [rows[0], rows[0], (3, 1, "assistant", "tie", ""), (3, None, "user", "no turn", ""), (50, 1, "assistant", "long " * 100_000, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string").repartition(3)
    made = conversations(df)
    got = {r["conv_id"]: tuple(r)[1:] for r in digest(made).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: tuple((x is not None, x if x is not None else "") for x in r[1:4]))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want[c] = (len(own), SHA("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), SHA(loss))
    assert {c: v[:4] for c, v in got.items()} == want
    for r in made.collect():
        assert got[r["conv_id"]][4] == len(r["formatted"])
        assert all(r["formatted"][s["start"] - len("assistant<|im_sep|>") : s["start"]] == "assistant<|im_sep|>" and r["formatted"][s["end"] :].startswith("<|im_end|>\n") for s in r["learn"])
    back = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in made.select("conv_id", read_back(F.col("formatted")).alias("t")).collect()}
    assert back[50] == [("assistant", "long " * 100_000)] and ("a\n<|im_sep|>b" in {t[0] for v in back.values() for t in v})
    assert conversations(df.limit(0)).count() == 0


def test_paths_of_trees(spark):
    rng = random.Random(6)
    rows, parent, score, text = [], {}, {}, {}
    for tree in range(6):
        ids = [tree * 1000 + i for i in range(rng.choice([1, 40, 90]))]
        for i, n in enumerate(ids):
            parent[n] = None if i == 0 or rng.random() < 0.03 else (ids[0] if tree == 1 else rng.choice(ids[max(0, i - 4) : i]))
            score[n], text[n] = rng.choice([None, 0.0, 1.0, rng.random()]), f"said {n}"
            rows.append((tree, n, parent[n], "user" if i % 2 else "assistant", text[n], score[n]))
    parent |= {9001: 9003, 9002: 9001, 9003: 9002, 9004: 9003, 9005: 555_555}  # a circle, one below it, a parent that is not there
    rows += [(9, n, parent[n], "user", "x", None) for n in (9001, 9002, 9003, 9004, 9005)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")

    def path(n):
        out = [n]
        while parent.get(out[-1]) in parent:
            out.append(parent[out[-1]])
        return out[::-1]

    inner = set(parent.values())
    leaves = [n for n in parent if n not in inner and n != 9004]
    got: dict = {}
    for r in branches(df.select("tree", "node", "parent")).collect():
        got.setdefault(r["leaf"], []).append((-r["up"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {n: path(n) for n in leaves}
    mean = lambda n: math.fsum(score.get(x) or 0.0 for x in path(n)) / len(path(n))
    by_tree: dict = {}
    for n in leaves:
        by_tree.setdefault(n // 1000, []).append(n)
    out = reply_trees(df, best=2).collect()
    for tree, own in by_tree.items():
        best = sorted(own, key=lambda n: (-round(mean(n), 9), -len(path(n)), n))[:2]
        mine = sorted((r for r in out if r["tree"] == tree), key=lambda r: r["rank"])
        assert [round(r["score"], 9) for r in mine] == [round(mean(n), 9) for n in best] and [r["leaf"] for r in mine] == best
        for r in mine:
            assert [f"said {n}" in r["formatted"] for n in path(r["leaf"])].count(False) == 0 or tree == 9


# manifest


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: SHA("".join(field(v) for v in (r[0], r[2], r[3], r[4], r[1])))
    lower = lambda t: None if t is None else t.encode().lower().decode()

    def tree(nodes):
        """The root, and of each node the (left, right) siblings of every level."""
        paths, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, w in enumerate(where):
                run = nodes[w // 16 * 16 : w // 16 * 16 + 16]
                paths[i].append(("".join(run[: w % 16]), "".join(run[w % 16 + 1 :])))
            nodes = [SHA("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
            where = [w // 16 for w in where]
        return nodes[0], paths

    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(groups[s], trees[s][1]):
            whole = path + top
            now = leaf((r[0], lower(r[1]), *r[2:])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r)
            for left, right in whole:
                now = SHA(left + now + right)
            out.append((r[0], leaf(r), trees[s][0], root, SHA("".join(a + b for a, b in whole)), now, now == root))
    return sorted(out, key=str)


def test_manifest_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    sizes = {"a": 1, "b": 16, "c": 17, "d": 256, "e": 257, "f": 4096, "g": 4097, "": 2, None: 33, "é": 5, "Z": 1} | {f"s{i}": 1 for i in range(300)}
    rows = [(rng.randrange(10**6), rng.choice(["Some Text", "plain", None, "", "ÄÖ Up"]), s, rng.choice(["en", None]), rng.choice([None, 9])) for s, n in sizes.items() for _ in range(n)]
    rows += [rows[5], rows[5], (None, "No Id", "b", None, None), (12, "X" * 300_000, "b", "en", 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, lang string, n_chars long, g string").repartition(6)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_manifest(spark, str(tmp_path)).collect()), key=str)
    want = brute_manifest(rows)
    assert len(got) == len(want) and got == want
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_manifest_of_few_rows(spark, tmp_path, n):
    rows = [(i, "Text", "s", "en", 4) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == (brute_manifest(rows) if rows else [])


def test_proofs_stand_alone(spark):
    """A leaf and its path give the root without any other row."""
    df = spark.createDataFrame([(i, "abc"[i % 3], f"text {i}") for i in range(700)], "k long, g string, t string")
    for r in mf.manifest(df, "k", "g", ["k", "t"]).collect():
        node = SHA(f"{len(str(r['k']))}:{r['k']}{len('text ' + str(r['k']))}:text {r['k']}")
        assert node == r["leaf"]
        for p in r["path"]:
            node = SHA(p["left"] + node + p["right"])
        assert node == r["root"] and r["verified"]
