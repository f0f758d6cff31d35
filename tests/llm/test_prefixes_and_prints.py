"""Operators 11 to 13 against brute force, and on odd, empty and hot tables."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import conversation_trie, fill_middle, line_rules, near_dup, pii, quality, registry, sim_hash, span_dedup

FOLDER = "/root/testdata/sf0.001"
on_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
ODD = [None, "", " ", "\n\n", "a", "one two", "x" * 5000, "é日本😀 ▁", "a<P>b", "<M>", "<P", "P>", "<<P>>", "same. Text here! Now?", "same. Text here! Now?", "é" * 700]


def odd_rows(spark):
    ids = [None, None, 7, 7, *range(20, 18 + len(ODD) - 2)]
    rows = spark.createDataFrame(list(zip(ids, ODD, strict=True)), "doc_id long, text string")
    return rows.select("*", *[F.lit(1).alias(n) for n in ("fim", "draws", "n", "form", "print", "id", "node", "component", "component_id", "fingerprint", "with.dot", "key", "part")])


# fill-in-middle


def moved(text, doc_id):
    text = text or ""
    h = [int(x, 16) for x in re.findall(".{8}", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest())[:4]]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_kernel_against_regular_expressions():
    rng = random.Random(3)
    parts = ["a", "Bc", "<P>", "<", "P", ">", " ", "é", "日", "😀", "x" * 300, "\n", "<S", "M>", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(1500)] + ODD + ["y" * 256, "y" * 257, "é" * 128 + "<P>", "a" * 254 + "<M>", "a" * 255 + "<S>"]
    scan_draws = np.array([[rng.randrange(2**32) for _ in range(4)] for _ in texts])
    found = fill_middle.transform(pa.array(texts), scan_draws)
    for i, text in enumerate(texts):
        units, h = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or ""), scan_draws[i].tolist()
        assert found["n"][i].as_py() == len(units)
        form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        assert found["form"][i].as_py() == form
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        spans = (None, None) if form == "plain" else (len("".join(units[:a])), len("".join(units[a:b])))
        assert (found["prefix_chars"][i].as_py(), found["middle_chars"][i].as_py()) == spans


def test_middles_of_odd_rows_and_back(spark):
    rows = odd_rows(spark)
    made = fill_middle.fill_in_middle(rows)
    assert sorted(made.columns) == sorted(rows.columns)
    found = made.select("doc_id", "text", "fim.*", fill_middle.restored(F.col("text"), F.col("fim.form")).alias("back")).collect()
    given = rows.select("doc_id", "text").collect()
    expected = sorted(map(repr, (moved(r["text"], r["doc_id"]) for r in given)))
    assert sorted(repr((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["text"])) for r in found) == expected
    assert sorted(r["back"] for r in found) == sorted(r["text"] or "" for r in given)
    assert fill_middle.fill_in_middle(rows.limit(0)).count() == 0
    named = rows.withColumnRenamed("text", "the.text").withColumnRenamed("doc_id", "doc`id")
    assert fill_middle.fill_in_middle(named, "doc`id", "the.text").count() == len(ODD)


def test_all_and_none_are_moved(spark):
    rows = spark.createDataFrame([(i, f"word {i} of some more words, here") for i in range(200)], "doc_id long, text string")
    forms = lambda **o: collections.Counter(r["form"] for r in fill_middle.fill_in_middle(rows, **o).select("fim.form").collect())
    assert forms(transformed=100, spm=0) == {"psm": 200} and forms(transformed=100, spm=100) == {"spm": 200} and forms(transformed=0) == {"plain": 200}
    assert forms(seed=2) != forms(seed=1)


@on_tables
def test_op11(spark):
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = registry.QUERIES["op11_byte_dfa_middles"](spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(given)
    for r in rows:
        n, form, p, m, output = moved(given[r["doc_id"]], r["doc_id"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((given[r["doc_id"]] or "").encode()).hexdigest()


# SimHash


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashed = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashed) > len(hashed))


def brute_components(prints):
    """The smallest place reachable over links, for each place."""
    values, name = np.array(prints, np.uint64), list(range(len(prints)))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 3).tolist():
            low, high = sorted((name[i], name[j]))
            if low != high:
                name = [low if x == high else x for x in name]
    return name


def test_fingerprints():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["Alpha", "beÉ", "x" * 40, "日本", "q"]) + rng.choice(["", "1", " ", "\n", "\x0b"]) for _ in range(rng.randrange(40))) for _ in range(300)] + ODD
    assert sim_hash.fingerprints(pa.array(texts)).tolist() == [brute_print(t) for t in texts]
    assert len(sim_hash.fingerprints(pa.array([], pa.string()))) == 0


def test_no_link_of_close_fingerprints_is_lost(spark):
    """Chains, balls and a bucket of thousands, over blocks of few members: all links, and each one once."""
    rng = random.Random(2)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = [rng.getrandbits(64) for _ in range(300)]
    for n in (1, 2, 3, 4, 5):
        prints += [flip(rng.choice(prints), n) for _ in range(200)]
    prints += [prints[0] & ~0xFFFF | rng.getrandbits(16) for _ in range(1500)]  # agree in 48 bits
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = sim_hash._tabled(spark.createDataFrame([(p,) for p in signed], "print long"))
    for block in (64, 4096):
        found = [(r["a"] % 2**64, r["b"] % 2**64) for r in sim_hash._links(nodes, 3, 5, block).collect()]
        values = np.array(prints, np.uint64)
        close = {frozenset((a, int(b))) for i, a in enumerate(prints) for b in values[:i][np.bitwise_count(values[:i] ^ values[i]) <= 3]}
        assert len(found) == len(close) and set(map(frozenset, found)) == close


def test_simhash_of_odd_rows(spark):
    rows = odd_rows(spark)
    found = collections.Counter((r["doc_id"], r["fingerprint"]) for r in sim_hash.near_duplicates(rows).collect())
    assert found == collections.Counter((r["doc_id"], f"{brute_print(r['text']):016x}") for r in rows.collect())
    by_print = {r["fingerprint"]: r["component_id"] for r in sim_hash.near_duplicates(rows).collect()}
    assert by_print["0" * 16] == 7  # of null, empty and blank texts, whose ids are null or 7
    assert sim_hash.near_duplicates(rows.where("doc_id IS NULL")).where("component_id IS NOT NULL").count() == 0
    assert sim_hash.near_duplicates(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sim_hash.near_duplicates(rows, radius=5)


@on_tables
def test_op12(spark):
    given = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    prints = [brute_print(t) for _, t in given]
    name = brute_components(prints)
    expected = {d: (f"{p:016x}", given[c][0]) for (d, _), p, c in zip(given, prints, name, strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.QUERIES["op12_pivot_simhash"](spark, FOLDER).collect()} == expected


# conversations

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows):
    own = collections.defaultdict(list)
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own[r[0]].append((r[2] or "", r[3] or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])[:h] + turns[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    tokens = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p, m in members.items()}
    leaves, saved = collections.Counter(), collections.Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += tokens[p]
    return collections.Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def found_trie(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").select("*", *[F.lit(1).alias(n) for n in ("node", "base", "conv", "words", "members", "a.b")])
    return collections.Counter(tuple(r[c] for c in COLUMNS) for r in conversation_trie.prefix_trie(table).collect())


def conversations(seed, n, words=3):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-30, 3 * n), n):
        rows += [(c, t, rng.choice(["user", "bot"]) if t else "user", " ".join(rng.choice("ab") for _ in range(rng.randrange(1, words)))) for t in range(rng.randrange(1, 7))]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_brute_force(spark, seed):
    rows = conversations(seed, 120)
    assert found_trie(spark, rows) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 0, "user", "no id"), (40, None, None, None), (40, 1, "user", "a b"), (40, 1, "user", "a b"), (41, 2, "user", "x"), (41, 2, "bot", "x"), (42, 0, "u", ""), (43, 0, "", "u"), (59, 0, "user", "w " * 30_000), (60, 3, "user", "late")]
    assert found_trie(spark, rows) == brute_trie(rows)
    assert found_trie(spark, rows[:0]) == collections.Counter()
    assert found_trie(spark, [(5, 0, "u", "a")]) == brute_trie([(5, 0, "u", "a")])  # a conversation that may have no turn left


def test_trie_of_copies_long_conversations_and_small_buffers(spark, monkeypatch):
    """A third of all rows in one conversation, a third copies of one conversation; families handed on in parts, ids joined in many pieces."""
    monkeypatch.setattr(conversation_trie, "HELD", 7)
    monkeypatch.setattr(conversation_trie, "PIECE", 40)
    monkeypatch.setattr(conversation_trie, "ROWS", 5)
    rows = conversations(9, 60) + [(1000 * 20, t, "user", f"turn {t % 50}") for t in range(300)] + [(20_000 + 20 * i + 20, t, "user", "hello there") for i in range(100) for t in range(3)]
    assert found_trie(spark, rows) == brute_trie(rows)


@on_tables
def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = registry.QUERIES["op13_family_trie"](spark, FOLDER)
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in found.collect()) == brute_trie(rows)


# names that the operators of earlier rounds use inside

INSIDE = ["_pii", "_pii_id", "_pii_hash", "_pii_own", "_span_id", "_span_hash", "_span_runs", "_node", "_kept_id", "_kept_node", "_gone", "_gone_id", "gone", "mark", "c0", "c1", "kept", "a.dot", "score"]


def test_columns_may_have_any_name(spark):
    """Other columns come back as they were, whatever they are called; null and repeated ids lose their frequent lines too."""
    body = "\n".join(f"line number {i} of the text, which is long enough to count. " for i in range(6))
    texts = [None, "", "Write to jane.doe@mail.example.com now.", body, body + " and more", *[f"terms and conditions apply\nown words {i} here" for i in range(12)]]
    rows = spark.createDataFrame([(None if i % 5 == 0 else i // 2, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = rows.select("*", *[F.monotonically_increasing_id().alias(n) for n in INSIDE]).persist()
    model = quality.fit(rows, spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int"))
    outs = [pii.replace_entities(rows), span_dedup.drop_repeated_spans(rows), near_dup.drop_near_duplicates(rows), line_rules.remove_frequent_lines(rows, least=3, share=0.1), quality.score(rows, model, score_col="given")]
    carried = {r["_pii"]: tuple(r) for r in rows.drop("text").collect()}
    for out in outs:
        assert out.columns[: len(rows.columns)] == rows.columns
        found = out.toDF(*[*rows.columns, *out.columns[len(rows.columns) :]]).collect()
        at = [i for i, c in enumerate(rows.columns) if c != "text"]
        assert all(tuple(r[i] for i in at) == carried[r["_pii"]] for r in found) and len(found) <= len(texts)
    left = [r["text"] for r in outs[3].collect()]
    assert not any("terms and conditions" in (t or "") for t in left) and sum("own words" in (t or "") for t in left) == 12
    assert line_rules.remove_frequent_lines(rows.limit(0)).count() == 0
