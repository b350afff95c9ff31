"""Token counts, the filter audit and the Merkle manifest against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logweave.llm import filter_audit, merkle, queries, token_counts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(VOCABULARY)
    return lambda text: len(found.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_odd_texts(library, monkeypatch):
    """Scripts, cases, white space, contractions and special strings, also where texts are cut and memos begin anew."""
    monkeypatch.setattr(token_counts, "MEMO", 50)
    counter, rng = token_counts.TokenCounter(VOCABULARY), random.Random(3)
    characters = [chr(i) for i in [*range(0x600), 0x1E9E, 0x3000, 0xFB03, 0x1F389, 0xAC00, *range(0x2000, 0x2070), *range(0x3040, 0x3060)]]
    for c in characters:
        for text in (c, f"ab{c}Cd", f"1{c}'s"):
            assert counter.count(text) == library(text), text
    alphabet = "aAbéßİıŁŉǅ '\t\n\u0085123.,!<|>endoftextstr中ΣσΣ🎉\u0301ée가"
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        text = text[:5] + rng.choice(["", "", "<|endoftext|>", "<|startoftext|><|endoftext|>"]) + text[5:]
        assert counter.count(text) == library(text), text
    for text in ("x" * 30_000, "".join(rng.choice("abcdefghij") for _ in range(30_000))):
        assert counter.count(text) == library(text)


def test_long_texts_are_cut_at_spaces(library):
    text = "some words aren't short. " * 200
    assert "".join(token_counts.pieces(text, 100)) == text and len([*token_counts.pieces(text, 100)]) > 20
    assert [*token_counts.pieces("x" * 1000, 100)] == ["x" * 1000] and [*token_counts.pieces("", 100)] == [""]
    counter = token_counts.TokenCounter(VOCABULARY)
    assert sum(counter.count(part) for part in token_counts.pieces(text, 100)) == library(text)


def test_token_counts_of_a_table(spark, library):
    """Nulls, empty texts, repeated rows and ids, no ids, clashing names, an empty table."""
    texts = [None, "", " ", "Two words", "Two words", "é中🎉 <|endoftext|>", "word " * 3000]
    rows = [(i, t, "x", "y", 1, "z") for i, t in enumerate(texts)] + [(3, "Two words", "x", "y", 1, "z"), (None, "none", None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_tokens string")
    found = token_counts.count_tokens(docs, VOCABULARY, 2048)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    wanted = [(i, len((t or "").encode()), library(t or ""), library(t or "") > 2048) for i, t, *_ in rows]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    assert token_counts.count_tokens(docs.limit(0), VOCABULARY, 2048).collect() == []


def test_token_counts_of_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op13_token_counts(spark, sf).collect()
    assert len(found) == len(text)
    assert all(r.n_tokens == library(text[r.doc_id]) and r.n_bytes == len(text[r.doc_id].encode()) for r in found)


# --- the filter audit


def plain_audit(docs, labels):
    """Every order of the filters applied to the documents themselves."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang, *_ in docs:
        text = text or ""
        w = word.findall(text)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > least[text]]
        rows.append((lang or "", {f for f, failed in zip("ABCDE", fails, strict=True) if failed}, i in good, i in toxic))
    out, removed_by = [], defaultdict(int)
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                every = [r for r in rows if r[0] == part and f in r[1]]
                removed_by[part, f] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), len(every) - len(gone), sum(r[1] == {f} for r in every), sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted((*row, removed_by[row[0], row[1][row[2] - 1]]) for row in out)


def odd_documents(rng, n):
    """Texts that fail every set of filters, copies of them, repeated rows, nulls, very long ones."""
    vocabulary = [f"w{i}" for i in range(900)]
    texts = [None, "", " \n", "short", "x" * 100_000, " ".join(rng.choices(vocabulary, k=30_000))]
    for _ in range(n):
        w = rng.choices(vocabulary[: rng.choice([20, 900])], k=rng.choice([150, 199, 200, 260]))
        w = [x.upper() * 4 for x in w] if rng.random() < 0.3 else w
        texts.append(rng.choice([" ", "\n", "\x0b \t"]).join(w) + rng.choice(["", "", " #", " \u00a0"]))
    texts += rng.choices(texts, k=n)
    rows = [(int(i), t, rng.choice(["en", "fr", "", None]), rng.choice(["a", "b", None]), None) for i, t in zip(rng.sample(range(-50, 10 * n + 60), len(texts)), texts, strict=True)]
    return rows + [rows[7], rows[0], (None, rows[8][1], "en", "b", 3), (None, None, None, None, None), (rows[9][0], "other text of an id", "en", "a", 1)]


def test_filter_audit(spark):
    rng = random.Random(11)
    rows = odd_documents(rng, 60)
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for r in rows if r[0] is not None and rng.random() < 0.6]
    labels += [(labels[0][0], 1, 1), (123_456, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA + ", mask string, n string, part string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, table)
    assert sorted(map(tuple, found.collect())) == plain_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), table).collect() == [] and filter_audit.audit(docs.limit(0), table).columns == found.columns
    lone = filter_audit.audit(docs, table.limit(0))
    assert lone.agg(F.sum(F.col("good_lost") + F.col("toxic_lost"))).first()[0] == 0 and lone.count() == found.count()


def test_gray_walk_equals_sums_over_cells():
    rng = np.random.default_rng(5)
    masks, counts = rng.permutation(32)[:20], rng.integers(0, 1000, (20, 3))
    states = filter_audit.walk(masks, counts)
    for subset in range(32):
        assert (states[subset] == counts[(masks & subset) == 0].sum(axis=0)).all()


# --- the Merkle manifest


def plain_manifest(rows, fan=16):
    """(root of all, {leaf: (subroot, digests beside it, ways up)}) by building every level of every tree."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    enc = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf_of = lambda i, text, lang, source, n: sha(enc(i) + enc(source) + enc(lang) + enc(n) + enc(text))

    def tree(hashes):
        paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
        while len(level) > 1:
            for k, i in enumerate(at):
                run = level[i // fan * fan : i // fan * fan + fan]
                paths[k].append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
            at = [i // fan for i in at]
            level = [sha("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
        return level[0], paths

    groups = defaultdict(list)
    for row in rows:
        groups[row[3]].append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, out = [], []
    for name in names:
        ordered = sorted(groups[name], key=lambda x: x[:3])
        sub, paths = tree([x[2] for x in ordered])
        subs.append(sub)
        out.append(list(zip(ordered, paths, strict=True)))
    root, tops = tree(subs)
    found = []
    for own, sub, top in zip(out, subs, tops, strict=True):
        for (_, _, leaf, row), path in own:
            i, text, lang, source, n = row
            touched = i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and text is not None
            now = leaf_of(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in text), lang, source, n) if touched else leaf
            for left, right in path + top:
                now = sha(left + now + right)
            found.append((i, leaf, sub, root, sha("".join(a + b for a, b in path + top)), now, now == root))
    return sorted(found, key=str)


def manifest_of(docs):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    later = {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered).otherwise(F.col("text"))}
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], later=later)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17, None: 15}, {"hot": 700, "": 257, "é": 256, "z": 1, None: 2}, {f"s{i}": 1 + i % 3 for i in range(300)}])
def test_manifest(spark, sizes):
    rng = random.Random(7)
    rows = [(None if rng.random() < 0.03 else rng.randrange(-999, 10**7), rng.choice([None, "", "Text ABC é", "low", "X" * 9000]), rng.choice(["en", None]), s, rng.choice([None, 5])) for s, n in sizes.items() for _ in range(n)]
    if len(rows) > 40:  # repeated rows and ids
        rows[5] = rows[6] = (5, "Five", "en", rows[5][3], 1)
        rows[8] = (5, "six", "en", rows[5][3], 1)
    docs = spark.createDataFrame([(*r, "l", "h") for r in rows], SCHEMA + ", leaf string, hash string").repartition(3)
    found = manifest_of(docs)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert manifest_of(spark.createDataFrame([], SCHEMA)).collect() == []


def test_manifest_finds_every_tampered_document(spark):
    rows = [(i, f"Text {i}" if i % 2 else f"text {i}", "en", f"s{i % 3}", 1) for i in range(400)]
    found = manifest_of(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in found if not r.verified} == {i for i in range(400) if i % 2 and zlib.crc32(str(i).encode()) % 5 == 0}


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_merkle"])
def test_audits_equal_their_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})")
    assert sorted(want.columns) == columns and sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
