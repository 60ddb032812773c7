"""Operators 11 to 13 against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from compare import assert_same, duck
from pyspark.sql import functions as F
from tallyframe.llm import bpe_codec, conversation_trie, merkle, queries
from tallyframe.llm.common import Scratch
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_merkle"])
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), duck(SF).sql(queries.ORACLES[name]))


# 11


def plain_trie(rows):
    """``{(smallest member, depth): (parent, members, children, leaves, saved, ends)}``."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(x, key=lambda y: (*y[:3], hashlib.sha256(f"{len(y[2].encode())}:{y[2]}{y[3]}".encode()).digest()))] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(c)
        ends[rebuilt].append(c)
    out = {}
    for node, m in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(k[:-1] == n and len(k) == len(n) + 1 for k in members)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        out[m[0], len(node)] = (min(members[node[:-1]]) if node else None, len(m), sum(len(n) == len(node) + 1 for n in below), len(leaves), saved, sha(",".join(map(str, sorted(ends[node])))))
    return out


def conversations():
    rng = random.Random(7)
    rows = [(1000 + i, t, "user", f"same {t}") for i in range(120) for t in range(4)]
    rows += [(500, t, "user", f"deep {t}") for t in range(150)] + [(501, t, "user", f"deep {t}") for t in range(140)]
    rows += [(c, t, rng.choice(("user", "assistant", None)), rng.choice(("a", "bé", "", None))) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(7, None, "user", "first"), (7, None, "user", "again"), (8, 0, "user", "twice"), (8, 0, "user", "twice"), (None, 0, "user", "lost"), (2003, 0, "user", "one")]
    return rows


@pytest.mark.parametrize("options", [{}, {"cap": 3, "band": 5, "held": 4}])
def test_trie(spark, options):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"node": F.lit("x"), "place": F.lit(1)}).repartition(3)
    found = conversation_trie.trie_digest(df, **options).collect()
    got = {(r["conv_id"], r["depth"]): tuple(r[c] for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in found}
    assert len(got) == len(found)
    assert got == plain_trie(rows)


def test_trie_of_nothing_and_of_one_long_conversation_over_ranges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.trie_digest(empty).collect() == []
    rows = [(0, t, "user", f"t{t % 7}") for t in range(400)]
    scratch = Scratch(spark)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    walked = conversation_trie.turn_maps(df, scratch)
    assert sorted(r["place"] for r in walked.select("place").collect()) == list(range(400))
    got = {(r["conv_id"], r["depth"]): r["n_leaves"] for r in conversation_trie.trie_digest(df, cap=50, band=32).collect()}
    assert got == {(0, d): 1 for d in range(401)}


def test_queue_spills():
    rng, queue = random.Random(3), conversation_trie.SpillingQueue(5)
    items = [(rng.randint(0, 9), i) for i in range(200)]
    for item in items:
        queue.push(item)
    taken = [x for k in range(10) for x in queue.take((k,))]
    assert taken == sorted(items) and not queue


# 12


def plain_tree(leaves: list[str]):
    """The root and each leaf's siblings by level, as (left, right)."""
    level, at, proofs = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for proof, i in zip(proofs, at):
            a = i // 8 * 8
            proof.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], proofs


def plain_manifest(docs):
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    by = defaultdict(list)
    for doc_id, text, lang, source, n_chars in docs:
        low = None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        own, other = leaf((doc_id, source, lang, n_chars, text)), leaf((doc_id, source, lang, n_chars, low))
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        by[lang].append((doc_id is not None, doc_id or 0, own, other if tampered else own))
    trees = {k: sorted(v) for k, v in by.items()}
    subs = {k: plain_tree([r[2] for r in v]) for k, v in trees.items()}
    order = sorted(subs, key=lambda k: (k is not None, (k or "").encode()))
    root, tops = plain_tree([subs[k][0] for k in order])
    out = []
    for k, top in zip(order, tops):
        for (known, doc_id, own, folded), proof in zip(trees[k], subs[k][1]):
            for left, right in (whole := proof + top):
                folded = sha(left + folded + right)
            out.append((doc_id if known else None, own, subs[k][0], root, sha("".join(a + b for a, b in whole)), folded, folded == root))
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("kind", ["many", "one"])
def test_manifest(spark, kind):
    docs = [(5, "Ein TEXT", "de", "web", 8)]
    if kind != "one":
        docs += [(i, f"Text {i}", f"l{i % 11}" if i % 2 else None, None if i % 5 == 0 else "é", i) for i in range(40)]
        docs += [(None, None, None, None, None), (None, "", "x", "s", 0), (3, "ABC", "en", "s", 3), (3, "ABC", "en", "s", 3), (3, "ABD", "en", "s", 3), (-9, "abc", "en", "s", 3)]
    if kind == "many":
        docs += [(1000 + i, f"A{i % 50}" if i % 3 else "same", "en", "web", 2) for i in range(1200)] + [(7000 + i, "B", "fr", "web", 1) for i in range(513)]
    df = spark.createDataFrame(docs, DOCS).withColumns({"leaf": F.lit(1), "place": F.lit(2), "tree": F.lit(3)}).repartition(3)
    made = merkle.build(df, Scratch(spark), merkle.lower_cased_third())
    got = [tuple(r) for r in merkle.proofs(made).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(docs), key=repr)
    whole = merkle.proofs(made, whole=True).first()
    assert sha("".join(s["l"] + s["r"] for s in whole["proof"])) == whole["proof_sha256"]


def test_manifest_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.proofs(merkle.build(empty, Scratch(spark), merkle.lower_cased_third())).collect() == []


# 13


def odd_texts():
    rng = random.Random(5)
    signs = [32, 39, 65, 97, 48, 0x300, 0x1E9E, 0x4E00, 0x1F600, 0x200D, 10, 9, 0xA0, 0x85]
    out = [None, "", " ", "  a", "<|endoftext|>x <|endoftext|>", "don't WE'LL 12345", "日本語​テスト", "-" * 5000, "ab" * 3000, "x" * 129, "=" * 128, "no end " * 30_000]
    out += ["".join(chr(rng.choice(signs)) for _ in range(n)) for n in (1, 40, 3000)]
    return out + ["".join(rng.choice("abct hex's019\n  ") for _ in range(rng.randint(0, 300))) for _ in range(60)]


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(BPE)
    texts = odd_texts() + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    wants = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoded = bpe_codec.encode(docs, BPE)
    assert sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=repr) == sorted(((i, w) for (i, _), w in zip(rows, wants)), key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in bpe_codec.decode(encoded, BPE).collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    digests = [(i, len(w), sha(",".join(map(str, w))), sha(library.decode(w, skip_special_tokens=False)), True) for (i, _), w in zip(rows, wants)]
    assert sorted(map(tuple, bpe_codec.round_trip(docs, BPE).collect()), key=repr) == sorted(digests, key=repr)


def test_bpe_decodes_ids_cut_within_a_character(spark):
    library = Tokenizer.from_file(BPE)
    ids = library.encode("😀 ok", add_special_tokens=False).ids[1:]
    got = bpe_codec.decode(spark.createDataFrame([(1, ids), (2, None), (3, [])], "doc_id long, ids array<int>"), BPE).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: library.decode(ids, skip_special_tokens=False), 2: "", 3: ""}


def test_bpe_short_and_long_words_agree():
    arrays, rng = bpe_codec.RankArrays(BPE), random.Random(2)
    words = [bytes(rng.choice(b"aeinst re") for _ in range(rng.randint(1, 128))) for _ in range(300)]
    assert arrays.words(words) == [arrays.long(w) for w in words]


def test_bpe_of_nothing(spark):
    assert bpe_codec.round_trip(spark.createDataFrame([], "doc_id long, text string"), BPE).collect() == []


# 4: texts of one id


def test_texts_of_one_id_whose_short_hashes_agree_keep_their_own_spans(spark):
    from tallyframe.llm.substring_dedup import substring_dedup

    passage, own = " ".join(f"p{i}" for i in range(20)), " ".join(f"q{i}" for i in range(42))
    ids = spark.range(150_000).select(F.col("id").cast("string").alias("id"))
    one, two = (ids.select(F.concat_ws(" ", F.lit(t), "id").alias(c)).withColumn("h", F.hash(c)) for t, c in ((f"{passage} a", "a"), (f"{own} b", "b")))
    pair = one.join(two, "h").first()
    assert pair
    docs = spark.createDataFrame([(-1, passage), (None, pair["a"]), (None, pair["b"])], "doc_id long, text string")
    got = {r["text"]: (r["n_removed"], r["kept"]) for r in substring_dedup(docs).collect()}
    assert got == {pair["a"]: (0, pair["a"]), passage: (20, ""), pair["b"]: (0, pair["b"])}


def test_thousands_of_texts_of_one_id(spark):
    from tallyframe.llm.substring_dedup import substring_dedup

    rng = random.Random(4)
    passages = [[f"w{p}.{i}" for i in range(25)] for p in range(60)]
    rows = sorted({" ".join([f"x{i}", *rng.choice(passages), f"y{i % 700}", *rng.choice(passages)]) for i in range(3000)})
    docs = spark.createDataFrame([(5, t) for t in rows], "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    got = docs.join(substring_dedup(docs.drop("h")).select("text", "kept"), "text").orderBy("h").collect()
    seen: dict[tuple, tuple] = {}
    for n, r in enumerate(got):
        w = r["text"].split()
        keep = [True] * len(w)
        for i in range(len(w) - 19):
            if seen.setdefault(tuple(w[i : i + 20]), (n, i)) != (n, i):
                keep[i : i + 20] = [False] * 20
        assert r["kept"] == " ".join(x for x, k in zip(w, keep) if k)


# 6: pages of a few sites that share paragraphs


def test_pages_of_few_paragraphs(spark):
    from tallyframe.llm.jaccard_join import jaccard_join

    rng = random.Random(1)
    paragraphs, heads = ([" ".join(f"{c}{k}w{i}" for i in range(40)) for k in range(n)] for c, n in (("p", 16), ("h", 3)))
    texts = [" ".join([heads[i % 3], *rng.sample(paragraphs, 5)]) for i in range(180)] + [" ".join(heads[0].split()[:38] + [f"own{i}", f"its{i}"]) for i in range(20)]
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    least = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((least[i], least[j]))
                least = [x if z == y else z for z in least]
    got = jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), region=8).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == least
