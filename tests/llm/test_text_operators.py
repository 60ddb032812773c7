"""The text operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tallyframe.llm import fingerprints as fp  # noqa: E402
from tallyframe.llm import pii, substring_dedup  # noqa: E402
from tallyframe.llm.jaccard_join import jaccard_join  # noqa: E402
from tallyframe.llm.language_id import language_fold, language_id  # noqa: E402
from tallyframe.llm.packing import differencing, equal_windows, pack  # noqa: E402
from tallyframe.llm.words import Words, mix, utf8  # noqa: E402

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(3)
LONG = " ".join(f"w{i % 7919}" for i in range(60_000))


def words(n):
    return " ".join(f"t{i}" for i in RNG.integers(0, 400, n))


BASE = words(120)
#: Nulls, blanks, repeated rows, equal texts, one id with two texts, a null id, other white space, a very long text.
EDGES = [
    (1, BASE, "en", "a", 1),
    (2, BASE.upper().replace(" ", "\n"), None, "a", 1),
    (3, None, "en", None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n ", "en", "a", 4),
    (6, "one two", "en", "a", 7),
    (7, "one two", "fr", "a", 7),
    (8, BASE + " " + words(10), "en", "a", 1),
    (9, words(50) + " " + " ".join(BASE.split()[20:70]), "en", "a", 1),
    (9, words(50) + " " + " ".join(BASE.split()[20:70]) + " end", "en", "a", 1),
    (10, words(30), "en", "a", 1),
    (10, words(30), "en", "a", 1),
    (11, LONG, "en", "a", 1),
    (None, words(25), "en", "a", 1),
    (12, "é ü ß 日本 x y\x1cz", "de", "a", 1),
]
EDGES.append(EDGES[10])


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS).withColumns({"id": F.lit(1), "tie": F.lit("x"), "kept": F.lit(2), "cls": F.lit(3), "spans": F.lit(4), "score": F.lit("s"), "label": F.lit(0)})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [(rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows))]


@pytest.mark.parametrize(("region", "hot"), [(256, 1 << 21), (2, 1 << 21), (256, 8), (2, 1)])
def test_jaccard_join_equals_brute_force(documents, region, hot):
    rows = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()]
    out = sorted(tuple(r) for r in jaccard_join(documents, region=region, hot=hot).collect())
    assert out == sorted(brute_components(rows))


def test_jaccard_join_edges(edges, nothing):
    out = jaccard_join(edges).collect()
    assert len(out) == len(EDGES)
    by_id = {r["doc_id"]: r for r in out if r["doc_id"] not in (9, 10)}
    assert by_id[1]["component_id"] == by_id[2]["component_id"] == by_id[8]["component_id"] == 1
    assert [(by_id[i]["n_shingles"], by_id[i]["component_id"]) for i in (3, 4, 5, 6, 7)] == [(0, 3), (0, 4), (0, 5), (1, 6), (1, 6)]
    assert by_id[None]["component_id"] is None and by_id[11]["component_id"] == 11
    assert jaccard_join(nothing).count() == 0


def test_jaccard_join_at_the_threshold(spark):
    w = [f"x{i}" for i in range(16)]
    a, b = " ".join(w), " ".join([*w[:-1], "y"])  # 11 of 13 shingles are shared
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    link = lambda t: jaccard_join(df, threshold=t).filter("doc_id = 2").first()["component_id"]
    assert link(Fraction(11, 13)) == 1 and link(Fraction(111, 130)) == 2


def test_jaccard_join_without_a_link_to_any_pivot(spark):
    """The only linked pair meets in regions whose pivot, a short text, links with nothing."""
    import pyarrow as pa

    from tallyframe.llm.jaccard_join import _class, _sets

    def cls(text):
        return _class(_sets(pa.record_batch([pa.array([0]), pa.array([text])], names=["id", "text"]), 5)[4])

    for salt in range(10_000):
        w = [f"s{salt}w{i}" for i in range(10)]
        rows = [(i, " ".join(w[i : i + 5])) for i in range(6)] + [(6, " ".join([*w, "b"])), (7, " ".join([*w, "c"]))]
        order = [cls(t) for _, t in rows]
        if max(order[:6]) < min(order[6:]):
            break
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join(df).collect()) == sorted(brute_components(rows))


def test_jaccard_join_large_groups(spark):
    """Hundreds of near copies and of documents that share a long passage, joined in small regions."""
    rng = np.random.default_rng(8)
    base, passage = [f"b{i}" for i in range(80)], " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(150):
        copy = list(base)
        copy[int(rng.integers(0, 80))] = f"e{i}"
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, f"{passage} " + " ".join(f"q{i}_{j}" for j in range(20 + i % 5))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join(df, region=8).collect()) == sorted(brute_components(rows))


def brute_removal(rows, k=20):
    """rows: (key, text) in order; repeated keys are one document."""
    seen, out = {}, []
    for key, text in rows:
        w = WORD.findall(text or "")
        keep = [True] * len(w)
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            if seen.setdefault(x, (key, i)) != (key, i):
                keep[i : i + k] = [False] * k
        out.append((len(w), keep.count(False), " ".join(a for a, b in zip(w, keep) if b)))
    return out


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 100, 1])
def test_substring_dedup_equals_brute_force(documents, hot):
    rows = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()]
    out = substring_dedup.substring_dedup(documents, hot=hot).orderBy("doc_id").select("n_words", "n_removed", "kept").collect()
    assert [tuple(r) for r in out] == brute_removal(rows)


def test_substring_dedup_edges(edges, nothing):
    out = substring_dedup.substring_dedup(edges)
    assert set(out.columns) == {*edges.columns, "n_words", "n_removed", "kept"}
    rows = out.withColumn("h", F.xxhash64("text")).orderBy(F.asc_nulls_first("doc_id"), "h").collect()
    expected = brute_removal([((r["doc_id"], r["h"]), r["text"]) for r in rows])
    assert [(r["n_words"], r["n_removed"], r["kept"]) for r in rows] == expected
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_fold(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").filter("held_out and n_chars > 50").collect()
    assert len(out) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97


def test_language_edges(edges, documents, nothing):
    out = {r["doc_id"]: r for r in language_id(edges, documents).collect()}
    assert len(out) == 13 and {out[i]["lang_pred"] for i in (3, 4, 5)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[3]["score"] == 0
    assert {r["lang_pred"] for r in language_id(edges, nothing).collect()} == {"und"}
    assert language_id(nothing, documents).count() == 0


def brute_entities(text):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    patterns = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    return sorted((m.start(), m.end(), k) for k, (p, good) in enumerate(patterns) for m in re.finditer(p, text) if good(m[0]))


def test_entities_equal_the_patterns():
    rng = np.random.default_rng(1)
    parts = ["a.b@c.de", "@", ".", "1.2.3.4", "300.1.1.1", "4539 1488 0343 6467", "4539148803436467", "+1 (234) 555-0199", " ", "x@y", "é", "7", "-", "+", "9.9.9.9.9.9.9.9", "@h.io"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 12)))
        assert pii.find_entities(text) == brute_entities(text), text
    assert pii.find_entities("1" * 200_000 + "." + "a" * 200_000) == []


def test_sanitise(spark, edges, nothing):
    """A term seen near one address in different contexts gives it away; common words do not."""
    rows = [(i, f"word{i} meet zorro at z.v@mail.com today item{i}") for i in range(5)] + [(i, f"meet someone today word{i} at home") for i in range(5, 60)]
    df = spark.createDataFrame([*rows, (60, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert out[0]["sanitised"] == "word0 meet  at [EMAIL] today item0" and out[0]["spans"] == "term:11:16,email:20:32"
    assert out[0]["base_spans"] == "email:20:32" and out[7]["sanitised"] == rows[7][1] and out[60]["sanitised"] is None
    same = pii.sanitise(edges).collect()
    assert len(same) == len(EDGES) and all(r["sanitised"] == r["text"] for r in same)
    assert pii.sanitise(nothing).count() == 0


def test_sanitise_folds_every_alphabet(spark):
    """Names with a capital outside ASCII are counted in all documents, whatever their case."""
    rows = [(i, f"word{i} meet Иван Élodie Über at z.v@mail.com item{i}") for i in range(5)] + [(i, f"meet Über at word{i} home") for i in range(5, 60)] + [(60, "über")]
    out = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == "word0 meet   Über at [EMAIL] item0" and all(out[i] == text for i, text in rows[5:])


def test_base_spans_are_by_start_and_kind(spark):
    texts = ["10.0.0.1@host.com", "4539148803436467@host.com"]
    out = pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    expected = ["email:0:17,ip:0:8", "email:0:25,card:0:16"]
    assert [r["base_spans"] for r in out] == [r["spans"] for r in out] == expected and [r["sanitised"] for r in out] == ["[EMAIL]"] * 2


def test_sanitise_counts_whole_documents(spark):
    """A name in the greeting gives away the address in the signature; copies of one passage do not."""
    fill = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    rows = [(i, f"hello zorro {fill(i)} yours z.v@mail.com") for i in range(4)] + [(4, f"zorro z.v@mail.com {fill(4)}")]
    rows += [(i, f"one two three four five six seven eight nine ten copied eleven twelve thirteen fourteen fifteen c.d@mail.com {fill(i)}") for i in range(5, 10)]
    rows += [(i, f"hello {fill(i)} yours") for i in range(10, 90)]
    out = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == f"hello  {fill(i)} yours [EMAIL]" for i in range(4)) and out[4] == f" [EMAIL] {fill(4)}"
    assert all("copied" in out[i] and "[EMAIL]" in out[i] for i in range(5, 10)) and all(out[i] == text for i, text in rows[10:])


def test_pipeline_keeps_unrelated_texts_of_one_id(spark):
    import corpus_pipeline

    text = [words(40) for _ in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (7, text[2]), (7, text[3]), (8, text[3]), (9, text[3] + " end"), (None, None), (3, ""), (4, text[4]), (4, text[4])]
    docs = spark.createDataFrame([(i, x, "en", "a", len(x or "")) for i, x in rows], DOCS)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    expected = [(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (None, None), (3, ""), (4, text[4])]
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=repr) == sorted(expected, key=repr)


def test_fingerprints_follow_the_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.orderBy(F.desc("doc_id")).collect()]
    out = {r["doc_id"]: r for r in fp.edited_fingerprints(docs).collect()}
    assert len(out) == len(rows)
    errors = []
    for i, (ident, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = out[ident]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = shingles(text), shingles(other)
            errors.append(r[name] - len(a & b) / max(1, len(a | b)))
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.04
    plain = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(docs).collect()}
    assert all(plain[i] == out[i]["fingerprint"] for i in out)


def plain_bins(text):
    """One text's bits, bin by bin: the least hash of each bin, then for an empty one that of the first full bin that its own row of tries meets."""
    words = Words(*utf8(pa.array([text], pa.large_string())), lower=True)
    a, b, _ = words.windows(5, short=True)
    least = {}
    for h in fp.SECOND.spans(words.hashes(fp.FIRST), a, b).tolist():
        at = h >> 55
        least[at] = min(h, least.get(at, h))
    one = lambda x: int(mix(np.array([x % 2**64], np.uint64))[0])
    out = []
    for at in range(512):
        tries = (one(at * 256 + t) % 512 for t in range(256))
        source = at if at in least else next((j for j in tries if j in least), None)
        if source is None:
            start = one(at * 256 + 256) % 512
            source = next(j % 512 for j in range(start, start + 512) if j % 512 in least)
        out.append(one(least[source] + at * 0x9E3779B97F4A7C15) & 15)
    return "".join(f"{x:x}" for x in out)


def test_fingerprint_bits_equal_plain_ones():
    """Full and empty bins, one shingle alone and the even bin of each byte in its high half."""
    rng = random.Random(8)
    texts = ["one", "a b c d e f", *(" ".join(f"w{rng.randrange(n)}" for _ in range(n)) for n in (9, 40, 300, 5000))]
    assert fp.packed_hex(*fp.fingerprint(texts)) == [plain_bins(x) for x in texts]


def test_language_ties_go_to_the_first_label(spark):
    """Two labels learnt from the same texts have equal prototypes."""
    text = ["the lantern turned in the long dark hall", "eine lange dunkle halle und ein licht"]
    train = spark.createDataFrame([(text[0], "zz"), (text[0], "bb"), (text[1], "aa"), (text[1], "cc")], "text string, lang string")
    out = language_id(spark.createDataFrame([(i, x) for i, x in enumerate(text)], "doc_id long, text string"), train).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in out] == ["bb", "aa"] and all(r["score"] > 0.999 for r in out)


def test_fingerprint_edges(spark, edges, nothing):
    out = fp.edited_fingerprints(edges).collect()
    assert len(out) == len(EDGES) and fp.edited_fingerprints(nothing).count() == 0
    prints = {r["doc_id"]: r["fingerprint"] for r in out}
    assert prints[1] == prints[2] != prints[8] and prints[3] == prints[4] == "" and prints[6] == prints[7]
    one = fp.edited_fingerprints(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b c d a b c d").hexdigest()


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_differencing_partitions(n):
    sizes = np.random.default_rng(n).integers(1, 512, n)
    window, load = differencing(sizes, 3)
    assert np.bincount(window, weights=sizes, minlength=len(load)).tolist() == load.tolist() and load.sum() == sizes.sum()
    assert np.bincount(equal_windows(sizes, 1024), weights=sizes).max() <= 1024


def test_differencing_is_nearly_equal():
    load = differencing(np.random.default_rng(2).integers(1, 512, 1000), 260)[1]
    assert load.max() - load.min() < 40


def check_pieces(rows, docs):
    """Every id of every row in exactly one piece, sequences gapless and within capacity."""
    import zlib

    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(BPE)
    expected = {}
    for ident, text in docs:
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected.setdefault(ident, []).append(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert any(len(ids) == r["doc_tokens"] and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for ids in expected[r["doc_id"]])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(len(ids) for x in expected.values() for ids in x)
    assert sum(r["length"] for r in rows) == total
    return total / (1024 * len(sequences))


def test_pack(documents):
    rows = pack(documents, BPE).collect()
    assert check_pieces(rows, [(r["doc_id"], r["text"]) for r in documents.collect()]) > 0.97


def test_pack_edges(edges, nothing):
    check_pieces(pack(edges, BPE).collect(), [(r[0], r[1]) for r in EDGES])
    assert pack(nothing, BPE).count() == 0
