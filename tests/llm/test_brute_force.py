"""Whole queries and the pipeline against plain versions, words that weak hashes confuse, and bounds at any row count."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from test_text_operators import BPE, SF, WORD, brute_components, brute_entities, brute_removal, check_pieces, shingles  # noqa: E402

from tallyframe.llm import chat, common, language_id, packing, pii, sentencepiece_codec, substring_dedup  # noqa: E402
from tallyframe.llm.jaccard_join import jaccard_join  # noqa: E402
from tallyframe.llm.pretokens import PreTokens  # noqa: E402
from tallyframe.llm.queries import QUERIES  # noqa: E402
from tallyframe.llm.words import FIRST, utf8  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


ALIKE = [(thue_morse(n), thue_morse(n, "ba")) for n in (1024, 2048)]


def test_words_that_sums_of_powers_confuse(spark):
    """Complementary Thue-Morse words have equal polynomial hashes modulo 2**64 for every odd base."""
    for a, b in ALIKE:
        assert len(set(FIRST.of_bytes(np.frombuffer((a + b).encode(), np.uint8), np.array([0, len(a)]), np.array([len(a), 2 * len(a)])).tolist())) == 2
        texts = [f"x {a} y", f"x {b} y"]
        own = [f"w{i}" for i in range(19)]
        df = spark.createDataFrame([(1, " ".join([a, *own])), (2, " ".join([b, *own]))], "doc_id long, text string")
        assert [r["n_removed"] for r in substring_dedup.substring_dedup(df).collect()] == [0, 0]
        short = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
        assert sorted(r["component_id"] for r in jaccard_join(short).collect()) == [1, 2]
        flat, count, same = sentencepiece_codec.Codec(PIECES).encode_all(pa.array(texts))
        assert all(same) and flat[: count[0]].tolist() != flat[count[0] :].tolist()
        flat, count = PreTokens(BPE).encode(*utf8(pa.array(texts)))
        assert flat[: count[0]].tolist() != flat[count[0] :].tolist()
        assert check_pieces(packing.pack(short, BPE).collect(), [(1, a), (2, b)])
        turns = spark.createDataFrame([(1, 0, "user", a), (2, 0, "user", b)], "conv_id long, turn long, role string, text string")
        assert {r["conv_id"]: r["turns_sha256"] for r in chat.chat_digest(turns, BPE).collect()} == {i: hashlib.sha256(f"user\n{t}\n".encode()).hexdigest() for i, t in ((1, a), (2, b))}


def test_sentencepiece_query(spark, rows):
    import sentencepiece

    original = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = {r["doc_id"]: r for r in QUERIES["op1_sentencepiece"](spark, SF).collect()}
    assert len(out) == len(rows)
    for ident, text, _ in rows:
        ids = original.encode(text or "")
        back = original.decode(ids)
        r = out[ident]
        assert (r["n_tokens"], r["ids_crc32"], r["decoded_sha256"], r["lossless"], r["parity"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (text or ""), True)


def test_fingerprint_query(spark, rows):
    out = {r["doc_id"]: r for r in QUERIES["op2_fingerprints"](spark, SF).collect()}
    down = rows[::-1]
    for i, (ident, text, _) in enumerate(down):
        text, after = text or "", down[(i + 1) % len(down)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = out[ident]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = shingles(text), shingles(other)
            assert abs(r[name] - len(a & b) / max(1, len(a | b))) < 0.13  # six standard deviations of 512 bins
    assert len(out) == len(rows)


def brute_languages(train, rows):
    """Hyperdimensional profiles by the definition: one trigram at a time."""
    letters, symbol = language_id._letters(512).astype(int), language_id._symbol_of()

    def bundle(text):
        words = "".join(x if symbol[ord(x)] else " " for x in text or "").split()
        total = np.zeros(512)
        # letters are bound with their neighbours; words are apart by one space, which is symbol 0
        line = [0, *[s for w in words for s in (*(int(symbol[ord(x)]) for x in w), 0)]]
        for (a, b, c), n in Counter(zip(line, line[1:], line[2:])).items():
            if b:
                total += n * np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return total

    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    prototypes = defaultdict(lambda: np.zeros(512))
    for text, lang in sorted(set(train)):
        prototypes[lang] += unit(bundle(text))
    names = sorted(prototypes)
    out = []
    for text in rows:
        v = bundle(text)
        cos = [float(unit(v) @ unit(prototypes[n])) for n in names]
        out.append((names[int(np.argmax(cos))], max(0.0, max(cos))) if v.any() else ("und", 0.0))
    return out


def test_language_query(spark, rows):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    train = [(t, lang) for i, t, lang in rows if not held[i] and t is not None and lang is not None]
    expected = dict(zip((i for i, _, _ in rows), brute_languages(train, [t for _, t, _ in rows])))
    out = QUERIES["op5_language_id"](spark, SF).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["held_out"], r["lang_pred"]) == (held[r["doc_id"]], expected[r["doc_id"]][0])
        assert abs(r["score"] - expected[r["doc_id"]][1]) < 1e-4


def brute_terms(rows, near=5, support=3, disclosure=0.8):
    """The terms of each document which reveal one of its entities: every pair is counted."""
    clean = lambda w: w.strip(pii._EDGE).lower()
    holds, n_t, contexts, joint = defaultdict(set), Counter(), defaultdict(set), defaultdict(set)
    for key, text in rows:
        words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
        n_t.update({clean(w) for _, _, w in words} - {""})
        spans = brute_entities(text)
        hidden = {j for j, (a, b, _) in enumerate(words) if any(s < b and a < e for s, e, _ in spans)}
        free, close = [w for j, (_, _, w) in enumerate(words) if j not in hidden], defaultdict(set)
        for s, e, k in spans:
            entity = f"{pii.KINDS[k]}:{text[s:e].lower()}"
            holds[entity].add(key)
            at = [j for j, (a, b, _) in enumerate(words) if s < b and a < e]
            around = [words[j][2] for j in range(max(0, at[0] - near), min(len(words), at[-1] + 1 + near)) if j not in hidden]
            for term in {clean(w) for w in around} - {""}:
                close[entity].add(term)
                contexts[entity, term].add(" ".join(around))
                joint[entity, term].add(key)
        first = {}
        for j, w in enumerate(free):
            first.setdefault(clean(w), j)
        for entity in {f"{pii.KINDS[k]}:{text[s:e].lower()}" for s, e, k in spans}:
            for term in set(first) - close[entity] - {""}:
                contexts[entity, term].add(" ".join(free[max(0, first[term] - near) : first[term] + near + 1]))
                joint[entity, term].add(key)
    bad = defaultdict(set)
    for (entity, term), seen in contexts.items():
        n_e, n_et = len(holds[entity]), len(joint[entity, term])
        ic = math.log2(len(rows) / n_e)
        if len(seen) >= support and ic > 0 and math.log2(len(rows) * n_et / (n_e * max(n_t[term], n_et))) >= disclosure * ic:
            for key in holds[entity]:
                bad[key].add(term)
    return bad


def brute_spans(key, text, bad):
    base = [(s, e, pii.KINDS[k]) for s, e, k in brute_entities(text)]
    order = lambda x: (x[0], (*pii.KINDS, "term").index(x[2]))
    terms = []
    for m in WORD.finditer(text):
        word = m[0].strip(pii._EDGE)
        at = m.start() + m[0].find(word)
        if word.lower() in bad[key] and not any(s < at + len(word) and at < e for s, e, _ in base):
            terms.append((at, at + len(word), "term"))
    return sorted(base, key=order), sorted(base + terms, key=order)


def said(spans):
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def test_pii_query(spark, rows):
    docs = [(i, t or "") for i, t, _ in rows]
    bad = brute_terms(docs)
    for r in QUERIES["op7_pii"](spark, SF).collect():
        base, every = brute_spans(r["doc_id"], dict(docs)[r["doc_id"]], bad)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in base) for k in pii.KINDS]
        assert (r["base_sha256"], r["spans"]) == (hashlib.sha256(said(base).encode()).hexdigest(), said(every))


def test_revealing_terms_in_every_alphabet(spark):
    """Names of three alphabets near and far from an address, beside common words, log lines of many addresses and repeated rows."""
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(60)]
    texts = []
    for i in range(60):
        body = " ".join(rng.choice(words, 30))
        name = ("Zorro", "Élodie", "Иванов", "ÖZIL")[i % 4]
        texts.append(f"Dear {name}, {body} write to {name.encode('punycode').decode()}{i % 4}@host{i % 2}.org. {body[:40]} {name}!" if i % 3 else body)
    texts += [" ".join(f"10.0.{i % 7}.{j} token{i}_{j}" for j in range(20)) for i in range(8)] + [texts[1]] * 3
    docs = list(enumerate(texts))
    bad = brute_terms(docs)
    assert any("élodie" in x for x in bad.values()) and any("иванов" in x for x in bad.values())
    for r in pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        base, every = brute_spans(r["doc_id"], texts[r["doc_id"]], bad)
        assert (r["base_spans"], r["spans"]) == (said(base), said(every))


def test_packing_query(spark, rows):
    assert check_pieces(QUERIES["op10_packing"](spark, SF).collect(), [(i, t) for i, t, _ in rows]) > 0.95


def test_repeated_rows_fill_blocks_evenly(spark):
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a few words").alias("text"))
    out = packing.pack(df.coalesce(2), BPE, block=512)
    assert out.count() == 20_000 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
    assert out.select("sequence_id", "offset").distinct().count() == 20_000


def test_samples_are_never_empty():
    for total in (10, 10**6, 10**11, 10**15, 10**18):
        bound = common.sample_bound(40_000, total)
        share = (bound + 2**63) / 2**64
        assert bound > -(2**63) and abs(share - min(1, 40_000 / total)) < 1e-3 * share + 1e-12


def test_hot_training_texts_count_once(spark):
    df = spark.createDataFrame([("the same words again", "en")] * 300 + [("des mots en français", "fr")], "text string, lang string")
    out = {r["text"]: r["lang_pred"] for r in language_id.language_id(df.select("text").distinct(), df).collect()}
    assert out == {"the same words again": "en", "des mots en français": "fr"}


def test_pipeline_equals_its_stages_by_brute_force(spark, rows):
    import corpus_pipeline as cp

    train = [(t, lang) for _, t, lang in rows if t is not None and lang is not None]
    guesses = brute_languages(train, [t for _, t, _ in rows])
    docs = [(i, t) for (i, t, _), (lang, score) in zip(rows, guesses) if lang != "und" and (score >= cp.LEAST_SCORE or len(t) < cp.LEAST_CHARS)]
    sizes = brute_components(docs)
    docs = [d for d, (i, n, component) in zip(docs, sizes) if n == 0 or i == component]
    cut = brute_removal(docs)
    docs = [(i, kept if n > len(WORD.findall(kept)) else t) for (i, t), (n, _, kept) in zip(docs, cut)]
    bad, clean = brute_terms(docs), []
    for i, text in docs:
        out, at = [], 0
        for s, e, kind in brute_spans(i, text, bad)[1]:
            if s >= at:
                out += [text[at:s], "" if kind == "term" else f"[{kind.upper()}]"]
            at = max(at, e)
        clean.append((i, "".join([*out, text[at:]])))
    found = cp.run(spark, SF).collect()
    assert {r["doc_id"] for r in found} == {i for i, _ in clean}
    assert check_pieces(found, clean) > 0.9


def test_large_group_of_near_copies(spark):
    """Thousands of copies of one text with edits, most of which link with nothing but lie close together, beside a common passage."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(5000):
        copy = list(base)
        for j in rng.integers(0, 60, 1 + i % 4):
            copy[j] = f"e{i}_{j}"
        rows.append((i, " ".join(copy)))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    every = sorted({s for _, t in rows for s in shingles(t)})
    number = {s: k for k, s in enumerate(every)}
    holders = defaultdict(list)
    sets = [sorted(number[s] for s in shingles(t)) for _, t in rows]
    for i, x in enumerate(sets):
        for s in x:
            holders[s].append(i)
    root, size = np.arange(len(rows)), np.array([len(x) for x in sets])
    for i, x in enumerate(sets):
        both = np.bincount(np.concatenate([holders[s] for s in x]), minlength=len(rows))
        linked = np.flatnonzero(100 * both >= 75 * (size[i] + size - both))
        low = root[linked].min()
        for r in np.unique(root[linked]):
            root[root == r] = low
    assert out == {i: (int(size[i]), int(root[i])) for i in range(len(rows))}


def test_fingerprints_across_many_ranges(spark, monkeypatch):
    """Null and repeated ids, repeated rows and long texts, in ranges of a few documents each."""
    from tallyframe.llm import fingerprints

    monkeypatch.setattr(fingerprints, "_RANGE", 1500)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(None, f"no id {i} " * (i + 1)) for i in range(12)] + [(5, f"again {i}") for i in range(8)] + [(7, "twice the same")] * 3 + [(8, None), (9, "")]
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    order = sorted(df.withColumn("tie", F.xxhash64("text")).collect(), key=lambda r: (-(r["doc_id"] if r["doc_id"] is not None else -(2**63)), r["tie"]))
    expected = []
    for i, r in enumerate(order):
        text, after = r["text"] or "", order[(i + 1) % len(order)]["text"] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        expected.append((r["doc_id"] or -1, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    out = fingerprints.edited_fingerprints(df).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"], r["edited_sha256"]) for r in out) == sorted(expected)


def test_urls_of_one_site_are_dealt_out(spark):
    from tallyframe.llm.queries import URL_RULES
    from tallyframe.llm.url_filter import rule_table, url_filter

    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.example.net/en/"), F.col("id").cast("string")).alias("url"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = url_filter(pages, rule_table(spark, URL_RULES))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan and any("hashpartitioning(site" in line and "salt" in line for line in plan.splitlines())
        assert {(r["rule"], r["verdict"]) for r in out.select("rule", "verdict").distinct().collect()} == {("example.net/en/", "allow")} and out.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
