"""Vectors, urls, conversations, SentencePiece, the queries with SQL, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import assert_same, duck
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tallyframe.llm import chat, common, embedding_dedup, sentencepiece_codec  # noqa: E402
from tallyframe.llm.pretokens import PreTokens, byte_pieces  # noqa: E402
from tallyframe.llm.queries import ORACLES, QUERIES, URL_RULES  # noqa: E402
from tallyframe.llm.url_filter import rule_table, url_filter  # noqa: E402
from tallyframe.llm.words import utf8  # noqa: E402

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", " a", "  a  b ", "\n x\n\ny", "it's we'll 'same ''s ' s 'S", "\t\ttab \xa0 nbsp　x", "12 34½ ²x", "日本語 😀 テスト", "é ü ß", "<s> </s> <unk> <0x41>", "▁x y", "\x85x\x1cy", " \n", "a\n", "    "]


@pytest.fixture(scope="module")
def sql():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    assert_same(QUERIES[name](spark, SF), sql.sql(ORACLES[name]))


def odd_texts(seed, alphabet, n=1500):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_pre_tokens_equal_the_library():
    from tokenizers import Tokenizer

    texts = odd_texts(5, list("ab 's\n\t1é²'.,  ½r evlmtd")) + ["<|endoftext|> hi"]
    whole = Tokenizer.from_file(BPE)
    flat, count = PreTokens(BPE).encode(*utf8(pa.array(texts)))
    ends = np.cumsum(count)
    for text, a, b in zip(texts, ends - count, ends):
        assert flat[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_bytes_of_ids_equal_the_library():
    from tokenizers import Tokenizer

    whole, pieces = Tokenizer.from_file(BPE), byte_pieces(BPE)
    for text in [*odd_texts(7, list("ab 's\n\t1é²'.,  ½r evlmtd日😀")), "<|endoftext|> hi"]:
        raw, edge = pieces.gather(np.array(whole.encode(text, add_special_tokens=False).ids, np.int64))
        assert raw.tobytes().decode() == text and edge[-1] == len(raw)


def test_sentencepiece_parity():
    import sentencepiece

    texts = odd_texts(3, list("ab 's\n\t1é²'.,  ½r evlmtd▁日"))
    original, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_codec.Codec(PIECES)
    flat, count, same = codec.encode_all(pa.array(texts))
    ends = np.cumsum(count)
    assert all(same)
    for text, a, b in zip(texts, ends - count, ends):
        ids = flat[a:b].tolist()
        assert ids == original.encode(text), text
        assert codec.decode(ids) == original.decode(ids), text


def test_unigram_model_is_rebuilt():
    """A unigram model with byte fallback, made of parsed pieces, against its best segmentation."""
    pieces = [("<unk>", 0.0, sentencepiece_codec.UNKNOWN), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁", -3.0, 1), ("a", -3.0, 1), ("▁ab", -2.5, 1)]
    pieces += [(f"<0x{i:02X}>", -10.0, sentencepiece_codec.BYTE) for i in range(256)]
    model = sentencepiece_codec.Model(pieces, bpe=False, byte_fallback=True)
    tokens = model.tokenizer().encode("ab  aé").tokens
    assert tokens == ["▁ab", "▁a", "<0xC3>", "<0xA9>"]


def unigram_file(path, byte_fallback, rule):
    """A unigram model of all short substrings of some words, with irregular scores and the character map ``rule`` of the original library."""
    import sentencepiece

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    field = lambda number, raw: varint(number << 3 | 2) + varint(len(raw)) + raw
    number = lambda at, n: varint(at << 3) + varint(n)
    words = ["▁the", "▁theta", "▁lantern", "▁turned", "in", "ing", "1/2", "▁éclair", "fi", "Åß", "日本", "カ", "▁", "▁▁", "."]
    parts = sorted({w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, min(i + 5, len(w)) + 1)})
    pieces = [("<unk>", 0.0, sentencepiece_codec.UNKNOWN), ("<s>", 0.0, sentencepiece_codec.CONTROL), ("</s>", 0.0, sentencepiece_codec.CONTROL)]
    pieces += [(x, -2 - zlib.crc32(x.encode()) % 100_003 / 20_011 - 2 / len(x), sentencepiece_codec.NORMAL) for x in parts]
    pieces += [(f"<0x{i:02X}>", 0.0, sentencepiece_codec.BYTE) for i in range(256)] * byte_fallback
    raw = b"".join(field(1, field(1, x.encode()) + b"\x15" + np.float32(score).tobytes() + number(3, kind)) for x, score, kind in pieces)
    raw += field(2, number(3, 1) + number(35, int(byte_fallback)))
    raw += sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto() if rule else field(3, number(4, 0))
    path.write_bytes(raw)
    return str(path)


@pytest.mark.parametrize("byte_fallback", [False, True])
@pytest.mark.parametrize("rule", [None, "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
def test_unigram_models_equal_the_original(tmp_path, byte_fallback, rule):
    """Scores, byte fallback, unknown characters, character map and white-space rules, against the original library."""
    import sentencepiece

    path = unigram_file(tmp_path / "unigram.model", byte_fallback, rule)
    original, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    assert bool(codec.model.charsmap) == (rule is not None)
    rng = random.Random(17)
    words = ["the", "theta", "lantern", "turned", "turning", "½", "éclair", "e\u0301clair", "ﬁn", "Åß", "A\u030a", "日本", "ｶ", "カ", ".", "x", "😀", "ＴＨＥ"]
    texts = ["", " ", "the", " the  lantern ", "the\u3000theta", "\u00a0the", "\tthe\n", "the\u2003 \ntheta ", "A\u030a\u0301B\u0327", "\u1e9b\u0323"] + [(" " * rng.choice([1, 1, 0, 2])).join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    flat, count, same = codec.encode_all(pa.array(texts))
    ends = np.cumsum(count)
    for text, a, b in zip(texts, ends - count, ends):
        ids = flat[a:b].tolist()
        assert ids == original.encode(text), text
        assert codec.decode(ids) == original.decode(ids), text
    assert all(same)


def test_sentencepiece_rows(spark):
    df = spark.createDataFrame([(1, "Hello  world\n"), (2, None), (3, ""), (None, "x"), (1, "Hello  world\n")], "doc_id long, text string").withColumn("ids", F.lit(0))
    out = sentencepiece_codec.round_trip(df, PIECES).collect()
    assert len(out) == 5 and all(r["lossless"] and r["parity"] for r in out)
    assert {r["doc_id"]: r["n_tokens"] for r in out if r["doc_id"] in (2, 3)} == {2: 0, 3: 0}
    encoded = sentencepiece_codec.encode(df, PIECES)
    assert sorted(r["text"] for r in sentencepiece_codec.decode(encoded, PIECES).collect()) == ["", "", "Hello  world\n", "Hello  world\n", "x"]
    assert sentencepiece_codec.round_trip(df.limit(0), PIECES).count() == 0


def brute_links(rows, least=0.93):
    n, root = {}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    good = []
    for i, v, label in rows:
        root.setdefault(i, i)
        n[i] = 0
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good.append((i, x / np.linalg.norm(x), label))
    for a in range(len(good)):
        for b in range(a):
            (i, x, k), (j, y, m) = good[a], good[b]
            if k == m and len(x) == len(y) and x @ y >= least:
                n[i] += 1
                n[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted((i, n[i], find(i), find(i) == i) for i in n)


def test_embedding_dedup_edges(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.1).tolist(), i % 2) for i in range(40)]
    rows += [(100, None, 0), (101, [0.0] * 8, 0), (102, [float("nan")] * 8, 0), (103, [1.0, None] * 4, 0), (104, base.tolist(), None), (105, [1.0, 2.0], 0), (106, [2.0, 4.0], 0), (107, [], 0), (108, rows[0][1], 0), (109, rows[0][1], 0), (110, [float("inf")] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"shard": F.lit("x"), "size": F.lit("y"), "key": F.lit(1)})
    out = embedding_dedup.embedding_dedup(df)
    assert sorted(tuple(r) for r in out.collect()) == brute_links(rows)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embedding_dedup_many_shards_and_parts(spark):
    """Small shards, dealt into parts, find what an exhaustive comparison finds."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=16).tolist(), 0) for i in range(500)]
    hot = rng.normal(size=16)
    rows += [(1000 + i, (hot + rng.normal(size=16) * 0.12).tolist(), 0) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_dedup(df, shard=120, cap=60).collect()}
    true = {r[0]: r[1] for r in brute_links(rows)}
    assert sum(out.values()) >= 0.98 * sum(true.values()) and all(out[i] <= true[i] for i in true)


@pytest.mark.parametrize("sizes", [dict(shard=20, block=150), dict(shard=20, block=150, cap=25)])
def test_embedding_dedup_divides_cells_level_by_level(spark, monkeypatch, sizes):
    """Three levels of cells fitted on few rows, several blocks, shards too full for overlap, one direction at many lengths: all links are found."""
    monkeypatch.setattr(embedding_dedup, "FAN", 4)
    monkeypatch.setattr(embedding_dedup, "SAMPLE_ROWS", 64)
    rng = np.random.default_rng(21)
    hubs = rng.normal(size=(30, 8))
    rows = [(i, (hubs[i % 30] + rng.normal(size=8) * 0.3).tolist(), i % 7 // 6) for i in range(700)]
    rows += [(1000 + i, (hubs[0] * (1 + i / 7)).tolist(), 0) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = embedding_dedup.embedding_dedup(df, **sizes).collect()
    assert sorted(tuple(r) for r in out) == brute_links(rows)


def test_embedding_cells_move_rows_in_proportion(spark, monkeypatch):
    """With a small sample, four times the vectors take four times the rows to shards and blocks, and no shard is cut into parts."""
    monkeypatch.setattr(embedding_dedup, "SAMPLE_ROWS", 128)
    rng = np.random.default_rng(22)
    moved = []
    for n in (1_000, 4_000):
        hubs = rng.normal(size=(n // 20, 24))
        x = hubs[np.arange(n) % len(hubs)] + rng.normal(size=(n, 24)) * 0.03
        df = spark.createDataFrame([("24:0", i, 1, v.tolist()) for i, v in enumerate(x)], "label string, cid long, size long, vector array<double>")
        cells = embedding_dedup._cells(df, embedding_dedup.Scratch(spark), 0.93, 40, 100, 100_000)
        got = cells.select("cid", "shards", F.size(F.coalesce("asks", F.array().cast("array<long>"))).alias("asks")).toPandas()
        assert len(got) == n and got["cid"].is_unique
        assert got["shards"].explode().value_counts().max() <= 100
        moved.append(got["shards"].map(len).sum() + got["asks"].sum())
    assert moved[1] <= 4.4 * moved[0]


def test_embedding_cells_beyond_a_block_repeat_no_vectors(spark):
    """Without clusters nearly every cell is within reach: a label of several blocks is asked for by block, and no vector is written for each cell."""
    rng = np.random.default_rng(23)
    n, block = 3_000, 600
    df = spark.createDataFrame([("24:0", i, 1, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 24)))], "label string, cid long, size long, vector array<double>")
    scratch = embedding_dedup.Scratch(spark)
    got = embedding_dedup._cells(df, scratch, 0.93, 20, 100, block).select("cid", "block", F.size(F.coalesce("asks", F.array().cast("array<long>"))).alias("asks")).toPandas()
    assert len(got) == n and got["block"].nunique() <= 2 * n // block and got["block"].value_counts().max() < 2 * block
    assert got["asks"].max() <= 2 * n // block
    tables = [spark.read.parquet(p) for p in scratch.held]
    assert max(t.filter("vector is not null").count() for t in tables if "vector" in t.columns) <= 4 * n  # its own row, and one at each level where it is near another cell


def test_embedding_dedup_finds_pairs_across_shards(spark):
    """Planted pairs at 0.93 to 0.95 with many centroids a label: all are found, whichever shards their ends are in."""
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(rng.normal(size=(1200, 16)))
    b = rng.normal(size=a.shape)
    b = unit(b - (b * a).sum(1, keepdims=True) * a)
    c = rng.uniform(0.9301, 0.95, (len(a), 1))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([a, c * a + np.sqrt(1 - c * c) * b]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = embedding_dedup.embedding_dedup(df, shard=20, block=400).collect()
    assert sorted(tuple(r) for r in out) == brute_links(rows)


def test_embedding_dedup_recall_of_many_vectors(spark):
    """Of 20,000 vectors in one label, every row divisible by 20 has the links that an exhaustive comparison finds."""
    rng = np.random.default_rng(31)
    x = rng.normal(size=(20_000, 32))
    x[10_000:11_000] = x[:1_000] + rng.normal(size=(1_000, 32)) * 0.37
    x[12_000:12_600] = x[5] + rng.normal(size=(600, 32)) * 0.25
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64())), "label": np.ones(len(x), np.int32)}))
    out = embedding_dedup.embedding_dedup(df).toPandas().set_index("vec_id")["n_links"]
    true = (x[::20] @ x.T >= 0.93).sum(1) - 1
    got = out.loc[np.arange(0, len(x), 20)].to_numpy()
    assert true.sum() > 1_000 and (got <= true).all() and got.sum() >= 0.98 * true.sum()
    print("links found", got.sum(), "of", true.sum())


def test_embedding_components_keep_chains():
    """A chain 1-5-6-2: no end of its middle link has the other as smallest neighbour."""
    assert embedding_dedup._merge(np.arange(7), np.array([1, 5, 6, 5, 6, 2]), np.array([5, 6, 2, 1, 5, 6])).tolist() == [0, 1, 1, 3, 4, 1, 1]


def test_range_search_finds_dense_groups():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 32))
    x[300:] = x[0] + rng.normal(size=(400, 32)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = x @ x.T >= 0.93
    found = embedding_dedup.range_search(x, embedding_dedup.robust_graph(x), x, 0.93)
    assert not (found & ~true).any() and found.sum() >= 0.98 * true.sum()


def test_url_filter_against_all_rules(spark):
    rng = random.Random(6)
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "org", "x.org", "notexample.net", "", "NET", "com.", "é.net"]
    paths = ["", "/", "/en/", "/en/x", "/en", "/e", "/fr/é", "/en/\U0010ffffz"]
    rules = {(h, p): rng.choice(["allow", "block"]) for h in ("net", "example.net", "a.example.net", "org") for p in ("/", "/en/", "/en/x", "/fr/")}
    table = [(v, h, p) for (h, p), v in rules.items()]
    urls = [f"{rng.choice(['http://', 'x', '://', 'a://b://'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#f'])}" for _ in range(300)] + [None, "", "http://net/", "http://net/"]
    rows = [(i % 290, u) for i, u in enumerate(urls)] + [(None, "http://x.org/fr/1")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "path": F.lit(2), "site": F.lit(3), "rule": F.lit(4)})

    def judge(url):
        if not url or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fits = [(len(h + p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")

    expected = sorted(((i, *judge(u)) for i, u in rows), key=repr)
    assert sorted((tuple(r) for r in url_filter(df, rule_table(spark, table)).collect()), key=repr) == expected
    assert url_filter(df.limit(0), rule_table(spark, URL_RULES)).count() == 0


def test_escape_is_reversible():
    rng = random.Random(1)
    parts = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "|", "role", "<|end|>", "\n", "é"]
    for _ in range(3000):
        a, b = ("".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(2))
        assert chat.unescape(chat.escape(a)) == a and "<|" not in chat.escape(a) and "</s>" not in chat.escape(a) and "[INST]" not in chat.escape(a)
        assert chat.parse("".join(chat.segments(a, b) + chat.segments(b, a))) == [(a, b), (b, a)]


def conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"shared {t}" if t < 2 else f"own {c} {t}") for c in range(40) for t in range(2 + c % 5)]
    rows += [(50, 0, None, None), (50, None, "user", "before"), (50, 1, "assistant", "</s>[INST] ok [/INST] <|end|> \\"), (51, 0, "user", "x"), (51, 0, "user", "x"), (None, 0, "assistant", "no id"), (52, 0, "user", "y " * 30_000)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"leaf": F.lit(1), "pack": F.lit(2), "nodes": F.lit("z")})


def digest(turns):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    learnt = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), sum(len("".join(chat.segments(r, t))) for r, t in turns)


def test_chat_reads_back(spark):
    rows, df = conversations(spark)
    turns = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    out = chat.chat_digest(df, BPE).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in out} == {c: digest(t) for c, t in turns.items()}
    assert chat.chat_digest(df.limit(0), BPE).count() == 0


def test_chat_reads_sequences_in_small_parts(spark, monkeypatch):
    """Sequences are large rows: a row group holds some MB of them, however many there are."""
    monkeypatch.setattr(common, "ROW_GROUP", 20_000)
    rows = [(c, 0, "user", f"{c} " + " ".join(str((c * 7919 + i * i) % 10_007) for i in range(2_000))) for c in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs, _ = chat.chat_tree(df.coalesce(1), BPE, 1)
    files = [pq.ParquetFile(f).metadata for f in Path(packs.scratch_path.removeprefix("file:")).glob("*.parquet")]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == packs.count() > 20 and max(groups) <= 2
    assert {r["conv_id"]: r["turns_sha256"] for r in chat.chat_digest(df, BPE).collect()} == {c: digest([("user", t)])[1] for c, _, _, t in rows}


@pytest.mark.parametrize("paths", [256, 4])
def test_chat_tree_shares_tokens(spark, paths):
    _, df = conversations(spark)
    packs, _ = chat.chat_tree(df.filter("conv_id < 40"), BPE, paths)
    for p in packs.collect():
        nodes = {n["node"]: n for n in p["nodes"]}
        assert len(nodes) == len(p["nodes"])
        for n in nodes.values():
            at = [i for s in n["attends"] for i in range(s["s"], s["e"])]
            assert [p["positions"][i] for i in at] == list(range(n["first_position"]))
            assert p["positions"][n["start"] : n["end"]] == list(range(n["first_position"], n["first_position"] + n["end"] - n["start"]))
    if paths == 256:
        assert packs.count() == 1


def test_pipeline(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = []
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{len(ids)}")
        docs = spark.read.parquet(path)
        ids.append({r["doc_id"] for r in docs.collect()})
    assert ids[0] >= ids[1] == ids[2] == ids[3]
    whole = {r["doc_id"] for r in cp.run(spark, SF).collect()}
    assert whole == ids[3]


@pytest.mark.parametrize("n", range(5))
def test_stages_take_empty_tables_and_edges(spark, n):
    import corpus_pipeline as cp

    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "plain words of a short text", "en", "a", 27), (3, "plain words of a short text", "en", "a", 27), (None, "no id here", "en", "a", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(1))
    out = cp.STAGES[n][1](spark, df, SF)
    assert out.count() > 0 and cp.STAGES[n][1](spark, df.limit(0), SF).count() == 0
