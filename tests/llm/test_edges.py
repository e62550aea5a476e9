"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import hashlib
import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernel.llm import language, line_dedup, mixing, packing, quality, secret_scan, simhash, similar, token_counts, topk, warc_index

LONG = "the quick brown fox of the hill and " * 2500
LINE = "A line that many documents hold, word by word"
TEXTS = [
    (1, f"{LINE}\nown one", "en", "b", 1), (
        2, f"  {LINE.upper()}\t\nown two is the other", "en", "a", 2,
    ), (3, f"x\n{LINE}\n{LINE}", "de", "a", 3), (3, f"x\n{LINE}\n{LINE}", "de", "a", 3),
    (4, None, "en", "a", 4), (5, "", None, "a", None), (6, LONG, "en", None, 6), (None, LINE, "en", "c", 7), (7, "üé 漢字 \x0b\x0c tail\n", "de", "b", 8), (8, "<|endoftext|> password = 'abcdef123'", None, None, 9), (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASH = "n_lines n_dropped lines id row fp component_id size target taken n_words kept n_tokens start length rid base h1 shard u copies record_type payload".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(spark):
    return pd.DataFrame(TEXTS, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})


def test_quality(spark, docs, none, same):
    same(quality.score_quality(docs), quality.SQL, tables={"documents": plain(spark)})
    assert quality.score_quality(none).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_repeated_words_by_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (7, 8, 9, 16, 40, 200)] + ["a " * 50, " ".join(map(str, range(60)))]

    def brute(words):
        seen, hit = {}, set()
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                hit |= {p for i in at for p in range(i, i + 8)}
        return len(hit)

    df = quality.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.n_repeat_words for r in df.collect()} == {i: brute(t.split()) for i, t in enumerate(texts)}


#: One broadcast, a group of shards after the other, the join.
WAYS = [{}, {"broadcast_bytes": 1, "passes": 1000}, {"broadcast_bytes": 1, "passes": 0}]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("way", WAYS)
def test_line_dedup(spark, docs, none, same, way):
    out = line_dedup.dedup_lines(docs, **way)
    digest = out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    same(digest, line_dedup.SQL, tables={"documents": plain(spark)})
    assert out.columns == [c for c in docs.columns if c != "lines"] + ["lines"]
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[1] == "own one" and kept[3] == f"x\n{LINE}\n{LINE}" and kept[4] is None
    assert line_dedup.dedup_lines(none, **way).count() == 0
    own = line_dedup.drop_lines(docs, **way)
    assert own.columns == docs.columns and {r.lines for r in own.collect()} == {"own lines"}


@pytest.mark.parametrize("way", WAYS)
def test_line_dedup_of_many_lines(spark, sf, same, way):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    out = line_dedup.dedup_lines(table, **way)
    same(out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")), line_dedup.SQL)
    if way.get("passes") != 0:
        assert exchanges(out) == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 50_000, np.uint64))
    made = line_dedup.PerfectHash(keys)
    assert sorted(made(keys).tolist()) == list(range(len(keys)))
    one = line_dedup.Shard(np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.uint64), np.array([3, 4, 5]), np.array([10, 20, 30]))
    found, last = one.keeper(np.array([5, 5, 5, 9, 9], np.uint64), np.array([1, 2, 3, 3, 4], np.uint64))
    assert found.tolist() == [True, True, False, True, False] and last[found].tolist() == [10, 20, 30]


def brute_fingerprint(text, n):
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t[1], 4) for t in TEXTS]
    groups = brute_components(fps, 4)
    want = []
    for i, t in enumerate(TEXTS):
        ids = [TEXTS[j][0] for j in range(len(TEXTS)) if groups[j] == groups[i] and TEXTS[j][0] is not None]
        want.append((t[0], fps[i], min(ids, default=None)))
    assert sorted(((r.id, r.fp % 2**64, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(none).count() == 0
    kept = similar.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 6, 7, 8]


def test_links_of_chains_and_clusters(spark):
    rng = np.random.default_rng(3)
    fps = list(rng.integers(0, 2**64, 300, np.uint64).tolist())
    chain = [fps[0]]
    for step in range(12):  # each four bits from the last
        x = chain[-1]
        for b in range(4):
            x ^= 1 << (4 * step + b + (16 if step > 10 else 0)) % 64
        chain.append(x)
    cluster = [fps[1] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]  # larger than a small bucket
    fps = list(dict.fromkeys(fps + chain + cluster))
    frame = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "i long, fp long")
    from quernel.llm.components import components

    roots = {r.node % 2**64: r.root for r in components(simhash.links(frame.select("fp"))).collect()}
    groups = brute_components(fps, 4)
    names = [roots.get(x, ("alone", x)) for x in fps]
    assert len({*zip(groups, names, strict=True)}) == len(set(groups)) == len(set(names))


def test_secrets(spark, docs, none, same):
    more = [
        (20, "api_key: Tok=abc AKIA" + "Q" * 16 + " and " + "0123456789abcdef" * 2, "en", "a", 0), (21, "SECRET = zz9-longer 漢 " + "Ab1" * 9, "en", "b", 0),
        (22, "token=" + "t" * 30 + " " + "Xy7" * 8, "en", "b", 0), (23, "token=" + "t" * 30 + " " + "Xy7" * 8, "en", "c", 0),
        (24, "token = a1; " * 700 + "passwd:hunter22", "en", "c", 0),
    ]
    df = docs.select(*plain(spark).columns).unionByName(spark.createDataFrame(more, SCHEMA))
    frame = pd.concat([plain(spark), pd.DataFrame(more, columns=plain(spark).columns)]).astype({"doc_id": "Int64"})
    out = secret_scan.find_secrets(df)
    same(
        out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_live", "n_shared"), secret_scan.SQL,
        tables={"documents": frame},
    )
    r = {x.doc_id: x for x in out.collect()}
    assert "owned:" in r[21].spans and "owned" not in r[22].spans and (r[21].n_live, r[22].n_shared) == (1, 1) and r[24].n_assign == 1
    assert secret_scan.find_secrets(none).count() == 0 and secret_scan.find_secrets(docs).count() == len(TEXTS)


def test_mixing(spark, docs, none):
    out = mixing.mix_sources(docs).collect()
    sizes = [(t[0], len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t[1] or "")), t[3]) for t in TEXTS]
    assert sorted(((r.id, r.size, r.source) for r in out), key=repr) == sorted(sizes, key=repr)
    assert all(r.taken == r.copies * r.size <= 2 * r.size for r in out) and len({(r.target) for r in out if r.source == "a"}) == 1
    assert mixing.mix_sources(none).count() == 0
    assert mixing.take_mix(docs).columns == docs.columns


def test_mixing_targets_and_reruns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 60)), f"s{i % 7}" if i % 3 else "hot") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(df).toPandas()
    by = out.groupby("source").agg(size=("size", "sum"), target=("target", "first"), source_size=("source_size", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.source_size).all() and abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 * by["size"].sum()
    assert (abs(by.taken - by.target) <= 60).all() and (out.taken <= 2 * out["size"]).all() and (by.target <= 2 * by["size"] + 1e-6).all()
    weights, left, want = dict(zip(sorted(by.index), (5, 2, 1) * 3, strict=False)), 1.5 * by["size"].sum(), {}
    while True:  # deal by weight, cut, deal the excess again
        free = [s for s in by.index if s not in want]
        share = {s: (left - sum(want.values())) * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s: 2.0 * by["size"][s] for s in free if share[s] > 2 * by["size"][s]}
        if not over:
            want |= share
            break
        want |= over
    assert all(abs(by.target[s] - want[s]) < 1e-6 * want[s] for s in want)
    again = mixing.mix_sources(df.repartition(7)).toPandas()
    assert out.sort_values("id").taken.tolist() == again.sort_values("id").taken.tolist()
    mean = out[out.source == "hot"]
    assert abs(mean.copies.mean() - (mean.target / mean.source_size).iloc[0]) < 0.05


def _ids():
    from tokenizers import Tokenizer

    from quernel.llm.tokens import vocabulary

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_token_counts(spark, docs, none):
    ids = _ids()
    want = [(t[0], len((t[1] or "").encode()), len(ids(t[1])), len(ids(t[1])) > 1024) for t in TEXTS]
    assert sorted((tuple(r) for r in token_counts.count_tokens(docs).collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(none).count() == 0
    import sentencepiece

    from quernel.llm.tokens import vocabulary

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = token_counts.count_tokens(docs.where("doc_id < 6"), model="piece_bpe_32k.model").collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((t[0], len(sp.encode(t[1] or ""))) for t in TEXTS if t[0] and t[0] < 6)


def test_units_encode_as_the_whole(spark):
    import random

    from quernel.llm.tokens import Encoder, vocabulary

    random.seed(4)
    enc, ids = Encoder(vocabulary("byte_bpe_50k.json")), _ids()
    alphabet = "ab Z9',.'s \n\t\r\x0b\x1c\x1f\x85\xa0 　é漢²!-_"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 25))) for _ in range(4000)] + ["a<|endoftext|>b", "don't. we'll, x", " ", "\n\n"]
    assert [x.tolist() for x in enc.token_ids(texts)] == [ids(t) for t in texts]
    assert enc.token_counts(texts, {" the": 1}) == [len(ids(t)) for t in texts]


def test_pieces_encode_as_the_whole():
    """Ids by pieces are the library's, whatever characters meet; a piece is remembered once, whatever stands beside it."""
    import random

    import pyarrow as pa

    from quernel.llm.tokens import Encoder, vocabulary

    enc, ids = Encoder(vocabulary("byte_bpe_50k.json")), _ids()
    enc.token_ids(["a word, (word) word7 word. it's", " word\n\nword"])
    assert set(enc.ids) == {b"a", b" word", b",", b" (", b"word", b")", b"7", b".", b" it", b"'s", b"\n", b" word"}

    rng = random.Random(7)
    parts = [*"aZé×÷ÿñ²µ漢ñ7٣.,!?-_'’\x00\x1c\x7f \n\t\r\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b\u0301😀", "\u1e80", "'s", "'ll", "'RE", " '", "  ", "\n\n", " \n", "word", "x" * 70, "<|endoftext|>"]
    texts = [*parts, *(a + b + c for a in parts for b in parts for c in parts)]
    texts += ["".join(rng.choices(parts[:-1], k=rng.randint(0, 30))) for _ in range(5000)]
    rng.shuffle(texts)
    want = [ids(t) for t in texts]
    for most in (900_000, 50):
        assert [x.tolist() for x in enc.token_ids(texts, most)] == want
        assert len(enc.ids) <= most and all(len(k) <= 64 for k in enc.ids)
    for a in range(0, 2000, 97):  # what is remembered from one call to the next, and forgotten
        assert [x.tolist() for x in enc.token_ids(texts[a : a + 97], 300)] == want[a : a + 97]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array([None, *texts[:50], None, ""], kind)
        assert [x.tolist() for x in enc.token_ids(column.slice(0, 40))] == [[], *want[:39]]
        assert [x.tolist() for x in enc.token_ids(column.slice(40))] == [*want[39:50], [], []]
    assert enc.token_ids([]) == [] and [len(x) for x in enc.token_ids(["", ""])] == [0, 0]


def test_parts_of_a_batch(monkeypatch):
    """Short texts are encoded together, long ones alone, none is left out."""
    import pyarrow as pa

    monkeypatch.setattr(packing, "_BYTES", 10)
    texts = ["abc", None, "", "abcd", "é" * 20, "x", "y" * 9, "z" * 10, None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(9)), "text": texts})
    parts = [p.column("id").to_pylist() for p in packing._parts(batch)]
    assert sum(parts, []) == list(range(9)) and [0, 1, 2, 3] in parts
    assert all(sum(len((texts[i] or "").encode()) for i in p[1:]) < 10 for p in parts)
    assert [p.num_rows for p in packing._parts(batch.slice(0, 0))] == [0]
    assert sum((p.column("id").to_pylist() for p in packing._parts(batch.slice(4, 2))), []) == [4, 5]


def check_packing(rows, texts):
    ids = _ids()
    pieces = pd.DataFrame([r.asDict() for r in rows])
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() == g.tier.iloc[0] <= 2048
    for doc, text in texts.items():
        want, g, at = np.array([*ids(text), 1], "<u4"), pieces[pieces.doc_id == doc].sort_values("start"), 0
        for r in g.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes()) and r.doc_tokens == len(want)
            at += r.length
        assert at == len(want)
    assert (np.log2(pieces.groupby("sequence_id").length.sum()) % 1 == 0).all()  # nothing is padded
    return pieces


def test_packing(spark, docs, none, sf):
    rows = packing.pack_documents(docs).collect()
    check_packing(rows, {t[0]: t[1] for t in TEXTS if t[0] is not None and t[0] != 3})
    assert sum(r.length for r in rows if r.doc_id == 3) == 2 * (len(_ids()(TEXTS[2][1])) + 1)
    assert packing.pack_documents(none).count() == 0
    table = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = check_packing(packing.pack_documents(table).collect(), {r.doc_id: r.text for r in table.collect()})
    assert pieces.groupby("step_group").tier.nunique().max() == 1


def test_step_groups_are_equal_over_all_tasks(spark, sf):
    """Of each length one group at most falls short, in however many tasks the pieces were made."""
    table = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    rows = packing.pack_documents(table, step_tokens=16 * 2048)
    pieces = check_packing(rows.collect(), {r.doc_id: r.text for r in table.collect()})
    assert pieces.step_group.notna().all() and pieces.sequence_id.map(lambda x: x >> 40).nunique() > 1
    tokens = pieces.groupby("step_group").agg(tier=("tier", "first"), tiers=("tier", "nunique"), tokens=("length", "sum"))
    assert (tokens.tiers == 1).all() and tokens.tokens.max() == 16 * 2048 and (tokens[tokens.tokens < 16 * 2048].groupby("tier").size() == 1).all()


def test_language(spark, docs, none, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    trees = language.learn(table)
    out = language.identify(table, trees).join(table.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()
    edge = {r.doc_id: r for r in language.identify(docs, trees).collect()}
    assert (edge[4].lang_pred, edge[5].lang_pred, edge[6].lang_pred) == ("und", "und", "en")
    assert language.identify(none, trees).count() == 0 and language.learn(none).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.learn(none)).collect()} == {"und"}
    # A shard for each language gives the same.
    assert len(language.shards(trees)) == 1 and len(language.shards(trees, 1)) == trees.count() > 1
    sharded = language.identify(table, trees, broadcast_bytes=1).toPandas().set_index("doc_id")
    assert (sharded.lang_pred == out.set_index("doc_id").lang_pred[sharded.index]).all()


def _counts(texts, order):
    codes = np.concatenate([language.grams(np.frombuffer(b"\n" * order + t, np.uint8), order) for t in texts])
    return [x.astype(t) for x, t in zip(np.unique(codes, return_counts=True), (np.uint64, np.float64), strict=True)]


@pytest.mark.parametrize("order", [1, 4, 7])
def test_code_lengths_by_brute_force(order):
    """All bytes and all contexts count: one language uses every byte, far more than a hundred symbols."""
    rng = np.random.default_rng(8)
    texts = {
        "x": [bytes(rng.choice(list(b"abcd "), 300).tolist()) for _ in range(3)], "y": [bytes(rng.integers(0, 256, 400).tolist()) for _ in range(3)],
        "z": ["\u043f\u0440\u0438\u0432\u0435\u0442 \u4f60\u597d ".encode() * 9, bytes(range(256)) * 2],
    }
    model = language.Model([*texts], [language.Tree(*_counts(v, order), order) for v in texts.values()])

    def probability(lang, context, symbol):
        n = {}
        for t in texts[lang]:
            s = b"\n" * order + t
            for i in range(order, len(s)):
                if s[i - len(context) : i] == context:
                    n[s[i]] = n.get(s[i], 0) + 1
        lower = (lambda c: probability(lang, context[1:], c)) if context else (lambda c: 1 / 256)
        if not n:
            return lower(symbol)
        if len(n) == 256:
            return n[symbol] / sum(n.values())
        if symbol in n:
            return n[symbol] / (sum(n.values()) + len(n))
        return len(n) / (sum(n.values()) + len(n)) * lower(symbol) / (1 - sum(lower(c) for c in n))

    text = b"abca d\xd0\xbf\xff\nz"
    padded = b"\n" * order + text
    want = [-sum(math.log2(probability(lang, padded[i - order : i], padded[i])) for i in range(order, len(padded))) for lang in texts]
    assert np.allclose(model.bits([text])[0], want, rtol=1e-6)
    one = model.bits([b"ab" * 40_000, text, b"", b"q"])
    assert np.allclose(one[1], want, rtol=1e-6) and not one[2].any()
    language_block, language._BLOCK = language._BLOCK, 1000
    try:
        assert np.allclose(model.bits([b"ab" * 40_000])[0], one[0])
    finally:
        language._BLOCK = language_block


def test_languages_of_other_scripts(spark):
    """Languages that share a script, and scripts of many bytes, are told apart by texts not learned from."""
    rng = np.random.default_rng(9)
    letters = {
        "ru": "\u0430\u0431\u0432\u0433\u0434\u0435\u0436", "uk": "\u0430\u0431\u0432\u0433\u0454\u0457\u0456",
        "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 400))), "el": "\u03b1\u03b2\u03b3\u03b4\u03b5", "en": "abcdefgh",
        "th": "".join(map(chr, range(0x0E01, 0x0E2F))),
    }
    word = lambda x: "".join(rng.choice(list(letters[x]), rng.integers(2, 7)))
    words = {x: [word(x) for _ in range(200)] for x in letters}
    rows = [(i, " ".join(rng.choice(words[x], 40)), x) for i in range(480) for x in [[*letters][i % len(letters)]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.identify(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 60 and (held.lang == held.lang_pred).all()


def test_top_k(spark, same):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(130)]
    rows += [
        (200, rows[20][1]), (201, rows[20][1]), (220, None), (240, []), (260, [float("nan")] + [0.0] * 7), (280, [None] + [0.0] * 7), (None, rows[0][1]),
        (300, [0.5, 0.25]), (301, [1.0, -1.0]), (40, rows[40][1]), (320, [3e38] * 8), (7, rows[7][1]),
    ]
    frame = pd.DataFrame(rows[:132], columns=["vec_id", "embedding"])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("own") for c in ("id", "v", "dim", "cb", "rank", "score")})
    fine = df.where(F.col("vec_id").isin(*map(int, frame.vec_id))).dropDuplicates(["vec_id"])
    for values in (1 << 20, 8 * 13):
        same(topk.top_k(fine, fine.where("vec_id % 20 = 0"), block_values=values), topk.SQL, tables={"embeddings": frame})
    out = topk.top_k(df, df.where("vec_id % 20 = 0"), block_values=240).toPandas()
    assert set(out[out.query_id == 300].vec_id) == {301} and not ({220, 240, 260, 280} & {*out.query_id, *out.vec_id})
    assert out.groupby(["query_id", "rank"]).size().max() == 1
    # The very long vectors cost no query its results.
    assert set(out[out.query_id != 300].groupby("query_id").size()) == {20} and {*range(0, 121, 20), 200, 320} <= {*out.query_id}
    none = df.limit(0)
    assert topk.top_k(none, none).count() == 0


def brute_top(ids, vectors, queries, k=20):
    whole = [[math.floor(64 * float(x)) for x in v] for v in vectors]
    out = []
    for i in queries:
        scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[i], w, strict=True)))), ids[j]) for j, w in enumerate(whole) if j != i]
        out += [(ids[i], c, -s) for s, c in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("lengths", [(1e4,), (1e9,), (1e37, 1e38), (1e160,), (1e160, 1e200), (1e300, -1e300)])
@pytest.mark.parametrize("near", [False, True])
def test_pivot_bounds_lose_nothing(lengths, near):
    """Vectors of all lengths beside each other; ``near`` ones lie in tight clusters, where bounds prune."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(0, 0.3, (12, 16))[rng.integers(0, 12, 900)] * 20 + rng.normal(0, 0.05, (900, 16)) if near else rng.normal(0, 0.3, (900, 16))
    for j, x in enumerate(lengths):
        vectors[17 * (j + 1)] = x
        vectors[20 * (j + 1)] = x * rng.normal(0, 1, 16)
    vectors[40:44], vectors[60] = vectors[39], 0
    ids, queries = np.arange(900), np.arange(0, 900, 60)
    table = topk.PivotTable(ids, topk._floored(vectors))
    got = list(table.search(ids[queries], topk._floored(vectors[queries])))
    assert sorted(got, key=lambda x: (x[0], -x[2], x[1])) == brute_top(ids.tolist(), vectors.tolist(), queries.tolist())


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 80
    pages = [
        (1, "http://WWW.b.org/x?q=1", big), (2, "https://a.org:8080", big), (3, None, None), (4, "http://a.org/\r\nz", ""), (5, "http://a.org/", "small"),
        (6, "http://a.org/", "small"), (7, "x", big + "!"), (7, "x", big + "!"), (None, "http://a.org/", big), (8, "http://[bad", "y"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("digest", "size", "payload", "captured_at", "last", "n")}).repartition(3)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)))
    path = f"file://{tmp_path}/warc"
    rows = warc_index.archive_and_index(df, at, path=path).orderBy("capture_seq").collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)
    want = []
    for i, _, html in pages:
        body = (html or "").encode()
        to = {big: 2, big + "!": 7}.get(html) if html else None
        to = None if to == i else to
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=repr)
    keys = [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0) for r in rows]
    assert keys == sorted(keys)
    payloads = {r.page_id: bytes(r.payload).decode() for r in warc_index.read_runs(spark, path, with_payload=True).where("payload IS NOT NULL").collect()}
    assert payloads[2] == big and payloads[5] == "small" and payloads[3] == ""
    empty = warc_index.archive_and_index(df.limit(0), at)
    assert empty.count() == 0


def test_archives_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    """Pages of 20 MB, a digest and a missing id with a third of all pages each: no archive gathers them."""
    monkeypatch.setattr(warc_index, "FILE_BYTES", 8 << 20)
    large = "".join(map(str, range(3_200_000)))[: 20 << 20]
    rows = [(i, "http://a.org/", large[i:]) for i in range(4)] + [(i, "http://a.org/x", large[: 1 << 19]) for i in range(4, 64)] + [(None, "http://b.org/", large[9 : 1 << 19])] * 60
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    out = warc_index.archive_and_index(df, F.timestamp_seconds(F.lit(1_700_000_000)), path=path).toPandas()
    assert len(out) == 124 and (out.record_type == "revisit").sum() == 59 and set(out[out.record_type == "revisit"].refers_to) == {63}
    sizes = warc_index.read_runs(spark, path).groupBy("run").agg(F.sum(F.when(F.col("record_type") == "response", F.col("payload_bytes"))).alias("n")).toPandas()
    assert len(sizes) >= 12 and sizes.n.max() < 60 << 20
    assert out.sort_values("capture_seq")[["url_key", "captured_at"]].apply(tuple, axis=1).is_monotonic_increasing


def test_ranges_of_runs(spark):
    """Many small ranges, ties without an id among them, come out in one order."""
    rng = np.random.default_rng(3)
    rows = sorted((int(r), f"k{x}", f"t{x % 3}", None if x % 4 == 0 else int(x)) for r, x in zip(rng.integers(0, 7, 3000), rng.integers(0, 40, 3000), strict=True))
    runs = spark.createDataFrame([(r, at, k, t, i, "u", "response", None, 1, "d", None) for at, (r, k, t, i) in enumerate(rows)], warc_index.RUN_SCHEMA)
    out = warc_index.merge_runs(runs, range_rows=100).orderBy("capture_seq").collect()
    key = lambda r: (r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0)
    assert len({r.capture_seq for r in out}) == 3000 and sorted(r.at for r in out) == list(range(3000))
    assert [key(r) for r in out] == sorted(map(key, out))


def test_loser_tree():
    rng = np.random.default_rng(0)
    for k in range(0, 9):
        runs = [sorted((int(x), i) for x in rng.integers(0, 30, rng.integers(0, 12))) for i in range(k)]
        merged = [x for x, _ in warc_index.LoserTree([[((x,), i) for x, i in r] for r in runs])]
        assert [x[0] for x in merged] == sorted(x for r in runs for x, _ in r)
