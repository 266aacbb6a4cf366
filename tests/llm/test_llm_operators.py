"""Operators of the training-data part on small tables: brute force, round trips, held-out accuracy, odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from skyquilt.llm import (
    contamination, language_model, line_frequency, mixing, near_duplicates, perfect_hash, quality, shingles, token_files, toxicity, url_filter, vantage,
)
from skyquilt.llm.queries import ORACLES, QUERIES
from skyquilt.llm.text import folded, words

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def odd(spark, *more):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, an extra column with a name used inside."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", None, 3), (3, long, "de", "a", None),
            (4, "one two three four five six", "en", "a", 27), (4, "one two three four five six", "en", "a", 27), (None, "x\ny", "en", "b", 3), *more]
    return spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit("mine"), "copy": F.lit("mine"), "digest": F.lit("mine"), "n": F.lit("mine")})


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    _, rows, error = oracle.compare(spark, SF, QUERIES[name], ORACLES[name], oracle.connect(SF))
    assert error is None and rows > 0


# 1
def test_url_parts_and_longest_rule(spark):
    urls = ["http://A.Example.NET/en/x?y#z", "https://example.net/fr/", "http://net/", "http://net", "no scheme/en/", None, "http://x.example.com?/de/",
            "http://example.com/de/1", "http://notexample.com/de/", "http://b.org/fr/", "a://b://c/d", "http://h\n.net/a\nb?c"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({
        "host": url_filter.host(F.col("url")), "path": url_filter.path(F.col("url"))})
    got = df.select("*", url_filter.best_rule(F.col("host"), F.col("path"), url_filter.RULES).alias("best")).orderBy("page_id").collect()
    for r in got:
        host = path = ""
        if r.url is not None and "://" in r.url:
            rest = r.url.split("://", 1)[1]
            cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
            host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
            path = rest[:min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
        assert (r.host, r.path) == (host, path)
        fits = [k for k in url_filter.RULES
                if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith(k[k.index("/"):])]
        want = max(fits, key=len) if fits else None
        assert (r.best and r.best.rule) == want


def test_trees_learn_lexical_labels(spark):
    rows = [(f"http://h{i % 9}.{'spam' if i % 2 else 'good'}.example.com/{'1234567/8901' if i % 2 else 'page'}", float(i % 2)) for i in range(300)]
    made = url_filter.train(spark.createDataFrame([*rows, (None, None), (None, 0.0)], "url string, blocked double"))
    fresh = spark.createDataFrame([(1, "http://n.spam.example.com/7654321/1098", "mine"), (2, "http://n.good.example.com/page", "mine"), (3, None, "mine")],
                                  "page_id long, url string, features string")
    assert [r.verdict for r in url_filter.judge(fresh, {}, made).orderBy("page_id").collect()][:2] == ["block", "allow"]
    none = url_filter.train(spark.createDataFrame([], "url string, blocked double"))
    assert {r.verdict for r in url_filter.judge(fresh, {}, none).collect()} == {"allow"}
    assert url_filter.judge(fresh.limit(0), url_filter.RULES, made).count() == 0


# 2
def test_perfect_hash_is_minimal():
    keys = perfect_hash.mix(np.arange(5_000, dtype=np.uint64))
    find = perfect_hash.Lookup(*perfect_hash.build(keys))
    assert sorted(find.slots(keys)) == list(range(5_000))
    with pytest.raises(ValueError):
        perfect_hash.build(np.array([3, 3], np.uint64))


def test_words_are_encoded_as_by_the_library(documents):
    enc = token_files.Encoder(token_files.public_vocabulary())
    texts = [*list(documents.values())[:150], "", " a", "a ", "a  b", "a\n b", "don't , x., éa ßö. <|endoftext|> 日本 \u00a0 z", "a.\nb c\t d", "x," * 50]
    for t in texts:
        want = enc.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == want


def test_letters_are_encoded_once_in_any_company():
    enc, asked = token_files.Encoder(token_files.public_vocabulary()), Counter()
    made = enc._made
    enc._made = lambda piece: asked.update([piece]) or made(piece)
    signs = ("", "!!", ".", ",", "###", "'", ".\nRest", "\nRest", "!!\nRest.\nEnd")
    text = "start " + " ".join(f"{word}{s}" for word in ("thonre", "gechö", "ÈAT") for s in signs)
    assert enc.encode(text) == enc._whole(text)
    assert {" thonre", " gechö", " ÈAT", "Rest", "!!"} <= set(asked) and max(asked.values()) == 1
    assert not any("\n" in word for word in enc)


def test_added_tokens_are_encoded_as_by_a_fresh_library(spark):
    from tokenizers import Tokenizer

    path = token_files.public_vocabulary()
    fresh, enc = Tokenizer.from_file(path), token_files.Encoder(path)
    texts = ["end of page <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>b, c", "x <|endoftext|>", "<|endoftext|> <|endoftext|> the end.", "<|endoftext", "plain text, no more."]
    want = {t: fresh.encode(t, add_special_tokens=False).ids for t in texts}
    for t in texts:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == want[t]
    assert want[texts[0]] == [437, 286, 2443, 220, 50256, 1306]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.digests(token_files.write(docs, path)).collect()}
    start = 0
    for k, t in enumerate(texts):
        ids = [*want[t], token_files.END]
        assert got[k] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_CHARS", 16)
    docs = odd(spark, *[(9, "same words", None, None, None)] * 5)
    made = token_files.write(docs, token_files.public_vocabulary())
    got = sorted((tuple(r) for r in token_files.digests(made).select("doc_id", "repeat", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[2])
    assert token_files.digests(made).columns == ["doc_id", "start", "n_tokens", "ids_crc32", "repeat"]
    enc = token_files.Encoder(token_files.public_vocabulary())
    assert [r[0] for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda d: (d is not None, d))
    assert [r[2] for r in got] == [sum(x[3] for x in got[:i]) for i in range(len(got))]
    want = Counter()
    for r in docs.collect():
        ids = [*enc.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r[0], r[3], r[4]) for r in got) == want
    assert [r[1] for r in got if r[0] == 9] == [0, 1, 2, 3, 4]
    keys = spark.createDataFrame([(9, 4), (9, 5), (77, 0), (None, 0)], "doc_id long, repeat long")
    assert [(r.doc_id, r.repeat) for r in made.lookup(keys).collect()] == [(9, 4)]
    assert token_files.digests(token_files.write(docs.limit(0), token_files.public_vocabulary())).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library_on_any_text(name):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(1)
    kinds = ["a", "B", "é", "ÿ", "×", "÷", "\n", "\n", " ", " ", "'", "'s", "'ll", "'S", "1", "23", ".", ",", "!?", "ß", "_", "\t", "\x00", "中", "\u00a0", "<|", "it"]
    path = public_tokenizers.path(name)
    enc, plain = token_files.Encoder(path), Tokenizer.from_file(path)
    for _ in range(6_000):
        text = "".join(rng.choice(kinds) for _ in range(rng.randint(1, 30)))
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids, text


# 3
def test_site_posteriors(spark):
    got = QUERIES["op3_site_posteriors"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    right = got.join(labels, "doc_id").agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.95 and got.count() == 1000
    odd_rows = quality.assess(odd(spark), labels.limit(0), F.col("source"), F.col("lang"))
    assert odd_rows.count() == 7
    assert quality.assess(odd(spark).limit(0), labels, F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_shrink(spark):
    groups = spark.createDataFrame([(100.0, 90.0), (100.0, 10.0), (2.0, 2.0)], "n double, good double")
    apart = quality._strength(groups, F.lit(0.5))
    alike = quality._strength(spark.createDataFrame([(100.0, 50.0), (100.0, 51.0), (2.0, 1.0)], "n double, good double"), F.lit(0.5))
    assert apart < 5 and alike == quality.HIGH


# 4
def _pitman_yor_by_hand(model, docs):
    """Probabilities of all words in all contexts from the words' totals of each sweep, and the texts' scores."""
    trained = [[*words(r.text), language_model.END] for r in docs if not r.held_out]
    pairs = Counter((u, w) for ws in trained for u, w in zip([language_model.END, *ws[:-1]], ws, strict=True))
    counts = Counter(w for ws in trained for w in ws)
    kinds = sorted(counts)
    facts = {}
    for r in model.words.collect():
        h = np.frombuffer(r.a, "<u8")
        n, past = language_model._get(r.b, "<u8"), language_model._get(r.d, "<u8").astype(np.int64).reshape(-1, 3, len(h))
        facts |= {int(x): (int(n[i]), past[:, :, i]) for i, x in enumerate(h)}
    hashes = np.array([language_model.number(w) for w in kinds], np.uint64)
    assert {int(h) for h in hashes} == set(facts) and all(facts[int(h)][0] == counts[w] for h, w in zip(hashes, kinds, strict=True))
    past = np.stack([facts[int(h)][1] for h in hashes], 2)  # sweep, kind of total, word
    n, at = np.array([counts[w] for w in kinds]), {w: i for i, w in enumerate(kinds)}
    size = len(kinds)
    u, w = np.repeat(np.arange(size), size), np.tile(np.arange(size), size)
    c = np.array([pairs[kinds[i], kinds[j]] for i, j in zip(u, w, strict=True)])
    seats = model.totals.replay(c, past[:, 2, u], past[:, 0, w], past[:, 1, w], language_model.pair_key(hashes[u], hashes[w]))
    for k, tables in enumerate(seats):
        assert np.array_equal(np.bincount(u, tables, size), past[k, 2]) and np.array_equal(np.bincount(w, tables, size), past[k, 0])
        assert (tables <= c).all() and (tables[c > 0] > 0).all()
    p = model.totals.chance(c, n[u], seats, past[:, 2, u], past[:, 0, w], past[:, 1, w]).reshape(size, size)
    none = np.zeros((len(past), size), np.int64)
    unknown = model.totals.chance(0, n, none, past[:, 2], none, none)
    new = model.totals.chance(0, 0, none[:, :1], none[:, :1], past[:, 0], past[:, 1])[None] if size else p

    def score(text):
        ws = [*words(text), language_model.END]
        out = 0.0
        for a, b in zip([language_model.END, *ws[:-1]], ws, strict=True):
            if a in at:
                out += math.log10(p[at[a], at[b]] if b in at else unknown[at[a]])
            else:
                out += math.log10(new[0, at[b]] if b in at else model.totals.chance(0, 0, none[:, 0], none[:, 0], none[:, 0], none[:, 0]))
        return out

    return counts, p, unknown, score


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_pitman_yor_equals_sums_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", block)
    monkeypatch.setattr(language_model, "FREQUENT", 6)
    monkeypatch.setattr(language_model, "LEAST_BUCKETS", 3)
    monkeypatch.setattr(language_model, "PART_TOKENS", 50)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"v{int(x)}" for x in rng.zipf(1.5, 30) % 40) for _ in range(60)] + ["v1 v2 " * 400, "Unseen v1 NEVER met", "v1 v2"]
    rows = [(None, None), (0, ""), *enumerate(texts, 10), (10, texts[0])]
    docs = language_model.with_split(spark.createDataFrame(rows, "doc_id long, text string").withColumn("flag", F.lit("mine")).coalesce(2))
    model = language_model.train(docs)
    counts, p, unknown, score = _pitman_yor_by_hand(model, docs.collect())
    assert np.allclose(p.sum(1) + unknown, 1.0) and (p > 0).all()
    total, kinds = sum(counts.values()), len(counts)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in language_model.score(model).collect())
    want = []
    for r in docs.collect():
        ws = [*words(r.text), language_model.END]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        want.append((r.doc_id is None, r.doc_id or 0, r.held_out, len(ws), sum(w in counts for w in ws), total, base, score(r.text)))
    assert [r[:6] for r in got] == [r[:6] for r in sorted(want)]
    assert np.allclose([r[6:] for r in got], [r[6:] for r in sorted(want)], rtol=1e-9)


def test_pitman_yor_beats_the_base_and_takes_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(language_model, "LEAST_BUCKETS", 4)
    docs = language_model.with_split(spark.read.parquet(f"{SF}/documents.parquet").limit(300).unionByName(odd(spark).select("doc_id", "text", "lang", "source", "n_chars")))
    got = language_model.score(language_model.train(docs)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 307 and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_model.score(language_model.train(docs.limit(0))).count() == 0
    alone = language_model.score(language_model.train(docs.limit(3).withColumn("held_out", F.lit(True)))).collect()
    assert len(alone) == 3 and all(r.score == 0 and r.n_known == 0 for r in alone)


def test_seating_in_turn_and_in_groups_follows_the_restaurant():
    rng = np.random.default_rng(2)
    many, discount = 4_000, 0.6

    def one_by_one(count, others, parent):
        tables = 1
        for seated in range(1, count):
            new = (language_model.STRENGTH + discount * (others + tables)) * parent
            tables += rng.random() < new / (new + seated - discount * tables)
        return tables

    for count, others, parent in ((5, 3, 0.2), (60, 40, 0.05), (300, 500, 0.02)):
        key = language_model._mix(np.arange(many, dtype=np.uint64))
        got = language_model.seat(np.full(many, count), np.full(many, others), discount, np.full(many, parent), key)
        want = np.array([one_by_one(count, others, parent) for _ in range(many)])
        assert abs(got.mean() - want.mean()) < 4 * np.hypot(got.std(), want.std()) / many ** 0.5 + 0.03 * want.mean() * (count > 64)
        assert 0.85 < got.std() / want.std() < 1.2
    n, q, key = np.full(50_000, 40), np.full(50_000, 0.7), language_model._mix(np.arange(50_000, dtype=np.uint64))
    drawn = language_model._binomial(n, q, key, 3)
    assert abs(drawn.mean() - 28) < 0.1 and abs(drawn.var() - 8.4) < 0.3
    drawn = language_model._binomial(n * 100, q, key, 3)
    assert abs(drawn.mean() - 2800) < 1 and abs(drawn.var() - 840) < 30


# 5
def test_vantage_trees(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(2000, None), (2001, []), (2002, [0.0] * 8), (2020, [float("nan")] * 8), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("mine"))
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and i < 2000}
    for factor, least in ((1.0, 1.0), (vantage.FACTOR, 0.9)):
        got = defaultdict(list)
        for r in vantage.nearest(df, df.filter("vec_id % 20 = 0"), factor=factor, shard=200).collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        hits = total = 0
        for q in (i for i in x if i % 20 == 0):
            want = sorted(((-float((x[q] * v).sum()), i) for i, v in x.items() if i != q))[:20]
            mine = sorted(got[q])
            assert [r for r, _, _ in mine] == list(range(1, 21))
            assert all(abs(s - float((x[q] * x[i]).sum())) < 1e-12 for _, i, s in mine)
            hits += len({i for _, i in want} & {i for _, i, _ in mine})
            total += 20
        assert hits >= least * total
    assert vantage.nearest(df.limit(0), df).count() == 0
    assert vantage.nearest(df.limit(5), df.limit(1)).count() == 4


def test_vantage_trees_break_ties_by_id_and_search_each_length_apart(spark):
    rows = [(100 + i, [1.0, float(i % 9 - 4), 0.5 * (i % 5)]) for i in range(400)]  # 400 vectors with one inner product
    rows += [(i, [1.0, 0.25 * (i % 3), float(i)]) for i in range(1, 30)] + [(600 + i, [float(i + 1), 1.0]) for i in range(30)] + [(700, [0.0, 1.0, 2.0, 5.0]), (500, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard in (16_384, 100):
        got = vantage.nearest(df, df.filter("vec_id in (500, 600, 700, 601)"), factor=1.0, shard=shard).collect()
        found = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (500, 600, 700, 601)}
        assert found[500] == [(i, 1.0) for i in [*range(1, 21)]] and found[700] == []
        for q in (600, 601):
            me = dict(rows)[q]
            want = sorted((-(me[0] * v[0] + me[1] * v[1]), i) for i, v in rows if len(v) == 2 and i != q)[:20]
            assert found[q] == [(i, -s) for s, i in want]


def test_mixing_by_targets_that_name_no_source_gives_no_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "ab"[i % 2], 6) for i in range(20)] + [(99, "", "en", "c", 0)], DOCS)
    for weights in ([("z", 1.0)], [("a", 0.0), ("b", 0.0)]):
        assert mixing.replicate(docs, spark.createDataFrame(weights, "source string, weight double")).count() == 0
    some = mixing.replicate(docs, spark.createDataFrame([("a", 2.0), ("z", 9.0)], "source string, weight double"))
    assert {r.source for r in some.collect()} == {"a"}


# 6
def test_qgram_decontamination(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_qgram_decontamination"](spark, SF).collect()}
    want = {(d, r.item_id) for r in bench.collect() for d, t in documents.items() if folded(r.text) in folded(t)}
    assert got == want and want
    item = bench.first().text
    near = f"before words {item[:30]}xy{item[31:90]} after words".upper()  # one whole window, edited
    docs = odd(spark, (50, near, None, None, None), (51, item[:35], None, None, None))
    s = contamination.Settings()
    odd_bench = bench.limit(1).unionByName(spark.createDataFrame([(None, None), (8, ""), (9, "short")], "item_id long, text string"))
    hits = contamination.matches(docs, odd_bench, s).collect()
    assert [(r.doc_id, r.item_id) for r in hits] == [(50, bench.first().item_id)] and 0 < hits[0].edits <= s.edits
    assert sorted(r.doc_id or 0 for r in contamination.clean(docs, odd_bench).collect()) == [0, 0, 1, 2, 3, 4, 4, 51]
    assert contamination.clean(docs, odd_bench).columns == docs.columns
    assert contamination.matches(docs, bench.limit(0)).count() == contamination.matches(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("cut", [1, 3, 5])
def test_truncated_starts_name_their_own_text(cut):
    words80 = b"charlie bravo delta echo foxtrot golf hotel india juliet kilo lima mike november"
    index = contamination.Index([(7, words80.decode())], contamination.Settings())
    leak, tail = words80[cut:], words80[:-cut]
    for texts, at in (([leak, b"clean one", b"clean two"], 0), ([b"clean one", leak, b"clean two"], 1), ([b"clean one", b"clean two", leak], 2), ([leak], 0)):
        assert {(d, a, e) for d, _, a, e, _ in index.search(texts)} == {(at, 0, len(leak))}
        got = contamination.matched(index, [(k, t.decode()) for k, t in enumerate(texts)])
        assert got["doc_id"].tolist() == [at] and got["text"].tolist() == [leak.decode()]
    for d, _, a, e, _ in index.search([b"clean one", tail, b"clean two"]):
        assert d == 1 and 0 <= a < e <= len(tail)


def test_short_items_are_found_exactly(spark):
    items = [(1, "What is it?"), (2, "cat"), (3, "the quick brown fox jumps over it all"), (4, "cat"), (5, "a b"), (6, "!?"), (7, "x" * 39), (8, "zz " * 30), (9, "five bytes")]
    texts = ["So, what is it", "concat catalogue", "cat", "dog CAT. cat", "the quick brown fox jumps over it  all", "a  b c", "", None, "x" * 38, "x" * 40, "zz " * 31,
             "the quick brown fox jumped over it all", "no five bytes", "what is", "end a", "b a"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.item_id): (r.first, r["last"]) for r in contamination.matches(docs, bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, p in items:
            p, f = folded(p), folded(t)
            hits = [k for k in range(len(f)) if p and f.startswith(p, k)]
            if len(p) < 10:
                hits = [k for k in hits if (b" " + f + b" ")[k:].startswith(b" " + p + b" ")]
            if hits and i != 8:
                want[d, i] = (hits[0], hits[-1] + len(p))
    assert {k: v for k, v in got.items() if k[1] != 8} == want and {k[0] for k in got if k[1] == 8} == {10}
    only = spark.createDataFrame(items[:1], "item_id long, text string")
    assert [r.doc_id for r in contamination.matches(docs, only).collect()] == [0]
    assert sorted(r.doc_id for r in contamination.clean(docs, only).collect()) == list(range(1, len(texts)))


def test_alignment_equals_full_table():
    rng = np.random.default_rng(5)
    buf = rng.integers(97, 100, 300).astype(np.uint8)
    for _ in range(40):
        start = int(rng.integers(0, 240))
        p = list(buf[start:start + 40])
        for _ in range(int(rng.integers(0, 4))):
            k = int(rng.integers(0, len(p)))
            p[k:k + 1] = [[], [120], [p[k], 121]][int(rng.integers(0, 3))]
        p = np.array(p, np.uint8)
        cost, first, end = contamination.align(buf, p[None, :], np.array([start - 8]), 16)
        row = np.zeros(len(buf) + 1, int)
        for c in p:
            new = [row[0] + 1]
            for j, t in enumerate(buf):
                new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
            row = np.array(new)
        assert cost[0] == row[max(0, start - 8 + len(p)):start + 8 + len(p)].min()
        assert 0 <= first[0] <= end[0] <= len(buf) + 16


# 7
def test_line_frequency(spark):
    rows = [(i, f"menu\nown line {i}\n\nmenu", "en", "a" if i < 8 else None, 0) for i in range(12)]
    got = {r.doc_id: r for r in line_frequency.drop_boilerplate(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[3].text == "own line 3\n" and got[11].n_dropped == 2 and got[0].n_lines == 4
    frame = odd(spark)
    kept = line_frequency.drop_boilerplate(frame).collect()
    assert sorted((r.text or "") for r in kept) == sorted((r.text or "") for r in frame.collect())
    assert line_frequency.drop_boilerplate(frame.limit(0)).count() == 0


# 8
def test_chain_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, toxicity.categories(labels.filter("doc_id % 4 <> 0")), toxicity.CATEGORIES)
    held = toxicity.score(docs, chain).drop("quality").join(labels.filter("doc_id % 4 = 0").select("doc_id", F.col("toxic").alias("truth")), "doc_id")
    right, false = held.agg(F.avg((F.col("toxic") == (F.col("truth") == 1)).cast("double")), F.sum((F.col("toxic") & (F.col("truth") == 0)).cast("int"))).first()
    assert right > 0.9 and false <= 2
    got = toxicity.score(odd(spark).withColumn("p_toxic", F.lit("mine")), chain)
    assert got.count() == 7 and got.filter("toxic").count() == 0
    assert toxicity.score(odd(spark).limit(0), chain).count() == 0
    none = toxicity.train(odd(spark), toxicity.categories(labels.limit(0)), toxicity.CATEGORIES)
    assert toxicity.score(odd(spark), none).count() == 7


def test_later_models_see_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    first = (x[:, 0] > 0).astype(float)
    y = np.stack([first, first], 1)
    weights = toxicity.fit_chain(x, y, np.arange(400) % 5)
    assert [len(w) for w in weights] == [4, 5] and weights[1][3] > 0.5


# 9
def test_poisson_mixing(spark):
    rows = [(i, "a" * 10, "en", "big" if i % 10 else "small", 10) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    chars = {r.source: r.n for r in mixing.replicate(docs).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert all(abs(n - 20_000) < 1_500 for n in chars.values())
    two = mixing.replicate(docs, spark.createDataFrame([("small", 1.0), ("absent", 0.0)], "source string, weight double"))
    assert {r.source for r in two.select("source").distinct().collect()} == {"small"}
    many = mixing.replicate(docs.filter("doc_id < 20"), spark.createDataFrame([("small", 1.0)], "source string, weight double"), epochs=60.0)
    counts = [r["count"] for r in many.groupBy("doc_id").count().collect()]
    assert len(counts) == 2 and all(abs(n - 600) < 150 for n in counts) and many.select("doc_id", "copy").distinct().count() == sum(counts)
    got = mixing.replicate(odd(spark), epochs=0.001)
    assert got.columns == [*[c for c in odd(spark).columns if c != "copy"], "copy", "shuffle_key"]
    twice = [r["count"] for r in got.filter("doc_id = 4").groupBy("copy").count().collect()]
    assert set(twice) <= {2}
    assert mixing.replicate(odd(spark).limit(0)).count() == 0


# 10
def brute_classes(docs):
    sets, links, parent = {}, defaultdict(set), {i: i for i in docs}
    where = defaultdict(list)
    for i, t in docs.items():
        ws = words(t)
        sets[i] = {tuple(ws[k:k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
        for s in sets[i]:
            where[s].append(i)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    both = Counter((a, b) for group in where.values() for k, a in enumerate(group) for b in group[k + 1:])
    for (a, b), n in both.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
            if docs[a] != docs[b]:
                links[a].add(docs[b])
                links[b].add(docs[a])
    return {i: (root(i), len(links[i])) for i in docs}


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    base = [f"w{i}" for i in range(120)]
    rows = {}
    for i in range(60):  # a group of near copies larger than a block, some of them equal
        text = list(base)
        for k in range(i % 5):
            text[(i * 7 + k * 31) % 120] = f"x{i % 20}"
        rows[i] = " ".join(text)
    rows |= {100: "short text", 101: "Short text", 102: "one", 103: "two words here only five six", 104: "a b c d e", 105: "A B c d e"}
    df = spark.createDataFrame([(i, t) for i, t in rows.items()], "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.classes(df).collect()} == brute_classes(rows)


def test_keep_one(spark):
    docs = odd(spark, (7, "one two three four five six", None, None, None))
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == [(0, ""), (0, "x\ny"), (1, ""), (2, " \n\t "), (3, "w0 w1"), (4, "one t")]
    assert near_duplicates.classes(docs.limit(0)).count() == 0


def test_shingle_hashes_follow_words():
    a, b, c, d = shingles.Hasher().sets([b"A b  c\nd e f", b"a b c d e f", b"", b"x y"])
    assert a.tolist() == b.tolist() and (len(a), len(c), len(d)) == (2, 0, 1)


# pipeline
def test_pipeline_stages(spark, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.session.cut(stage(spark, docs, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        seen.append((docs, out))
        docs = out
    ids = [({r[0] for r in a.select("doc_id").collect()}, {r[0] for r in b.select("doc_id").collect()}) for a, b in seen]
    assert all(after <= before for before, after in ids)
    kept = {i: documents[i] for i in ids[1][0]}
    assert ids[1][1] == {c for c, _ in brute_classes(kept).values()}
    bench = [folded(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids[2][1] == {i for i in ids[2][0] if not any(b in folded(documents[i]) for b in bench)}
    assert docs.count() == seen[3][1].count()
    assert {r.doc_id: r.n for r in docs.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()} == {
        r.doc_id: r.n for r in seen[3][1].groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
